import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import dictionary as dc
from quern.operators import regression as rg


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])], [f"y{i}" for i in range(y.shape[1])]
    table = pd.DataFrame(np.column_stack((x, y)), columns=[*names[0], *names[1]]).assign(row_id=np.arange(len(x)))
    return spark.createDataFrame(table), [F.col(c) for c in names[0]], [F.col(c) for c in names[1]]


def planted(n, p, m, zeros=0.0, noise=0.0, seed=42):
    g = np.random.default_rng(seed)
    x, w = g.normal(size=(n, p)), g.normal(size=(p, m))
    w[g.random((p, m)) < zeros] = 0
    return x, x @ w + noise * g.normal(size=(n, m)), w


@pytest.mark.parametrize(("shape", "noise", "most"), [((1000, 5, 1), 0, 1e-6), ((1000, 5, 7), 0, 1e-6), ((1000, 11, 14), 0.1, 1e-1)])
def test_ols(spark, shape, noise, most):
    x, y, w = planted(*shape, noise=noise)
    assert np.abs(rg.ols(rg.gram(*frame(spark, x, y))) - w).max() < most


def test_both_ways_of_summing_agree(spark):
    x, y, _ = planted(500, 5, 2)
    df, z, t = frame(spark, x, y)
    a, b = rg.gram(df, z, t), rg.gram(df, z, t, wide=0)
    assert a.n == b.n == 500
    for p, q in zip((a.g, a.c, a.s, a.y), (b.g, b.c, b.s, b.y), strict=True):
        assert np.allclose(p, q)
    assert np.allclose(a.g, x.T @ x) and np.allclose(a.c, x.T @ y)


def test_greedy(spark):
    x, y, w = planted(1000, 11, 13, zeros=0.8, noise=0.1)
    assert np.abs(rg.greedy(rg.gram(*frame(spark, x, y)), density=0.02, rel_tol=1e-4) - w).max() < 2e-2


@pytest.mark.parametrize(("shape", "zeros", "noise", "lam", "most"), [((1000, 11, 13), 0.8, 0, 0.1, 1e-3), ((1000, 11, 13), 0.8, 0.1, 0.1, 2e-1), ((500, 20, 1), 0.7, 0, 0.1, 5e-2), ((2000, 8, 5), 0.9, 0.05, 0.5, 5e-2)])
def test_sr3(spark, shape, zeros, noise, lam, most):
    x, y, w = planted(*shape, zeros=zeros, noise=noise)
    got = rg.sr3(rg.gram(*frame(spark, x, y)), lam, 5.0, 500)
    assert np.abs(got - w).max() < most


def test_wide_sr3(spark):
    g = np.random.default_rng(1)
    x, w = g.normal(size=(4000, 256)), np.zeros((256, 16))
    for j in range(3):
        w[g.choice(256, 20, replace=False), j] = g.normal(size=20)
    df, z, t = frame(spark, x, x @ w + 0.05 * g.normal(size=(4000, 16)))
    got = rg.sr3(rg.gram(df, z, t), 5.0, 100.0, 500)
    assert np.abs(got - w).max() < 1e-2 and (got != 0).sum() < 2 * 60


def test_lasso_meets_its_conditions(spark):
    x, y, _ = planted(800, 10, 3, zeros=0.6, noise=0.2)
    s = rg.gram(*frame(spark, x, y))
    lam = 0.05
    w = rg.lasso(s, lam, rel_tol=1e-10)
    slope = s.c - s.g @ w
    assert np.abs(slope[w != 0] - lam * s.n * np.sign(w[w != 0])).max() < 1e-3 * s.n
    assert np.abs(slope[w == 0]).max() <= lam * s.n * 1.001


def test_path_and_reload(spark, tmp_path):
    x, y, w = planted(5000, 20, 3, zeros=0.75)
    df, z, t = frame(spark, x, y)
    path = rg.Path(num_steps=15).fit(df, z, t, "row_id")
    assert len(path.models) == 15
    assert np.abs(path.best() - w).max() < 1e-2 and np.abs(path.best()[w == 0]).max() < 1e-3
    path.save(spark, str(tmp_path / "p"))
    again = rg.Path.load(spark, str(tmp_path / "p"))
    assert again == path
    assert path.table(spark).count() == 15


def test_dictionary_graph(spark):
    g = np.random.default_rng(3)
    node = dc.Concatenate([dc.Identity(), dc.Constant(), dc.Wave(dc.CrossTerms(), n_harmonics=5)])
    x = g.normal(size=(2000, 3))
    df, z, _ = frame(spark, x, np.zeros((2000, 1)))
    lifted = node(z)
    assert len(lifted) == 64
    y = 1.5 * lifted[0] + 0.8 * lifted[3] - 2.0 * lifted[4]
    sums = rg.gram(df, lifted, [y])
    for w in (rg.greedy(sums, density=3 / 64), rg.sr3(sums, 0.3, 5.0, 500)):
        assert np.abs(w[[0, 3, 4], 0] - [1.5, 0.8, -2.0]).max() < 1e-2
    p = df.select(F.max(F.abs(rg.predicted(lifted, rg.greedy(sums, density=3 / 64))[0] - y))).first()[0]
    assert p < 1e-2


def test_nodes():
    with pytest.raises(ValueError):
        dc.Polynomial(degree=1)
    with pytest.raises(TypeError):
        dc.Concatenate(dc.Identity())
    assert "Wave(n_harmonics=2) <- CrossTerms" in repr(dc.Wave(dc.CrossTerms(), 2))


def test_identification_and_ransac(spark):
    g = np.random.default_rng(4)
    a, b = np.array([[0.9, 0.1], [-0.2, 0.8]]), np.array([[0.0], [0.5]])
    x, rows = np.zeros(2), []
    for i in range(600):
        u = g.normal(size=1)
        rows.append((0, i, *map(float, x), float(u[0])))
        x = a @ x + b @ u
    df = spark.createDataFrame(rows, "key int, seq long, x0 double, x1 double, u0 double")
    got = rg.identified(df, "key", ["seq"], ["x0", "x1"], ["u0"])
    assert np.abs(got[0] - a).max() < 1e-8 and np.abs(got[1] - b).max() < 1e-8
    dirty = df.withColumn("x0", F.when(F.col("seq") % 7 == 0, F.col("x0") + 3).otherwise(F.col("x0")))
    ra, rb, marked = rg.ransac(dirty, "key", ["seq"], ["x0", "x1"], ["u0"], "seq", 200, tolerance=1e-3)
    assert np.abs(ra - a).max() < 1e-6 and np.abs(rb - b).max() < 1e-6
    assert 0.6 < marked.where("inlier").count() / marked.count() < 0.8
