"""Ranks, sums and quantiles over several ranges and groups against pandas; samples; kernels across batches."""

import numpy as np
import pandas as pd
import pytest

from quern.operators import filters as fl
from quern.operators import metrics as mt
from quern.operators import ordered as od
from quern.operators import sampling as sm
from quern.operators import series as se
from quern.sources import tables as src


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(od, "RANGE_ROWS", 40)


def rows(n=900):
    g = np.random.default_rng(1)
    return pd.DataFrame({"i": np.arange(n), "v": g.normal(size=n).round(2), "g": g.choice(["a", "b", None], n), "w": g.integers(0, 9, n), "key": "k", "range": "r"})


def test_running_by_group(spark, narrow):
    from pyspark.sql import functions as F

    table = rows()
    got = od.running(spark.createDataFrame(table), F.col("v"), [F.col("i")], {"total": F.col("w")}, by=["g"]).toPandas().sort_values("i")
    table = table.assign(g=table["g"].fillna("none")).sort_values(["v", "i"])
    table["rank"] = table.groupby("g").cumcount() + 1
    table["total"] = table.groupby("g")["w"].cumsum()
    table = table.sort_values("i")
    assert (got["rank"].to_numpy() == table["rank"].to_numpy()).all() and (got["total"].to_numpy() == table["total"].to_numpy()).all()
    assert set(got["key"]) == {"k"} and set(got["range"]) == {"r"}


def test_quantiles(spark, narrow):
    table = rows()
    df = spark.createDataFrame(table)
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in od.quantiles(df, "v", [0.0, 0.3, 1.0], ["g"]).collect()}
    for name, own in table.assign(g=table["g"].fillna("none")).groupby("g"):
        assert np.allclose(got[None if name == "none" else name], own["v"].quantile([0.0, 0.3, 1.0]))
    assert od.quantiles(df, "v", [0.5]).first()["q0"] == pytest.approx(table["v"].median())
    assert od.quantiles(df.where("i < 0"), "v", [0.5]).count() <= 1
    assert mt.timing_summary(df.where("i = 3"), "v").first()["p95"] == pytest.approx(table["v"][3])


def test_balanced_and_dealt(spark, narrow):
    df = spark.createDataFrame(rows(4000))
    got = sm.balanced(df, "i", "g", 300, 3).collect()
    assert len(got) == 300 and {r["slot"] for r in got} == set(range(300)) and abs(sum(r["g"] == "a" for r in got) - 150) < 40
    dealt = sm.dealt(df, "i", 8, 100, 1).toPandas()
    assert (dealt.groupby("draw").size() == 100).all() and dealt["i"].is_unique and len(dealt) == 800
    many = sm.dealt(df, "i", 50, 100, 1).toPandas()
    assert (many.groupby("draw").size() == 100).all() and not many.duplicated(["draw", "i"]).any()


def test_kernel_goes_on_across_batches(spark):
    n = 30_000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        df = spark.range(2 * n).selectExpr("id % 2 as key", "id div 2 as seq", "cast(id % 97 as double) as x")
        out = fl.filtered(df, fl.Ema(0.1), "key", ["seq"], ["x"]).orderBy("key", "seq").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, own in out.groupby("key"):
        x, y, want = (np.arange(n) * 2 + k) % 97, None, []
        for v in x:
            y = float(v) if y is None else 0.1 * v + 0.9 * y
            want.append(y)
        assert np.allclose(own["y"], want)


def test_blocks_and_log(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(35)] + [("b", 0, 1.0)], "k string, t int, v double")
    got = {(r["k"], r["block"]): r["x"] for r in se.blocks(df, "k", ["t"], "v", 16).collect()}
    assert {k: len(x) for k, x in got.items()} == {("a", 0): 16, ("a", 1): 16, ("a", 2): 3, ("b", 0): 1} and got["a", 2] == [32.0, 33.0, 34.0]
    for _ in range(2):
        src.append_lines(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 72
