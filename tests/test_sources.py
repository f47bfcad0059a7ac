import numpy as np

from quern.operators import metrics as mt
from quern.operators import sampling as sm
from quern.operators import series as se
from quern.sources import tables as src


def test_numeric_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c,d\n1,x,2.5,nan\n2,3,1e3,inf\n-4,5,7,0\n")
    df = src.numeric_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a", "c", "d"] and df.count() == 3


def test_images(spark, tmp_path):
    for name in ("b/2.png", "a/1.jpg", "a/.hidden.png", "b/note.txt", "b/3.PNG"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = src.images(spark, str(tmp_path)).orderBy("index").collect()
    assert [r["path"].rsplit("/", 2)[1:] for r in rows] == [["a", "1.jpg"], ["b", "2.png"], ["b", "3.PNG"]] and [r["index"] for r in rows] == [0, 1, 2]
    assert src.paired(src.images(spark, str(tmp_path), "a/"), src.images(spark, str(tmp_path), "b/")).count() == 1
    pixels = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "r int, g int, b int")
    assert [r["mask"] for r in src.colour_mask(pixels, [(4, 5, 6)]).collect()] == [0, 1]


def test_trajectories(spark):
    out = src.trajectories(spark, 5, [[1.0, 0.0], [0.0, 1.0]], src.linear(np.array([[0.0, 1.0], [-1.0, 0.0]])), 0.1, "rk4").where("seq = 4").orderBy("key").collect()
    assert np.allclose(out[0]["x"], [np.cos(0.4), -np.sin(0.4)], atol=1e-6)


def test_metric_edges(spark):
    df = spark.createDataFrame([(0, 1.0, 0.5), (1, 0.0, float("nan")), (2, 1.0, 0.9), (3, 0.0, None)], "id long, y double, s double")
    r = mt.detection_evaluation(df, "y", "s").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 0, 1, 2)
    one = spark.createDataFrame([(0, 1.0, 0.5)], "id long, y double, s double")
    assert mt.curve_areas(one, "y", "s", "id").first()["auc_roc"] == 0
    assert mt.regression_evaluation(spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "t double, p double"), "t", "p").first()["mape"] == float("inf")
    assert {x["metric"] for x in mt.formatted(mt.detection_evaluation(df, "y", "s")).collect()} >= {"f1", "mcc"}


def test_ranges_do_not_change_curves(spark, monkeypatch):
    from quern.operators import ordered

    g = np.random.default_rng(1)
    df = spark.createDataFrame([(i, int(g.random() < 0.3), float(round(g.normal(), 1))) for i in range(3000)], "id long, y int, s double").repartition(5)
    whole = mt.curve_areas(df, "y", "s", "id").first(), mt.average_precision(df, "y", "s", "id").first()
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    assert (mt.curve_areas(df, "y", "s", "id").first(), mt.average_precision(df, "y", "s", "id").first()) == whole


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    assert sm.first_by_hash(df, "i", 10, 1).count() == 10
    assert sm.split(df, "i", 0.8, 3).where("train").count() == 800
    assert sm.per_draw(df, "i", 3, 10, 1).groupBy("draw").count().where("count = 10").count() == 3


def test_features():
    f = se.shape_features(np.sin(np.arange(100) / 5))
    assert all(np.isfinite(v) for v in f.values()) and se.shape_features(np.ones(5))["std"] == 0
    k = se.kernel_features(np.random.default_rng(0).normal(size=50), 64)
    assert len(k) == 64 and ((k >= 0) & (k <= 1)).all()
