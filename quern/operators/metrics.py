"""Evaluation metrics as aggregates: detection, anomalies, classes, regression, key points, ranking curves, thresholds.

All take one table that holds truth and prediction side by side, so lengths cannot differ. Ratios are 0 where their
denominator is 0; figures are rounded to five places, as the names of the columns promise. A score equal to the threshold
is negative, and so is NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import quantiles, running

PLACES = 5
#: Pairs of true and predicted class that are broadcast.
MOST_PAIRS = 1_000_000


def above(c: Column, threshold: float | Column) -> Column:
    return F.coalesce(~F.isnan(c.cast("double")) & (c > threshold), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def detection_counts(truth: Column, score: Column, threshold: float | Column = 0.5) -> list[Column]:
    t, p = above(truth, threshold), above(score, threshold)
    n = lambda c: F.sum(c.cast("long"))
    return [n(t & p).alias("tp"), n(~t & ~p).alias("tn"), n(~t & p).alias("fp"), n(t & ~p).alias("fn")]


def detection_ratios(epsilon: float = 0.0) -> dict[str, Column]:
    """Ratios of tp, tn, fp, fn; with ``epsilon`` added to every denominator where it is not 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    div = (lambda a, b: a / (b + epsilon)) if epsilon else ratio
    precision, recall, specificity = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    return {
        "accuracy": (tp + tn) / (tp + tn + fp + fn + 1e-10),
        "precision": precision, "recall": recall,
        "f1": div(2 * tp, 2 * tp + fp + fn),
        "mcc": div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2,
        "iou": div(tp, tp + fp + fn), "dice": div(2 * tp, 2 * tp + fp + fn),
    }


def rounded(columns: dict[str, Column]) -> list[Column]:
    return [F.round(c, PLACES).alias(n) for n, c in columns.items()]


def detection_evaluation(df: DataFrame, truth: str, score: str, threshold: float = 0.5, by: Sequence[str] = (), epsilon: float = 0.0) -> DataFrame:
    """One row (or one for each ``by``): counts, ratios, n_samples."""
    counts = df.groupBy(*by).agg(*detection_counts(F.col(truth), F.col(score), threshold), F.count("*").alias("n_samples"))
    return counts.select(*by, "tp", "tn", "fp", "fn", "n_samples", *rounded(detection_ratios(epsilon)))


def _ranked(df: DataFrame, truth: str, score: str, row_id: str) -> DataFrame:
    return running(df.select(F.col(truth).cast("int").alias("_y"), F.col(score).cast("double").alias("_s"), F.col(row_id).alias("_id")), F.col("_s"), [F.col("_id")], {"tp": F.col("_y").cast("long")}, reverse=True)


def curve_areas(df: DataFrame, truth: str, score: str, row_id: str) -> DataFrame:
    """One row (auc_roc, auc_pr): trapezoids over one point a row, in descending order of score, without an origin.

    Both need only ranks and running positives: a step of the ROC is a negative row, a step of recall a positive one. 0 if a
    class is absent.
    """
    y, tp, k = F.col("_y"), F.col("tp").cast("double"), F.col("rank").cast("double")
    steps = _ranked(df, truth, score, row_id)
    own = steps.agg(
        F.sum("_y").alias("p"), F.sum(1 - y).alias("n"),
        F.sum(F.when((y == 0) & (k > 1), tp)).alias("a"),
        F.sum(F.when((y == 1) & (k > 1), (tp / k + (tp - 1) / (k - 1)) / 2)).alias("b"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return own.select(*rounded({"auc_roc": F.when(both, F.coalesce("a", F.lit(0.0)) / (F.col("p") * F.col("n"))).otherwise(0.0), "auc_pr": F.when(both, F.coalesce("b", F.lit(0.0)) / F.col("p")).otherwise(0.0)}))


def average_precision(df: DataFrame, truth: str, score: str, row_id: str) -> DataFrame:
    """One row (average_precision): recall steps times the best precision at that recall or a higher one."""
    points = _ranked(df, truth, score, row_id).where("_y = 1").select((F.col("tp") / F.col("rank")).alias("p"), F.col("tp").alias("k"))
    # best precision from the right: of the points below k only those matter that come later, k is unique
    n = points.count()
    right = running_best(points, n)
    return right.agg(F.round(F.sum("best") / F.lit(float(max(n, 1))), PLACES).alias("average_precision"))


def running_best(points: DataFrame, n: int, width: int = 50_000) -> DataFrame:
    """(k, best): the largest p at k or later, by blocks of k; the maxima of later blocks are few and joined back."""
    from pyspark.sql import Window

    block = F.floor((F.col("k") - 1) / width)
    placed = points.withColumn("_block", block)
    later = {r["_block"]: r["m"] for r in placed.groupBy("_block").agg(F.max("p").alias("m")).collect()}
    best, after = 0.0, {}
    for b in sorted(later, reverse=True):
        after[b] = best
        best = max(best, later[b])
    table = F.array(*(F.lit(float(after.get(b, 0.0))) for b in range(int(max(later, default=0)) + 1)))
    own = F.max("p").over(Window.partitionBy("_block").orderBy("k").rowsBetween(0, Window.unboundedFollowing))
    return placed.select("k", F.greatest(own, F.get(table, F.col("_block").cast("int"))).alias("best"))


def anomaly_evaluation(df: DataFrame, truth: str, score: str, row_id: str, threshold: float = 0.5) -> DataFrame:
    """One row: detection figures, areas under the curves, class counts and score statistics."""
    t, s = above(F.col(truth), threshold), F.col(score)
    base = df.agg(
        *detection_counts(F.col(truth), s, threshold), F.count("*").alias("n_samples"),
        F.avg(s).alias("score_mean"), F.stddev_samp(s).alias("score_std"), F.avg(F.when(t, s)).alias("score_mean_anomaly"), F.avg(F.when(~t, s)).alias("score_mean_normal"),
    )
    n, tp, tn, fp, fn = (F.col(c).cast("double") for c in ("n_samples", "tp", "tn", "fp", "fn"))
    more = {
        "anomaly_ratio": ratio(tp + fn, n), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp),
        "score_mean": F.col("score_mean"), "score_std": F.coalesce("score_std", F.lit(0.0)), "score_mean_anomaly": F.coalesce("score_mean_anomaly", F.lit(0.0)), "score_mean_normal": F.coalesce("score_mean_normal", F.lit(0.0)),
        "score_separation": F.coalesce("score_mean_anomaly", F.lit(0.0)) - F.coalesce("score_mean_normal", F.lit(0.0)),
    }
    own = base.select("tp", "tn", "fp", "fn", "n_samples", (F.col("tp") + F.col("fn")).alias("n_anomalies"), (F.col("tn") + F.col("fp")).alias("n_normal"), *rounded(detection_ratios() | more))
    return own.join(F.broadcast(curve_areas(df, truth, score, row_id)))  # one row each


def confusion(df: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """(class, tp, fp, fn, tn, n_truth, n_predicted) of every class 0 ... classes - 1, absent ones included."""
    pairs = df.groupBy(F.col(truth).cast("int").alias("t"), F.col(predicted).cast("int").alias("p")).count()
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).alias
    t, p, k = F.col("t"), F.col("p"), F.col("class")
    grid = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    if (most := pairs.count()) > MOST_PAIRS:
        raise ValueError(f"{most} pairs of classes; at most {MOST_PAIRS} are compared with every class")
    return grid.join(F.broadcast(pairs)).groupBy("class").agg(n((t == k) & (p == k))("tp"), n((t != k) & (p == k))("fp"), n((t == k) & (p != k))("fn"), n((t != k) & (p != k))("tn"), n(t == k)("n_truth"), n(p == k)("n_predicted"))  # at most classes x classes pairs


def classification_by_class(df: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    ratios = detection_ratios()
    names = ("precision", "recall", "f1", "mcc", "specificity", "iou", "dice")
    return confusion(df, truth, predicted, classes).select("class", "tp", "fp", "fn", "tn", "n_truth", "n_predicted", *rounded({n: ratios[n] for n in names}))


def classification_evaluation(df: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """One row: accuracy, and plain means over all classes, absent ones included."""
    ratios = detection_ratios()
    names = ("precision", "recall", "f1", "mcc", "specificity", "iou", "dice")
    own = confusion(df, truth, predicted, classes).select("*", *(ratios[n].alias(n) for n in names))
    out = own.agg(F.sum("tp").alias("hits"), F.sum("n_truth").alias("n"), *(F.avg(n).alias(f"macro_{n}") for n in names))
    columns = {"accuracy": ratio(F.col("hits").cast("double"), F.col("n"))} | {f"macro_{n}": F.col(f"macro_{n}") for n in names}
    return out.select(F.col("n").alias("n_samples"), *rounded(columns | {"macro_balanced_accuracy": (F.col("macro_recall") + F.col("macro_specificity")) / 2}))


def argmax(values: Column) -> Column:
    """Index of the first largest value of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def regression_evaluation(df: DataFrame, truth: str, predicted: str, n_features: int | None = None) -> DataFrame:
    """One row of error figures; the band figures are means over residuals within 1, 2, 3 deviations of 0.

    Inputs are cut to single precision first, sums are in double.
    """
    t, p = F.col(truth).cast("float").cast("double"), F.col(predicted).cast("float").cast("double")
    base = df.select(t.alias("t"), (t - p).alias("r"))
    r, e = F.col("r"), F.abs("r")
    some = F.abs("t") > 1e-12
    first = base.agg(
        F.count("*").alias("n"), F.avg(r * r).alias("mse"), F.avg(e).alias("mae"), F.max(e).alias("maxe"), F.avg(F.when(some, e / F.abs("t"))).alias("mape"),
        F.avg(r).alias("rm"), F.stddev_samp(r).alias("rs"), F.sum(r * r).alias("res"), (F.count("*") * F.var_pop("t")).alias("tot"),
    )
    bands = base.join(F.broadcast(first.select("rs"))).agg(*(F.avg(F.when(e <= k * F.col("rs"), r * r)).alias(f"band{k}") for k in (1, 2, 3)))  # one row
    n, r2 = F.col("n"), F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(0.0)
    columns = {
        "mse": F.col("mse"), "rmse": F.sqrt("mse"), "mae": F.col("mae"), "median_ae": F.col("medae"), "max_ae": F.col("maxe"), "mape": F.coalesce(100 * F.col("mape"), F.lit(float("inf"))), "r2": r2,
        "residual_mean": F.col("rm"), "residual_std": F.coalesce("rs", F.lit(0.0)),
    } | {f"mse_{k}_sigma": F.coalesce(f"band{k}", "mse") for k in (1, 2, 3)}
    if n_features is not None:
        columns["adjusted_r2"] = F.when(n > n_features + 1, 1 - (1 - r2) * (n - 1) / (n - n_features - 1)).otherwise(r2)
    middle = quantiles(base.select(e.alias("e")), "e", [0.5]).agg(F.max("q0").alias("medae"))
    return first.join(F.broadcast(bands)).join(F.broadcast(middle)).select(F.col("n").alias("n_samples"), *rounded(columns))  # one row each


def keypoints_evaluation(df: DataFrame, point: str, zone: str, predicted: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Of pixels: confidence at true points, hits inside and outside the tolerance zone (> 0.1), error inside it. Recall may exceed 1."""
    at, near, hit = above(F.col(point), 0.5), above(F.col(zone), 0.1), above(F.col(predicted), threshold)
    n = lambda c: F.sum(c.cast("long"))
    own = df.groupBy(*by).agg(n(at).alias("n_points"), F.avg(F.when(at, F.col(predicted))).alias("c"), n(near & hit).alias("tp"), n(~near & hit).alias("fp"), n(at & ~hit).alias("fn"), F.avg(F.when(near, F.abs(F.col(zone) - F.col(predicted)))).alias("e"))
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    precision, recall = ratio(tp, tp + fp), ratio(tp, F.col("n_points").cast("double"))
    columns = {"peak_confidence": F.coalesce("c", F.lit(0.0)), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall), "zone_mae": F.coalesce("e", F.lit(0.0))}
    return own.select(*by, "n_points", "tp", "fp", "fn", *rounded(columns))


def threshold_table(df: DataFrame, truth: str, score: str, steps: int = 100) -> DataFrame:
    """(threshold, tp, fp, fn, tn) at ``steps`` even thresholds from 0 to 1: scores are put into bins once, bins summed from above."""
    grid = [i / (steps - 1) for i in range(steps)]
    bins = F.when(F.isnan(F.col(score).cast("double")) | F.col(score).isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t < F.col(score))))
    y = above(F.col(truth), 0.5)
    own = df.groupBy(bins.alias("bin")).agg(F.sum(y.cast("long")).alias("p"), F.sum((~y).cast("long")).alias("n"))
    points = df.sparkSession.createDataFrame(list(enumerate(grid)), "i int, threshold double")
    p, n, over = F.col("p"), F.col("n"), F.col("bin") > F.col("i")
    s = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    return points.join(F.broadcast(own)).groupBy("threshold").agg(s(over, p).alias("tp"), s(over, n).alias("fp"), s(~over, p).alias("fn"), s(~over, n).alias("tn"))  # at most steps + 1 bins


def tune_threshold(df: DataFrame, truth: str, score: str, metric: str = "f1", steps: int = 100) -> DataFrame:
    """One row (threshold, value): the first threshold with the largest f1, mcc or youden figure."""
    ratios = detection_ratios()
    value = {"f1": ratios["f1"], "mcc": ratios["mcc"], "youden": ratios["recall"] + ratios["specificity"] - 1}[metric]
    # rounded before the comparison, so that equal figures are ties in any engine
    table = threshold_table(df, truth, score, steps).select("threshold", F.round(value, 12).alias("value"))
    return table.orderBy(F.desc("value"), "threshold").limit(1).select(F.round("threshold", PLACES).alias("threshold"), F.round("value", PLACES).alias("value"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n) over even bins from the smallest to the largest value, the last one closed; empty bins included."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = ((hi or 0.0) - (lo or 0.0)) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(lo)) / F.lit(width)).cast("int")) if width else F.lit(0)
    own = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return grid.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def timing_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """By group mean, std, exact 68, 95 and 99.7 % quantiles and max. Groups are few: their figures are broadcast."""
    first = df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.max(column).alias("max"))
    marks = quantiles(df, column, [0.68, 0.95, 0.997], by).select(*(F.col(c).alias(f"o_{c}") for c in by), "q0", "q1", "q2")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    both = first.join(marks, on, "left") if by else first.join(F.broadcast(marks), how="left")
    return both.select(*by, *rounded({"mean": F.col("mean"), "std": F.col("std"), "p68": F.col("q0"), "p95": F.col("q1"), "p997": F.col("q2"), "max": F.col("max")}))


def formatted(metrics: DataFrame) -> DataFrame:
    """(metric, value) lines of a one-row result."""
    return metrics.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in metrics.columns)), F.array(*(F.col(c).cast("string") for c in metrics.columns)))).alias("metric", "value"))


def variance_hinge(df: DataFrame, vector: str, upper: float = 1.0) -> DataFrame:
    """One row: mean over dimensions of max(0, upper - standard deviation)."""
    one = df.select(F.posexplode(vector).alias("d", "v")).groupBy("d").agg(F.stddev_samp("v").alias("s"))
    return one.agg(F.round(F.avg(F.greatest(F.lit(0.0), upper - F.col("s"))), PLACES).alias("std_hinge"), F.count("*").alias("n_dims"))


def inside(u: Column, v: Column, width: float, height: float, boundary: float = 1.0) -> Column:
    """Whether a mapped key point lies within the image, more than ``boundary`` from its edges."""
    return (u > boundary) & (u < width - boundary) & (v > boundary) & (v < height - boundary)


def heatmap_evaluation(df: DataFrame, truth: str, predicted: str, row_id: str, threshold: float = 0.5, epsilon: float = 1e-7) -> DataFrame:
    """One row (precision, recall, f1, average_precision) of points (0 or 1) against a heat map; here the threshold itself counts as found."""
    t, hit = F.col(truth).cast("double"), F.coalesce(F.col(predicted) >= threshold, F.lit(False)).cast("double")
    n = df.agg(F.sum(t * hit).alias("tp"), F.sum((1 - t) * hit).alias("fp"), F.sum(t * (1 - hit)).alias("fn"))
    tp = F.coalesce("tp", F.lit(0.0))
    both = n.select((tp / (tp + F.coalesce("fp", F.lit(0.0)) + epsilon)).alias("p"), (tp / (tp + F.coalesce("fn", F.lit(0.0)) + epsilon)).alias("r"))
    ratios = both.select(*rounded({"precision": F.col("p"), "recall": F.col("r"), "f1": 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + epsilon)}))
    return ratios.join(F.broadcast(average_precision(df, truth, predicted, row_id)))  # one row each


def control_costs(df: DataFrame, by: str, control: Column, error: Column) -> DataFrame:
    """(by, control_cost, tracking_cost, reduction): sums of squares, and by how many per cent the tracking cost is below the largest one."""
    own = df.groupBy(by).agg(F.sum(control * control).alias("c"), F.sum(error * error).alias("t"))
    most = own.agg(F.max("t").alias("most"))
    out = own.join(F.broadcast(most))  # one row
    return out.select(by, *rounded({"control_cost": F.col("c"), "tracking_cost": F.col("t"), "reduction": ratio(100 * (F.col("most") - F.col("t")), F.col("most"))}))


def r2_by_output(df: DataFrame, outputs: Sequence[tuple[Column, Column]]) -> DataFrame:
    """(output, r2): one row for each pair of truth and prediction, in one pass; 0 where the truth is constant."""
    sums = df.agg(*(c for i, (t, p) in enumerate(outputs) for c in (F.sum((t - p) * (t - p)).alias(f"e{i}"), (F.count(t) * F.var_pop(t)).alias(f"v{i}"))))
    each = F.array(*(F.struct(F.lit(i).alias("output"), F.round(F.when(F.col(f"v{i}") > 0, 1 - F.col(f"e{i}") / F.col(f"v{i}")).otherwise(0.0), PLACES).alias("r2")) for i in range(len(outputs))))
    return sums.select(F.explode(each).alias("r")).select("r.output", "r.r2")


def characteristic_loss(df: DataFrame, vector: str, directions: np.ndarray, t_range: float = 5.0, points: int = 17) -> DataFrame:
    """One row (loss): how far the vectors' projections on unit ``directions`` (columns) are from a standard normal distribution.

    The squared distance of the empirical characteristic function from exp(-t^2 / 2) at ``points`` even t, weighed by the same
    curve, integrated by trapezoids, averaged over the directions and multiplied by the number of vectors. A task sends
    the sums of its cosines and sines, whose number does not depend on the rows.
    """
    directions = np.asarray(directions, float)
    directions = directions / np.linalg.norm(directions, axis=0)
    t = np.linspace(-t_range, t_range, points)
    cells = directions.shape[1] * points

    def run(batches):
        total = np.zeros(2 * cells + 1)
        for batch in batches:
            values = batch.column(0).drop_null()
            for at in range(0, len(values), 256):
                z = np.array(values.slice(at, 256).to_pylist(), float)
                x = (z @ directions)[:, :, None] * t
                total += np.concatenate((np.cos(x).sum(0).reshape(-1), np.sin(x).sum(0).reshape(-1), [len(z)]))
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "v": total})

    sums = df.select(vector).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = np.zeros(2 * cells + 1)
    for r in sums:
        found[r["i"]] = r["v"]
    n, aim = found[-1], np.exp(-0.5 * t * t)
    real, imaginary = ((found[k * cells : (k + 1) * cells] / max(n, 1)).reshape(-1, points) for k in (0, 1))
    loss = float(n) * float(np.trapezoid(((real - aim) ** 2 + imaginary**2) * aim, t, axis=1).mean())
    return df.sparkSession.createDataFrame([(round(loss, PLACES),)], "loss double")
