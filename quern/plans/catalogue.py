"""The library's queries over the standard tables, each with the SQL that gives the same rows where SQL can.

Names follow the operators: src, prj, dic, agg, win, srt, set, smp, spl, jon, reg, sid, tre, flt, ctl, dsp, sim, emb.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dictionary as dc
from ..functions import linalg as la
from ..operators import filters as fl
from ..operators import metrics as mt
from ..operators import regression as rg
from ..operators import sampling as sm
from ..operators import series as se
from ..operators import trees as tr
from ..sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Inputs that several queries share, with their SQL.
X = ("x0", "x1", "x2")
X_SQL = "(select o_orderkey, o_totalprice / 99991.0 as x0, (o_custkey % 97) / 10.0 - 4.8 as x1, (o_orderkey % 13) / 4.0 - 1.5 as x2 from orders)"
EV_SQL = "(select user_id, ts, event_id, value, row_number() over (partition by user_id order by ts, event_id) as seq, count(*) over (partition by user_id) as n from events)"
SCORED_SQL = "(select o_orderkey as id, case when o_orderstatus = 'F' then 1 else 0 end as y, (o_totalprice + (case when o_orderstatus = 'F' then 60000 else 0 end)) / 600000.0 as s from orders)"


def points(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 99991.0).alias("x0"), (F.col("o_custkey") % 97 / 10.0 - 4.8).alias("x1"), (F.col("o_orderkey") % 13 / 4.0 - 1.5).alias("x2"))


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", "value")


def scored(spark, d) -> DataFrame:
    f = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), f.cast("int").alias("y"), ((F.col("o_totalprice") + F.when(f, 60000).otherwise(0)) / 600000.0).alias("s"))


def rounded(df: DataFrame, places: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes))


def r(e: str, places: int = 6) -> str:
    return f"round({e}, {places})"


BY = ("ts", "event_id")


# Sources and projections -------------------------------------------------------------------------------------------


@query("src_numeric_columns", "select 'p_partkey' as name union all select 'p_size' union all select 'p_retailprice'")
def src_numeric_columns(spark, d):
    part = table(spark, d, "part")
    found = src.numeric_columns(part.select(*(F.col(c).cast("string").alias(c) for c in part.columns)))
    return spark.createDataFrame([(c,) for c in found], "name string")


@query("prj_tabular_split", "select l_orderkey, l_linenumber, l_quantity as x0, l_discount as x1, l_extendedprice as y0 from lineitem")
def prj_tabular_split(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), F.col("l_discount").alias("x1"), F.col("l_extendedprice").alias("y0"))


F4 = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("prj_standardise", "select o_orderkey, " + ", ".join(f"round(({c} - avg({c}) over ()) / (stddev_pop({c}) over () + 1e-12), 6) as {c}" for c in X) + f" from {X_SQL}")
def prj_standardise(spark, d):
    return rounded(dc.standardised(points(spark, d), X))


@query("prj_one_hot", "select vec_id, " + ", ".join(f"(label = {k})::int::double as z{k}" for k in range(10)) + " from embeddings")
def prj_one_hot(spark, d):
    return table(spark, d, "embeddings").select("vec_id", *(c.alias(f"z{k}") for k, c in enumerate(dc.one_hot(F.col("label"), 10))))


@query("prj_fixed_projection", f"select o_orderkey, round(x0 * 0.5 - x1 * 1.25 + x2 * 2.0, 6) as z0, round(x1 * 0.75, 6) as z1 from {X_SQL}")
def prj_fixed_projection(spark, d):
    df = points(spark, d)
    return df.select("o_orderkey", *(F.round(c, 6).alias(f"z{i}") for i, c in enumerate(dc.projected([F.col(c) for c in X], [[0.5, 0.0], [-1.25, 0.75], [2.0, 0.0]]))))


@query("prj_clip", f"select o_orderkey, greatest(-1.0, least(1.0, x1)) as z0 from {X_SQL}")
def prj_clip(spark, d):
    return points(spark, d).select("o_orderkey", dc.clip(F.col("x1"), -1.0, 1.0).alias("z0"))


@query("prj_homography", "select o_orderkey, round((x0 * 0.8 - x1 * 0.6 + 2.0) / (x0 * 0.01 + x1 * 0.02 + 1.0), 6) as u, round((x0 * 0.6 + x1 * 0.8 - 1.0) / (x0 * 0.01 + x1 * 0.02 + 1.0), 6) as v from " + X_SQL)
def prj_homography(spark, d):
    u, v = dc.warped(F.col("x0"), F.col("x1"), [[0.8, -0.6, 2.0], [0.6, 0.8, -1.0], [0.01, 0.02, 1.0]])
    return points(spark, d).select("o_orderkey", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("prj_quaternion_angles", "select o_orderkey, round(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), 6) as roll, round(asin(greatest(-1.0, least(1.0, 2 * (w * y - z * x)))), 6) as pitch, round(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 6) as yaw from (select o_orderkey, 0.8 as w, x0 / 10 as x, x1 / 10 as y, x2 / 10 as z from " + X_SQL + ")")
def prj_quaternion_angles(spark, d):
    q = dc.quaternion_angles(F.lit(0.8), F.col("x0") / 10, F.col("x1") / 10, F.col("x2") / 10)
    return points(spark, d).select("o_orderkey", *(F.round(c, 6).alias(n) for n, c in zip(("roll", "pitch", "yaw"), q, strict=True)))


@query("prj_camera_point", f"select o_orderkey, round(x0 / (x2 + 3) * 500.0 + 320.0, 6) as u, round(x1 / (x2 + 3) * 500.0 + 240.0, 6) as v from {X_SQL}")
def prj_camera_point(spark, d):
    u, v = dc.camera_point(F.col("x0"), F.col("x1"), F.col("x2") + 3, (500.0, 500.0), (320.0, 240.0))
    return points(spark, d).select("o_orderkey", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


# Dictionaries ------------------------------------------------------------------------------------------------------


def _dictionary(name: str, node, exprs: list[str]) -> None:
    sql = "select o_orderkey, " + ", ".join(f"round({e}, 6) + 0.0 as z{i}" for i, e in enumerate(exprs)) + f" from {X_SQL}"
    query(name, sql)(lambda spark, d: rounded(dc.apply(points(spark, d), node, X, ["o_orderkey"])))


_pairs = [(a, b) for i, a in enumerate(X) for b in X[i:]]
_nonlinear = [f.format(c) for f in ("sign({0})", "abs({0})", "greatest({0}, 0.0)", "least({0}, 0.0)", "tanh({0})", "({0} * {0})", "(abs({0}) * {0})") for c in X]
_dictionary("dic_identity_constant", dc.Concatenate([dc.Identity(), dc.Constant()]), [*X, "1.0::double"])
_dictionary("dic_polynomial", dc.Polynomial(degree=3), [f"{c} * {c}" for c in X] + [f"{c} * {c} * {c}" for c in X])
_dictionary("dic_cross_terms", dc.CrossTerms(), [f"{a} * {b}" for a, b in _pairs])
_dictionary("dic_cross_terms_strict", dc.CrossTerms(squares=False), [f"{a} * {b}" for a, b in _pairs if a != b])
_dictionary("dic_wave", dc.Wave(n_harmonics=2), [f"{f}({c} * {k}.0)" for k in (1, 2) for f in ("sin", "cos") for c in X])
_dictionary("dic_nonlinear", dc.NonLinear(), [f"{e}::double" for e in _nonlinear])
_dictionary("dic_rational", dc.Rational(), [f"sign({c}) / (abs({c}) + 1e-7)" for c in X])
_dictionary("dic_rational_quadratic", dc.RationalQuadratic(), [f"1.0 / ({c} * {c} + 1e-7)" for c in X])
_dictionary("dic_sin_cos_cross", dc.SinCosCross(), [f"{a} * {f}({b})" for a in X for b in X if a != b for f in ("sin", "cos")])
_dictionary("dic_concat_graph", dc.Concatenate([dc.Identity(), dc.Constant(), dc.Wave(dc.CrossTerms(), n_harmonics=1)]), [*X, "1.0::double", *(f"{f}({a} * {b})" for f in ("sin", "cos") for a, b in _pairs)])


# Aggregations ------------------------------------------------------------------------------------------------------

_COUNTS = "sum((y > 0.5 and s > 0.5)::int)::bigint as tp, sum((y <= 0.5 and s <= 0.5)::int)::bigint as tn, sum((y <= 0.5 and s > 0.5)::int)::bigint as fp, sum((y > 0.5 and s <= 0.5)::int)::bigint as fn, count(*) as n_samples"


def _div(a: str, b: str) -> str:
    return f"(case when ({b}) > 0 then ({a})::double / ({b}) else 0.0 end)"


_MCC = _div("tp::double * tn - fp::double * fn", "sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn))")
_RATIOS = {
    "accuracy": "(tp + tn) / (tp + tn + fp + fn + 1e-10)", "precision": _div("tp", "tp + fp"), "recall": _div("tp", "tp + fn"), "f1": _div("2 * tp", "2 * tp + fp + fn"), "mcc": _MCC,
    "specificity": _div("tn", "tn + fp"), "balanced_accuracy": f"({_div('tp', 'tp + fn')} + {_div('tn', 'tn + fp')}) / 2", "iou": _div("tp", "tp + fp + fn"), "dice": _div("2 * tp", "2 * tp + fp + fn"),
}
_RATIO_SQL = ", ".join(f"round({e}, 5) as {n}" for n, e in _RATIOS.items())


@query("agg_detection_eval", f"select *, {_RATIO_SQL} from (select {_COUNTS} from {SCORED_SQL})")
def agg_detection_eval(spark, d):
    return mt.detection_evaluation(scored(spark, d), "y", "s")


LABELLED_SQL = "(select lang, toxic as y, n_chars / (n_chars + 1500.0) as s from documents join labels using (doc_id))"


@query("agg_detection_eval_by_key", f"select *, {_RATIO_SQL} from (select lang, {_COUNTS} from {LABELLED_SQL} group by lang)")
def agg_detection_eval_by_key(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", F.col("toxic").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("s"))
    return mt.detection_evaluation(df, "y", "s", by=["lang"])


_AUC_SQL = f"""(select sum(y) as p, sum(1 - y) as n, sum(case when y = 0 and k > 1 then tp end)::double as a, sum(case when y = 1 and k > 1 then (tp::double / k + (tp - 1)::double / (k - 1)) / 2 end) as b
    from (select y, row_number() over w as k, sum(y) over w as tp from {SCORED_SQL} window w as (order by s desc, id rows unbounded preceding)))"""


@query("win_auc_roc_pr", f"select round(a / (p::double * n), 5) as auc_roc, round(b / p, 5) as auc_pr from {_AUC_SQL}")
def win_auc_roc_pr(spark, d):
    return mt.curve_areas(scored(spark, d), "y", "s", "id")


@query("agg_anomaly_eval", f"""select c.*, tp + fn as n_anomalies, tn + fp as n_normal, {_RATIO_SQL}, round((tp + fn)::double / n_samples, 5) as anomaly_ratio, round({_div('fp', 'fp + tn')}, 5) as fpr, round({_div('fn', 'fn + tp')}, 5) as fnr,
    round(m, 5) as score_mean, round(sd, 5) as score_std, round(ma, 5) as score_mean_anomaly, round(mn, 5) as score_mean_normal, round(ma - mn, 5) as score_separation, round(a / (p::double * n), 5) as auc_roc, round(b / p, 5) as auc_pr
    from (select {_COUNTS} from {SCORED_SQL}) c, (select avg(s) as m, stddev_samp(s) as sd, avg(case when y > 0.5 then s end) as ma, avg(case when y <= 0.5 then s end) as mn from {SCORED_SQL}), {_AUC_SQL}""")
def agg_anomaly_eval(spark, d):
    return mt.anomaly_evaluation(scored(spark, d), "y", "s", "id")


@query("win_average_precision", f"select round(sum(best) / (select sum(y) from {SCORED_SQL}), 5) as average_precision from (select y, max(tp::double / k) over (order by k rows between current row and unbounded following) as best from (select y, row_number() over w as k, sum(y) over w as tp from {SCORED_SQL} window w as (order by s desc, id rows unbounded preceding)) where y = 1)")
def win_average_precision(spark, d):
    return mt.average_precision(scored(spark, d), "y", "s", "id")


_PRED_SQL = "(select vec_id, label as t, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 as p from embeddings)"
_CLASS_SQL = f"""(select k::int as class, sum((t = k and p = k)::int)::bigint as tp, sum((t <> k and p = k)::int)::bigint as fp, sum((t = k and p <> k)::int)::bigint as fn, sum((t <> k and p <> k)::int)::bigint as tn, sum((t = k)::int)::bigint as n_truth, sum((p = k)::int)::bigint as n_predicted
    from range(10) g(k), {_PRED_SQL} group by k)"""
_CLASS_RATIOS = ("precision", "recall", "f1", "mcc", "specificity", "iou", "dice")


def predicted_classes(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("t"), mt.argmax(F.slice("embedding", 1, 10)).alias("p"))


@query("agg_classification_by_class", f"select *, {', '.join(f'round({_RATIOS[n]}, 5) as {n}' for n in _CLASS_RATIOS)} from {_CLASS_SQL}")
def agg_classification_by_class(spark, d):
    return mt.classification_by_class(predicted_classes(spark, d), "t", "p", 10)


@query("agg_classification_eval", f"select sum(n_truth)::bigint as n_samples, round(sum(tp)::double / sum(n_truth), 5) as accuracy, {', '.join(f'round(avg({_RATIOS[n]}), 5) as macro_{n}' for n in _CLASS_RATIOS)}, round((avg({_RATIOS['recall']}) + avg({_RATIOS['specificity']})) / 2, 5) as macro_balanced_accuracy from {_CLASS_SQL}")
def agg_classification_eval(spark, d):
    return mt.classification_evaluation(predicted_classes(spark, d), "t", "p", 10)


@query("agg_regression_eval", """with b as (select o_totalprice::float::double as t, o_totalprice::float::double - (250000 + (o_custkey % 100) * 17.5)::float::double as r from orders),
    f as (select count(*) as n, avg(r * r) as mse, avg(abs(r)) as mae, median(abs(r)) as medae, max(abs(r)) as maxe, avg(case when abs(t) > 1e-12 then abs(r) / abs(t) end) as mape, avg(r) as rm, stddev_samp(r) as rs, sum(r * r) as res, count(*) * var_pop(t) as tot from b),
    g as (select avg(case when abs(r) <= rs then r * r end) as b1, avg(case when abs(r) <= 2 * rs then r * r end) as b2, avg(case when abs(r) <= 3 * rs then r * r end) as b3 from b, f)
    select n as n_samples, round(mse, 2) as mse, round(sqrt(mse), 5) as rmse, round(mae, 5) as mae, round(medae, 5) as median_ae, round(maxe, 5) as max_ae, round(100 * mape, 5) as mape, round(1 - res / tot, 5) as r2, round(rm, 5) as residual_mean, round(rs, 5) as residual_std, round(b1, 2) as mse_1_sigma, round(b2, 2) as mse_2_sigma, round(b3, 2) as mse_3_sigma from f, g""")
def agg_regression_eval(spark, d):
    df = table(spark, d, "orders").select(F.col("o_totalprice").alias("t"), (250000 + F.col("o_custkey") % 100 * 17.5).alias("p"))
    out = mt.regression_evaluation(df, "t", "p")
    return out.select(*(F.round(c, 2).alias(c) if c.startswith("mse") else F.col(c) for c in out.columns))


_GRID_SQL = "(select i // 64 % 64 as py, i % 64 as px, case when i // 64 % 64 % 16 = 8 and i % 64 % 16 = 8 then 1 else 0 end as pt, exp(-((i // 64 % 64 % 16 - 8) ** 2 + (i % 64 % 16 - 8) ** 2) / 8.0) as z, (i * 37 % 101) / 101.0 as s from range(4096) g(i))"


@query("agg_keypoints_eval", f"""select n_points, tp, fp, fn, round(c, 5) as peak_confidence, round(p, 5) as precision, round(rc, 5) as recall, round({_div('2 * p * rc', 'p + rc')}, 5) as f1, round(e, 5) as zone_mae from
    (select *, {_div('tp', 'tp + fp')} as p, {_div('tp', 'n_points')} as rc from (select sum(pt)::bigint as n_points, sum((z > 0.1 and s > 0.5)::int)::bigint as tp, sum((z <= 0.1 and s > 0.5)::int)::bigint as fp, sum((pt = 1 and s <= 0.5)::int)::bigint as fn, avg(case when pt = 1 then s end) as c, avg(case when z > 0.1 then abs(z - s) end) as e from {_GRID_SQL}))""")
def agg_keypoints_eval(spark, d):
    g = spark.range(4096).select((F.floor(F.col("id") / 64) % 64).alias("py"), (F.col("id") % 64).alias("px"), "id")
    dy, dx = F.col("py") % 16 - 8, F.col("px") % 16 - 8
    g = g.select(((dy == 0) & (dx == 0)).cast("int").alias("pt"), F.exp(-(dy * dy + dx * dx) / 8.0).alias("z"), (F.col("id") * 37 % 101 / 101.0).alias("s"))
    return mt.keypoints_evaluation(g, "pt", "z", "s")


_CELLS = [(i, j) for i in range(4) for j in range(4)]


@query("agg_gram", " union all ".join(f"select {i} as i, {j} as j, round(sum({F4[i]} * {F4[j]}) / count(*), 4) as v from lineitem" for i, j in _CELLS))
def agg_gram(spark, d):
    s = rg.gram(table(spark, d, "lineitem"), [F.col(c) for c in F4])
    return spark.createDataFrame([(i, j, round(float(s.g[i, j] / s.n), 4)) for i, j in _CELLS], "i int, j int, v double")


@query("agg_histogram_50", "with m as (select min(value) as lo, max(value) as hi from events), h as (select least(49, floor((value - lo) / ((hi - lo) / 50)))::int as bin, count(*) as n from events, m group by 1) select k::int as bin, coalesce(n, 0) as n from range(50) g(k) left join h on h.bin = k")
def agg_histogram_50(spark, d):
    return mt.histogram(table(spark, d, "events"), "value")


@query("agg_percentiles", "select event_type, round(avg(value), 5) as mean, round(stddev_pop(value), 5) as std, round(quantile_cont(value, 0.68), 5) as p68, round(quantile_cont(value, 0.95), 5) as p95, round(quantile_cont(value, 0.997), 5) as p997, round(max(value), 5) as max from events group by event_type")
def agg_percentiles(spark, d):
    return mt.timing_summary(table(spark, d, "events"), "value", ["event_type"])


_SOFT_SQL = "(select vec_id, label, list_transform(list_transform(embedding[1:10], lambda v: exp(20 * (v::double - list_max(embedding[1:10])::double))), lambda e: e / list_sum(list_transform(embedding[1:10], lambda v: exp(20 * (v::double - list_max(embedding[1:10])::double))))) as p from embeddings)"


def probabilities(spark, d) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * 20)
    return table(spark, d, "embeddings").withColumn("l", logits).select("vec_id", "label", dc.softmax(F.col("l")).alias("p"))


@query("agg_softmax_entropy", f"select round(avg(e), 5) as entropy, round(avg(case when hit then e end), 5) as entropy_correct, round(avg(case when not hit then e end), 5) as entropy_incorrect from (select -list_sum(list_transform(p, lambda v: v * ln(v + 1e-15))) as e, list_position(p, list_max(p)) - 1 = label as hit from {_SOFT_SQL})")
def agg_softmax_entropy(spark, d):
    hit, e = mt.argmax(F.col("p")) == F.col("label"), dc.entropy(F.col("p"))
    return probabilities(spark, d).select(e.alias("e"), hit.alias("hit")).agg(F.round(F.avg("e"), 5).alias("entropy"), F.round(F.avg(F.when(F.col("hit"), F.col("e"))), 5).alias("entropy_correct"), F.round(F.avg(F.when(~F.col("hit"), F.col("e"))), 5).alias("entropy_incorrect"))


@query("agg_blind_spots", f"select vec_id, case when hit then 'weak' else 'wrong' end as kind, round(c, 5) as confidence from (select vec_id, list_max(p) as c, list_position(p, list_max(p)) - 1 = label as hit from {_SOFT_SQL}) where (not hit and c >= 0.8) or (hit and c <= 0.5)")
def agg_blind_spots(spark, d):
    df = probabilities(spark, d).select("vec_id", F.array_max("p").alias("c"), (mt.argmax(F.col("p")) == F.col("label")).alias("hit"))
    return df.where((~F.col("hit") & (F.col("c") >= 0.8)) | (F.col("hit") & (F.col("c") <= 0.5))).select("vec_id", F.when(F.col("hit"), "weak").otherwise("wrong").alias("kind"), F.round("c", 5).alias("confidence"))


@query("agg_class_counts", "select quality, toxic, count(*) as n from labels group by all")
def agg_class_counts(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("agg_tracking_cost", f"select user_id, round(sum(value * value), 4) as control_cost, round(sum((value - m) * (value - m)), 4) as tracking_cost from (select *, avg(value) over (partition by user_id) as m from {EV_SQL}) group by user_id")
def agg_tracking_cost(spark, d):
    s = events(spark, d).groupBy("user_id").agg(F.sum(F.col("value") ** 2).alias("a"), (F.count("*") * F.var_pop("value")).alias("b"))
    return s.select("user_id", F.round("a", 4).alias("control_cost"), F.round("b", 4).alias("tracking_cost"))


@query("agg_burn_in_error", f"select user_id, round(avg((value - 50) * (value - 50)), 5) as mse, round(avg(abs(value - 50)), 5) as mae from {EV_SQL} where seq > 20 group by user_id")
def agg_burn_in_error(spark, d):
    df = events(spark, d).withColumn("seq", F.row_number().over(se.order("user_id", BY))).where("seq > 20")
    return df.groupBy("user_id").agg(F.round(F.avg((F.col("value") - 50) ** 2), 5).alias("mse"), F.round(F.avg(F.abs(F.col("value") - 50)), 5).alias("mae"))


# Thresholds, sorts, sets, joins ------------------------------------------------------------------------------------


def _tune(metric: str, expr: str) -> None:
    sql = f"""with t as (select i / 99.0::double as th from range(100) g(i)), c as (select th, sum((y > 0.5 and s > th)::int) as tp, sum((y <= 0.5 and s > th)::int) as fp, sum((y > 0.5 and s <= th)::int) as fn, sum((y <= 0.5 and s <= th)::int) as tn from t, {SCORED_SQL} group by th)
        select round(th, 5) as threshold, round(v, 5) as value from (select th, round({expr}, 12) as v from c) order by v desc, th limit 1"""
    query(f"tune_threshold_{metric}", sql)(lambda spark, d: mt.tune_threshold(scored(spark, d), "y", "s", metric))


_tune("f1", _RATIOS["f1"])
_tune("mcc", _RATIOS["mcc"])
_tune("youden", f"{_RATIOS['recall']} + {_RATIOS['specificity']} - 1")


@query("srt_topk_scores", f"select id, s from {SCORED_SQL} order by s desc, id limit 20")
def srt_topk_scores(spark, d):
    return scored(spark, d).select("id", "s").orderBy(F.desc("s"), "id").limit(20)


@query("fil_score_threshold", f"select id, s from {SCORED_SQL} where s > 0.77")
def fil_score_threshold(spark, d):
    return scored(spark, d).where(mt.above(F.col("s"), 0.77)).select("id", "s")


@query("set_collate", "select c_custkey as id, c_acctbal as bal, 0 as source_id, c_custkey as global_id from customer union all select s_suppkey, s_acctbal, 1, s_suppkey + (select count(*) from customer) from supplier")
def set_collate(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return sm.collated([a, b], "id")


@query("jon_score_label_inner", "select doc_id, n_chars, quality, toxic from documents join labels using (doc_id)")
def jon_score_label_inner(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "quality", "toxic")


@query("jon_unscored_anti", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def jon_unscored_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


# Samples and splits ------------------------------------------------------------------------------------------------


@query("smp_without_replacement", f"select o_orderkey from (select o_orderkey, row_number() over (order by {sm.mix_sql('o_orderkey', 7)}, o_orderkey) as k from orders) where k <= 500")
def smp_without_replacement(spark, d):
    return sm.first_by_hash(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 7)


@query("smp_per_draw", f"select draw::int as draw, o_orderkey from (select draw, o_orderkey, row_number() over (partition by draw order by {sm.mix_sql('o_orderkey', 3, 'draw')}, o_orderkey) as k from orders, range(8) g(draw)) where k <= 100")
def smp_per_draw(spark, d):
    return sm.per_draw(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8, 100, 3).select("draw", "o_orderkey")


@query("smp_with_replacement", f"select o_orderkey, slot, draw, o_totalprice from (select (i // 300)::int as draw, i % 300 as slot, {sm.mix_sql('i', 5)} % (select count(*) from orders) as o_orderkey from range(1200) g(i)) join orders using (o_orderkey)")
def smp_with_replacement(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sm.with_replacement(orders, "o_orderkey", orders.count(), 300, 5, 4)


@query("smp_balanced", f"""with c as (select toxic, count(*) as n, row_number() over (order by toxic) - 1 as k from labels where toxic is not null group by toxic), r as (select toxic, doc_id, quality, row_number() over (partition by toxic order by doc_id) - 1 as rank from labels),
    s as (select i as slot, {sm.mix_sql('i', 11)} % (select count(*) from c) as k, {sm.mix_sql('i', 12)} as h from range(400) g(i))
    select toxic, slot, doc_id, quality from s join c using (k) join r using (toxic) where r.rank = h % n""")
def smp_balanced(spark, d):
    return sm.balanced(table(spark, d, "labels"), "doc_id", "toxic", 400, 11)


@query("spl_ratio", f"select o_orderkey, row_number() over (order by {sm.mix_sql('o_orderkey', 1)}, o_orderkey) <= floor(0.8 * (select count(*) from orders)) as train from orders")
def spl_ratio(spark, d):
    return sm.split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, 1)


@query("spl_chronological", f"select user_id, event_id, seq <= floor(0.8 * n) as train from {EV_SQL}")
def spl_chronological(spark, d):
    return sm.chronological(events(spark, d), BY, 0.8, "user_id").select("user_id", "event_id", "train")


# Windows, series, filters ------------------------------------------------------------------------------------------


@query("win_sliding", f"select user_id, event_id, round(list_sum(w), 4) as total, w[1] as first, w[5] as last from (select *, list(value) over (partition by user_id order by ts, event_id rows between current row and 4 following) as w from {EV_SQL}) where seq <= n - 5")
def win_sliding(spark, d):
    w = se.sliding(events(spark, d), "user_id", BY, "value", 5)
    return w.select("user_id", "event_id", F.round(F.aggregate("window", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.get("window", F.lit(0)).alias("first"), F.get("window", F.lit(4)).alias("last"))


@query("win_sliding_horizon", f"select user_id, event_id, w[5] as last, target from (select *, list(value) over (partition by user_id order by ts, event_id rows between current row and 4 following) as w, lead(value, 6) over (partition by user_id order by ts, event_id) as target from {EV_SQL}) where seq <= n - 6")
def win_sliding_horizon(spark, d):
    w = se.sliding(events(spark, d), "user_id", BY, "value", 5, horizon=2)
    return w.select("user_id", "event_id", F.get("window", F.lit(4)).alias("last"), "target")


_OVER = "over (partition by user_id order by ts, event_id)"


@query("win_lagged_features", f"select user_id, event_id, value_lag0, value_lag1, value_lag2, value_next from (select *, value as value_lag0, lag(value, 1) {_OVER} as value_lag1, lag(value, 2) {_OVER} as value_lag2, lead(value) {_OVER} as value_next from {EV_SQL}) where seq > 2 and seq < n")
def win_lagged_features(spark, d):
    return se.lagged(events(spark, d), "user_id", BY, ["value"], lags=2).select("user_id", "event_id", "value_lag0", "value_lag1", "value_lag2", "value_next")


@query("win_hankel", f"select user_id, event_id, h0, h1, h2 from (select *, value as h0, lead(value, 1) {_OVER} as h1, lead(value, 2) {_OVER} as h2 from {EV_SQL}) where seq <= n - 2")
def win_hankel(spark, d):
    return se.hankel(events(spark, d), "user_id", BY, "value", 3).select("user_id", "event_id", "h0", "h1", "h2")


@query("win_cumulative_integral", f"select user_id, event_id, round(coalesce(sum(value * 0.1) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0.0), 6) as integral from {EV_SQL}")
def win_cumulative_integral(spark, d):
    return se.integrated(events(spark, d), "user_id", BY, "value", 0.1).select("user_id", "event_id", F.round("integral", 6).alias("integral"))


@query("win_gradient", f"select user_id, event_id, round(coalesce((b - a) / 0.2, (b - value) / 0.1, (value - a) / 0.1, 0.0), 6) as gradient from (select *, lag(value) {_OVER} as a, lead(value) {_OVER} as b from {EV_SQL})")
def win_gradient(spark, d):
    return se.gradient(events(spark, d), "user_id", BY, "value", 0.1).select("user_id", "event_id", F.round("gradient", 6).alias("gradient"))


def _recurrence(chain: dict[str, str], start: dict[str, float], outs: str, gains: str = "", tables: str = "", last: bool = False) -> str:
    """A recurrence along each user's events (row e). ``chain`` computes new values one after the other from those before (p_...),
    which are ``start`` on the first row; ``gains`` are common tables, ``tables`` those of them that a step reads."""
    more = "".join(f", {t}.*" for t in tables.split())
    join = "".join(f", {t}" for t in tables.split())
    step = ", ".join(f"{e} as {n}" for n, e in chain.items())
    names = ", ".join(start)
    first = f"select e.user_id, e.event_id, e.seq, e.value{more}, {', '.join(f'{v}::double as p_{n}' for n, v in start.items())} from e{join} where e.seq = 1"
    then = f"select e.user_id, e.event_id, e.seq, e.value{more}, {', '.join(f's.{n} as p_{n}' for n in start)} from s join e on e.user_id = s.user_id and e.seq = s.seq + 1{join}"
    each = f"select {names}, user_id, event_id, seq from (select *, {step} from ({{}}))"
    return f"with recursive {gains + ', ' if gains else ''}e as {EV_SQL}, s({names}, user_id, event_id, seq) as ({each.format(first)} union all {each.format(then)}) select {outs} from s"


def _riccati(name: str, a: tuple, b: tuple, q: tuple, r: float, steps: int = 600) -> str:
    """Common tables that iterate the Riccati equation of two states and one input in SQL. ``name`` has the gain (k1, k2) of a regulator
    with A = a (by row), B = b, Q = diag q; and, for A and B transposed from those of an observer, its gain (l1, l2)."""
    parts = f"""select i, {a[0]} * m11 + {a[2]} * m21 + {q[0]} as x11, {a[0]} * m12 + {a[2]} * m22 as x12, {a[1]} * m12 + {a[3]} * m22 + {q[1]} as x22,
        {b[0]} * m11 + {b[1]} * m21 as g1, {b[0]} * m12 + {b[1]} * m22 as g2, {b[0]} * p11 + {b[1]} * p12 as h1, {b[0]} * p12 + {b[1]} * p22 as h2, {r} + {b[0]} * ({b[0]} * p11 + {b[1]} * p12) + {b[1]} * ({b[0]} * p12 + {b[1]} * p22) as s
        from (select *, p11 * {a[0]} + p12 * {a[2]} as m11, p11 * {a[1]} + p12 * {a[3]} as m12, p12 * {a[0]} + p22 * {a[2]} as m21, p12 * {a[1]} + p22 * {a[3]} as m22 from {name}_it)"""
    return f"""{name}_it(i, p11, p12, p22) as (select 0, {q[0]}::double, 0::double, {q[1]}::double union all select i + 1, x11 - g1 * g1 / s, x12 - g1 * g2 / s, x22 - g2 * g2 / s from ({parts}) where i < {steps}),
        {name} as (select g1 / s as {name}1, g2 / s as {name}2, h1 / s as {name}l1, h2 / s as {name}l2 from ({parts}) where i = {steps})"""


def _clip(e: str, most: float) -> str:
    return f"greatest(-{most}::double, least({most}::double, {e}))"


def _along(spark, d, kernel, **inputs) -> DataFrame:
    """A kernel along each user's events; inputs are columns of the events."""
    df = events(spark, d).withColumns({f"in_{n}": c.cast("double") for n, c in inputs.items()})
    return rounded(fl.filtered(df, kernel, "user_id", BY, [f"in_{n}" for n in inputs]).select("user_id", "event_id", *kernel.outputs))


def _steered(name: str, kernel, inputs: dict, sql: str) -> None:
    query(name, sql)(lambda spark, d: _along(spark, d, kernel(), **{n: c() for n, c in inputs.items()}))


_ID = "user_id, event_id"
_VALUE, _FIFTY, _ZERO = (lambda: F.col("value")), (lambda: F.lit(50.0)), (lambda: F.lit(0.0))


@query("win_ema", _recurrence({"y": "case when seq = 1 then value else 0.2::double * value + 0.8::double * p_y end"}, {"y": 0}, f"{_ID}, round(y, 6) as ema"))
def win_ema(spark, d):
    return se.ema(events(spark, d), "user_id", BY, "value", 0.2).select("user_id", "event_id", F.round("ema", 6).alias("ema"))


# Second-order sections at 0.4 radians a sample: the numerators of the audio cookbook over 1 + alpha.
_SECTIONS = {"low_pass": ("(1 - c) / 2", "1 - c", "(1 - c) / 2"), "high_pass": ("(1 + c) / 2", "-1 - c", "(1 + c) / 2"), "band_pass": ("alpha", "0", "-alpha"), "band_stop": ("1", "-2 * c", "1")}


def _section(kind: str) -> str:
    b = _SECTIONS[kind]
    q = "sqrt(0.5)" if kind in ("low_pass", "high_pass") else "1.0"
    return f"g as (select ({b[0]}) / (1 + alpha) as b0, ({b[1]}) / (1 + alpha) as b1, ({b[2]}) / (1 + alpha) as b2, -2 * c / (1 + alpha) as a1, (1 - alpha) / (1 + alpha) as a2 from (select cos(0.4::double) as c, sin(0.4::double) / (2 * {q}) as alpha))"


for _kind in _SECTIONS:
    _steered(
        "flt_biquad_" + _kind.replace("_", ""), lambda kind=_kind: fl.Biquad.design(kind, 0.4), {"x": _VALUE},
        _recurrence({"y": "b0 * value + p_w1", "w1": "b1 * value - a1 * y + p_w2", "w2": "b2 * value - a2 * y"}, {"y": 0, "w1": 0, "w2": 0}, f"{_ID}, round(y, 6) as y", _section(_kind), "g"),
    )


@query("flt_frequency_response", f"""with {_section("low_pass")}, p as (select i, i * pi() / 63 as w from range(64) t(i)), q as (select i, w, b0 + b1 * cos(w) + b2 * cos(2 * w) as nr, -(b1 * sin(w) + b2 * sin(2 * w)) as ni, 1 + a1 * cos(w) + a2 * cos(2 * w) as dr, -(a1 * sin(w) + a2 * sin(2 * w)) as di from p, g)
    select i, round(w, 6) as w, round((nr * dr + ni * di) / (dr * dr + di * di), 6) + 0.0 as re, round((ni * dr - nr * di) / (dr * dr + di * di), 6) + 0.0 as im from q""")
def flt_frequency_response(spark, d):
    w, z = fl.Biquad.design("low_pass", 0.4).response(64)
    return spark.createDataFrame([(i, round(float(w[i]), 6), round(float(z[i].real), 6) + 0.0, round(float(z[i].imag), 6) + 0.0) for i in range(64)], "i long, w double, re double, im double")


# A constant-velocity model observed in its place; the SQL iterates its gain.
def _velocity(make, **more):
    return make(np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[0.0], [0.0]]), np.array([[1.0, 0.0]]), np.diag([0.01, 0.01]), np.array([[4.0]]), **more)


_CV_SQL = _riccati("g", (1, 0, 1, 1), (1, 0), (0.01, 0.01), 4)
_CV_STEP = {"f0": "p_p + gl1 * (value - p_p)", "f1": "p_w + gl2 * (value - p_p)", "p": "f0 + f1", "w": "f1"}
_CV_START = dict.fromkeys(_CV_STEP, 0)
_steered("flt_kalman_cv", lambda: _velocity(fl.Kalman), {"y": _VALUE, "u": _ZERO}, _recurrence(_CV_STEP, _CV_START, f"{_ID}, round(f0, 6) as x0, round(f1, 6) as x1", _CV_SQL, "g"))
_steered(
    "flt_kalman_alarm", lambda: _velocity(fl.KalmanAlarm), {"y": _VALUE, "u": _ZERO},
    _recurrence({"p": "p_p + p_w + gl1 * (value - p_p)", "w": "p_w + gl2 * (value - p_p)", "far": "(value - p) * (value - p) / 4", "alarm": "0.99 * p_alarm + 0.01 * (far > 6.6348966010212145)::int"}, {"p": 0, "w": 0, "far": 0, "alarm": 0}, f"{_ID}, round(p, 6) as x0, round(w, 6) as x1, round(far, 6) as distance, round(alarm, 6) as alarm", _CV_SQL, "g"),
)


@query("flt_kalman_forecast", f"select user_id, h::int as step, round(p + w * h, 5) as y from ({_recurrence(_CV_STEP, _CV_START, 'user_id, seq, p, w', _CV_SQL, 'g')}) join (select user_id, count(*) as seq from events group by user_id) using (user_id, seq), range(1, 6) t(h)")
def flt_kalman_forecast(spark, d):
    out = fl.forecasted(events(spark, d).withColumn("u", F.lit(0.0)), _velocity(fl.Kalman), "user_id", BY, ["value", "u"], [[0.0]] * 5)
    return out.select("user_id", "step", F.round("y0", 5).alias("y"))


_steered(
    "flt_madgwick", lambda: fl.Madgwick(0.1),
    {"ax": lambda: F.col("value") / 100 - 0.5, "ay": lambda: (F.col("event_id") % 5 - 2) / 10, "az": lambda: F.lit(1.0), "gx": lambda: F.lit(0.1), "gy": lambda: (F.col("event_id") % 3 - 1) / 5, "gz": lambda: F.lit(0.05), "dt": lambda: F.lit(0.1)},
    _recurrence(
        {
            "ax": "value / 100 - 0.5::double", "ay": "(event_id % 5 - 2) / 10.0::double", "gy": "(event_id % 3 - 1) / 5.0::double", "n": "sqrt(ax * ax + ay * ay + 1)",
            "fx": "2 * (p_x * p_z - p_w * p_y) - ax / n", "fy": "2 * (p_w * p_x + p_y * p_z) - ay / n", "fz": "1 - 2 * (p_x * p_x + p_y * p_y) - 1 / n",
            "sw": "2 * (p_x * fy - p_y * fx)", "sx": "2 * (p_z * fx + p_w * fy - 2 * p_x * fz)", "sy": "2 * (p_z * fy - p_w * fx - 2 * p_y * fz)", "sz": "2 * (p_x * fx + p_y * fy)", "m": "sqrt(sw * sw + sx * sx + sy * sy + sz * sz)",
            "vw": "p_w + 0.1::double * (0.5::double * (-p_x * 0.1::double - p_y * gy - p_z * 0.05::double) - 0.1::double * sw / m)", "vx": "p_x + 0.1::double * (0.5::double * (p_w * 0.1::double + p_y * 0.05::double - p_z * gy) - 0.1::double * sx / m)",
            "vy": "p_y + 0.1::double * (0.5::double * (p_w * gy - p_x * 0.05::double + p_z * 0.1::double) - 0.1::double * sy / m)", "vz": "p_z + 0.1::double * (0.5::double * (p_w * 0.05::double + p_x * gy - p_y * 0.1::double) - 0.1::double * sz / m)",
            "size": "sqrt(vw * vw + vx * vx + vy * vy + vz * vz)", "w": "vw / size", "x": "vx / size", "y": "vy / size", "z": "vz / size",
        },
        {"w": 1, "x": 0, "y": 0, "z": 0}, f"{_ID}, round(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), 6) as roll, round(asin(greatest(-1.0, least(1.0, 2 * (w * y - z * x)))), 6) as pitch, round(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 6) as yaw",
    ),
)

_steered("ctl_pid_textbook", lambda: fl.PidTextbook(0.5, 0.01, 0.1), {"xr": _FIFTY, "x": _VALUE}, f"select user_id, event_id, round(0.5 * e + 0.01 * sum(e) over (partition by user_id order by ts, event_id rows unbounded preceding) + 0.1 * (e - coalesce(lag(e) {_OVER}, 0)), 6) as u from (select *, 50 - value as e from {EV_SQL})")
_steered(
    "ctl_pid_incremental", lambda: fl.Pid(0.5, 0.01, 0.1, 100.0), {"xr": _FIFTY, "x": _VALUE, "u_prev": lambda: F.lag("value", 1, 0.0).over(se.order("user_id", BY))},
    f"select user_id, event_id, round(greatest(-100.0, least(100.0, coalesce(lag(value) {_OVER}, 0) + 0.61 * e - 0.7 * coalesce(lag(e, 1) {_OVER}, 0) + 0.1 * coalesce(lag(e, 2) {_OVER}, 0))), 6) as u from (select *, 50 - value as e from {EV_SQL})",
)
_steered(
    "ctl_lqr_static", lambda: fl.Lqr(np.array([[1.0, 0.1], [0.0, 1.0]]), np.array([[0.0], [0.1]]), np.eye(2), np.eye(1), 12.0), {"xr0": lambda: F.lit(5.0), "xr1": _ZERO, "x0": lambda: F.col("value") / 10, "x1": lambda: F.col("event_id") % 10},
    f"with recursive {_riccati('k', (1, 0.1, 0, 1), (0, 0.1), (1, 1), 1)} select user_id, event_id, round({_clip('k1 * (5 - value / 10) - k2 * (event_id % 10)', 12)}, 6) as u0 from events, k",
)

# The plants of the other controllers: x' = 0.9 x + 0.5 u. Their gains are iterated in SQL, too.
_A, _B, _HALF, _ONE = np.array([[0.9]]), np.array([[0.5]]), np.array([[0.5]]), np.eye(1)
_TRACK = {"xr": _FIFTY, "x": _VALUE}
_steered(
    "ctl_lqr_integral", lambda: fl.LqrIntegral(_A, _B, _ONE, _HALF, q_scale=0.5, u_max=40.0), _TRACK,
    _recurrence({"z0": "p_z + k2 * (50 - value)", "free": "z0 - k1 * value", "u": _clip("free", 40), "z": "z0 - (free - u)"}, {"u": 0, "z": 0}, f"{_ID}, round(u, 6) as u0", _riccati("k", (0.9, 0, 1, 1), (0.5, 0), (1, 0.5), 0.5), "k"),
)
_steered(
    "ctl_lqr_increment", lambda: fl.LqrIncrement(_A, _B, _ONE, _HALF, 0.1, 30.0), _TRACK,
    _recurrence({"u": _clip("p_u + k1 * (50 - value) - k2 * p_u", 30)}, {"u": 0}, f"{_ID}, round(u, 6) as u0", _riccati("k", (0.9, 0.5, 0, 1), (0, 1), (1, 0.1), 0.5), "k"),
)
_steered(
    "ctl_lqr_disturbance", lambda: fl.LqrDisturbance(_A, _B, _ONE, _HALF, np.diag([0.1, 0.05]), _ONE), _TRACK,
    _recurrence({"x0": "0.9 * p_x + 0.5 * p_d + 0.5 * p_u", "x": "x0 + ol1 * (value - x0)", "d": "p_d + ol2 * (value - x0)", "u": "k1 * (50 - value) - d"}, {"x": 0, "d": 0, "u": 0}, f"{_ID}, round(u, 6) as u0", _riccati("k", (0.9, 0, 0, 0), (0.5, 0), (1, 0), 0.5) + ", " + _riccati("o", (0.9, 0, 0.5, 1), (1, 0), (0.1, 0.05), 1), "k o"),
)
_steered(
    "ctl_lqg", lambda: fl.Lqg(_A, _B, _ONE, _ONE, _HALF, np.array([[0.2]]), _ONE, 60.0, 5.0), _TRACK,
    _recurrence({"sums": f"p_z + {_clip('k2 * (50 - value)', 5)}", "free": "sums - k1 * p_x", "u": _clip("free", 60), "z": "sums + u - free", "x": "0.9 * p_x + 0.5 * u + ol1 * (value - p_x)"}, {"u": 0, "z": 0, "x": 0}, f"{_ID}, round(u, 6) as u0", _riccati("k", (0.9, 0, 1, 1), (0.5, 0), (0, 1), 0.5) + ", " + _riccati("o", (0.9, 0, 0, 0), (1, 0), (0.2, 0), 1), "k o"),
)
# Three steps ahead with one input: the plan is one quotient; the projected gradient reaches the same input in its first step.
_MPC = f"select user_id, event_id, round({_clip('(0.5 * (50 - 0.9 * value) + 0.45 * (50 - 0.81 * value) + 0.405 * (50 - 0.729 * value)) / (0.25 + 0.2025 + 0.164025 + 0.5)', 45)}, 6) as u0 from events"
_steered("ctl_mpc", lambda: fl.Mpc(_A, _B, _ONE, _HALF, 3, 1, 45.0), _TRACK, _MPC)
_steered("ctl_mpc_gradient", lambda: fl.MpcGradient(_A, _B, _ONE, _HALF, predict=3, control=1, u_max=45.0), _TRACK, _MPC)
_steered(
    "ctl_adrc", lambda: fl.Adrc(1.0, 0.5, 2.0, 0.1), _TRACK | {"u_now": lambda: F.col("event_id") % 7 / 10},
    _recurrence({"z1": "p_z1 + 0.1::double * (p_z2 + 6 * (value - p_z1))", "z2": "p_z2 + 0.1::double * (p_z3 + event_id % 7 / 10.0::double + 12 * (value - p_z1))", "z3": "p_z3 + 0.1::double * 8 * (value - p_z1)"}, {"z1": 0, "z2": 0, "z3": 0}, f"{_ID}, round(0.25::double * (50 - z1) - z2 - z3, 6) as u"),
)


@query("ctl_koopman", f"select user_id, event_id, round(-(0.3 * value + 0.2 * coalesce(lag(value, 1) {_OVER}, 0) + 0.1 * coalesce(lag(value, 2) {_OVER}, 0)), 6) as u from {EV_SQL}")
def ctl_koopman(spark, d):
    out = fl.filtered(events(spark, d), fl.KoopmanLqr([0.3, 0.2, 0.1]), "user_id", BY, ["value"])
    return rounded(out.select("user_id", "event_id", "u"))


# All events of a user in blocks of 16; the last one has what is left.
_BLOCKS = f"(select user_id, (seq - 1) // 16 as block, (seq - 1) % 16 as i, least(16, n - (seq - 1) // 16 * 16) as n, value from {EV_SQL})"


def _blocks(spark, d) -> DataFrame:
    return se.blocks(events(spark, d), "user_id", BY, "value", 16)


@query("dsp_tukey", f"select user_id, block, i::int as i, round(value * case when n = 1 then 1.0 when least(i, n - 1 - i) < (n - 1) / 4.0 then 0.5 * (1 + cos(pi() * (least(i, n - 1 - i) / ((n - 1) / 4.0) - 1))) else 1.0 end, 6) as v from {_BLOCKS}")
def dsp_tukey(spark, d):
    return se.tapered(_blocks(spark, d), "x").select("user_id", "block", F.posexplode("x").alias("i", "v")).select("user_id", "block", "i", F.round("v", 6).alias("v"))


@query("dsp_rfft16", f"select user_id, block, k::int as k, round(sum(value * cos(2 * pi() * k * i / n)), 5) + 0.0 as re, round(-sum(value * sin(2 * pi() * k * i / n)), 5) + 0.0 as im from {_BLOCKS}, range(9) g(k) where k <= n // 2 group by user_id, block, k")
def dsp_rfft16(spark, d):
    s = se.spectrum(_blocks(spark, d), "x").select("user_id", "block", F.posexplode(F.arrays_zip("re", "im")).alias("k", "c"))
    return s.select("user_id", "block", "k", (F.round("c.re", 5) + 0.0).alias("re"), (F.round("c.im", 5) + 0.0).alias("im"))


@query("sim_reference_trajectory", "select n, h::int as h, case (n + h) // 250 % 4 when 0 then 1.0 when 1 then 1.0 when 2 then -1.0 else -1.0 end::double as xr, case (n + h) // 250 % 4 when 0 then 1.0 when 1 then -1.0 when 2 then -1.0 else 1.0 end::double as yr from range(1000) g(n), range(8) k(h)")
def sim_reference_trajectory(spark, d):
    g = spark.range(1000).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("h"))
    leg = F.floor((F.col("n") + F.col("h")) / 250) % 4
    return g.select("n", "h", F.when(leg < 2, 1.0).otherwise(-1.0).alias("xr"), F.when((leg == 0) | (leg == 3), 1.0).otherwise(-1.0).alias("yr"))


@query("sim_lorenz", "with recursive s(seq, x, y, z) as (select 0::bigint, 1.0::double, 1.0::double, 1.0::double union all select seq + 1, x + 0.01::double * (10 * (y - x)), y + 0.01::double * (x * (28 - z) - y), z + 0.01::double * (x * y - (8.0 / 3)::double * z) from s where seq < 199) select seq, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from s")
def sim_lorenz(spark, d):
    t = src.trajectories(spark, 200, [[1.0, 1.0, 1.0]], src.lorenz(), 0.01)
    return t.select("seq", *(F.round(F.get("x", F.lit(i)), 4).alias(c) for i, c in enumerate("xyz")))


@query("emb_variance_hinge", "select round(avg(greatest(0.0, 1.0 - s)), 5) as std_hinge, count(*) as n_dims from (select d, stddev_samp(v) as s from (select unnest(range(64)) as d, unnest(embedding)::double as v from embeddings) group by d)")
def emb_variance_hinge(spark, d):
    return mt.variance_hinge(table(spark, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("v")), "v")


@query("emb_covariance_offdiag", "with e as (select vec_id, unnest(range(64)) as d, unnest(embedding)::double as v from embeddings), c as (select a.d as i, b.d as j, covar_samp(a.v, b.v) as c from e a join e b using (vec_id) where a.d <> b.d group by all) select round(sum(c * c) / 64, 6) as covariance from c")
def emb_covariance_offdiag(spark, d):
    df = table(spark, d, "embeddings")
    one = F.lit(1.0)
    s = rg.gram(df, [*(F.get("embedding", F.lit(i)) for i in range(64)), one])
    n = max(2, s.n)
    mean = s.g[:64, 64] / n
    cov = (s.g[:64, :64] - n * np.outer(mean, mean)) / (n - 1)
    return spark.createDataFrame([(round(float((cov**2).sum() - (np.diag(cov) ** 2).sum()) / 64, 6),)], "covariance double")


# Regression, identification, trees ---------------------------------------------------------------------------------


@query("reg_ols_1d", "select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem")
def reg_ols_1d(spark, d):
    w = rg.ols(rg.gram(table(spark, d, "lineitem"), [F.col("l_quantity"), F.lit(1.0)], [F.col("l_extendedprice")]))
    return spark.createDataFrame([(round(float(w[0, 0]), 4), round(float(w[1, 0]), 3))], "slope double, intercept double")


@query("reg_ols_by_key", "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem group by l_returnflag")
def reg_ols_by_key(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@query("reg_predict_sparse", f"select o_orderkey, round(x0 * 1.5 - x2 * 0.25, 6) as y0, round(x1 * 2.0, 6) as y1 from {X_SQL}")
def reg_predict_sparse(spark, d):
    y = rg.predicted([F.col(c) for c in X], np.array([[1.5, 0.0], [0.0, 2.0], [-0.25, 0.0]]))
    return points(spark, d).select("o_orderkey", *(F.round(c, 6).alias(f"y{i}") for i, c in enumerate(y)))


def _planted(spark, d):
    """Features of a dictionary, and an output that three of them make."""
    node = dc.Concatenate([dc.Identity(), dc.Constant(), dc.CrossTerms()])
    df = dc.apply(points(spark, d), node, X, ["o_orderkey"])
    z = [F.col(f"z{i}") for i in range(10)]
    return df, z, 1.5 * z[0] + 0.8 * z[3] - 2.0 * z[5]


def _coefficients(spark, w) -> DataFrame:
    return spark.createDataFrame([(i, j, round(float(v), 5) + 0.0) for i, row in enumerate(w) for j, v in enumerate(row)], "feature int, output int, coef double")


_PLANTED = "select i::int as feature, 0 as output, case i when 0 then 1.5 when 3 then 0.8 when 5 then -2.0 else 0.0 end::double as coef from range(10) g(i)"
for _name, _solve in {"reg_ols": rg.ols, "reg_greedy": lambda s: rg.greedy(s, density=0.3)}.items():

    @query(_name, _PLANTED)
    def _regression(spark, d, solve=_solve):  # noqa: ANN001
        df, z, y = _planted(spark, d)
        return _coefficients(spark, solve(rg.gram(df, z, [y])))


# These shrink what they find: what SQL can state of them is how far from the planted values they may be.
for _name, (_solve, _near) in {"reg_lasso": (lambda s: rg.lasso(s, 1e-3), 0.1), "reg_sr3": (lambda s: rg.sr3(s, 0.1, 5.0, 500), 0.05)}.items():

    @query(_name, f"select feature, output, true as near from ({_PLANTED})")
    def _sparse(spark, d, solve=_solve, near=_near):  # noqa: ANN001
        df, z, y = _planted(spark, d)
        true = {0: 1.5, 3: 0.8, 5: -2.0}
        return spark.createDataFrame([(i, j, bool(abs(v - true.get(i, 0.0)) < near)) for i, row in enumerate(solve(rg.gram(df, z, [y]))) for j, v in enumerate(row)], "feature int, output int, near boolean")


@query("reg_path", "select 10 as steps, true as falls, true as fits")
def reg_path(spark, d):
    df, z, y = _planted(spark, d)
    models = rg.Path(num_steps=10).fit(df, z, [y], "o_orderkey").models
    loss = [m["loss"] for m in models]
    return spark.createDataFrame([(len(models), loss == sorted(loss, reverse=True), max(m["r2_score"] for m in models) > 0.99)], "steps int, falls boolean, fits boolean")


@query("sid_linear", f"""with p as (select value as a, coalesce(lag(value) {_OVER}, 0) as b, lead(value) {_OVER} as y, seq, n from {EV_SQL}), s as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as by_ from p where seq > 1 and seq < n)
    select round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 6) as a0, round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 6) as a1 from s""")
def sid_linear(spark, d):
    a, b = rg.identified(events(spark, d), "user_id", BY, ["value"], [], lags=1)
    return spark.createDataFrame([(round(float(a[0, 0]), 6), round(float(b[0, 0]), 6))], "a0 double, a1 double")


@query("ransac_inliers", f"select user_id, event_id from (select *, value as a, lead(value) {_OVER} as b from {EV_SQL}) where seq < n and abs(b - 0.9 * a) < 5")
def ransac_inliers(spark, d):
    t = se.lagged(events(spark, d), "user_id", BY, ["value"])
    return rg.with_inliers(t, ["value_lag0"], ["value_next"], np.array([[0.9]]), 5.0).where("inlier").select("user_id", "event_id")


# Ten decaying series with every seventh value spoilt: pairs of good neighbours are inliers.
@query("ransac_fit", "select round(0.9, 6)::double as a, count(*) as n_inliers from range(10) k(k), range(39) g(i) where i % 7 <> 3 and (i + 1) % 7 <> 3")
def ransac_fit(spark, d):
    i = F.floor(F.col("id") / 10)
    df = spark.range(400).select((F.col("id") % 10).alias("key"), i.alias("seq"), ((100.0 + F.col("id") % 10) * F.pow(F.lit(0.9), i) + F.when(i % 7 == 3, 50.0 + F.col("id") % 13).otherwise(0.0)).alias("x"), F.col("id").alias("row"))
    a, _, rows = rg.ransac(df, "key", ["seq"], ["x"], [], "row", hypotheses=50, tolerance=1e-6)
    return rows.agg(F.lit(round(float(a[0, 0]), 6)).alias("a"), F.count_if("inlier").alias("n_inliers"))


# Three small trees: (tree, node, depth, feature, threshold, left, right, value).
_FIXED = [
    (0, 0, 0, 0, 2.5, 1, 2, 0.0), (0, 1, 1, 1, 0.0, 3, 4, 0.0), (0, 2, 1, -1, 0.0, -1, -1, 3.0), (0, 3, 2, -1, 0.0, -1, -1, 1.0), (0, 4, 2, -1, 0.0, -1, -1, 2.0),
    (1, 0, 0, 2, 0.25, 1, 2, 0.0), (1, 1, 1, -1, 0.0, -1, -1, -1.0), (1, 2, 1, -1, 0.0, -1, -1, 1.0),
    (2, 0, 0, 1, -2.0, 1, 2, 0.0), (2, 1, 1, -1, 0.0, -1, -1, 5.0), (2, 2, 1, 0, 4.0, 3, 4, 0.0), (2, 3, 2, -1, 0.0, -1, -1, 0.0), (2, 4, 2, -1, 0.0, -1, -1, 4.0),
]


def _fixed_nodes() -> list[dict]:
    return [{"tree_id": t, "node_id": n, "depth": dp, "feature": f, "threshold": th, "weights": None, "left_id": a, "right_id": b, "size": 1, "value": [v]} for t, n, dp, f, th, a, b, v in _FIXED]


_FIXED_SQL = f"""with recursive nodes(tree, node, depth, f, th, l, r, v) as (values {", ".join(str(n) for n in _FIXED)}), x as {X_SQL},
    w as (select o_orderkey, x0, x1, x2, tree, 0 as node from x, (select distinct tree from nodes)
        union all select o_orderkey, x0, x1, x2, w.tree, case when (case f when 0 then x0 when 1 then x1 else x2 end) < th then l else r end from w join nodes on nodes.tree = w.tree and nodes.node = w.node where f >= 0)
    select o_orderkey, round(avg(v), 6) as mean, round(power(2.0, -avg(depth) / (2 * (ln(255) + 0.5772156649) - 510.0::double / 256)), 6) as isolation from w join nodes on nodes.tree = w.tree and nodes.node = w.node where f < 0 group by o_orderkey"""


@query("tre_score_fixed", _FIXED_SQL)
def tre_score_fixed(spark, d):
    df = tr.Forest(list(X), _fixed_nodes(), "mean").score(points(spark, d), "mean")
    return rounded(tr.Forest(list(X), _fixed_nodes(), "isolation", 256).score(df, "isolation").select("o_orderkey", "mean", "isolation"))


_LINE = "l_orderkey * 8 + l_linenumber"


def _lines(spark, d) -> DataFrame:
    """Line items under a number of their own, with every 101st moved far off (y = 1), and a target that features make."""
    df = table(spark, d, "lineitem").withColumn("y", (F.expr(_LINE) % 101 == 0).cast("int"))
    # line numbers repeat within an order; rows that are equal throughout may take each other's number
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*(c for c in df.columns if c not in ("l_orderkey", "l_linenumber")))
    df = df.withColumn("id", F.expr(_LINE) * 1024 + F.row_number().over(same))
    far = [(F.col(c) + F.col("y") * step).alias(c) for c, step in zip(F4, (120.0, 400000.0, 0.5, 0.4), strict=True)]
    return df.select("id", "y", *far, (F.col("l_quantity") * 3 + F.col("l_discount") * 400 - F.col("l_tax") * 100).alias("t"))


_FOUND_SQL = f"select count(*) as n, sum((({_LINE}) % 101 = 0)::int)::bigint as n_anomalies, true as separates from lineitem"
_FITS_SQL = "select count(*) as n, true as fits from lineitem"


def _separates(df: DataFrame) -> DataFrame:
    """One row: rows scored, anomalies among them, whether the area under the ROC is above 0.9."""
    return mt.anomaly_evaluation(df, "y", "score", "id").select(F.col("n_samples").alias("n"), "n_anomalies", (F.col("auc_roc") > 0.9).alias("separates"))


@query("tre_iforest_fit_score", _FOUND_SQL)
def tre_iforest_fit_score(spark, d):
    df = _lines(spark, d)
    return _separates(tr.isolation_forest(df, F4, "id", 8, 64, 256, 1, standardise=True).score(df))


@query("tre_eif_fit_score", _FOUND_SQL)
def tre_eif_fit_score(spark, d):
    df = _lines(spark, d)
    return _separates(tr.isolation_forest(df, F4, "id", 8, 32, 256, 1, oblique=True, standardise=True).score(df))


def _fits(df: DataFrame, least: float) -> DataFrame:
    """One row: rows predicted, whether R2 is above a bound."""
    return mt.regression_evaluation(df, "t", "p").select(F.col("n_samples").alias("n"), (F.col("r2") > least).alias("fits"))


_THREE = ("l_quantity", "l_discount", "l_tax")


@query("tre_rf_fit_predict", _FITS_SQL)
def tre_rf_fit_predict(spark, d):
    df = _lines(spark, d)
    return _fits(tr.random_forest(df, _THREE, ["t"], "id", 8, 16, 1024).score(df, "p"), 0.8)


@query("tre_boost_fit_predict", _FITS_SQL)
def tre_boost_fit_predict(spark, d):
    df = _lines(spark, d)
    return _fits(tr.boosted_forest(df, _THREE, ["t"], "id", 5, 24, 1024, 0.2).score(df, "p"), 0.7)


@query("ftr_series_features")
def ftr_series_features(spark, d):
    f = se.features(se.blocks(events(spark, d), "user_id", BY, "value", 64), "x", kernels=32)
    return f.select("user_id", "block", F.posexplode("features").alias("i", "v")).select("user_id", "block", "i", F.round("v", 6).alias("v"))


# Smaller forms ------------------------------------------------------------------------------------------------------


@query("prj_train_only_standardise", f"select o_orderkey, round((x0 - (select avg(x0) from {X_SQL} where o_orderkey < 0.8 * (select count(*) from orders))) / ((select stddev_pop(x0) from {X_SQL} where o_orderkey < 0.8 * (select count(*) from orders)) + 1e-8), 6) as x0 from {X_SQL}")
def prj_train_only_standardise(spark, d):
    df = points(spark, d).select("o_orderkey", "x0")
    return rounded(dc.standardised(df, ["x0"], 1e-8, df.where(F.col("o_orderkey") < 0.8 * df.count())))


@query("srt_prefix", f"select o_orderkey, x0 from {X_SQL} where o_orderkey < 100")
def srt_prefix(spark, d):
    return points(spark, d).where("o_orderkey < 100").select("o_orderkey", "x0")


@query("sim_disturbance", "select i as seq, case when i > 500 then 0.5::double + ((i * 37 % 101) / 101.0 - 0.5) * 0.2 else 0.0 end as w from range(1000) g(i)")
def sim_disturbance(spark, d):
    w = F.when(F.col("id") > 500, 0.5 + (F.col("id") * 37 % 101 / 101.0 - 0.5) * 0.2).otherwise(0.0)
    return spark.range(1000).select(F.col("id").alias("seq"), w.alias("w"))


@query("agg_detection_mean_of_groups", f"""select round(avg(tp / (tp + fp + 1e-7)), 5) as precision, round(avg(tp / (tp + fn + 1e-7)), 5) as recall, round(avg(tp / (tp + fp + fn + 1e-7)), 5) as iou, round(avg(2 * tp / (2 * tp + fp + fn + 1e-7)), 5) as dice
    from (select lang, {_COUNTS} from {LABELLED_SQL} group by lang)""")
def agg_detection_mean_of_groups(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", F.col("toxic").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("s"))
    each = df.groupBy("lang").agg(*mt.detection_counts(F.col("y"), F.col("s")))
    ratios = mt.detection_ratios(1e-7)
    return each.agg(*(F.round(F.avg(ratios[n]), 5).alias(n) for n in ("precision", "recall", "iou", "dice")))


@query("jon_class_lookup", "select event_id, case event_type when 'click' then 0 when 'error' then 1 when 'view' then 2 else -1 end as class from events")
def jon_class_lookup(spark, d):
    ids = F.create_map(*(F.lit(v) for pair in {"click": 0, "error": 1, "view": 2}.items() for v in pair))
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(ids, F.col("event_type")), F.lit(-1)).alias("class"))


@query("agg_distinct_colours", "select distinct o_custkey % 4 as r, o_orderkey % 3 as g, o_orderkey % 5 as b from orders")
def agg_distinct_colours(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("r"), (F.col("o_orderkey") % 3).alias("g"), (F.col("o_orderkey") % 5).alias("b")).distinct()


@query("jon_pixel_colours", "select o_orderkey as pixel, (o_custkey % 4 = 1 and o_orderkey % 3 = 2)::int as mask from orders")
def jon_pixel_colours(spark, d):
    pixels = table(spark, d, "orders").select(F.col("o_orderkey").alias("pixel"), (F.col("o_custkey") % 4).alias("r"), (F.col("o_orderkey") % 3).alias("g"), F.lit(0).alias("b"))
    return src.colour_mask(pixels, [(1, 2, 0)]).select("pixel", "mask")


@query("spl_first_batch", f"select round(avg(o_totalprice), 4) as base, round(stddev_pop(o_totalprice), 4) as scale from (select {sm.mix_sql('i', 9)} % (select count(*) from orders) as o_orderkey from range(512) g(i)) join orders using (o_orderkey)")
def spl_first_batch(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sm.with_replacement(orders, "o_orderkey", orders.count(), 512, 9).agg(F.round(F.avg("o_totalprice"), 4).alias("base"), F.round(F.stddev_pop("o_totalprice"), 4).alias("scale"))


@query("agg_coefficient_recovery", "select round(avg((a - b) * (a - b)), 8) as mse, sum((b <> 0)::int)::bigint as nonzero from (values (1.5, 1.49), (0.0, 0.0), (-2.0, -2.01), (0.8, 0.0)) v(a, b)")
def agg_coefficient_recovery(spark, d):
    df = spark.createDataFrame([(1.5, 1.49), (0.0, 0.0), (-2.0, -2.01), (0.8, 0.0)], "a double, b double")
    return df.agg(F.round(F.avg((F.col("a") - F.col("b")) ** 2), 8).alias("mse"), F.sum((F.col("b") != 0).cast("long")).alias("nonzero"))


@query("tre_vote_fixed", f"""with recursive nodes(tree, node, depth, f, th, l, r, v) as (values {", ".join(str(n) for n in _FIXED)}), x as {X_SQL},
    w as (select o_orderkey, x0, x1, x2, tree, 0 as node from x, (select distinct tree from nodes)
        union all select o_orderkey, x0, x1, x2, w.tree, case when (case f when 0 then x0 when 1 then x1 else x2 end) < th then l else r end from w join nodes on nodes.tree = w.tree and nodes.node = w.node where f >= 0)
    select o_orderkey, class from (select o_orderkey, v::double as class, row_number() over (partition by o_orderkey order by count(*) desc, v) as k from w join nodes on nodes.tree = w.tree and nodes.node = w.node where f < 0 group by o_orderkey, v) where k = 1""")
def tre_vote_fixed(spark, d):
    return tr.Forest(list(X), _fixed_nodes(), "vote").score(points(spark, d), "class").select("o_orderkey", "class")


@query("emb_mean_squared_difference", "select round(avg((a - b) * (a - b)), 8) as mse from (select unnest(x.embedding)::double as a, unnest(y.embedding)::double as b from embeddings x join embeddings y on y.vec_id = x.vec_id + 1)")
def emb_mean_squared_difference(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    total = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return pairs.agg(F.round(F.sum(total) / F.sum(F.size("x")), 8).alias("mse"))


# Key points, costs, outputs, closed loops ----------------------------------------------------------------------------

_WARP = "(x0 * 0.8 - x1 * 0.6 + 2.0) / (x0 * 0.01 + x1 * 0.02 + 1.0)", "(x0 * 0.6 + x1 * 0.8 + 1.0) / (x0 * 0.01 + x1 * 0.02 + 1.0)"


@query("fil_keypoints_inside", f"select o_orderkey, round(u, 6) as u, round(v, 6) as v from (select o_orderkey, {_WARP[0]} as u, {_WARP[1]} as v from {X_SQL}) where u > 1 and u < 5 and v > 1 and v < 4")
def fil_keypoints_inside(spark, d):
    u, v = dc.warped(F.col("x0"), F.col("x1"), [[0.8, -0.6, 2.0], [0.6, 0.8, 1.0], [0.01, 0.02, 1.0]])
    mapped = points(spark, d).select("o_orderkey", u.alias("u"), v.alias("v"))
    return rounded(mapped.where(mt.inside(F.col("u"), F.col("v"), 6.0, 5.0)))


@query("agg_heatmap_eval", f"""select round(p, 5) as precision, round(r, 5) as recall, round(2 * p * r / (p + r + 1e-7), 5) as f1, (select round(sum(best) / (select sum(y) from {SCORED_SQL}), 5) from (select y, max(tp::double / k) over (order by k rows between current row and unbounded following) as best from (select y, row_number() over w as k, sum(y) over w as tp from {SCORED_SQL} window w as (order by s desc, id rows unbounded preceding)) where y = 1)) as average_precision
    from (select tp / (tp + fp + 1e-7) as p, tp / (tp + fn + 1e-7) as r from (select sum((y = 1 and s >= 0.5)::int)::double as tp, sum((y = 0 and s >= 0.5)::int)::double as fp, sum((y = 1 and s < 0.5)::int)::double as fn from {SCORED_SQL}))""")
def agg_heatmap_eval(spark, d):
    return mt.heatmap_evaluation(scored(spark, d), "y", "s", "id")


@query("agg_cost_reduction", "select event_type, round(c, 5) as control_cost, round(t, 5) as tracking_cost, round(100 * (max(t) over () - t) / max(t) over (), 5) as reduction from (select event_type, sum(value * value / 1e4) as c, sum((value - 50) * (value - 50) / 1e4) as t from events group by event_type)")
def agg_cost_reduction(spark, d):
    return mt.control_costs(table(spark, d, "events"), "event_type", F.col("value") / 100, (F.col("value") - 50) / 100)


@query("agg_r2_by_output", f"select 0 as output, round(1 - sum((x0 - 0.9 * x0 - 0.1) ** 2) / (count(*) * var_pop(x0)), 5) as r2 from {X_SQL} union all select 1, round(1 - sum((x1 - x2) ** 2) / (count(*) * var_pop(x1)), 5) from {X_SQL}")
def agg_r2_by_output(spark, d):
    x0, x1, x2 = (F.col(c) for c in X)
    return mt.r2_by_output(points(spark, d), [(x0, 0.9 * x0 + 0.1), (x1, x2)])


_T = "(select (i - 8) * 0.625::double as t, exp(-0.5 * ((i - 8) * 0.625::double) ** 2) as g, case when i in (0, 16) then 0.5 else 1.0 end * 0.625::double as w from range(17) p(i))"


@query("emb_characteristic_loss", f"""select round((select count(*) from embeddings) * avg(total), 5) as loss from (select k, sum(((c - g) ** 2 + s ** 2) * g * w) as total from
    (select k, t, g, w, avg(cos(t * x)) as c, avg(sin(t * x)) as s from (select k, embedding[k]::double as x from embeddings, range(1, 9) d(k)), {_T} group by all) group by k)""")
def emb_characteristic_loss(spark, d):
    return mt.characteristic_loss(table(spark, d, "embeddings"), "embedding", np.eye(64)[:, :8])


@query("sim_time_constants", "select round(0.5, 6)::double as tau_min, round(1.0, 6)::double as tau_max")
def sim_time_constants(spark, d):
    low, high = la.time_constants(np.array([[0.0, 1.0], [-2.0, -3.0]]))  # poles -1 and -2
    return spark.createDataFrame([(round(low, 6), round(high, 6))], "tau_min double, tau_max double")


@query("sim_closed_loop", """with recursive s(key, seq, x, u, total, e) as (select k, 0::bigint, 0.0::double, (k + 1) * 1.31::double, (k + 1)::double, (k + 1)::double from range(4) t(k)
    union all select key, seq + 1, x1, 0.8::double * e1 + 0.01::double * (total + e1) + 0.5::double * (e1 - e), total + e1, e1 from (select *, key + 1 - x1 as e1 from (select *, 0.9::double * x + 0.5::double * u as x1 from s)) where seq < 199)
    select key, seq, round(x, 6) as x0, round(u, 6) as u0 from s""")
def sim_closed_loop(spark, d):
    loop = fl.ClosedLoop([[0.9]], [[0.5]], fl.PidTextbook(0.8, 0.01, 0.5))
    steps = spark.range(800).select(F.floor(F.col("id") / 200).alias("key"), (F.col("id") % 200).alias("seq"), (F.floor(F.col("id") / 200) + 1).alias("xr"))
    return rounded(fl.filtered(steps, loop, "key", ["seq"], ["xr"]))


@query("tre_projected_iforest", _FOUND_SQL)
def tre_projected_iforest(spark, d):
    df = _lines(spark, d)
    return _separates(tr.isolation_forest(df, F4, "id", 8, 32, 256, 1, standardise=True, projection_dim=3).score(df))
