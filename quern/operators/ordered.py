"""Running sums, ranks and exact quantiles over a whole table in a global order, without one task for all rows.

Rows are cut into ranges of the key at approximate quantiles, each range (of each group) is a window partition of its own, and
the sums of the ranges before it (one row for each range and group) are added.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS, MOST_RANGES = 50_000, 4096


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name`` with as many underscores before it as no column in ``taken`` has."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def below(key: Column, cuts: Sequence) -> Column:
    """How many of the ascending ``cuts`` lie below ``key``, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.array(*map(F.lit, cuts))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        less = F.get(table, middle) < key
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(less, middle + 1).otherwise(s["low"]).alias("low"), F.when(less, s["high"]).otherwise(middle).alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve, lambda s: s["low"])


def running(df: DataFrame, key: Column, tie: list[Column], sums: dict[str, Column], reverse: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``rank`` (from 1) and each of ``sums`` summed up to and with the row, in ascending order of ``key`` and ``tie``, apart for each ``by``.

    Null keys come first, NaN last. ``reverse`` orders the key downwards, with nulls and NaN last. Ties must be settled by ``tie``.
    Of ``by`` there should be few values: one row for each and each range reaches the driver and all workers.
    """
    own, part = fresh("key", df.columns), fresh("range", df.columns)
    k = F.when(~F.isnan(key.cast("double")), key.cast("double"))
    df = df.withColumn(own, -k if reverse else k)
    ranges = max(1, min(MOST_RANGES, df.count() // RANGE_ROWS))
    cuts = sorted(set(df.agg(F.percentile_approx(own, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [])) if ranges > 1 else []
    df = df.withColumn(part, F.when(F.col(own).isNull(), len(cuts) + 1).otherwise(below(F.col(own), cuts))).withColumn("rank", F.lit(1).cast("long")).withColumns(sums)
    names = ["rank", *sums]
    if cuts:
        totals = df.groupBy(part, *by).agg(*(F.sum(n).alias(n) for n in names))
        before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        offset = {n: fresh(f"before_{n}", df.columns) for n in names}
        # at most MOST_RANGES + 2 rows for each group
        found = totals.select(part, *by, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset[n]) for n in names))
        found = found.select(*(F.col(c).alias(f"o_{c}") for c in (part, *by)), *offset.values())
        on = F.lit(True)
        for c in (part, *by):
            on = on & df[c].eqNullSafe(F.col(f"o_{c}"))
        df = df.join(F.broadcast(found), on).drop(*(f"o_{c}" for c in (part, *by)))
    window = Window.partitionBy(part, *by).orderBy(F.col(own).asc_nulls_last(), *tie).rowsBetween(Window.unboundedPreceding, 0)
    plus = lambda n: F.col(offset[n]) if cuts else F.lit(0)
    out = df.withColumns({n: F.sum(n).over(window) + plus(n) for n in names}).drop(own, part)
    return out.drop(*offset.values()) if cuts else out


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles with linear interpolation, by ranks in ranges: no task holds a group's values.

    Nulls do not count; a group without values has no row. One row for each group reaches the driver.
    """
    slim = df.select(*by, F.col(column).cast("double").alias("v")).where("v is not null")
    sizes = slim.groupBy(*by).agg(F.count("*").alias("n"))
    place = F.array(*(F.lit(float(s)) * (F.col("n") - 1) for s in shares))
    # the two ranks on both sides of each place, with their weights
    near = F.flatten(F.transform(place, lambda p, i: F.array(F.struct(i.alias("i"), (F.floor(p) + 1).alias("rank"), (1 - (p - F.floor(p))).alias("w")), F.struct(i.alias("i"), (F.floor(p) + 2).alias("rank"), (p - F.floor(p)).alias("w")))))
    wanted = sizes.select(*(F.col(c).alias(f"o_{c}") for c in by), F.explode(near).alias("q")).select(*(f"o_{c}" for c in by), F.col("q.i").alias("i"), F.col("q.rank").alias("o_rank"), F.col("q.w").alias("w")).where("w > 0")
    ranked = running(slim, F.col("v"), [], {}, by=by)
    on = F.col("rank") == F.col("o_rank")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    met = ranked.join(F.broadcast(wanted), on)  # two rows for each share and group
    return met.groupBy(*by).agg(*(F.sum(F.when(F.col("i") == i, F.col("v") * F.col("w"))).alias(f"q{i}") for i in range(len(shares))))
