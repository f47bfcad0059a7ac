"""Mixing documents to target weights by iterative proportional fitting. DataFrame operations only.

Tokens are summed by cell (source, language, topic). Raking scales the cells' token weights to the targets of each margin in
turn until all margins hold. A document is kept with the probability weight / available tokens of its cell, scaled so that the
largest is 1: then the expected tokens of the sample have the target margins exactly, as far as the margins can be met.

Only cells are iterated over, never documents. Up to ``ONE_ROW_CELLS`` cells lie in the arrays of one row, and all sweeps are
one expression over them: no shuffle and no job between sweeps. More cells are raked by one job a sweep, whose result is
written to the shared folder; sums by margin value are aggregated before they are shuffled, so a source with a third of all
tokens is a few cells like any other. Both ways give the same weights.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_small, saved

WHITE = r"[\x20\x09-\x0D]+"
MARGINS = ("source", "lang", "topic")
#: Target shares grow with these powers of the available shares; below 1 they lean towards what is rare.
POWERS = {"source": 0.8, "lang": 0.9, "topic": 0.9}
TOLERANCE, MOST_SWEEPS = 1e-10, 200
#: Cells are raked within one row up to this many, and by a shuffle for each margin beyond.
ONE_ROW_CELLS = 20_000
NONE = "(none)"


def tokens(text: Column) -> Column:
    """Words of a text."""
    text = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(text, WHITE), "")).cast("long")


def topic(text: Column, words: Column) -> Column:
    """A topic by form: table (cell bars), code (other symbols), note (under 50 words), article."""
    text = F.coalesce(text, F.lit(""))
    count = lambda chars: F.size(F.split(text, chars)) - 1
    return F.when(count(r"\|") * 10 >= F.greatest(words, F.lit(1)), "table").when(count("[#*$%&<>]") * 5 >= F.greatest(words, F.lit(1)), "code").when(words < 50, "note").otherwise("article")


def cell_columns(text_col: str = "text") -> tuple[Column, dict[str, Column]]:
    """The tokens of a document, and its value of each margin; a null category is one of its own."""
    n = tokens(F.col(f"`{text_col}`"))
    return n, {"source": F.coalesce(F.col("source"), F.lit(NONE)), "lang": F.coalesce(F.col("lang"), F.lit(NONE)), "topic": topic(F.col(f"`{text_col}`"), n)}


def with_cell(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, tokens, source, lang, topic): each row of ``docs`` as a struct, whatever its columns are called, beside its cell."""
    n, margins = cell_columns(text_col)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), n.alias("tokens"), *(c.alias(m) for m, c in margins.items()))


def cells_of(placed: DataFrame) -> DataFrame:
    """(source, lang, topic, available): tokens by cell, of the rows of ``with_cell``."""
    return placed.groupBy(*MARGINS).agg(F.sum("tokens").alias("available"))


def long_form(cells: DataFrame) -> DataFrame:
    """(margin, value, tokens) of each cell and margin; margins by their number."""
    each = F.inline(F.array(*(F.struct(F.lit(i).alias("margin"), F.col(m).alias("value"), F.col("available").alias("tokens")) for i, m in enumerate(MARGINS))))
    return cells.select(each)


def power_targets(cells: DataFrame, powers: dict[str, float]) -> DataFrame:
    """(margin, value, share): by margin the available shares to a power, summing to 1."""
    power = F.get(F.array(*(F.lit(float(powers[m])) for m in MARGINS)), F.col("margin"))
    sums = long_form(cells).groupBy("margin", "value").agg(F.sum("tokens").cast("double").alias("x")).where("x > 0").withColumn("x", F.pow("x", power))
    whole = sums.groupBy("margin").agg(F.sum("x").alias("whole"))
    return sums.join(whole, "margin").select("margin", "value", (F.col("x") / F.col("whole")).alias("share"))


def given_targets(targets: dict[str, DataFrame]) -> DataFrame:
    """(margin, value, share) of a table (value, share) for each margin, whose first column is named after it."""
    out = None
    for i, m in enumerate(MARGINS):
        own = targets[m].select(F.lit(i).alias("margin"), F.coalesce(F.col(m), F.lit(NONE)).alias("value"), F.col("share").cast("double").alias("share"))
        out = own if out is None else out.unionByName(own)
    return out


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _raked_in_a_row(cells: DataFrame, targets: DataFrame, tolerance: float, most: int) -> DataFrame:
    """All cells in one row: weights are an array, a margin is the lists of its values' cells; a sweep is a step of one fold."""
    numbered = cells.agg(F.array_sort(F.collect_list(F.struct(*MARGINS, "available"))).alias("c")).select(F.posexplode("c").alias("k", "c")).select("k", "c.*")
    each = F.inline(F.array(*(F.struct(F.lit(i).alias("margin"), F.col(m).alias("value"), F.col("k"), F.col("available")) for i, m in enumerate(MARGINS))))
    values = numbered.select(each).groupBy("margin", "value").agg(F.sort_array(F.collect_list(F.struct("k", "available"))).alias("own")).join(targets, ["margin", "value"], "left")
    row = values.agg(F.sort_array(F.collect_list(F.struct("margin", "value", "own", F.coalesce("share", F.lit(0.0)).alias("share")))).alias("all"))
    for i in range(len(MARGINS)):
        row = row.withColumn(f"g{i}", F.filter("all", lambda g: g["margin"] == i))  # noqa: B023
        row = row.withColumn(f"cells{i}", F.transform(f"g{i}", lambda g: F.transform(g["own"], lambda x: x["k"]))).withColumn(f"share{i}", F.transform(f"g{i}", lambda g: g["share"]))
        # which value of the margin each cell has
        pairs = F.flatten(F.transform(f"cells{i}", lambda ks, j: F.transform(ks, lambda k: F.struct(k.alias("k"), j.alias("j")))))
        row = row.withColumn(f"at{i}", F.transform(F.array_sort(pairs), lambda x: x["j"]))
    first = F.transform(F.array_sort(F.flatten(F.transform("g0", lambda g: g["own"]))), lambda x: x["available"].cast("double"))
    row = row.select(first.alias("w"), *(f"{c}{i}" for i in range(len(MARGINS)) for c in ("cells", "share", "at")))

    def scaled(state: Column, i: int) -> Column:
        w = state["w"]
        sums = F.transform(F.col(f"cells{i}"), lambda ks: F.aggregate(ks, F.lit(0.0), lambda a, k: a + F.get(w, k)))

        def use(s: Column) -> Column:
            gap = F.array_max(F.zip_with(F.col(f"share{i}"), s, lambda t, x: F.abs(t - x)))
            scale = F.zip_with(F.col(f"share{i}"), s, lambda t, x: F.when(x > 0, t / x).otherwise(0.0))
            new = let(scale, lambda f: F.transform(w, lambda x, k: x * F.get(f, F.get(F.col(f"at{i}"), k))))
            return F.struct(new.alias("w"), F.greatest(state["gap"], F.coalesce(gap, F.lit(0.0))).alias("gap"))

        return let(sums, use)

    def sweep(state: Column, _: Column) -> Column:
        new = F.struct(state["w"].alias("w"), F.lit(0.0).alias("gap"))
        for i in range(len(MARGINS)):
            new = let(new, lambda s: scaled(s, i))  # noqa: B023
        return F.when(state["gap"] < tolerance, state).otherwise(new)

    done = row.select(F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(F.col("w"), F.lit(float("inf")).alias("gap")), sweep).alias("s"))
    weights = done.select(F.posexplode("s.w").alias("k", "weight"), F.col("s.gap").alias("gap"))
    return numbered.join(weights, "k").select(*MARGINS, "available", "weight", "gap")


def _raked_by_shuffles(cells: DataFrame, targets: DataFrame, tolerance: float, most: int) -> DataFrame:
    """One job a sweep; the table of a sweep goes when the next one is written."""
    with Scratch(cells.sparkSession) as work:
        now, name = cells.withColumn("weight", F.col("available").cast("double")), None
        for sweep in range(most):
            step = now.drop("gap").withColumn("gap", F.lit(0.0))
            for i, m in enumerate(MARGINS):
                own = targets.where(F.col("margin") == i).select(F.col("value").alias(m), "share")
                sums = step.groupBy(m).agg(F.sum("weight").alias("sum")).join(own, m, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
                step = step.join(sums, m).withColumn("gap", F.greatest("gap", F.abs(F.col("sum") - F.col("share"))))
                step = step.withColumn("weight", F.when(F.col("sum") > 0, F.col("weight") * F.col("share") / F.col("sum")).otherwise(0.0)).drop("sum", "share")
            now = work.saved(step, f"cells_{sweep}")
            if name:
                work.drop(name)
            name = f"cells_{sweep}"
            if (now.agg(F.max("gap")).first()[0] or 0.0) < tolerance:
                break
        return saved(now, "mixing_raked")


def raked(cells: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, most: int = MOST_SWEEPS, one_row: int = ONE_ROW_CELLS) -> DataFrame:
    """(source, lang, topic, available, weight, gap) of the ``cells`` with available > 0; the weights' margins are the ``targets``.

    gap is the largest distance of a margin from its target that the last sweep met; it ends when that is below
    ``tolerance``, or after ``most`` sweeps: targets that contradict each other or ask for what no cell has cannot be met,
    and gap says so. A value without a target has the target 0.
    """
    with Scratch(cells.sparkSession) as work:
        cells, targets = work.saved(cells.where("available > 0"), "cells"), work.saved(targets, "targets")
        way = _raked_in_a_row if cells.count() <= one_row else _raked_by_shuffles
        return saved(way(cells, targets, tolerance, most).select(*MARGINS, "available", "weight", "gap"), "mixing_weights")


def probabilities(weights: DataFrame, top: float) -> DataFrame:
    """(source, lang, topic, probability) of the rows of ``raked``; ``top`` is their largest weight / available, which has probability 1."""
    return weights.select(*MARGINS, (F.col("weight") / F.col("available") / F.lit(top or 1.0)).alias("probability"))


def uniform(*path: str) -> Column:
    """A number from 0 to below 1 that the id determines."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(".".join(f"`{p}`" for p in path)).cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_probability(placed: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``with_cell`` with probability. ``targets``: by margin a table (value, share); else by ``powers``.

    Documents without words have the probability 1: they weigh nothing. Warns if the margins could not be met.
    """
    with Scratch(placed.sparkSession) as work:
        cells = work.saved(cells_of(placed.select("tokens", *MARGINS)), "available")
        weights = raked(cells, given_targets(targets) if targets else power_targets(cells, powers or POWERS))
    seen = weights.agg(F.max(F.col("weight") / F.col("available")).alias("top"), F.max("gap").alias("gap")).first()
    if (seen["gap"] or 0.0) > 1e-6:
        warnings.warn(f"margins are off their targets by up to {seen['gap']:.2g}", stacklevel=2)
    found = probabilities(weights, seen["top"])
    joined = placed.join(F.broadcast(found) if is_small(found) else found, list(MARGINS), "left")
    return joined.withColumn("probability", F.when(F.col("tokens") == 0, 1.0).otherwise(F.coalesce("probability", F.lit(0.0))))


def mixed(docs: DataFrame, id_col: str = "doc_id", powers: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept), one row for each row of ``docs``.

    A row is kept if the number that its id determines is below its probability, so rows with equal ids in one cell go or
    stay together. Null categories count as "(none)", null texts as empty. An empty table gives an empty result.
    """
    n, margins = cell_columns()
    placed = docs.select(F.col(f"`{id_col}`").alias("id"), n.alias("tokens"), *(c.alias(m) for m, c in margins.items()))
    out = with_probability(saved(placed, "mixing_rows"), powers)  # the texts are read once
    return out.select(F.col("id").cast("long").alias("doc_id"), *MARGINS, F.col("tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), (uniform("id") < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, id_col: str = "doc_id", powers: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mixed`` keeps, with their columns, whatever these are called."""
    kept = with_probability(with_cell(docs), powers).where(uniform("row", id_col) < F.col("probability"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def oracle_sql(sweeps: int = 40) -> str:
    """``mixed`` for DuckDB: the sweeps written out one after the other."""
    words = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"
    count = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    parts = [
        f"""d as (select doc_id, n, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang,
            case when {count("|")} * 10 >= greatest(n, 1) then 'table' when {count("#*$%&<>")} * 5 >= greatest(n, 1) then 'code' when n < 50 then 'note' else 'article' end as topic
            from (select doc_id, source, lang, coalesce(text, '') as t, {words} as n from documents))""",
        "c0 as materialized (select source, lang, topic, sum(n)::double as available, sum(n)::double as w from d group by all having sum(n) > 0)",
    ]
    for m in MARGINS:
        parts.append(f"g_{m} as materialized (select {m}, x / sum(x) over () as share from (select {m}, pow(sum(available), {POWERS[m]}) as x from c0 group by {m}))")
    k = 0
    for _ in range(sweeps):
        for m in MARGINS:
            parts.append(f"c{k + 1} as materialized (select source, lang, topic, available, w * share / sum(w) over (partition by {m}) as w from c{k} join g_{m} using ({m}))")
            k += 1
    parts.append(f"p as (select source, lang, topic, (w / available) / max(w / available) over () as p from c{k})")
    return "with " + ",\n".join(parts) + """
    select doc_id, source, lang, topic, n as n_tokens, round(q, 6) as probability, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 < q as kept
    from (select d.*, case when n = 0 then 1.0 else coalesce(p, 0.0) end as q from d left join p using (source, lang, topic))"""
