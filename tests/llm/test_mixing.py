from collections import defaultdict

import numpy as np
import pytest

from quern.llm import mixing


def brute(rows, powers):
    """Raking with dictionaries: rows of (source, lang, topic, tokens)."""
    cells = defaultdict(float)
    for s, lang, t, n in rows:
        cells[s, lang, t] += n
    cells = {k: v for k, v in cells.items() if v > 0}
    weight, target = dict(cells), []
    for i, m in enumerate(mixing.MARGINS):
        sums = defaultdict(float)
        for k, v in cells.items():
            sums[k[i]] += v
        whole = sum(v ** powers[m] for v in sums.values())
        target.append({k: v ** powers[m] / whole for k, v in sums.items()})
    for _ in range(300):
        for i in range(3):
            sums = defaultdict(float)
            for k, v in weight.items():
                sums[k[i]] += v
            weight = {k: v * target[i][k[i]] / sums[k[i]] for k, v in weight.items()}
    top = max((weight[k] / cells[k] for k in cells), default=1)
    return {k: weight[k] / cells[k] / top for k in cells}, weight, target


def test_against_dictionaries(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = mixing.mixed(docs).collect()
    want, weight, target = brute([(r["source"], r["lang"], r["topic"], r["n_tokens"]) for r in got], mixing.POWERS)
    assert len(got) == docs.count()
    for r in got:
        if r["n_tokens"]:
            assert abs(r["probability"] - want[r["source"], r["lang"], r["topic"]]) < 2e-6
    for i in range(3):
        for value, share in target[i].items():
            assert abs(sum(w for k, w in weight.items() if k[i] == value) - share) < 1e-6
    # the expected sample has the target margins
    expected = defaultdict(float)
    for r in got:
        expected[r["source"]] += r["n_tokens"] * r["probability"]
    whole = sum(expected.values())
    assert max(abs(v / whole - target[0][k]) for k, v in expected.items()) < 1e-4
    kept = [r for r in got if r["kept"]]
    assert abs(sum(r["n_tokens"] for r in kept) / whole - 1) < 0.15


def test_given_targets(spark, make_docs):
    docs = make_docs([(i, "w " * 60) for i in range(300)])
    targets = {"source": spark.createDataFrame([("s0", 0.6), ("s1", 0.3), ("s2", 0.1)], "source string, share double"), "lang": spark.createDataFrame([("en", 1.0)], "lang string, share double"), "topic": spark.createDataFrame([("article", 1.0)], "topic string, share double")}
    got = {r["source"]: r["probability"] for r in mixing.with_probability(mixing.with_cell(docs), targets=targets).select("source", "probability").distinct().collect()}
    assert np.allclose([got["s0"], got["s1"], got["s2"]], [1, 0.5, 1 / 6])
    targets["lang"] = spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, share double")  # no cell has "de"
    with pytest.warns(UserWarning, match="margins"):
        mixing.with_probability(mixing.with_cell(docs), targets=targets)


def test_both_ways_of_raking(spark):
    """Within one row and by shuffles: the same weights, margins met, no zero weight cell lost."""
    rng = np.random.default_rng(4)
    rows = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(0, 1000))) for a in range(12) for b in range(5) for c in range(4) if rng.random() < 0.7]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, available long")
    targets = mixing.power_targets(cells, mixing.POWERS)
    one, two = ({tuple(r[:3]): r for r in mixing.raked(cells, targets, one_row=n).collect()} for n in (1000, 0))
    assert set(one) == set(two) == {r[:3] for r in rows if r[3]}
    assert all(abs(one[k]["weight"] - two[k]["weight"]) < 1e-9 and one[k]["gap"] < mixing.TOLERANCE for k in one)
    for r in targets.collect():
        assert abs(sum(x["weight"] for k, x in one.items() if k[r["margin"]] == r["value"]) - r["share"]) < 1e-8


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = mixing.mixed(docs.withColumn("source", docs["source"].substr(1, 0)).union(docs)).collect()
    assert len(got) == 2 * len(odd_rows)
    assert all(0 <= r["probability"] <= 1 for r in got)
    nothing = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source")
    assert {r["source"] for r in mixing.mixed(nothing).collect()} == {mixing.NONE}
    assert mixing.sample(docs).columns == docs.columns
    clash = docs.selectExpr("*", "1 as tokens", "'x' as topic", "'y' as probability", "'z' as row", "2 as weight")
    kept = mixing.sample(clash)
    assert kept.columns == clash.columns and {(r["tokens"], r["topic"], r["probability"], r["row"]) for r in kept.collect()} == {(1, "x", "y", "z")}
    assert mixing.mixed(make_docs([])).count() == 0
