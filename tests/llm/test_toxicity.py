import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import toxicity as tx


def brute_ratio(words, counts):
    """log P(toxic) - log P(ordinary) of each word, from dictionaries; counts: (class, word) -> n."""
    full, cont = {0: Counter(), 1: Counter()}, {}
    every = set()
    for (kind, word), n in counts.items():
        s = [tx.START, *word, tx.END]
        for i in range(1, len(s)):
            full[kind][tuple(s[max(0, i - 5) : i + 1])] += n
        for i in range(len(s)):
            for m in range(1, 7):
                if i - m + 1 >= 0 and not (m == 1 and i == 0):
                    every.add(tuple(s[i - m + 1 : i + 1]))
    for g in every:
        if len(g) > 1:
            cont[g[1:]] = cont.get(g[1:], 0) + 1

    def ctx(table, c):
        own = [v for g, v in table.items() if g[:-1] == c]
        return sum(own), len(own)

    def shared(g):
        below = shared(g[1:]) if len(g) > 1 else 1 / 258
        total, kinds = ctx(cont, g[:-1])
        return (max(cont.get(g, 0) - tx.DISCOUNT, 0) + tx.DISCOUNT * kinds * below) / total if total else below

    out = []
    for word in words:
        s, sum_ = [tx.START, *word, tx.END], 0.0
        for i in range(1, len(s)):
            g = tuple(s[max(0, i - 5) : i + 1])
            p = []
            for kind in (1, 0):
                total, kinds = ctx(full[kind], g[:-1])
                below = shared(g[1:])
                p.append((max(full[kind][g] - tx.DISCOUNT, 0) + tx.DISCOUNT * kinds * below) / total if total else below)
            sum_ += np.log(p[0]) - np.log(p[1])
        out.append(sum_)
    return out


def test_model_against_dictionaries(spark):
    words = [b"idiot", b"idiotic", b"the", b"then", b"there", b"a", b"scum", b"thing", b"\xc3\xa9t\xc3\xa9"]
    rng = np.random.default_rng(2)
    counts = {(k, w): int(n) for k in (0, 1) for w, n in zip(words, rng.integers(0, 6, len(words)), strict=True) if n}
    table = spark.createDataFrame([(bytearray(w), counts.get((1, w), 0), counts.get((0, w), 0)) for w in words], "word binary, toxic long, ordinary long")
    seen = [*words, b"thingy", b"idio", b"zzz", b"scummy"]
    own = {key for key in counts if counts[key]}
    got = tx.ratios(tx.model(table), seen)
    assert np.allclose(got, brute_ratio(seen, {key: counts[key] for key in own}), atol=1e-4)


def test_counts_of_many_ngrams_stay_apart(spark):
    rng = np.random.default_rng(3)
    words = list({bytes(rng.integers(97, 123, 10).astype(np.uint8)) for _ in range(30_000)})
    counts = {(int(k), w): 1 for k, w in zip(rng.integers(0, 2, len(words)), words, strict=True)}
    full, every = Counter(), set()
    for (kind, word) in counts:
        s = (tx.START, *word, tx.END)
        full.update((kind, s[max(0, i - 5) : i + 1]) for i in range(1, len(s)))
        every.update(s[i - m + 1 : i + 1] for i in range(len(s)) for m in range(2, 7) if i >= m - 1)
    cont = Counter(g[1:] for g in every)
    sums, kinds = Counter(), Counter()
    for table in (full, cont):
        for g, n in table.items():
            c = (g[0], g[1][:-1]) if table is full else g[:-1]
            sums[c] += n
            kinds[c] += 1

    def smooth(g, c, table, below):
        return (max(table[g] - tx.DISCOUNT, 0) + tx.DISCOUNT * kinds[c] * below) / sums[c] if sums[c] else below

    def shared(g):
        return smooth(g, g[:-1], cont, shared(g[1:])) if g else 1 / 258

    seen, want = [*words[:200], *(w[::-1] for w in words[:200])], []
    for word in seen:
        s = (tx.START, *word, tx.END)
        ends = [s[max(0, i - 5) : i + 1] for i in range(1, len(s))]
        want.append(sum(np.log(smooth((1, g), (1, g[:-1]), full, shared(g[1:])) / smooth((0, g), (0, g[:-1]), full, shared(g[1:]))) for g in ends))
    table = spark.createDataFrame([(bytearray(w), k, 1 - k) for k, w in counts], "word binary, toxic long, ordinary long")
    assert np.allclose(tx.ratios(tx.model(table), seen), want, atol=1e-3)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = tx.scored(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]) == 1, np.array([r["score"] for r in rows])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    assert auc > 0.95
    assert np.mean((s >= 0.5) == y) > 0.93
    assert (s[~y] >= 0.5).mean() < 0.01
    assert got.count() == docs.count()


def test_odd_rows_and_labels(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    for labels in ([], [(3, 1)], [(3, 0), (4, 0)], [(3, 1), (4, 0), (4, None), (None, 1), (5, 1), (5, 0), (6, 0), (8, 1), (9, 0), (10, 1)]):
        got = tx.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == len(odd_rows)
        for r in got:
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert tx.scored(make_docs([]), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


@pytest.mark.parametrize("words", [[], [b"a"], [b"x"] * 40])
def test_figures(words):
    mean, peak, *_ = tx.figures(words, np.ones(len(words)))
    assert mean == pytest.approx(0.5 if words else 0) and peak >= mean - 1e-12
