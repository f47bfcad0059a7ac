from collections import defaultdict

import numpy as np

from quern.llm import packing


def brute(pieces, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [(b["left"], b) for b in bins if b["left"] >= length and source not in b["s"] and cluster not in b["c"]]
        b = min(fits, key=lambda x: x[0])[1] if fits else None
        if b is None:
            b = {"left": capacity, "s": set(), "c": set()}
            bins.append(b)
        out.append((b["left"], length))
        b["left"] -= length
        b["s"].add(source)
        b["c"].add(cluster)
    return sorted(b["left"] for b in bins)


def test_tightest_compatible_bin():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 150))
        pieces = [(int(rng.integers(1, 41)), int(rng.choice([0, 0, 0, 1, 2, 3, 4])), int(rng.integers(0, 30))) for _ in range(n)]
        pieces.sort(key=lambda p: -p[0])
        placed = packing.pack(pieces, 40)
        left, held = defaultdict(lambda: 40), defaultdict(list)
        for (length, s, c), (b, start) in zip(pieces, placed, strict=True):
            assert start == 40 - left[b]
            # no open bin that has neither source nor cluster is tighter
            tight = [left[o] for o in held if left[o] >= length and all(s != x and c != y for x, y in held[o])]
            assert (left[b] == min(tight)) if tight else not held[b]
            left[b] -= length
            held[b].append((s, c))
            assert left[b] >= 0


def check(rows, docs, capacity):
    got = packing.packed(docs, capacity).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    source = {}
    for i, t, s in rows:
        source[(i, s)] = t
    total = sum(len((t or "").encode().split()) + 1 for _, t, _ in rows)
    assert sum(r["n_tokens"] for r in got) == total
    for own in bins.values():
        own.sort(key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at
            at += r["n_tokens"]
        assert at <= capacity
    return got, bins


def test_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got, bins = check(rows, docs, 64)
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert sorted(r["copy"] for r in got if r["doc_id"] == 6) == [1, 2]
    by_id = {i: s for i, _, s in rows}
    for own in bins.values():
        assert len({by_id[r["doc_id"]] for r in own}) == len(own)
    assert packing.packed(make_docs([])).count() == 0


def test_shards(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got, bins = check(rows, docs, 1024)
    text, source = {i: " ".join((t or "").lower().split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    for own in bins.values():
        assert len({text[r["doc_id"]] for r in own}) == len(own) == len({source[r["doc_id"]] for r in own})
    assert len({r["bin_id"] >> 32 for r in got}) > 1
