import itertools
import re

import numpy as np
import xxhash

from quern.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: (doc_id, fp) -> component of each row, by joining every pair."""
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f, least.get(find(f))) for d, f in fps}


def test_golay_keys_meet():
    code = simhash.Golay()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000).astype(np.uint32)
    for a, b in itertools.combinations_with_replacement(range(23), 2):
        other = words ^ np.uint32((1 << a) | (1 << b))
        x, own = code.keys(words)
        y, his = code.keys(other)
        assert ((x[:, :, None] == y[:, None, :]) & own[:, :, None] & his[:, None, :]).any((1, 2)).all()


def test_against_brute_force(spark, make_docs, odd_rows, sf):
    for docs in (make_docs(odd_rows), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
        got = simhash.near_duplicates(docs).collect()
        assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64)) for r in got) == sorted((str(d), f) for d, f in rows)
        assert {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got} == brute_components(rows)


def test_crowded_buckets_and_chains(spark):
    """Planted fingerprints: a ball of near ones, chains of two-bit steps; the crowded way must agree with pairs."""
    rng = np.random.default_rng(5)
    centre, fps = int(rng.integers(1 << 62)), set()
    for _ in range(250):
        fps.add(centre ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))))
    x = int(rng.integers(1 << 62))
    for _ in range(60):
        fps.add(x := x ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))))
    fps |= {int(v) for v in rng.integers(1 << 62, size=100)}
    rows = list(enumerate(sorted(fps)))
    want = {f: c for _, f, c in brute_components(rows)}
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    for dense in (2, 32, 10_000):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct, dense)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(found.get(f, f), set()).add(f)
        assert {frozenset(g) for g in groups.values()} == {frozenset(f for f in fps if want[f] == c) for c in set(want.values())}


def test_keep_one_and_empty(spark, make_docs):
    docs = make_docs([(3, "a b c d"), (1, "a b c d"), (2, "p q r s t u v w"), (None, "a b c d"), (5, None), (4, "")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4"]
    # an id shared by a copy and a text of its own, repeated rows, a group without ids
    docs = make_docs([(1, "a b c d"), (5, "a b c d"), (5, "p q r s t u v w"), (7, "k l m n o"), (7, "k l m n o"), (None, "x y z x w"), (None, "x y z x w"), (None, None), (8, "")])
    rows = sorted((str(r["doc_id"]), r["text"] or "") for r in simhash.keep_one(docs).collect())
    assert rows == [("1", "a b c d"), ("5", "p q r s t u v w"), ("7", "k l m n o"), ("8", ""), ("None", "x y z x w")]
    assert simhash.near_duplicates(make_docs([])).count() == 0
