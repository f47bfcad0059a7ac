import hashlib
import re
import struct

import numpy as np
import xxhash

from quern.llm import fingerprints as fp


def chain(values, kind):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack(kind, v), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [signed(chain([w.encode()], "")) for w in words]
    if not words:
        return []
    shingles = {signed(chain(hashes[i : i + 5], "<q")) for i in range(len(words) - 4)} or {signed(chain(hashes, "<q"))}
    least = {}
    for s in sorted(shingles):
        least.setdefault((s >> (64 - fp.LOG_BINS)) + fp.BINS // 2, s)
    out = []
    for j in range(fp.BINS):
        if j in least:
            out.append(least[j] & 255)
        else:
            order = {i: signed(xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(struct.pack("<i", j), 42))) for i in least}
            # the first filled bin of this bin's own order, by all but the low bits of the hash
            out.append(min((order[i] & ~255) | (least[i] & 255) for i in least) & 255)
    return out


def brute_rows(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(chain([r[1].encode()], ""))))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edit = text[: len(text) - q] + following[:q]
        a, b, c = brute(text), brute(edit), brute(following)

        def near(x, y):
            if len(x) != len(y):
                return 0.0
            return 1.0 if not x else max(0.0, (np.mean(np.array(x) == np.array(y)) - 2**-8) / (1 - 2**-8))

        out.append((str(i), len(text), hashlib.sha256(edit.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), round(near(a, b), 9), round(near(a, c), 9)))
    return sorted(out)


def rows_of(df):
    return sorted((str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in df.collect())


def test_against_brute_force(spark, make_docs, odd_rows, sf):
    odd = [r for r in odd_rows if r[0] != 7]
    assert rows_of(fp.edited(make_docs(odd))) == brute_rows(odd)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(fp.edited(docs)) == brute_rows([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_ranges_meet(spark, make_docs, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 3)
    rows = [(i * 7, f"document number {i} says {i * i} things about {i % 5}") for i in range(40)]
    assert rows_of(fp.edited(make_docs(rows).repartition(7))) == brute_rows(rows)
    assert rows_of(fp.edited(make_docs(rows[:1]))) == brute_rows(rows[:1])
    assert fp.edited(make_docs([])).count() == 0


def test_likeness_follows_jaccard(spark, make_docs):
    rng = np.random.default_rng(1)
    errors = []
    rows, truth = [], []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400 if k % 2 else 30)]
        keep = int(len(words) * rng.random())
        other = words[:keep] + [f"v{x}" for x in rng.integers(0, 10**6, len(words) - keep)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        truth.append(len(a & b) / len(a | b))
    got = {r["doc_id"]: r["near_next"] for r in fp.edited(make_docs(rows)).collect()}
    errors = [got[2 * k] - t for k, t in enumerate(truth)]
    assert np.mean(np.abs(errors)) < 0.05 and abs(np.mean(errors)) < 0.02
