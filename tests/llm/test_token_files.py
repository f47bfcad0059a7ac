import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    t = Tokenizer.from_file(PATH)
    own = sorted(((-1 if i is None else i), t.encode(x or "", add_special_tokens=False).ids + [1], i) for i, x in rows)
    out, start = [], 0
    for _, ids, i in own:
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_whole_texts_come_back(spark, make_docs, odd_rows, tmp_path):
    got = tf.round_trip(make_docs(odd_rows), PATH)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=str) == expected(odd_rows)
    tf.write(make_docs(odd_rows), str(tmp_path / "t"), PATH, 1)
    ids = {(r["doc_id"], r["start"]): r["ids"] for r in tf.read(spark, str(tmp_path / "t")).collect()}
    assert ids[(3, next(s for d, s in ids if d == 3))] == Tokenizer.from_file(PATH).encode("one", add_special_tokens=False).ids + [1]


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = tf.round_trip(docs, PATH)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_empty_table(spark, make_docs):
    assert tf.round_trip(make_docs([]), PATH).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 3000])
def test_code_is_optimal_within_its_limit(n):
    rng = np.random.default_rng(n)
    counts = {int(i): int(c) for i, c in enumerate(2.0 ** rng.uniform(0, 40, n))}
    lengths = tf.code_lengths(counts)
    assert max(lengths.values()) <= tf.MAX_LENGTH
    assert sum(2.0**-x for x in lengths.values()) <= 1
    code = tf.Code(lengths)
    for size in (1, 63, 64, 65, 5000):
        ids = rng.integers(0, n, size)
        points, bits = code.encode(ids)
        assert (code.decode(bits, size, points, tf.STRIDE) == ids).all()


def test_unlimited_lengths_match_plain_huffman():
    import heapq

    rng = np.random.default_rng(3)
    counts = {i: int(c) for i, c in enumerate(rng.integers(1, 100, 200))}
    heap, cost = [*counts.values()], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    lengths = tf.code_lengths(counts)
    assert sum(counts[i] * lengths[i] for i in counts) == cost
