"""Token files: ids of whole texts under a canonical, length-limited Huffman code.

Layout of a token folder (all parts are written by Spark, so it may lie in any store that Spark reaches):

* ``code``: (id, length), one row for each id that occurs. Canonical codes follow from the lengths: shorter first, then
  by id. Lengths are at most ``MAX_LENGTH`` bits (package-merge over the global counts of ids).
* ``blocks``: (shard, block, before, n_docs, n_tokens, data). Shards are ranges of ascending document ids; ``before`` is
  the number of ids in the shard's earlier blocks. ``data`` is a block, which can be decoded on its own.

A block is, little-endian: magic ``QTK1``, documents d, checkpoints c, stride, ids n (8 bytes, the others 4); then d
document ids (8 bytes), d flags (1 byte, 0: the id is null), d lengths in ids (8 bytes), c bit offsets (8 bytes: where
every ``stride``-th id begins), then the bits, most significant first. Decoding is driven by a table of 2^MAX_LENGTH
entries and runs over all checkpoints of a block side by side.
"""

from __future__ import annotations

import itertools
import os
import struct
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_GROUP, dropped, saved, shared_path

MAX_LENGTH = 16
STRIDE = 64
BLOCK_TOKENS = 1 << 16
SHARD_TOKENS = 1 << 24
#: Bytes of words and their ids that a worker remembers.
REMEMBERED = 16 << 20
#: Words that are tokenised together, and bytes of text that are worked on at a time (or one text).
TOGETHER, PART_BYTES = 4096, 4 << 20
#: Small letters of Latin-1, which normalising leaves as they are.
SMALL = "a-zß-öø-ÿ"
HEAD = "<4sIIIQ"
MAGIC = b"QTK1"


def worker_state():
    """A module of this library's own in each worker process: what lies there outlives a task, unlike the globals of functions that travel by value."""
    if "_quern_worker_state" not in sys.modules:
        sys.modules["_quern_worker_state"] = types.ModuleType("_quern_worker_state")
    return sys.modules["_quern_worker_state"].__dict__


def forget() -> None:
    """Free what an encoding stage left behind in this worker."""
    worker_state().clear()


class WordIds:
    """Ids of texts by the tokenizers library, which sees each distinct word once; all else runs on Arrow and NumPy arrays.

    Only for tokenizers that cut at ASCII white space and drop it, normalise by NFC and to lower case, keep letters apart from
    marks and mark a word's last id, as ``word_bpe_49k.json`` does: the ids of a text are then those of its words in a row, and
    marks behind a letter or digit at a word's end are a word of their own. Words of plain small letters are what normalising
    and cutting would leave them, so they go straight to the merges, many at a time. All other words take the whole way.

    Worker processes outlive tasks, and so do the words they remember, with their ids: beyond ``REMEMBERED`` bytes only the
    words of the texts at hand stay.
    """

    def __init__(self, path: str, kind: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        held = worker_state()
        if (path, kind, end_id) not in held:
            whole = tokenizers.Tokenizer.from_file(path)
            merges = tokenizers.Tokenizer(whole.model)
            cut = tokenizers.pre_tokenizers
            merges.pre_tokenizer = cut.Sequence([cut.WhitespaceSplit(), cut.ByteLevel(add_prefix_space=False, use_regex=False)])
            last = np.zeros(whole.get_vocab_size(), bool)
            last[[i for token, i in whole.get_vocab().items() if token.endswith(whole.model.end_of_word_suffix)]] = True
            # the first word stands for the end of a text: none of its letters is ever met
            held[path, kind, end_id] = {"whole": whole, "merges": merges, "last": last, "words": pa.array([" "]), "n": np.ones(1, np.int64), "ids": np.array([end_id], kind)}
        self.held, self.kind = held[path, kind, end_id], kind

    def _whole(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.held["whole"].encode_batch_fast(words, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each word has, all ids)."""
        ids = np.array(self.held["merges"].encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        return np.diff(np.flatnonzero(self.held["last"][ids]) + 1, prepend=0), ids

    def learn(self, words: pa.Array) -> None:
        """Put words that are not known behind those that are."""
        plain = pc.match_substring_regex(words, f"^[{SMALL}]+$")
        short, rest = words.filter(plain), words.filter(pc.invert(plain))
        parts = [self._plain(short.slice(at, TOGETHER).to_pylist()) for at in range(0, len(short), TOGETHER)]
        for at in range(0, len(rest), TOGETHER):
            found = self._whole(rest.slice(at, TOGETHER).to_pylist())
            parts.append((np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found)))
        held = self.held
        held["words"] = pa.concat_arrays([held["words"], short, rest])
        held["n"] = np.concatenate([held["n"], *(n for n, _ in parts)])
        held["ids"] = np.concatenate([held["ids"], *(ids for _, ids in parts)])

    def keep(self, which: np.ndarray) -> None:
        """Forget all words but those numbered ``which``, in that order after the first."""
        held, which = self.held, np.concatenate(([0], which))
        held["ids"] = gathered(held["ids"], held["n"], which)
        held["words"], held["n"] = held["words"].take(pa.array(which)), held["n"][which]

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The ids of each text and the end's as little-endian bytes."""
        held = self.held
        split = pc.ascii_split_whitespace(spaced(texts))
        met = split.flatten().dictionary_encode()
        if held["words"].nbytes + held["n"].nbytes + held["ids"].nbytes > REMEMBERED:
            there = pc.index_in(met.dictionary, held["words"])
            self.keep(there.drop_null().to_numpy(zero_copy_only=False))
        there = pc.index_in(met.dictionary, held["words"])
        if there.null_count:
            first = len(held["words"])
            new = met.dictionary.filter(pc.is_null(there))
            self.learn(new)
            # learned words are put in another order
            place = pc.index_in(new, held["words"].slice(first)).to_numpy(zero_copy_only=False) + first
            where = np.flatnonzero(pc.is_null(there).to_numpy(zero_copy_only=False))
            at = there.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at[where] = place
        else:
            at = there.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        words = np.insert(at[met.indices.to_numpy(zero_copy_only=False)], ends, 0)
        size = np.cumsum(held["n"][words])[ends + np.arange(len(ends))] * held["ids"].itemsize
        offsets = np.concatenate(([0], size)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(gathered(held["ids"], held["n"], words).tobytes())])


def gathered(ids: np.ndarray, n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ids of the words numbered ``words`` in a row; word w has n[w] ids, behind those of the words before it."""
    size = n[words]
    return ids[np.repeat((np.cumsum(n) - n)[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def spaced(texts: pa.Array) -> pa.Array:
    """``texts`` in lower case where that is all that normalising would do to them, and with a space before marks at the end of a word."""
    texts = texts.fill_null("")
    low = pc.invert(pc.match_substring_regex(texts, r"<\||[^\x00-\x{FF}]"))
    texts = pc.if_else(low, pc.utf8_lower(texts), texts)
    return pc.replace_substring_regex(texts, rf"([{SMALL}0-9])([.,;:!?]+[\t\n\v\f\r ])", r"\1 \2")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): little-endian ids of each text, with ``end_id`` after them. A null text counts as empty."""

    def run(batches):
        words = WordIds(tokenizer_path, kind, end_id)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(size) - size) // PART_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    own = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), words(own.column("text")).cast(pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def counts(tokens: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs; at most one entry for each id of the vocabulary reaches the driver."""

    def run(batches):
        forget()
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=len(total))
            own[: len(total)] += total
            total = own
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": there.astype(np.int64), "n": total[there].astype(np.int64)})

    return {r["id"]: r["n"] for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def code_lengths(frequency: dict[int, int], limit: int = MAX_LENGTH) -> dict[int, int]:
    """Lengths of an optimal prefix code with no length above ``limit``, by package-merge.

    On each level the symbols are merged by weight with the packages of two from the level below. Of the top level the
    first 2n - 2 items are taken; a package taken means two items more on the level below. The symbols taken on a level
    are always the rarest ones, so a symbol's length is the number of levels on which its rank is below their number.
    """
    symbols = sorted(frequency, key=lambda s: (frequency[s], s))
    n = len(symbols)
    if n < 2:
        return dict.fromkeys(symbols, 1)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes longer than {limit} bits")
    weight = np.array([frequency[s] for s in symbols], np.float64)
    packages, leaf = np.zeros(0), []
    for _ in range(limit):
        merged = np.concatenate((weight, packages))
        order = np.argsort(merged, kind="stable")
        leaf.append(order < n)
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(leaf):
        own = int(level[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    return dict(zip(symbols, length.tolist(), strict=True))


class Code:
    """Canonical code words of given lengths, with the tables for both directions."""

    def __init__(self, lengths: dict[int, int]) -> None:
        top = max(lengths, default=0) + 1
        self.code, self.length = np.zeros(top, np.uint32), np.zeros(top, np.uint8)
        self.symbol_at, self.length_at = np.zeros(1 << MAX_LENGTH, np.uint32), np.ones(1 << MAX_LENGTH, np.int64)
        word = before = 0
        for length, symbol in sorted((n, s) for s, n in lengths.items()):
            word <<= length - before
            before = length
            self.code[symbol], self.length[symbol] = word, length
            first, size = word << (MAX_LENGTH - length), 1 << (MAX_LENGTH - length)
            self.symbol_at[first : first + size], self.length_at[first : first + size] = symbol, length
            word += 1

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of every STRIDE-th id, and the bits."""
        if not len(ids):
            return np.zeros(0, np.int64), b""
        length = self.length[ids]
        end = np.cumsum(length, dtype=np.int64)
        start = end - length
        # each code lies within the three bytes from the one it starts in; codes never overlap, so sums are unions
        part = self.code[ids] << (24 - (start & 7) - length).astype(np.uint32)
        byte = start >> 3
        new = np.empty(len(ids), bool)
        new[0] = True
        np.not_equal(byte[1:], byte[:-1], out=new[1:])
        first = np.flatnonzero(new)
        joined, at = np.add.reduceat(part, first), byte[first]
        out = np.zeros(int(end[-1] + 7 >> 3) + 2, np.uint8)
        for k in range(3):
            out[at + k] += (joined >> np.uint32(16 - 8 * k) & np.uint32(255)).astype(np.uint8)
        return start[::STRIDE], out[: int(end[-1] + 7 >> 3)].tobytes()

    def decode(self, bits: bytes, n: int, checkpoints: np.ndarray, stride: int) -> np.ndarray:
        raw = np.concatenate((np.frombuffer(bits, np.uint8), np.zeros(3, np.uint8))).astype(np.uint32)
        window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        at, last = checkpoints.astype(np.int64), len(window) - 1
        out = np.empty((stride, len(at)), np.uint32)
        for k in range(stride):
            seen = window[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
            out[k] = self.symbol_at[seen]
            at = at + self.length_at[seen]
        return out.T.reshape(-1)[:n]


def block_bytes(code: Code, doc_ids: list, ids: list[np.ndarray]) -> bytes:
    points, bits = code.encode(np.concatenate(ids))
    n = [len(x) for x in ids]
    return b"".join((
        struct.pack(HEAD, MAGIC, len(ids), len(points), STRIDE, sum(n)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], "<u1").tobytes(),
        np.array(n, "<i8").tobytes(),
        points.astype("<i8").tobytes(),
        bits,
    ))


def block_docs(code: Code, data: bytes):
    """(doc_id, ids) of each document of a block."""
    magic, d, c, stride, n = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a block of a token file")
    at = struct.calcsize(HEAD)
    parts = []
    for kind, k in (("<i8", d), ("<u1", d), ("<i8", d), ("<i8", c)):
        parts.append(np.frombuffer(data, kind, k, at))
        at += parts[-1].nbytes
    ids, ends = code.decode(data[at:], n, parts[3], stride), np.cumsum(parts[2]).tolist()
    for doc, real, a, b in zip(parts[0].tolist(), parts[1].tolist(), [0, *ends], ends, strict=False):
        yield doc if real else None, ids[a:b]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int = 49408, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token folder ``path`` for all rows of ``docs`` in ascending order of document id (null ids first).

    Rows with equal ids are ordered by their ids' bytes. A block ends with the document that brings it to
    ``BLOCK_TOKENS`` ids, so a longer document has one of its own. Texts are tokenised once.
    """
    spark, kind = docs.sparkSession, id_type(vocabulary)
    held_at = shared_path(spark, "token_ids")
    tokens = saved(tokenised(docs, tokenizer_path, end_id, kind, id_col, text_col), "token_ids", held_at)
    found = counts(tokens, kind)
    lengths = code_lengths(found)
    spark.createDataFrame(sorted(lengths.items()), "id long, length int").coalesce(1).write.parquet(f"{path}/code")

    def run(batches):
        forget()
        code, shard = Code(lengths), TaskContext.get().partitionId()
        block = before = held = 0
        names, parts = [], []

        def full():
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "block": [block], "before": [before], "n_docs": [len(names)], "n_tokens": [held], "data": [block_bytes(code, names, parts)]},
                schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())]),
            )

        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(ids, kind)
                names.append(name)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield full()
                    block, before, held, names, parts = block + 1, before + held, 0, [], []
        if names:
            yield full()

    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(found.values()) // SHARD_TOKENS + 1)
    key = [F.col("doc_id"), F.xxhash64("ids")]
    laid = tokens.repartitionByRange(shards, *key).sortWithinPartitions(*key, "ids")
    laid.mapInArrow(run, "shard int, block int, before long, n_docs long, n_tokens long, data binary").write.option("compression", "uncompressed").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
    dropped(spark, held_at)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids), or with ``digest`` ids_crc32 for ids: every document of a token folder.

    start counts the ids of all documents before it. Sums by shard, one number for each, pass through the driver.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = {r["id"]: r["length"] for r in spark.read.parquet(f"{path}/code").collect()}
    shards = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    first = dict(zip(sorted(shards), itertools.accumulate((shards[s] for s in sorted(shards)), initial=0), strict=False))

    def run(batches):
        code = Code(lengths)
        for batch in batches:
            for shard, before, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "before", "data")), strict=True):
                rows, start = [], first[shard] + before
                for doc, ids in block_docs(code, data):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.tolist()))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int64())), strict=True)], ["doc_id", "start", "n_tokens", "x"])

    schema = f"doc_id long, start long, n_tokens long, x {'long' if digest else 'array<long>'}"
    return blocks.select("shard", "before", "data").mapInArrow(run, schema).withColumnRenamed("x", "ids_crc32" if digest else "ids")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as a token folder in the shared folder and return the digest of what is read back."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, end_id)
    return read(docs.sparkSession, path, digest=True)
