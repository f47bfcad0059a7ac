"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint is 64 majority bits over the XXH64 hashes of a text's three-word shingles. Fingerprints that differ in at
most ``MAX_BITS`` = 2 bits are linked. The search needs no pass over pairs:

* the 64 bits are cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect (23, 12, 7) code;
* two errors leave at least one of three segments untouched (pigeonhole), and the next segment has at most two errors;
* any two 23-bit words within two bits of each other have a codeword within distance four of both: a word whose nearest
  codeword is at most two bits off has that one key, a word three bits off has six.

So (segment number, exact segment, codeword index of the next segment) is a key that every linked pair shares: 3 to 18
keys for each distinct fingerprint. Buckets of up to ``DENSE`` fingerprints are joined and verified bit by bit. Larger
ones go another exact way with a fixed number of rows for each fingerprint: each one is sent to the 65 words within one
bit of it, and two of them are within two bits exactly if they meet at such a word, where at most 65 can meet.

Copies collapse before anything is joined: links and components are between distinct fingerprints, so a group of equal
texts, however large, is one row there.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, id_and_bytes, map_rows, saved

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Buckets above this many distinct fingerprints are linked through words one bit away instead of pairs.
DENSE = 32
#: A fingerprint of more than 1 row in so many is hot; there are fewer than that many, and they are joined by broadcast.
HOT_PART = 1000
#: Shingles whose bits are counted at a time, so that a very long text needs no more memory for them.
CHUNK = 1 << 16

# Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary (23, 12, 7) code.
GENERATOR = 0b110001110101
LENGTH, MESSAGE, PARITY = 23, 12, 11


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of UTF-8 ``text``; 0 for a text without words."""
    words = text.lower().split()  # of bytes: A-Z only, cut at ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < width:
        spans = [(0, len(line))]
    else:
        spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), CHUNK):
        part = np.array([digest(line[a:b], SEED) for a, b in spans[at : at + CHUNK]], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, row_hash): one row for each row of ``docs``; fp is the fingerprint as a signed long, row_hash a hash of all columns. A null text counts as empty."""

    def make():
        def work(ids, texts, hashes):
            return {"doc_id": ids, "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), "row_hash": hashes}

        return work

    return map_rows(id_and_bytes(docs, id_col, text_col, row_hash(docs).alias("row_hash")), make, "doc_id long, fp long, row_hash long")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; what cannot be hashed, maps, is taken as text."""
    return F.xxhash64(*(F.col(f"`{c}`").cast("string") if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes))


class Golay:
    """Decoding tables of the perfect code, built from the generator polynomial."""

    def __init__(self) -> None:
        unit = [self._remainder(1 << i) for i in range(LENGTH)]
        leader, weight = np.zeros(1 << PARITY, np.uint32), np.zeros(1 << PARITY, np.uint8)
        for w in (1, 2, 3):
            for where in itertools.combinations(range(LENGTH), w):
                syndrome = 0
                for p in where:
                    syndrome ^= unit[p]
                leader[syndrome], weight[syndrome] = sum(1 << p for p in where), w
        light = [c for i in range(1 << MESSAGE) if (c := i << PARITY | self._remainder(i << PARITY)).bit_count() == 7]
        #: For each syndrome, what to add to a word to reach its keys: the nearest codeword, and for words three bits off
        #: the five others at distance four.
        self.step, self.count = np.zeros((1 << PARITY, 6), np.uint32), np.where(weight == 3, 6, 1)
        for s in range(1 << PARITY):
            error = int(leader[s])
            self.step[s, 0] = error
            if weight[s] == 3:
                self.step[s, 1:] = [error ^ c for c in light if c & error == error]
        self.high = np.array([self._remainder(i << PARITY) for i in range(1 << MESSAGE)], np.uint32)

    @staticmethod
    def _remainder(word: int) -> int:
        for bit in range(LENGTH - 1, PARITY - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - PARITY)
        return word

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword indices (n, 6) of 23-bit words, and which of the six count."""
        syndrome = self.high[words >> PARITY] ^ (words & ((1 << PARITY) - 1))
        return (words[:, None] ^ self.step[syndrome]) >> PARITY, np.arange(6) < self.count[syndrome][:, None]


def segments(fps: np.ndarray) -> list[np.ndarray]:
    """The 22, 21 and 21 bits of unsigned fingerprints, high bits first."""
    low = np.uint64((1 << 21) - 1)
    return [(fps >> np.uint64(42)).astype(np.uint32), (fps >> np.uint64(21) & low).astype(np.uint32), (fps & low).astype(np.uint32)]


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): the 3 to 18 keys of each fingerprint in ``distinct`` (fp)."""

    def run(batches):
        code = Golay()
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            parts = segments(fps.view(np.uint64))
            for i in range(3):
                index, real = code.keys(parts[(i + 1) % 3])
                key = np.int64(i) << 34 | parts[i].astype(np.int64)[:, None] << 12 | index
                yield pa.RecordBatch.from_pydict({"key": key[real], "fp": np.broadcast_to(fps[:, None], real.shape)[real]})

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b), a < b: pairs of distinct fingerprints that connect all that are linked.

    From buckets of up to ``dense`` fingerprints come all their linked pairs; from larger ones each fingerprint's link to
    the smallest one that it meets one bit away, which joins up the same components.
    """
    keys = fuzzy_keys(distinct)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    with Scratch(distinct.sparkSession) as work:
        shared = work.saved(keys.join(sizes, "key"), "buckets")
        small = shared.where(F.col("n") <= dense).select("key", "fp")
        pairs = (
            small.withColumnRenamed("fp", "a")
            .join(small.withColumnRenamed("fp", "b"), "key")
            .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
            .select("a", "b")
        )
        crowded = shared.where(F.col("n") > dense).select("fp").distinct()
        near = crowded.select("fp", F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))).alias("bit"))
        met = near.groupBy(F.col("fp").bitwiseXOR(F.col("bit")).alias("at")).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
        return saved(pairs.union(stars).distinct(), "simhash_links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) the smallest node that it is connected with.

    Rounds of large-star and small-star steps, each written to the shared folder: a step joins every node to the smallest
    of its neighbours, so the number of rounds grows with the logarithm of the longest path and edges never multiply.
    """
    with Scratch(edges.sparkSession) as work:
        now = work.saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "step_0")
        step, done = 0, now.isEmpty()
        while not done:
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (
                large.join(least, "u")
                .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
                .select("e.u", "e.v")
                .where("u <> v")
                .distinct()
            )
            step += 1
            now = work.saved(small, f"step_{step}")
            work.drop(f"step_{step - 1}")
            # every node hangs on a root, and no root hangs on another: what the next round would leave as it is
            done = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and now.alias("x").join(now.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi").isEmpty()
        found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        return saved(found, "simhash_components")


def _named(fps: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of ``fps`` with the columns of ``values``, one row for each fp with its number of rows n; hot fingerprints apart."""
    hot = values.where(F.col("n") * HOT_PART > fps.count()).drop("n")  # fewer than HOT_PART rows
    cold = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(values.drop("n"), "fp")
    return cold.unionByName(fps.join(F.broadcast(hot), "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, n_links, row_hash, chosen), one row for each row of ``docs``.

    component_id is the smallest id among the documents that can be reached over links; n_links counts the distinct
    fingerprints of the component besides its own. chosen marks the row of a component to keep: the one with the smallest id,
    of several with that id, or without any id, the one with the smallest row_hash; rows that are equal in all columns are
    marked alike. Null texts are empty and have fingerprint 0; rows with a null id keep it, and count for a component only
    where no other id does. Repeated rows stay; an empty table gives an empty result.
    """
    fps = saved(fingerprints(docs, id_col, text_col), "simhash_fingerprints")
    best = F.min(F.struct(F.isnull("doc_id").alias("no"), F.col("doc_id").alias("id"), F.col("row_hash").alias("h")))
    distinct = fps.groupBy("fp").agg(best.alias("first"), F.count("*").alias("n"))
    found = components(links(distinct))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = saved(rooted, "simhash_roots")
    whole = rooted.groupBy("root").agg(F.min("first").alias("first"), (F.count("*") - 1).alias("n_links"))
    values = rooted.select("fp", "root", "n").join(whole, "root").select("fp", "n", F.col("first.id").alias("component_id"), "n_links", F.col("first.h").alias("h"))
    chosen = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_hash") == F.col("h"))
    return _named(fps, values).select("doc_id", "fp", "component_id", "n_links", "row_hash", chosen.alias("chosen"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one that ``near_duplicates`` chooses; of rows equal in all columns one stays."""
    found = near_duplicates(docs, id_col, text_col)
    key = ["doc_id", "row_hash"]
    names = {k: fresh(k, docs.columns) for k in key}
    # what is to go, and what is chosen but there more than once; both by id and hash, never by id alone
    slim = saved(found.groupBy(*key, "chosen").agg(F.count("*").alias("n")).select(F.coalesce("doc_id", F.lit(0)).alias(names["doc_id"]), F.col("row_hash").alias(names["row_hash"]), "chosen", F.col("n").alias("copies")).where("not chosen or copies > 1"), "simhash_marks")
    keyed = docs.withColumns({names["doc_id"]: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)), names["row_hash"]: row_hash(docs)})
    on = list(names.values())
    straight = keyed.join(slim.select(*on), on, "left_anti").drop(*on)
    tied = slim.where("chosen").select(*on)
    if tied.isEmpty():
        return straight
    whole = [c for c in docs.columns]
    one = keyed.join(tied, on, "left_semi").groupBy(*on).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in whole))).alias("d"))
    return straight.unionByName(one.select(*(F.col("d").getField(c).alias(c) for c in whole)))
