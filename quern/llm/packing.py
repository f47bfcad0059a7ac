"""Best-fit packing of documents into sequences of fixed capacity, without conflicts inside a sequence.

Two documents conflict if they have the same source or the same duplicate cluster. Documents longer than ``CAPACITY`` are cut
into full sequences of their own and a rest. Pieces are dealt into shards by a hash, each shard packs its pieces alone,
longest first: open bins lie by the capacity they have left, and the search goes from the tightest level that fits to the next
one until it meets a bin whose bitmaps of sources and clusters have neither of the piece's bits. Levels on which every bin
has the source already are passed over by a count.

Texts are never shuffled, only lengths and hashes; a shard has about ``SHARD_PIECES`` pieces whatever the table's size, and a
hot source or group of copies spreads over all of them.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

CAPACITY = 1024
SHARD_PIECES = 8192
WHITE = r"[\x20\x09-\x0D]+"


def pack(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each piece (length, source, cluster); pieces are placed in the order given."""
    sources, clusters = defaultdict(lambda: len(sources)), defaultdict(lambda: len(clusters))
    levels: list[list[int]] = [[] for _ in range(capacity + 1)]
    with_source: list[dict[int, int]] = [defaultdict(int) for _ in range(capacity + 1)]
    open_levels = 0  # bit r: some bin has r left
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    left: list[int] = []
    out = []
    for length, source, cluster in pieces:
        s, c = sources[source], clusters[cluster]
        bit, other, chosen = 1 << s, 1 << c, -1
        rest = open_levels >> length << length
        while rest and chosen < 0:
            level = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            if with_source[level].get(s, 0) < len(levels[level]):
                chosen = next((b for b in levels[level] if not source_bits[b] & bit and not cluster_bits[b] & other), -1)
        if chosen < 0:
            chosen = len(left)
            left.append(capacity)
            source_bits.append(0)
            cluster_bits.append(0)
        else:
            level = left[chosen]
            levels[level].remove(chosen)
            if not levels[level]:
                open_levels &= ~(1 << level)
            held = source_bits[chosen]
            while held:
                with_source[level][(held & -held).bit_length() - 1] -= 1
                held &= held - 1
        out.append((chosen, capacity - left[chosen]))
        left[chosen] -= length
        source_bits[chosen] |= bit
        cluster_bits[chosen] |= other
        level = left[chosen]
        if level:
            levels[level].append(chosen)
            open_levels |= 1 << level
            held = source_bits[chosen]
            while held:
                with_source[level][(held & -held).bit_length() - 1] += 1
                held &= held - 1
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(doc_id, copy, piece, bin_id, start, n_tokens): where each piece of each row of ``docs`` lies.

    A document has its words and one end mark as tokens; null and empty texts have the end mark alone. Without
    ``cluster_col`` texts whose words are equal without regard to case are a cluster. Rows that are alike in id, source, text
    and length are told apart by copy (1, 2, ...). Null ids, sources and clusters are values of their own. bin_id is
    unique over all shards. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.array_remove(F.split(F.lower(text), WHITE), "")
    cluster = F.col(f"`{cluster_col}`") if cluster_col else F.xxhash64("_words")
    slim = docs.withColumn("_words", words).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), cluster.cast("long").alias("cluster"), (F.size("_words") + 1).cast("long").alias("length"))
    alike = saved(slim.groupBy("doc_id", "source", "cluster", "length").count(), "packing_lengths")
    pieces_n = alike.agg(F.sum(F.col("count") * F.ceil(F.col("length") / capacity))).first()[0] or 0
    shards = max(1, -(-int(pieces_n) // SHARD_PIECES))
    one = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).drop("count")
    one = one.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("length") / capacity) - 1).cast("int"))))
    one = one.withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("piece") * capacity)).drop("length")
    one = one.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy", "piece"), F.lit(shards)))

    def place(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["n_tokens", "doc_id", "source", "cluster", "copy", "piece"], ascending=[False, True, True, True, True, True], kind="stable")
        source = [None if pd.isna(x) else x for x in table["source"]]
        cluster = [None if pd.isna(x) else x for x in table["cluster"]]
        found = pack(list(zip(table["n_tokens"].tolist(), source, cluster, strict=True)), capacity)
        shard = int(table["shard"].iloc[0])
        return table[["doc_id", "copy", "piece"]].assign(bin_id=[shard << 32 | b for b, _ in found], start=[s for _, s in found], n_tokens=table["n_tokens"])

    return one.groupBy("shard").applyInPandas(place, "doc_id long, copy int, piece int, bin_id long, start long, n_tokens long")
