"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits. DataFrame operations only.

Every five-word shingle of a text is hashed once (fewer words: the whole sequence is the one shingle). The top bits of the hash
name one of ``BINS`` bins, each bin keeps its smallest hash. An empty bin takes over from the filled bin that a hash of
(empty bin, filled bin) puts first: the first filled bin of a random order of its own, as in optimal densification, so
two texts agree in such a bin with the probability of their Jaccard likeness, too. Of each bin the low ``BITS`` bits are
stored. Two different hashes agree there with probability 2^-BITS, which the estimate takes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import below

SHINGLE = 5
LOG_BINS = 7
BINS = 1 << LOG_BINS
BITS = 8
#: Rows to a range of ids, and the most ranges, when documents are put beside their successors; ids drawn for each range to cut by.
RANGE_ROWS, MOST_RANGES, DRAWN = 500, 1 << 16, 64
WHITE = r"[\x20\x09-\x0D]+"


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the hashes of the shingles of the column ``text``, repeats included; empty for a text without words."""
    words, n = f"_{out}_words", F.size(f"_{out}_words")
    df = df.withColumn(words, F.transform(F.array_remove(F.split(F.col(text), WHITE), ""), lambda w: F.xxhash64(w)))
    at = lambda i, k: F.get(F.col(words), i + k)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(at(i, k) for k in range(SHINGLE))))
    none = F.array().cast("array<bigint>")
    return df.withColumn(out, F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.xxhash64(F.col(words)))).otherwise(none)).drop(words)


def _bin(x: Column) -> Column:
    """Bins in the order of signed hashes."""
    return F.shiftright(x, 64 - LOG_BINS).cast("int") + BINS // 2


def with_signature(df: DataFrame, shingles: str, out: str) -> DataFrame:
    """Replace ``shingles`` by ``out``: array of BINS low-order values, empty for no shingles."""
    mask = (1 << BITS) - 1
    low = lambda x: x.bitwiseAND(F.lit(mask).cast("long")).cast("int")
    order, least, slots = f"_{out}_sorted", f"_{out}_least", f"_{out}_slots"
    prev = lambda a, i: F.get(F.col(a), i - 1)
    df = df.withColumn(order, F.sort_array(shingles)).drop(shingles)
    df = df.withColumn(least, F.filter(F.col(order), lambda x, i: (i == 0) | (_bin(x) != _bin(prev(order, i))))).drop(order)
    empty = lambda n: F.array_repeat(F.lit(-1), n)
    filled = F.transform(F.col(least), lambda x, i: F.concat(empty(_bin(x) - F.when(i == 0, -1).otherwise(_bin(prev(least, i))) - 1), F.array(low(x))))
    last = _bin(F.get(F.col(least), F.size(least) - 1))
    df = df.withColumn(slots, F.when(F.size(least) > 0, F.concat(F.flatten(filled), empty(BINS - 1 - last))).otherwise(F.array().cast("array<int>")))
    first = lambda j: low(F.array_min(F.transform(F.col(least), lambda x: F.xxhash64(j, _bin(x)).bitwiseAND(F.lit(~mask).cast("long")).bitwiseOR(x.bitwiseAND(F.lit(mask).cast("long"))))))
    return df.withColumn(out, F.transform(F.col(slots), lambda v, j: F.when(v >= 0, v).otherwise(first(j)))).drop(slots, least)


def packed(signature: str) -> Column:
    """Hexadecimal string of BITS bits a bin; empty for a text without words."""
    digits = BITS // 4
    return F.lower(F.array_join(F.transform(F.col(signature), lambda v: F.lpad(F.hex(v), digits, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard likeness from two signatures, 0 to 1, without the share of chance agreements. Two texts without words are alike."""
    chance = 2.0**-BITS
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    some = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when(F.size(a) == F.size(b), F.when(F.size(a) == 0, 1.0).otherwise(some)).otherwise(0.0)


def beside_next(df: DataFrame, id_col: str, carried: list[str], tie: str) -> DataFrame:
    """Add ``next``: a struct of the ``carried`` columns of the row with the next larger id (of the smallest after the largest).

    Ids are cut into ranges, each a window partition of its own that may spill; where the cuts lie changes how work is dealt, not
    the result, so they come from ids drawn by hash. The first rows of a range are sent to the range before it as well, so the last
    row of a range finds its successor there. Rows with equal ids come in the order of ``tie``, rows without id first.
    Only the cuts and one id for each range pass through the driver.
    """
    at = F.coalesce(F.col(id_col), F.lit(-(1 << 63)).cast("long"))
    rows = df.count()
    if not rows:
        return df.withColumn("next", F.struct(*carried))
    ranges = max(1, min(MOST_RANGES, rows // RANGE_ROWS))
    drawn = df.where(F.pmod(F.xxhash64(at), F.lit(1 << 20)) <= int(min(1.0, DRAWN * ranges / rows) * (1 << 20)))
    cuts = (drawn.agg(F.percentile_approx(at, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []) if ranges > 1 else []
    own = below(at, sorted(set(cuts)))
    first = {r["r"]: r["f"] for r in df.groupBy(own.alias("r")).agg(F.min(at).alias("f")).collect()}
    there = sorted(first)
    before = dict(zip(there, [there[-1], *there[:-1]], strict=True))
    table = lambda values: F.array(*(F.lit(v) for v in values))
    top = there[-1] + 1
    firsts = table(first.get(i, 0) for i in range(top)).cast("array<bigint>")
    befores = table(before.get(i, 0) for i in range(top)).cast("array<int>")
    df = df.withColumn("_range", own)
    home, guest = F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")), F.struct(F.get(befores, F.col("_range")).alias("r"), F.lit(1).alias("guest"))
    df = df.withColumn("_in", F.explode(F.when(at == F.get(firsts, F.col("_range")), F.array(home, guest)).otherwise(F.array(home))))
    order = Window.partitionBy("_in.r").orderBy("_in.guest", F.col(id_col).asc_nulls_first(), *([F.xxhash64(tie), F.col(tie)]))
    return df.withColumn("next", F.lead(F.struct(*carried)).over(order)).where("_in.guest = 0").drop("_in", "_range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), one row for each row of ``docs``; a null text counts as empty."""
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return with_signature(with_shingles(df, "text", "h"), "h", "sig").select("doc_id", packed("sig").alias("fingerprint"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row of ``docs``.

    The edited text has the last quarter (rounded down) of the code points replaced by as many from the beginning of the next
    document, or all that it has. Null texts are empty. Rows without id come first, equal ids in the order of a hash of their
    texts; in a table of one row the row is its own next one. An empty table gives an empty result.
    """
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    own = with_signature(with_shingles(df, "text", "h"), "h", "sig")
    # the ranges come from ids alone: nothing else is read for them
    own = beside_next(own, "doc_id", ["text", "sig"], "text")
    n = F.length("text")
    own = own.withColumn("edited", F.concat(F.expr("left(text, length(text) - length(text) div 4)"), F.expr("left(next.text, cast(length(text) div 4 as int))"))).withColumn("n_chars", n.cast("long"))
    own = own.select("doc_id", "n_chars", "sig", F.col("next.sig").alias("next_sig"), "edited")
    own = own.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    out = with_signature(with_shingles(own, "edited", "h"), "h", "edited_sig")
    return out.select("doc_id", "n_chars", "edited_sha256", packed("sig").alias("fingerprint"), packed("edited_sig").alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
