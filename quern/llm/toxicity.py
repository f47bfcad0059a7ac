"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary training texts, give each symbol of a word its probability after the up
to five symbols before it in the word (``^`` opens a word, its end is a symbol too; A-Z count as a-z, UTF-8 bytes are the
symbols). Both interpolate the class's own discounted counts with one shared backoff: continuation counts over both classes,
down to single symbols. So an expression that neither class has seen says nothing, and a rare one speaks through its parts.

A text is compared by length-normalised log-likelihoods, toxic minus ordinary: over the whole text; over its most suspicious
runs of 16 and of 4 words, which find a few expressions in a long text; and, for what lies scattered, over the words that
favour the toxic model by more than 1, 2 or 3 nats (the square root of that excess by symbol), which leaves out the drift
of ordinary words that the smaller class knows less well. A logistic curve over these six figures, fitted on a bounded
sample of training texts that were kept out of the counts, turns them into a score.

Counts cover all training texts: words are counted per task, summed over the cluster, and cut into n-grams there; n-grams
are distinct before continuation counts are taken. Only the model itself reaches the driver and the workers: one row of
counts for each distinct n-gram and context, by its 64-bit hash, so it grows with the distinct n-grams of the training words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_and_bytes, is_small

ORDER = 6
DISCOUNT = 0.75
RUNS = (16, 4)
EXCESS = (1, 2, 3)
FIGURES = ("mean", *(f"peak_{n}" for n in RUNS), *(f"excess_{n}" for n in EXCESS))
#: At most so many labelled texts, drawn by a hash of their ids, fit the logistic curve.
CALIBRATION_ROWS = 20_000
REMEMBERED = 1 << 18
START, END = 256, 257
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Columns of the model: raw counts of full n-grams and of their contexts by class, kinds of symbols after a context by
#: class; continuation counts of shorter n-grams, their sums and kinds by context.
FIELDS = ("toxic", "ordinary", "ctx_toxic", "ctx_ordinary", "kinds_toxic", "kinds_ordinary", "cont", "ctx_cont", "ctx_kinds")


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5


def grams(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each symbol, by length 0 to ORDER; each symbol's place in its word; its word's number."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    at = np.cumsum(n) - n
    symbols = np.frombuffer(b"\0" + b"\0\0".join(words) + b"\0", np.uint8).astype(np.uint64)
    symbols[at], symbols[at + n - 1] = START, END
    word = np.repeat(np.arange(len(words)), n)
    place = np.arange(len(symbols)) - at[word]
    hashes = [np.full(len(symbols), 1, np.uint64)]
    for _ in range(ORDER):
        before = np.concatenate((np.ones(1, np.uint64), hashes[-1][:-1]))
        hashes.append(before * STEP + symbols + np.uint64(1))
    return hashes, place, word


def before(h: np.ndarray) -> np.ndarray:
    """The hash one symbol earlier."""
    return np.concatenate((h[:1], h[:-1]))


def mixed(h: np.ndarray) -> np.ndarray:
    """One to one, with even leading bits."""
    return (h ^ (h >> np.uint64(29))) * SPREAD


def bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def rows_of(tables: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """The table row of each hash; the last row, of zeros, for those that the table does not have."""
    keys, first, wanted = tables["keys"], tables["first"], mixed(h)
    own = bucket(wanted, (len(first) - 1).bit_length() - 1)
    at, end = first[own], first[own + 1]
    out = np.full(len(h), len(keys), np.int32)
    left = np.flatnonzero(at < end)
    at, end, wanted = at[left], end[left], wanted[left]
    while len(left):
        there = keys[at]
        hit = there == wanted
        out[left[hit]] = at[hit]
        go = (there < wanted) & (at + 1 < end)
        left, at, end, wanted = left[go], at[go] + 1, end[go], wanted[go]
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, and for the columns ``toxic``, ``kept_out`` of docs its counts t0, o0, t1, o1: toxic and ordinary, counted and kept out)."""

    def run(batches):
        found = [Counter() for _ in range(4)]

        def emit():
            words = list(set().union(*found))
            return pa.RecordBatch.from_pydict({"word": words} | {n: [c[w] for w in words] for n, c in zip(("t0", "o0", "t1", "o1"), found, strict=True)}, schema=pa.schema([("word", pa.binary()), *((n, pa.int64()) for n in ("t0", "o0", "t1", "o1"))]))

        for batch in batches:
            for text, toxic, out in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "kept_out")), strict=True):
                found[2 * out + (not toxic)].update(text.lower().split())
                if sum(map(len, found)) > REMEMBERED:
                    yield emit()
                    found = [Counter() for _ in range(4)]
        yield emit()

    parts = docs.select("text", "toxic", "kept_out").mapInArrow(run, "word binary, t0 long, o0 long, t1 long, o1 long")
    return parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("t0", "o0", "t1", "o1")))


def model(words: DataFrame) -> dict[str, np.ndarray]:
    """The tables of both class models from (word, toxic, ordinary): sorted ``keys`` (mixed hashes), the ``first`` row of each
    bucket of leading bits, and FIELDS by row with a last row of zeros. A row of each distinct n-gram and context reaches the driver."""

    def cut(batches):
        for batch in batches:
            found = batch.column("word").to_pylist()
            if not found:
                continue
            hashes, place, word = grams(found)
            toxic, ordinary = (batch.column(c).to_numpy()[word] for c in ("toxic", "ordinary"))
            for m in range(1, ORDER + 1):
                ends = place >= max(m - 1, 1)  # within the word, and not the opening mark alone
                full = (m == ORDER) | (place == m - 1)  # nothing longer exists
                g, c, s = (h[ends].view(np.int64) for h in (hashes[m], before(hashes[m - 1]), hashes[m - 1]))
                own, first, inverse = np.unique(g, return_index=True, return_inverse=True)
                add = lambda x: np.bincount(inverse, x, len(own)).astype(np.int64)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"m": np.full(len(own), m, np.int8), "g": own, "ctx": c[first], "rest": s[first], "whole": full[ends][first], "opens": (place == m - 1)[ends][first], "toxic": add(toxic[ends]), "ordinary": add(ordinary[ends])})

    table = words.mapInArrow(cut, "m byte, g long, ctx long, rest long, whole boolean, opens boolean, toxic long, ordinary long")
    table = table.groupBy("m", "g", "ctx", "rest", "whole", "opens").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    with Scratch(words.sparkSession) as work:
        return _tables(work.saved(table.where("toxic + ordinary > 0"), "grams"))


def _tables(table: DataFrame) -> dict[str, np.ndarray]:
    """The tables from (m, g, ctx, rest, whole, opens, toxic, ordinary): a row for each n-gram."""
    full = table.where("whole")
    shorter = table.where("m > 1").groupBy("rest").agg(F.count("*").alias("cont"))
    # contexts of shorter n-grams: each distinct one brings its continuation count and one kind
    inner = table.where("not opens").select("g", "ctx").join(shorter.withColumnRenamed("rest", "g"), "g")
    zero = {f: F.lit(0) for f in FIELDS}

    def rows(df: DataFrame, key: str, **values) -> DataFrame:
        return df.select(F.col(key).alias("h"), *(F.lit(v).cast("long").alias(f) for f, v in (zero | values).items()))

    both = {"toxic": F.col("toxic"), "ordinary": F.col("ordinary")}
    parts = (
        rows(full, "g", **both)
        .union(rows(full, "ctx", ctx_toxic=F.col("toxic"), ctx_ordinary=F.col("ordinary"), kinds_toxic=(F.col("toxic") > 0).cast("long"), kinds_ordinary=(F.col("ordinary") > 0).cast("long")))
        .union(rows(shorter, "rest", cont=F.col("cont")))
        .union(rows(inner, "ctx", ctx_cont=F.col("cont"), ctx_kinds=1))
    )

    found = parts.groupBy("h").agg(*(F.sum(f).cast("float").alias(f) for f in FIELDS)).toArrow()
    keys = mixed(found.column("h").to_numpy().view(np.uint64))
    at = np.argsort(keys)
    keys = keys[at]
    bits = max(1, len(keys).bit_length())
    out = {"keys": keys, "first": np.searchsorted(bucket(keys, bits), np.arange((1 << bits) + 1)).astype(np.int32)}
    for f in FIELDS:
        out[f] = np.append(found.column(f).to_numpy()[at], np.float32(0))
    del found, at
    pa.default_memory_pool().release_unused()
    return out


def ratios(tables: dict[str, np.ndarray], words: list[bytes], symbols: int = 1 << 15) -> np.ndarray:
    """For each word the sum over its symbols of log P(toxic model) - log P(ordinary model); about ``symbols`` of them at a time."""
    part = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2) - 1) // symbols
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
    return np.concatenate([_ratios(tables, words[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a] or [np.zeros(0)])


def _ratios(tables: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    hashes, place, word = grams(words)
    use = place > 0
    slots = []
    for m, h in enumerate(hashes):  # n-grams that lie within one word; the empty one is the same everywhere
        inside = np.flatnonzero(place >= m - 1) if m else slice(None)
        slots.append(np.full(len(h), len(tables["keys"]), np.int32))
        slots[-1][inside] = rows_of(tables, h[inside] if m else h[:1])
    ctx = [before(s) for s in slots]
    # shared backoff, from single symbols up to what one symbol less than the full context gives
    shared = np.full(len(place), 1 / 258)
    levels = [shared]
    for m in range(1, ORDER):
        count, total, kinds = tables["cont"][slots[m]], tables["ctx_cont"][ctx[m - 1]], tables["ctx_kinds"][ctx[m - 1]]
        seen = (total > 0) & (place >= m)
        level = np.where(seen, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * levels[-1]) / np.maximum(total, 1), levels[-1])
        levels.append(np.maximum(level, 1e-9))
    length = np.minimum(place + 1, ORDER)
    row = np.arange(len(place))
    below = np.stack(levels)[length - 1, row]
    g, c = np.stack(slots)[length, row], np.stack(ctx)[length - 1, row]
    log = []
    for kind in ("toxic", "ordinary"):
        total = tables[f"ctx_{kind}"][c]
        own = (np.maximum(tables[kind][g] - DISCOUNT, 0) + DISCOUNT * tables[f"kinds_{kind}"][c] * below) / np.maximum(total, 1)
        log.append(np.log(np.maximum(np.where(total > 0, own, below), 1e-12)))
    return np.bincount(word, np.where(use, log[0] - log[1], 0), len(words))


def figures(words: list[bytes], ratio: np.ndarray) -> list[float]:
    """FIGURES of a text: log-likelihood differences by symbol, of all of it, of its worst runs, and of its worst words."""
    if not words:
        return [0.0] * len(FIGURES)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    total, length = np.concatenate(([0], np.cumsum(ratio))), np.concatenate(([0], np.cumsum(size)))
    out = [total[-1] / length[-1]]
    for n in RUNS:
        n = min(n, len(words))
        out.append(((total[n:] - total[:-n]) / (length[n:] - length[:-n])).max())
    out += [np.sqrt(np.maximum(ratio - nats, 0).sum() / length[-1]) for nats in EXCESS]
    return [float(x) for x in out]


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns: one pass over the texts, no join."""
    share, curve = fitted(docs, labels, id_col, text_col)
    if curve is None:
        return docs if share < threshold else docs.where(F.lit(False))
    sent, weight, offset = curve
    types = docs.schema
    most = np.log(threshold) - np.log1p(-threshold)

    def run(batches):
        score = Scorer(sent.value)
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                odds = np.array(score([(t or "").encode() for t in part.column(text_col).to_pylist()])).reshape(-1, len(FIGURES)) @ weight + offset
                yield part.filter(pa.array(odds < most))

    return docs.mapInArrow(run, types)


class Scorer:
    """FIGURES of texts; remembers what words are worth."""

    def __init__(self, tables: dict[str, np.ndarray]) -> None:
        self.tables, self.known = tables, {}

    def __call__(self, texts: list[bytes]) -> list[list[float]]:
        split = [t.lower().split() for t in texts]
        new = list(set().union(*split).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(set().union(*split))
        if new:
            self.known.update(zip(new, ratios(self.tables, new).tolist(), strict=True))
        look = self.known.__getitem__
        return [figures(w, np.fromiter(map(look, w), float, len(w))) for w in split]


def measured(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """``docs`` (with text binary) with FIGURES in place of the text, by the model that was sent."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        score = Scorer(sent.value)
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                found = score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(x, pa.float64()) for x in zip(*found, strict=True))], [*kept, *FIGURES])

    types = dict(docs.dtypes)
    return docs.select(*kept, "text").mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"{c} double" for c in FIGURES)]))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic curve by Newton steps, on figures that are scaled first."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - centre) / scale, np.ones(len(x))))
    w, keep = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + keep, z.T @ (p - y) / len(z) + keep @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * centre / scale).sum())


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str):
    """The share of toxic labels, and (model sent to the workers, weights, offset), None without labels of both classes."""
    own = id_and_bytes(docs, id_col, text_col)
    truth = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null").where(fold("doc_id") != 0)
    context = docs.sparkSession.sparkContext
    with Scratch(docs.sparkSession) as work:
        truth = work.saved(truth.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
        train = own.join(F.broadcast(truth) if is_small(truth) else truth, "doc_id").withColumn("toxic", F.col("toxic") > 0).withColumn("kept_out", fold("doc_id") == 4)
        words = work.saved(word_counts(train), "words")
        has = [bool(x) for x in words.agg(*(F.sum(c) for c in ("t0", "o0", "t1", "o1"))).first()]
        if not ((has[0] or has[2]) and (has[1] or has[3])):
            return truth.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0, None
        folded = words.select("word", (F.col("t0") + F.col("t1")).alias("toxic"), (F.col("o0") + F.col("o1")).alias("ordinary"))
        apart = all(has)
        # one model at a time on the driver: that of the sample goes before the final one comes
        tables = model(words.select("word", F.col("t0").alias("toxic"), F.col("o0").alias("ordinary")) if apart else folded)
        rate = min(1.0, CALIBRATION_ROWS / max(1, (truth.where(fold("doc_id") == 4) if apart else truth).count()))
        drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(rate * (1 << 20))
        sent = context.broadcast(tables)
        if apart:
            del tables
        sample = measured(train.where(F.col("kept_out") & drawn if apart else drawn).select("toxic", "text"), sent).toArrow()
        sent.destroy()
        sent = context.broadcast(model(folded) if apart else tables)
    x = np.column_stack([sample.column(c).to_numpy() for c in FIGURES])
    weight, offset = logistic(x, sample.column("toxic").to_numpy(zero_copy_only=False).astype(float))
    return None, (sent, weight, offset)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, FIGURES...), one row for each row of ``docs``.

    Labels (``doc_id``, ``toxic``) of rows whose fold is 0 are held out: neither counts nor the curve see them. The fold 4
    fits the curve against counts of folds 1 to 3; the final counts have folds 1 to 4. Texts only are scored: no label,
    language, source or id. Null and empty texts have figures of 0. Rows with a null id are scored and not held out; an
    id with several labels counts as toxic if one says so; repeated rows each count. Without labels of both classes the
    score is the share of toxic labels, 0 if there are none.
    """
    own = id_and_bytes(docs, id_col, text_col)
    share, curve = fitted(docs, labels, id_col, text_col)
    if curve is None:
        out = own.select("doc_id", F.lit(share).alias("score"), *(F.lit(0.0).alias(c) for c in FIGURES))
    else:
        sent, weight, offset = curve
        odds = sum((F.lit(float(w)) * F.col(c) for w, c in zip(weight, FIGURES, strict=True)), F.lit(offset))
        out = measured(own, sent).withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FIGURES)
