"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far to trust each.

Each rule looks at one figure of a text and votes good (1), bad (-1) or abstains (0). Under a two-class model in which
votes are independent given the class, expectation-maximisation over the counts of all vote patterns estimates the
prior of good texts and each rule's vote probabilities in both classes; the posterior probability of "good" replaces
the demand that a text pass every rule. Patterns are counted in Spark over all rows; at most 3^rules of them exist.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved

WINDOW = 8
#: Multiplier of the window hash: odd, bits well mixed.
MIX = np.uint64(0x9E3779B97F4A7C15)
MIN_WORDS = 20
#: Figures of a text, in the order of ``figures``.
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_ends")


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words which occurs twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * MIX + hashes[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = np.concatenate(([False], np.diff(rolled[order]) == 0, [False]))
    twice = order[same[1:] | same[:-1]]
    if not len(twice):
        return 0
    edge = np.bincount(twice, minlength=len(hashes) + 1) - np.bincount(twice + WINDOW, minlength=len(hashes) + 1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def figures(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines, seen, copies = raw.split(b"\n"), set(), 0
    for line in lines:
        if line in seen:
            copies += 1
        elif line.split(None, 1):
            seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    spaces = sum(text.count(c) for c in " \t\n\v\f\r")
    marks = sum(text.count(c) for c in ",;:!?()[]{}\"'-_=+/\\@^~`0123456789") + text.count(".")
    digest = xxhash.xxh64_intdigest
    repeats = repeated_words(np.fromiter(map(digest, words), np.uint64, len(words))) if len(words) > WINDOW else 0
    with_words = [line for line in (x.rstrip() for x in lines) if line]
    ends = sum(line.endswith((b".", b"!", b"?", b":", b";", b'"')) for line in with_words)
    return len(words), len(text) - spaces, symbols, copies, repeats, len(with_words), len(text) - spaces - symbols - marks, ends


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, FIGURES...), one row for each row of ``docs``; a null text has no words."""

    def make():
        def work(ids, texts):
            found = [figures(t or "") for t in texts]
            return {"doc_id": ids} | {name: [f[i] for f in found] for i, name in enumerate(FIGURES)}

        return work

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(source, make, "doc_id long, " + ", ".join(f"{n} long" for n in FIGURES))


class Rule(NamedTuple):
    name: str
    good: Column
    bad: Column


def rules() -> list[Rule]:
    """The default rules. Ratios are per 100 words or characters; a text without words gets votes for its length only."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    per_word = lambda c: 100 * F.col(c) / F.when(words > 0, words)
    per_char = lambda c: 100 * F.col(c) / F.when(chars > 0, chars)
    mean = chars / F.when(words > 0, words)
    return [
        Rule("length", words >= 50, words < MIN_WORDS),
        Rule("word_length", mean.between(3, 9), ~mean.between(2, 15)),
        Rule("symbols", per_word("n_symbols") < 1, per_word("n_symbols") > 10),
        Rule("repeats", per_word("n_repeat_words") < 5, per_word("n_repeat_words") > 20),
        Rule("copied_lines", F.col("n_dup_lines") * 20 < lines, F.col("n_dup_lines") * 3 > lines),
        Rule("letters", per_char("n_letters") > 90, per_char("n_letters") < 75),
        Rule("line_ends", F.col("n_ends") * 2 >= lines, (F.col("n_ends") * 10 < lines) & (lines > 3)),
    ]


class Model(NamedTuple):
    prior: float
    #: log of P(vote | good) / P(vote | bad), for each rule at votes -1, 0, 1
    weight: np.ndarray
    accuracy: np.ndarray


def estimate(votes: np.ndarray, count: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> Model:
    """EM over vote patterns (patterns, rules) in -1, 0, 1 and how often each occurs.

    It begins at rules that are right four times in five; one added observation a vote and class keeps every probability
    above 0, and a rule's better-than-chance reading in the start fixes which class is "good".
    """
    rules_n = votes.shape[1] if votes.ndim == 2 else 0
    hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    share = (hot * count[:, None, None]).sum(0) / max(count.sum(), 1)
    p = np.empty((2, rules_n, 3))
    voted = 1 - share[:, 1]
    for c, right in ((0, 0), (1, 2)):
        p[c, :, 1], p[c, :, right], p[c, :, 2 - right] = share[:, 1], 0.8 * voted, 0.2 * voted
    p, prior, before = np.clip(p, 1e-6, 1), 0.8, -np.inf
    for _ in range(rounds):
        log = [np.log(q) + (hot * np.log(p[c])).sum((1, 2)) for c, q in ((0, 1 - prior), (1, prior))]
        total = np.logaddexp(*log)
        good = np.exp(log[1] - total)
        now = float((count * total).sum() / max(count.sum(), 1))
        if now - before < tolerance:
            break
        before = now
        prior = float(np.clip((count * good).sum() / max(count.sum(), 1), 0.01, 0.99))
        for c, w in ((0, count * (1 - good)), (1, count * good)):
            seen = (hot * w[:, None, None]).sum(0) + 1
            p[c] = seen / seen.sum(1, keepdims=True)
    weight = np.log(p[1]) - np.log(p[0])
    accuracy = (prior * p[1, :, 2] + (1 - prior) * p[0, :, 0]) / np.maximum(prior * (p[1, :, 2] + p[1, :, 0]) + (1 - prior) * (p[0, :, 0] + p[0, :, 2]), 1e-12)
    return Model(prior, weight, accuracy)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, FIGURES..., base_failed, quality, kept), one row for each row of ``docs``.

    base_failed: fewer than 20 words, or more than 30 % of the words repeated. quality is the posterior probability of a
    good text, kept is quality >= threshold and not base_failed. Null and empty texts fail; null ids and repeated rows
    stay; an empty table gives an empty result.
    """
    table = rules()
    vote = [F.when(r.bad, -1).when(r.good, 1).otherwise(0).alias(f"vote_{i}") for i, r in enumerate(table)]
    cast = saved(measured(docs, id_col, text_col).select("*", *vote), "quality_votes")
    names = [f"vote_{i}" for i in range(len(table))]
    patterns = cast.groupBy(*names).count().collect()  # at most 3^rules
    votes = np.array([[r[n] for n in names] for r in patterns], np.int64).reshape(-1, len(names))
    model = estimate(votes, np.array([r["count"] for r in patterns], float))
    odds = F.lit(float(np.log(model.prior) - np.log1p(-model.prior)))
    for i, n in enumerate(names):
        odds = odds + F.when(F.col(n) == -1, F.lit(float(model.weight[i, 0]))).when(F.col(n) == 1, F.lit(float(model.weight[i, 2]))).otherwise(F.lit(float(model.weight[i, 1])))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = cast.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop(*names)
