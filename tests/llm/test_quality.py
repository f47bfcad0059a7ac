import re
from collections import Counter

import numpy as np

from quern.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_figures(spark, make_docs, odd_rows, sf):
    odd = [*odd_rows, (30, "a b c\na b c\n\n  \n\na b c \na b c"), (31, "#x *y $z %% &&& |<>| " * 9)]
    for docs in (make_docs([r for r in odd if r[0] != 7]), spark.read.parquet(f"{sf}/documents.parquet")):
        want = sorted((str(r["doc_id"]), *brute(r["text"])) for r in docs.select("doc_id", "text").collect())
        got = quality.judged(docs).collect()
        assert sorted((str(r["doc_id"]), *(r[c] for c in quality.FIGURES[:5])) for r in got) == want
        for r in got:
            failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.judged(make_docs([])).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.55])
    votes = np.where(rng.random((40_000, 5)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, count.astype(float))
    assert abs(model.prior - 0.7) < 0.02
    assert np.abs(model.accuracy - right).max() < 0.03


def test_agrees_with_labels(spark, sf):
    d = sf.replace("0.001", "0.01")
    got = quality.judged(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "truth"), "doc_id").collect()
    assert np.mean([r["kept"] == (r["truth"] == 1) for r in got]) > 0.9
    assert np.mean([r["kept"] for r in got if r["truth"] == 1 and r["n_words"] >= 50]) > 0.95
