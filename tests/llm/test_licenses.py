import re

from quern.llm import licenses as lc


def cut(text):
    words = [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (text or "").lower()) if w]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def brute(rows, templates=lc.TEMPLATES):
    out = set()
    for i, text in rows:
        own = cut(text)
        for name, notice in templates.items():
            want = set(cut(notice))
            common = want & set(own)
            if len(common) / len(want) >= 0.8:
                out.add((i, name, round(len(common) / len(want), 9), min(own.index(s) for s in common)))
    return out


def got(df):
    return {(r["doc_id"], r["license"], round(r["containment"], 9), r["first_word"]) for r in df.collect()}


def test_against_brute_force(spark, make_docs, odd_rows, sf):
    rows = list(odd_rows)
    for k, (_, text) in enumerate(lc.TEMPLATES.items()):
        commented = "\n".join(f" * {line}" for line in re.findall(r"(?:\S+\s*){1,9}", text))
        words = text.split()
        words[len(words) // 2] = "changed"
        rows += [(100 + k, f"some words before {k} " * k + commented + " and after"), (200 + k, " ".join(words)), (300 + k, " ".join(text.split()[::-1]))]
    assert got(lc.scan(make_docs(rows))) == brute(rows)
    d = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert got(lc.scan(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()]) != set()
    assert lc.scan(make_docs([])).count() == 0
    assert lc.scan(make_docs(rows), templates={}).count() == 0


def test_joined_index_finds_the_same(spark, make_docs, odd_rows):
    """The way for indexes beyond the bound, with rows that repeat and rows without id."""
    rows = [*odd_rows, *((i, f"before {i} {text} after") for i, text in enumerate(lc.TEMPLATES.values())), (None, lc.TEMPLATES["MIT-permission"]), (50, lc.TEMPLATES["GPL-header"]), (50, lc.TEMPLATES["GPL-header"])]
    docs = make_docs(rows)
    plain, joined = (sorted(lc.scan(docs, most_keys=n).collect(), key=str) for n in (lc.MOST_KEYS, 0))
    assert plain == joined and sum(r["doc_id"] == 50 and r["license"] == "GPL-header" for r in joined) == 2
    many = {f"t{k}": " ".join(f"w{(k * 7919 + i * 31) % 104729}" for i in range(400)) for k in range(160)}
    assert sum(len(t[2]) + len(t[3]) for t in lc.index(spark, many)) > lc.MOST_KEYS
    texts = [(k, "head " * (k % 5) + t) for k, t in enumerate(many.values())]
    assert got(lc.scan(make_docs(texts), templates=many)) == brute(texts, many)
    assert lc.scan(make_docs([]), templates=many).count() == 0


def test_short_templates_at_every_offset(make_docs):
    """Templates of eight to eleven shingles stand in no window of the texts at most offsets."""
    for n in range(12, 17):
        notice = {"n": " ".join(f"term{n}x{i}" for i in range(n))}
        rows = [(k, " ".join(f"pre{j}" for j in range(k)) + " " + notice["n"] + " and more words that follow it") for k in range(9)]
        assert got(lc.scan(make_docs(rows), templates=notice)) == brute(rows, notice) and len(brute(rows, notice)) == 9


def test_bands_find_edited_windows(spark):
    """Windows that share six of ten shingles or more meet in a band about as often as independent bands do."""
    for edits, shared in ((1, 7 / 9), (2, 6 / 10)):
        rows = [(k, [k * 100 + i for i in range(8)], [k * 100 + i + (50 if i < edits else 0) for i in range(8)]) for k in range(4000)]
        df = spark.createDataFrame(rows, "k long, a array<bigint>, b array<bigint>")
        bands = lambda c: lc.with_bands(df.select("k", lc.F.transform(c, lambda x: lc.F.xxhash64(x)).alias("h")), 1, c)
        met = bands("a").join(bands("b").drop("h"), "k").where("arrays_overlap(a, b)").count() / len(rows)
        assert abs(met - (1 - (1 - shared) ** lc.BANDS)) < 0.01
