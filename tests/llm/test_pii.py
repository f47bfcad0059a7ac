import datetime
import hashlib
import re

from quern.llm import pii


def digest(*parts):
    return hashlib.sha512("|".join(map(str, parts)).encode()).hexdigest()


def shift(s, d):
    out = []
    for i, c in enumerate(s):
        k = int(d[4 * (i % 32) : 4 * (i % 32) + 4], 16)
        for first, n in (("0", 10), ("a", 26), ("A", 26)):
            if 0 <= ord(c) - ord(first) < n:
                c = chr(ord(first) + (ord(c) - ord(first) + k) % n)
                break
        out.append(c)
    return "".join(out)


def permuted(s, key, kind):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(8):
        if i % 2 == 0:
            left = shift(left, digest(key, kind, len(s), i, right))
        else:
            right = shift(right, digest(key, kind, len(s), i, left))
    return left + right


def pair(a, b, sizes, key, kind):
    for i in range(8):
        f = lambda other: int(digest(key, kind, i, other)[:12], 16)  # noqa: B023, E731
        if i % 2 == 0:
            a = (a + f(b)) % sizes[0]
        else:
            b = (b + f(a)) % sizes[1]
    return a, b


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def refill(template, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in template)


def one(kind, m, key):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "email":
        local, rest = m.split("@", 1)
        return permuted(local, key, kind) + "@" + rest
    if kind == "card":
        if luhn(d):
            return None
        body = d[0] + permuted(d[1:-1], key, kind)
        return refill(m, body + str((10 - luhn(body + "0")) % 10))
    if kind == "ipv4":
        o = m.split(".")
        if any(x != str(int(x)) or int(x) > 255 for x in o):
            return None
        a, b = pair(int(o[0]) * 256 + int(o[1]), int(o[2]) * 256 + int(o[3]), (65536, 65536), key, kind)
        return f"{a >> 8}.{a % 256}.{b >> 8}.{b % 256}"
    if kind == "date":
        form = "%Y-%m-%d" if m[4] == "-" else "%d.%m.%Y" if m[2] == "." else "%m/%d/%Y"
        try:
            n = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            return None
        if not 0 <= n < 73049:
            return None
        a, b = pair(n // 4297, n % 4297, (17, 4297), key, kind)
        return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)).strftime(form)
    if kind == "ssn":
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return None
        g, s = pair(g - 1, s - 1, (99, 9999), key, kind)
        return f"{m[:3]}-{g + 1:02d}-{s + 1:04d}"
    if kind == "iban":
        s = m.replace(" ", "")
        value = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        inner = re.sub(r"[^0-9]", "", s[4:])
        if not 15 <= len(s) <= 34 or not inner or value(s[4:] + s[:4]) != 1:
            return None
        new = permuted(inner, key, kind)
        return refill(m, f"{98 - value(refill(s[4:], new) + s[:2] + '00'):02d}" + new)
    code = (re.match(r"\+(\d{1,3})", m) or ["", ""])[1]
    own = d[len(code) :]
    if code in ("", "1") and len(own) == 10:
        if not re.match("[2-9]..[2-9]", own):
            return None
        p = permuted(own[1:3] + own[4:], key, kind)
        return refill(m, code + own[0] + p[:2] + own[3] + p[2:])
    return refill(m, code + own[0] + permuted(own[1:], key, kind)) if code and 6 <= len(own) <= 14 else None


PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.FORMATS.items()), re.ASCII)


def brute(text, key):
    return PATTERN.sub(lambda m: one(m.lastgroup, m[0], key) or m[0], text) if text else text


SAMPLES = [
    "card 4969041296088474, 4969 0412 9608 8474; bad 4969041296088475 and a4969041296088474",
    "+1 (745) 555-9313 or 745-555-9313 or (745) 555-9313, IP 21.49.43.205. 300.1.1.1 v1.2.3.4 1.2.3.4.5 01.2.3.4",
    "joe.O-89@mail8.example.com born 1984-02-29, 29.02.1984, 02/30/1984 12/31/1999 1899-12-31 2099-12-31",
    "SSN 123-45-6789 000-12-3456 666-12-3456 IBAN DE89 3704 0044 0532 0130 00 x GB82WEST12345698765432 GB83WEST12345698765432",
    "+44 20 7946 0958 ! 145-555-9313 x@y z@example.org 4111111111111111é",
]


def test_against_brute_force(spark, make_docs, odd_rows, sf):
    rows = [*odd_rows, *((50 + i, s) for i, s in enumerate(SAMPLES))]
    out = {(r["doc_id"], r["text"]) for r in pii.report(make_docs(rows), "k").collect()}
    assert out == {(i, brute(t, "k")) for i, t in rows}
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pii.report(docs, "k").collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(i, brute(t, "k")) for i, t in texts.items()}
    assert sum(r["n_card"] for r in got) and sum(r["n_email"] for r in got) and sum(r["n_phone"] for r in got) and sum(r["n_ipv4"] for r in got)
    assert all(len(r["text"]) == len(texts[r["doc_id"]]) for r in got if not r["n_ipv4"])
    assert pii.report(make_docs([]), "k").count() == 0


def test_valid_parts_of_candidates(spark, make_docs):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    texts = {f"card {card} 12/27": card, "4111111111111111 123": "4111111111111111", f"order 7 {card}": card, f"12 35 {card} 12/27": card, f"{iban} BY": iban, f"x {iban} 12": iban, f"7 {card} 9 {iban} OK": card}
    got = {r["doc_id"]: r for r in pii.report(make_docs(list(enumerate(texts))), "k").collect()}
    for i, (text, value) in enumerate(texts.items()):
        want = text.replace(value, one("iban" if value == iban else "card", value, "k"))
        assert got[i]["text"] == (want.replace(iban, one("iban", iban, "k")) if i == 6 else want)
        assert got[i]["n_card"] + got[i]["n_iban"] == 1 + (i == 6)


def test_permutations_are_one_to_one(spark):
    from pyspark.sql import functions as F

    n = spark.range(1000)
    assert n.select(pii.permuted(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("k"), "x").alias("p")).distinct().count() == 1000
    p = n.select(pii.permuted_pair(F.floor(F.col("id") / 40), F.col("id") % 40, (25, 40), F.lit("k"), "x").alias("p")).distinct()
    assert p.count() == 1000
    days = spark.range(73049).select(pii._date(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd"), F.lit("k")).alias("d"))
    assert days.distinct().count() == 73049


def test_neighbours_and_clashing_columns(spark):
    texts = ["call 5 4111 1111 1111 1111", "room 12 4111111111111111", "IBAN AT61 1904 3002 3457 3201 THE end", "4111111111111111 123", "card 4111 1111 1111 1111 12/27"]
    docs = spark.createDataFrame([(i, t, "f", "p", "t") for i, t in enumerate(texts)], "doc_id long, text string, found string, pieces string, taken string")
    got = pii.pseudonymised(docs, "key").orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert r["text"] != t and len(r["text"]) == len(t) and len(r["pii"]) >= 1
        assert (r["found"], r["pieces"], r["taken"]) == ("f", "p", "t")
        assert "4111 1111 1111 1111" not in r["text"] and "4111111111111111" not in r["text"] and "3002 3457" not in r["text"]
