"""Personal numbers, dates and addresses replaced by format-preserving pseudonyms. DataFrame operations only.

One pattern finds candidates at every place, and each kind has a check of its own (Luhn sum, modulo 97, calendar, ranges). Cards and
IBANs that fail are tried without their last groups, and candidates that begin inside after them; what fails stays as it is. A valid one is permuted within its format by an eight-round Feistel network keyed by a secret: digits stay digits,
letters stay letters of their case, separators stay, check digits are made anew. The permutation depends on key and kind
only, so equal values have equal pseudonyms in all documents, and different values different ones.

Kinds: email (local part), iban, date (yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy; 1900 to 2099), ssn, card, phone, ipv4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
#: 1900-01-01 to 2099-12-31 has 73,049 days.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)

_START, _STOP = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
# Formats by kind, tried in this order where several begin at one place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": _START + r"[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?" + _STOP,
    "date": _START + r"(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})" + _STOP,
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
    "ipv4": r"(?<![0-9A-Za-z.])(?:\d{1,3}\.){3}\d{1,3}(?![0-9A-Za-z]|\.\d)",
    "phone": r"(?<![0-9A-Za-z+])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{3}\)\x20?|\d{3}[.-])\d{3}[\x20.-]\d{4}" + _STOP + r"|(?<![0-9A-Za-z+])\+\d{1,3}(?:[\x20-]\d{2,4}){3,5}" + _STOP,
    "card": _START + r"\d(?:[\x20-]?\d){12,18}" + _STOP,
}
KINDS = tuple(FORMATS)
ANY = "|".join(FORMATS.values())
# Lengths of IBANs by country (the registry of ISO 13616), for those that are followed by other groups.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _hex(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 512)


def _number(digest: Column, at: Column | int, length: int) -> Column:
    return F.conv(F.substring(digest, at, length) if isinstance(at, int) else digest.substr(at, F.lit(length)), 16, 10).cast("long")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def _shift(s: Column, digest: Column) -> Column:
    """Each character moved on within its own kind (0-9, a-z, A-Z) by its part of the digest."""

    def one(i: Column) -> Column:
        c = F.ascii(s.substr(i, F.lit(1)))
        k = _number(digest, (i - 1) % 32 * 4 + 1, 4).cast("int")
        within = lambda first, n: F.char(F.lit(first) + F.pmod(c - first + k, F.lit(n)))
        return F.when(c.between(48, 57), within(48, 10)).when(c.between(97, 122), within(97, 26)).when(c.between(65, 90), within(65, 26)).otherwise(s.substr(i, F.lit(1)))

    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), ""))


def permuted(s: Column, key: Column, kind: str) -> Column:
    """Feistel over the two halves of a string; every character keeps its kind."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(s.substr(F.lit(1), half).alias("l"), s.substr(half + 1, F.length(s)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        digest = lambda other: _hex(key, F.lit(kind), F.length(s).cast("string"), i.cast("string"), other)
        even = F.struct(_shift(acc["l"], digest(acc["r"])).alias("l"), acc["r"].alias("r"))
        return F.when(i % 2 == 0, even).otherwise(F.struct(acc["l"].alias("l"), _shift(acc["r"], digest(acc["l"])).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def permuted_pair(a: Column, b: Column, sizes: tuple[int, int], key: Column, kind: str) -> Column:
    """Feistel over a pair of numbers below ``sizes``; a struct of a and b."""

    def step(acc: Column, i: Column) -> Column:
        f = lambda other: _number(_hex(key, F.lit(kind), i.cast("string"), other.cast("string")), 1, 12)
        even = F.struct(F.pmod(acc["a"] + f(acc["b"]), F.lit(sizes[0]).cast("long")).alias("a"), acc["b"].alias("b"))
        return F.when(i % 2 == 0, even).otherwise(F.struct(acc["a"].alias("a"), F.pmod(acc["b"] + f(acc["a"]), F.lit(sizes[1]).cast("long")).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _refilled(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced in a row by ``digits``."""
    parts = F.split(template, "")
    return F.aggregate(
        parts,
        F.struct(F.lit("").alias("s"), F.lit(1).alias("n")),
        lambda acc, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(acc["s"], digits.substr(acc["n"], F.lit(1))).alias("s"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["n"].alias("n"))),
        lambda acc: acc["s"],
    )


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 for a valid number."""

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        d = F.when((F.length(digits) - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + d

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def _modulo_97(s: Column) -> Column:
    """A string of digits and capital letters (A = 10 ... Z = 35) modulo 97."""

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code.between(48, 57), (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), add)


def _email(m: Column, key: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permuted(local, key, "email"), m.substr(F.length(local) + 1, F.length(m)))


def _iban(m: Column, key: Column) -> Column:
    def made(s: Column) -> Column:
        inner = s.substr(F.lit(5), F.length(s))
        digits = _digits(inner)
        other = lambda free: _refilled(inner, free)
        check = lambda free: F.lpad((98 - _modulo_97(F.concat(other(free), s.substr(1, 2), F.lit("00")))).cast("string"), 2, "0")
        made_digits = lambda free: _refilled(m, F.concat(check(free), free))
        valid = F.length(s).between(15, 34) & (F.length(digits) > 0) & (_modulo_97(F.concat(inner, s.substr(1, 4))) == 1)
        return F.when(valid, let(permuted(digits, key, "iban"), made_digits))

    return let(F.translate(m, " ", ""), made)


def _date(m: Column, key: Column) -> Column:
    sep = m.substr(5, 1)
    iso = sep == "-"
    dotted = m.substr(3, 1) == "."
    year = F.when(iso, m.substr(1, 4)).otherwise(m.substr(7, 4))
    month = F.when(iso, m.substr(6, 2)).when(dotted, m.substr(4, 2)).otherwise(m.substr(1, 2))
    day = F.when(iso, m.substr(9, 2)).when(dotted, m.substr(1, 2)).otherwise(m.substr(4, 2))
    form = lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(dotted, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    first = F.lit(FIRST_DAY).cast("date")

    def moved(n: Column) -> Column:
        pair = permuted_pair(F.floor(n / DAYS[1]), n % DAYS[1], DAYS, key, "date")
        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), let(pair, lambda p: form(F.date_add(first, (p["a"] * DAYS[1] + p["b"]).cast("int")))))

    return let(F.datediff(F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date"), first), moved)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = m.substr(1, 3).cast("int"), m.substr(5, 2).cast("int"), m.substr(8, 4).cast("int")
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    form = lambda p: F.concat_ws("-", m.substr(1, 3), F.lpad((p["a"] + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))
    return F.when(valid, let(permuted_pair(group - 1, serial - 1, (99, 9999), key, "ssn"), form))


def _card(m: Column, key: Column) -> Column:
    def made(d: Column) -> Column:
        n = F.length(d)
        inner = permuted(d.substr(F.lit(2), n - 2), key, "card")
        whole = lambda body: F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
        return F.when(_luhn(d) == 0, _refilled(m, let(F.concat(d.substr(1, 1), inner), whole)))

    return let(_digits(m), made)


def _phone(m: Column, key: Column) -> Column:
    """The country code stays; of ten North American digits the first of area and exchange, else the first after the code, too."""
    code = F.regexp_extract(m, r"^\+(\d{1,3})", 1)

    def made(d: Column) -> Column:
        own = d.substr(F.length(code) + 1, F.length(d))
        american = (code.isin("", "1")) & (F.length(own) == 10)
        valid = F.when(american, own.rlike("^[2-9][0-9]{2}[2-9]")).otherwise((code != "") & F.length(own).between(6, 14))
        free = F.when(american, F.concat(own.substr(2, 2), own.substr(F.lit(5), F.length(own)))).otherwise(own.substr(F.lit(2), F.length(own)))
        back = lambda p: F.when(american, F.concat(own.substr(1, 1), p.substr(1, 2), own.substr(4, 1), p.substr(F.lit(3), F.length(p)))).otherwise(F.concat(own.substr(1, 1), p))
        return F.when(valid, _refilled(m, F.concat(code, let(permuted(free, key, "phone"), back))))

    return let(_digits(m), made)


def _ipv4(m: Column, key: Column) -> Column:
    def made(o: Column) -> Column:
        valid = F.forall(o, lambda x: (x.cast("int") <= 255) & (x == x.cast("int").cast("string")))
        at = lambda i: F.get(o, F.lit(i)).cast("long")
        form = lambda p: F.concat_ws(".", *(x.cast("string") for x in (F.shiftright(p["a"], 8), p["a"] % 256, F.shiftright(p["b"], 8), p["b"] % 256)))
        return F.when(valid, let(permuted_pair(at(0) * 256 + at(1), at(2) * 256 + at(3), (65536, 65536), key, "ipv4"), form))

    return let(F.split(m, r"\."), made)


_MAKE = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "phone": _phone, "card": _card}


def _valid_iban(s: Column) -> Column:
    return _modulo_97(F.concat(s.substr(F.lit(5), F.length(s)), s.substr(1, 4))) == 1


def _shorter(m: Column, name: str) -> Column:
    """The longest valid part of a card or IBAN that ends before one of its separators; null if there is none."""
    ends = F.filter(F.sequence(F.length(m) - 1, F.lit(1), F.lit(-1)), lambda i: m.substr(i + 1, F.lit(1)).isin(" ", "-"))
    parts = F.transform(ends, lambda i: m.substr(F.lit(1), i))
    if name == "card":
        return F.get(F.filter(parts, lambda p: let(_digits(p), lambda d: (F.length(d) >= 13) & (_luhn(d) == 0))), F.lit(0))
    size = F.lit(None).cast("int")
    for n, countries in IBAN_SIZES.items():
        size = F.when(m.substr(1, 2).isin(*countries.split()), F.lit(n)).otherwise(size)
    return F.get(F.filter(parts, lambda p: let(F.translate(p, " ", ""), lambda s: (F.length(s) == size) & _valid_iban(s))), F.lit(0))


def _found(m: Column, key: Column) -> Column:
    """struct(kind, value, n, ends) of a candidate: n the letters that value stands for, ends whether other candidates begin after
    it only; kind null where no check holds."""
    kind = F.lit(None).cast("string")
    for name in reversed(KINDS):
        kind = F.when(m.rlike(f"^(?:{FORMATS[name]})$"), F.lit(name)).otherwise(kind)

    card_holds = _luhn(_digits(m)) == 0
    iban_holds = let(F.translate(m, " ", ""), _valid_iban)
    whole = lambda k: F.when((k == "card") & ~card_holds, F.coalesce(_shorter(m, "card"), m)).when((k == "iban") & ~iban_holds, F.coalesce(_shorter(m, "iban"), m)).otherwise(m)

    def result(k: Column, m: Column) -> Column:
        value = F.lit(None).cast("string")
        for name in KINDS:
            value = F.when(k == name, _MAKE[name](m, key)).otherwise(value)
        return let(value, lambda v: F.struct(F.when(v.isNotNull(), k).alias("kind"), F.coalesce(v, m).alias("value"), F.length(m).alias("n"), (v.isNotNull() | ~k.isin("card", "iban")).alias("ends")))

    return let(kind, lambda k: let(whole(k), lambda part: result(k, part)))


def _taken(found: Column, pieces: Column) -> Column:
    """For each candidate, in order: whether its value is put in, and how many letters of its piece go, for it or for an earlier one."""
    start = F.struct(F.lit(0).alias("left"), F.array().cast("array<struct<own:boolean,gone:int>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        own = (acc["left"] <= 0) & x["f"]["ends"]
        gone = F.when(own, x["f"]["n"]).otherwise(F.greatest(acc["left"], F.lit(0)))
        return let(F.struct(own.alias("own"), gone.alias("gone")), lambda t: F.struct((t["gone"] - F.length(x["p"])).alias("left"), F.concat(acc["taken"], F.array(t)).alias("taken")))

    return F.aggregate(F.zip_with(found, pieces, lambda f, p: F.struct(f.alias("f"), p.alias("p"))), start, step, lambda acc: acc["taken"])


def pseudonymised(docs: DataFrame, secret: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and a column ``pii``: array of the kinds found, in the order of the text.

    A null text stays null with an empty array; empty texts, repeated rows and all other columns stay as they are. A column
    ``pii`` that ``docs`` has is replaced. ``secret`` keys the permutations; without it pseudonyms cannot be undone.
    """
    found, pieces, taken = (fresh(n, docs.columns) for n in ("found", "pieces", "taken"))
    text, key = F.col(f"`{text_col}`"), F.lit(secret)
    none = F.array().cast("array<struct<kind:string,value:string,n:int,ends:boolean>>")
    body = F.concat(F.lit("\n"), text)  # a split before each candidate has one piece more than there are candidates
    matches = F.when(text.rlike("[0-9@]"), F.transform(F.regexp_extract_all(body, F.lit(f"(?=({ANY}))"), F.lit(1)), lambda m: _found(m, key))).otherwise(none)
    df = docs.withColumn(found, F.coalesce(matches, none)).withColumn(pieces, F.when(F.size(found) > 0, F.split(body, f"(?={ANY})")))
    df = df.withColumn(taken, _taken(F.col(found), F.slice(pieces, F.lit(2), F.size(found))))
    rest = F.zip_with(F.slice(pieces, F.lit(2), F.size(found)), taken, lambda p, t: p.substr(t["gone"] + 1, F.length(p)))
    values = F.zip_with(found, taken, lambda f, t: F.when(t["own"], f["value"]).otherwise(F.lit("")))
    parts = F.concat(F.array(F.get(pieces, F.lit(0))), F.flatten(F.zip_with(values, rest, lambda v, r: F.array(v, r))))
    kinds = F.filter(F.zip_with(found, taken, lambda f, t: F.when(t["own"], f["kind"])), lambda k: k.isNotNull())
    new = F.array_join(parts, "")
    out = df.withColumn(text_col, F.when(F.size(found) > 0, new.substr(F.lit(2), F.length(new))).otherwise(text))
    return out.withColumn("pii", F.coalesce(kinds, F.array().cast("array<string>"))).drop(found, pieces, taken)


def _count(array: str, value: str) -> Column:
    return F.size(F.filter(array, lambda k: k == value)).cast("long")


def report(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_<kind> for each kind, text): one row for each row of ``docs``."""
    out = pseudonymised(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), secret)
    return out.select("doc_id", *(_count("pii", name).alias(f"n_{name}") for name in KINDS), "text")
