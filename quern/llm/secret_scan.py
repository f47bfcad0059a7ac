"""Secrets in texts: fixed patterns, and structural confirmation of encoded candidates.

Base kinds are found by pattern alone. The method adds kinds that must decode and parse before they are reported:

* ``jwt``: dot-separated base64url parts whose first is a JSON object that names an algorithm and whose second is a JSON
  object (signed token), with a signature unless the algorithm is "none";
* ``ssh``: base64 or hex that decodes to the private-key container of OpenSSH: cipher, derivation, options, number of keys, public
  keys of known types with all their fields, and a private part whose length and check numbers hold, to the last byte;
* ``der``: base64 or hex that decodes to an ASN.1 SEQUENCE whose nested lengths add up and that has the shape of a private key: PKCS#1,
  DSA, SEC 1, PKCS#8 or encrypted PKCS#8. Public keys and certificates are no secrets. Armour lines are not needed.

Base64 may run over lines, also indented ones and escaped line ends, as in armoured keys, YAML and JSON. Keys may stand behind and
before other letters: they begin wherever their first bytes can, and end where their lengths say. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# The base patterns. Only ASCII letters are matched in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "jwt", "ssh", "der")

# The header alone is consumed, so each part can be the header of a token; no letter is given back, so a run is read at most three times.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,}+)(?=\.([A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]*+))")
# Line ends inside a key, real ones or escaped as in JSON, and indentation.
BREAK = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*")
# One pass for each alphabet: a key in one of them has pieces that are runs in the other.
ENCODED = tuple(re.compile(rf"[{letters}]{{24,}}+(?:{BREAK.pattern}[{letters}]++)*+={{0,2}}") for letters in ("A-Za-z0-9+/", "A-Za-z0-9_-"))
# What 0x30 and a length, and the magic of the container begin with in base64.
STARTS = re.compile(r"M(?=[B-H]|I[E-T])|b(?=3BlbnNzaC1rZXktdjEA)")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
# Names of SSH key types and the fields of their public keys, the name included.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}
SSH_MAGIC = b"openssh-key-v1\0"
# Tags of ASN.1.
SEQUENCE, INTEGER, IDENTIFIER, OCTETS, BITS, FIRST, SECOND, SECOND_PLAIN = 0x30, 0x02, 0x06, 0x04, 0x03, 0xA0, 0xA1, 0x81
MAX_NESTING = 16


def decoded(text: str) -> bytes | None:
    """Base64 of either alphabet, with or without padding and line breaks."""
    text = text.replace("\r", "").replace("\n", "").rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    raw = decoded(part)
    try:
        found = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def token_start(head: str, body: str, signature: str) -> int | None:
    """Where in ``head`` the header of a signed token begins: at its start, or at an ``eyJ`` behind other letters."""
    if _object(body) is None:
        return None
    signed = len(decoded(signature) or b"") >= 16
    for at in dict.fromkeys((0, *(m.start() for m in re.finditer("eyJ", head)))):
        found = _object(head[at:])
        if found and isinstance(found.get("alg"), str) and (signed or found["alg"].lower() == "none"):
            return at
    return None


def _elements(raw: bytes, at: int, end: int, depth: int = 0) -> list[tuple] | None:
    """(tag, value, elements inside) of the ASN.1 elements that raw[at:end] is to the last byte; None if it is not."""
    out = []
    while at < end:
        if at + 2 > end or depth > MAX_NESTING:
            return None
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n >= 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > end:
                return None
            n, at = int.from_bytes(raw[at : at + size], "big"), at + size
        if at + n > end:
            return None
        inside = _elements(raw, at, at + n, depth + 1) if tag & 0x20 else []
        if inside is None:
            return None
        out.append((tag, raw[at : at + n], inside))
        at += n
    return out


def is_der_key(raw: bytes) -> bool:
    """Whether ``raw`` is one SEQUENCE with the elements of a private key."""
    whole = _elements(raw, 0, len(raw)) if raw[:1] == bytes([SEQUENCE]) else None
    if not whole or len(whole) != 1:
        return False
    parts = whole[0][2]
    tags = [tag for tag, _, _ in parts]
    named = lambda part: part[0] == SEQUENCE and [t for t, _, _ in part[2][:1]] == [IDENTIFIER]
    if len(parts) == 2:
        return named(parts[0]) and tags[1] == OCTETS and len(parts[1][1]) >= 16  # encrypted PKCS#8
    if len(parts) < 2 or tags[0] != INTEGER or parts[0][1] not in (b"\0", b"\1"):
        return False
    if tags == [INTEGER] * 9 or tags == [INTEGER] * 9 + [SEQUENCE] or tags == [INTEGER] * 6:
        return len(raw) >= 64  # PKCS#1, DSA
    if len(parts) >= 3 and named(parts[1]) and tags[2] == OCTETS:
        return set(tags[3:]) <= {FIRST, SECOND, SECOND_PLAIN}  # PKCS#8
    return tags[1] == OCTETS and len(parts[1][1]) >= 20 and tags[2:] in ([FIRST], [SECOND], [FIRST, SECOND])  # SEC 1


def _fields(raw: bytes, at: int, count: int) -> tuple[list[bytes], int] | None:
    """``count`` strings, each behind its length, and where they end."""
    out = []
    for _ in range(count):
        n = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + n > len(raw):
            return None
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out, at


def is_ssh_key(raw: bytes) -> bool:
    """Whether ``raw`` is a container of private keys to the last byte."""
    if not raw.startswith(SSH_MAGIC) or not (head := _fields(raw, len(SSH_MAGIC), 3)):
        return False
    (cipher, derivation, options), at = head
    keys = int.from_bytes(raw[at : at + 4], "big")
    # a locked container names a derivation with options, an open one neither
    if not cipher or not derivation or not 1 <= keys <= len(raw) // 8 or (cipher == b"none") != (derivation == b"none") or (derivation == b"none") != (not options):
        return False
    if not (rest := _fields(raw, at + 4, keys + 1)):
        return False
    (*public, private), end = rest
    for key in public:
        name = _fields(key, 0, 1)
        found = _fields(key, 0, SSH_FIELDS[name[0][0]]) if name and name[0][0] in SSH_FIELDS else None
        if not found or found[1] != len(key):
            return False
    open_ = cipher == b"none"
    # the tag of an authenticated cipher may follow the private part
    return (end == len(raw) or (not open_ and len(raw) - end == 16)) and len(private) >= 16 and len(private) % 8 == 0 and (not open_ or private[:4] == private[4:8])


def _part(letters: str, at: int, i: int, n: int) -> bytes:
    """Bytes i to i + n of the base64 that begins at ``at``; fewer where it ends."""
    first = at + i // 3 * 4
    part = letters[first : first + (i % 3 + n + 2) // 3 * 4]
    return (decoded(part[: len(part) - (len(part) % 4 == 1)]) or b"")[i % 3 : i % 3 + n]


def _ssh_size(letters: str, at: int) -> int | None:
    """Bytes of the container that begins there, by its lengths: cipher, derivation, options, number of keys, keys, private part."""
    i, left, counted = len(SSH_MAGIC), 3, False
    while left and 4 * i < 3 * (len(letters) - at):
        raw = _part(letters, at, i, 4)
        if len(raw) < 4:
            return None
        i, left = i + 4 + int.from_bytes(raw, "big"), left - 1
        if not left and not counted:
            raw, counted = _part(letters, at, i, 4), True
            i, left = i + 4, int.from_bytes(raw, "big") + 1
    return None if left or not counted else i


def _der_size(letters: str, at: int) -> int | None:
    """Bytes of the ASN.1 SEQUENCE that begins there, as its header states."""
    raw = _part(letters, at, 0, 6)
    if len(raw) < 6 or raw[0] != SEQUENCE:
        return None
    if raw[1] < 0x80:
        return 2 + raw[1]
    size = raw[1] & 0x7F
    return 2 + size + int.from_bytes(raw[2 : 2 + size], "big") if 1 <= size <= 4 else None


def encoded_keys(run: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the keys in a run of base64 letters with line breaks and padding."""
    if not STARTS.search(run) and not BREAK.search(run):
        return []
    body, parts, lines, at, n = run.rstrip("="), [], [], 0, 0
    for m in (*BREAK.finditer(body), None):
        parts.append(body[at : m.start() if m else len(body)])
        lines.append((n, at))  # where a line begins in the letters and in the run
        n, at = n + len(parts[-1]), m.end() if m else at
    letters = "".join(parts)

    def place(i: int, end: bool = False) -> int:
        if end and i == n:
            return len(run)
        k = bisect.bisect_left(lines, (i,)) - 1 if end else bisect.bisect_right(lines, (i, len(run))) - 1
        return lines[k][1] + i - lines[k][0]

    found, free = [], 0
    for m in STARTS.finditer(letters):
        at = m.start()
        if at < free:
            continue
        kind, size_of, holds = ("der", _der_size, is_der_key) if m[0] == "M" else ("ssh", _ssh_size, is_ssh_key)
        size = size_of(letters, at)
        end = at - (-(size or 0) * 4 // 3)
        if size and end <= n and holds(_part(letters, at, 0, size)):
            found.append((kind, place(at), place(end, True)))
            free = end
    return found


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's secrets, by start and then in the order of ``KINDS``."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "." in text:
        found += [("jwt", m.start() + at, m.end(3)) for m in TOKEN.finditer(text) if (at := token_start(*m.groups())) is not None]
    for pattern in ENCODED:
        for m in pattern.finditer(text):
            found += [(kind, m.start() + a, m.start() + b) for kind, a, b in encoded_keys(m[0])]
    longest = {s[:2]: s for s in sorted(found)}  # of what both alphabets read from one place
    found = list(longest.values())
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and m[0][:2] in ("30", "6f", "6F"):
            raw = bytes.fromhex(m[0])
            found += [(kind, *m.span()) for kind, holds in (("ssh", is_ssh_key), ("der", is_der_key)) if holds(raw)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with the secrets replaced by ``[SECRET]``, overlapping spans as one; of an assignment only the value goes."""
    parts, at = [], 0
    for kind, a, b in found:
        if kind == "assign":
            a += ASSIGN.match(text[a:b]).start(2)
        if a >= at:
            parts += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of ``docs``.

    base_sha256 is the SHA-256 of the base kinds' spans. A null or empty text has no secrets. Null ids and repeated rows
    stay as they are; an empty table gives an empty result.
    """

    def make():
        def work(ids, texts):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in texts:
                found = spans(text or "")
                base = [s for s in found if s[0] in KINDS[:3]]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(found))
            return {"doc_id": ids} | out

        return work

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(source, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the texts and ``length_col`` (if there) set to the new number of code points.

    Null texts stay null; all other columns and all rows are kept as they are.
    """

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redacted(t, spans(t)) if t else t)

    out = docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
    return out.withColumn(length_col, F.length(F.col(f"`{text_col}`")).cast("long")) if length_col in docs.columns else out
