import base64
import hashlib
import json
import random
import re
import struct

from quern.llm import secret_scan as ss


def brute_base(text):
    """The base rules, character by character as they are stated."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def url(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + struct.pack(">H", n)) + body


def numbers(*sizes, draw=random.Random(0)):
    return b"".join(der(2, b"\x01" + draw.randbytes(n - 1)) for n in sizes)


def rsa(size, draw=random.Random(0)):
    half = max(1, size // 2)
    return der(0x30, der(2, b"\0") + numbers(size, 3, size, half, half, half, half, half, draw=draw))


field = lambda x: struct.pack(">I", len(x)) + x


def container(private, cipher=b"none", derivation=b"none", options=b""):
    return b"openssh-key-v1\0" + field(cipher) + field(derivation) + field(options) + struct.pack(">I", 1) + field(PUBLIC) + field(private)


OID = der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01")
KEY = rsa(128)
PUBLIC = field(b"ssh-ed25519") + field(b"k" * 32)
SSH = container(b"abcdabcd" + b"p" * 128)
JWT = f"{url(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{url(json.dumps({'sub': '1'}).encode())}.{url(b's' * 32)}"


def test_structures():
    pem = base64.encodebytes(KEY).decode()
    text = f"a é {JWT} b\n-----BEGIN RSA PRIVATE KEY-----\n{pem}-----END\n {base64.b64encode(SSH).decode()} me {KEY.hex()} {SSH.hex()} end"
    kinds = [k for k, _, _ in ss.spans(text)]
    assert kinds.count("jwt") == 1 and kinds.count("ssh") == 2 and kinds.count("der") == 2
    (a, b) = next((a, b) for k, a, b in ss.spans(text) if k == "jwt")
    assert text[a:b] == JWT
    broken = f"{JWT.replace('ey', 'ex', 1)} {base64.b64encode(KEY[:-1]).decode()} {base64.b64encode(SSH[:-8]).decode()} MAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"
    assert not [k for k, _, _ in ss.spans(broken) if k in ("jwt", "ssh", "der")]


def test_shapes():
    """Private keys of every shape are found, what only looks like one is not."""
    point = der(3, b"\0\x04" + b"q" * 64)
    yes = {
        "pkcs1": KEY, "dsa": der(0x30, der(2, b"\0") + numbers(64, 20, 64, 64, 20)), "pkcs8": der(0x30, der(2, b"\0") + der(0x30, OID + der(5, b"")) + der(4, KEY)),
        "encrypted": der(0x30, der(0x30, OID + der(0x30, der(4, b"s" * 8) + der(2, b"\x08\0"))) + der(4, b"e" * 64)), "sec1": der(0x30, der(2, b"\1") + der(4, b"d" * 32) + der(0xA0, OID) + der(0xA1, point)),
    }
    no = {
        "spki": der(0x30, der(0x30, OID + der(5, b"")) + point), "pkcs1 public": der(0x30, numbers(128, 3)), "hello": der(0x30, der(2, b"\0") + der(4, b"hello" * 20)),
        "certificate": der(0x30, der(0x30, numbers(9) + der(0x30, OID)) + der(0x30, OID + der(5, b"")) + der(3, b"\0" + b"s" * 64)), "junk": b"openssh-key-v1\0" + b"junk that is not a key" * 9, "public": PUBLIC * 3,
        "two keys named": SSH.replace(struct.pack(">I", 1) + field(PUBLIC), struct.pack(">I", 2) + field(PUBLIC)), "check numbers": container(b"abcdabce" + b"p" * 128), "options": container(b"abcdabcd" + b"p" * 128, options=b"x"),
    }
    for name, raw in yes.items():
        for text in (base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode(), raw.hex(), base64.encodebytes(raw).decode().strip()):
            assert [(a, b) for k, a, b in ss.spans(f"key {text} end") if k == "der"] == [(4, 4 + len(text))], name
    for name, raw in no.items():
        for text in (base64.b64encode(raw).decode(), base64.encodebytes(raw).decode(), raw.hex()):
            assert not [s for s in ss.spans(f"key {text} end") if s[0] in ("der", "ssh")], name
    locked = container(b"x" * 144, b"aes256-ctr", b"bcrypt", field(b"salt") + b"\0\0\0\x10")
    assert [k for k, _, _ in ss.spans(base64.encodebytes(locked).decode())] == ["ssh"]


def test_both_alphabets():
    draw = random.Random(1)
    for size in (37, 60, 125, 300, 600):
        for _ in range(20):
            key = rsa(size, draw)
            for text in (url(key), base64.urlsafe_b64encode(key).decode(), base64.b64encode(key).decode()):
                assert ("der", 4, 4 + len(text)) in ss.spans(f"key {text} end")
    for _ in range(200):
        raw = container(b"abcdabcd" + draw.randbytes(136))
        for text in (url(raw), base64.b64encode(raw).decode()):
            assert [s for s in ss.spans(text) if s[0] == "ssh"] == [("ssh", 0, len(text))]


def test_keys_inside_other_letters():
    draw = random.Random(2)
    key = rsa(300, draw)
    lines = base64.encodebytes(key).decode().rstrip("=\n").split("\n")
    pem = base64.b64encode(key).decode()
    for text in (
        json.dumps({"key": "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END RSA PRIVATE KEY-----"}),
        json.dumps({"env": json.dumps("\r\n".join(lines))}),
        "key: |\n" + "\n".join(f"    {x}" for x in lines) + "\nnext: 1",
        "\n".join([*lines, "Letters"]),
        "\n".join([*lines, "plain words follow the key here and go on for more than a line of it does"]),
        f"data{pem} end",
        f"x/{pem} end",
        f"key_{url(key)} end",
    ):
        found = [text[a:b] for k, a, b in ss.spans(text) if k == "der"]
        assert len(found) == 1 and ss.decoded(re.sub(r"\s|\\+[rn]", "", found[0])) == key, text
    for text in (f"sessionid.{JWT}", f"token_{JWT}", f"jwt-{JWT}", f"{JWT} {JWT}"):
        assert {text[a:b] for k, a, b in ss.spans(text) if k == "jwt"} == {JWT}
    ssh = base64.b64encode(SSH).decode().rstrip("=")
    for text, want in ((f"x{ssh}\nmore", ssh), (f"  {ssh[:70]}\n  {ssh[70:]}\n", f"{ssh[:70]}\n  {ssh[70:]}"), (f"{ssh}\nwords after it", ssh)):
        assert [text[a:b] for k, a, b in ss.spans(text) if k == "ssh"] == [want]
    noise = base64.b64encode(draw.randbytes(3_000_000)).decode() + "A" * 200_000 + "MIMI" * 50_000
    assert not [s for s in ss.spans(noise) if s[0] in ("ssh", "der")]


def test_base_patterns(spark, make_docs, odd_rows, sf):
    odd = [*odd_rows, (20, 'PassWord = "abcdef" ſecret=abcdefgh toKen:abcdefg API_KEY:\'x.y-z=1\' token=abc secret: token=abcdefgh'), (21, "AKIA" + "Z" * 15 + " AKIAAKIA" + "0" * 12 + "\xe9" + "0a" * 12 + "g" + "f" * 23), (22, f"secret={'ab' * 30}")]
    for docs in (make_docs(odd), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = docs.select("doc_id", "text").collect()
        got = ss.scan(docs).collect()
        want = sorted((str(r["doc_id"]), hashlib.sha256(brute_base(r["text"] or "").encode()).hexdigest()) for r in rows)
        assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
        base = {str(r["doc_id"]): brute_base(r["text"] or "") for r in rows}
        for r in got:
            parts = [s for s in r["spans"].split(",") if s.split(":")[0] in ss.KINDS[:3]]
            assert ",".join(parts) == base[str(r["doc_id"])]
            assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(parts)
    assert ss.scan(make_docs([])).count() == 0


def test_redact(make_docs):
    docs = make_docs([(1, "my password=hunter22 ok"), (2, None), (3, f"x {JWT} y"), (4, "plain")])
    out = {r["doc_id"]: r for r in ss.redact(docs).collect()}
    assert out[1]["text"] == "my password=[SECRET] ok" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "x [SECRET] y" and out[4]["text"] == "plain"
