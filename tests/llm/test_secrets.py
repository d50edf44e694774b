import base64
import hashlib
import json
import random
import re
import string

from pyspark.sql import types as T

from webgauge.llm.secrets import digest, find_secrets, redact, spans_of

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("secrets", T.StringType())])
RULES = [
    ("assign", re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def brute(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, fits) in enumerate(RULES) for m in p.finditer(text or "") if fits(m)]
    spans = [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]
    counts = [sum(x.startswith(k) for x in spans) for k in ("assign", "access", "hex")]
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 + (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


R = random.Random(5)
NUMBER = lambda n: der(0x02, b"\x01" + R.randbytes(n))
RSA = der(0x30, der(0x02, b"\0") + b"".join(NUMBER(n) for n in (128, 3, 128, 64, 64, 64, 64, 64)))
PKCS8 = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2b\x65\x70")) + der(0x04, der(0x04, R.randbytes(32))))
PUBLIC = der(0x30, der(0x30, der(0x06, b"\x2b\x65\x70")) + der(0x03, b"\0" + R.randbytes(32)))
FIELD = lambda b: len(b).to_bytes(4, "big") + b
SSH = b"openssh-key-v1\0" + FIELD(b"none") + FIELD(b"none") + FIELD(b"") + (1).to_bytes(4, "big") + FIELD(R.randbytes(51)) + FIELD(R.randbytes(136))
B64 = lambda b: base64.b64encode(b).decode()
URL = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
JWT = ".".join([URL(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), URL(b'{"sub":"1"}'), URL(R.randbytes(32))])


def kinds(text):
    return [(k, text[s:e]) for k, s, e in spans_of(text) if k not in ("assign", "access", "hex")]


def test_confirmed_structures_are_reported_at_their_place():
    assert kinds(f"é key {B64(RSA)} end") == [("key", B64(RSA))]
    assert kinds(f"x {PKCS8.hex().upper()} y") == [("key", PKCS8.hex().upper())]
    assert kinds(f"x {B64(SSH)} y") == [("ssh", B64(SSH))]
    assert kinds(f"bearer {JWT}, ok") == [("token", JWT)]
    hidden = B64(b"password = hunter2hunter2")
    assert kinds(f"x {hidden} y") == [("wrapped", hidden)]
    lines = "\n".join(B64(RSA)[k : k + 64] for k in range(0, len(B64(RSA)), 64))
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\nfollowing words") == [("key", lines)]


def test_look_alikes_are_not_reported():
    broken = bytearray(RSA)
    broken[7] ^= 1  # one nested length no longer adds up
    other = URL(json.dumps({"typ": "JWT"}).encode())
    unsigned = URL(b'{"alg":"none"}')
    for text in (B64(bytes(broken)), B64(PUBLIC), B64(SSH[:-9]), f"{other}.{URL(b'{}')}.{'a' * 30}", f"{unsigned}.{URL(b'{}')}.{'a' * 30}", B64(b"just a harmless sentence here"), "a" * 500, B64(R.randbytes(200))):
        assert kinds(f"x {text} y") == []


def odd_texts():
    yield from (None, "", "token", "token=", 'TOKEN" : \'abcdefgh', "token=\"secret: longvalue123", "paſſword=abcdefghij", "toKen=abcdefghij", "AKIA" + "Z" * 12, "AKIA" + "Z" * 11, "AKIAxAKIA" + "9" * 12)
    yield from ("a" * 31, "a" * 32, "A" * 40, "xyz" + "0f" * 20 + "g", "é" * 3 + "api_key=" + "k" * 9, "apikey: " + "x" * 200_000, "passwd=short secret=longenough1")
    pieces = ["token", "secret", "=", ": ", '"', "é", " ", "AKIA", "ABCD1234", "0123456789abcdef", "zz", ".", "passwd", "api_key", "\n"]
    for _ in range(600):
        yield "".join(R.choice(pieces) for _ in range(R.randint(1, 14)))
    for _ in range(50):
        yield "".join(R.choice(string.printable) for _ in range(300))


def test_plain_spans_equal_the_rules(spark):
    texts = [*odd_texts(), "token=abcdefgh", "token=abcdefgh"]
    df = spark.createDataFrame([(k if k != 3 else None, t, "clash") for k, t in enumerate(texts)], DOCS)
    found = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in digest(find_secrets(df)).collect()}
    assert found == {(k if k != 3 else None): brute(t) for k, t in enumerate(texts)}


def test_all_spans_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in digest(find_secrets(docs)).collect()}
    for row in docs.collect():
        assert (got[row.doc_id].n_assign, got[row.doc_id].n_access, got[row.doc_id].n_hex, got[row.doc_id].base_sha256) == brute(row.text)


def test_redact_and_empty_table(spark):
    text = f"é token=abcdefgh {JWT} end"
    df = spark.createDataFrame([(1, text, ""), (2, None, ""), (3, "clean", "")], DOCS)
    out = {r.doc_id: r.text for r in redact(find_secrets(df)).collect()}
    assert out == {1: "é [secret] [secret] end", 2: None, 3: "clean"}
    assert find_secrets(spark.createDataFrame([], DOCS)).count() == 0
