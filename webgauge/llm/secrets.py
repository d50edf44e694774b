"""Secret scan with structural confirmation.

Plain patterns find assignments, access ids and long hex strings. Beyond them, base64 and hex runs are
decoded and reported only when the bytes are what they seem to be: a private key whose nested lengths
all add up, an OpenSSH key container, a signed token whose header names its algorithm, or text
that itself holds one of these or a plain secret.

Each row is scanned alone in its task. A vectorised pass over the bytes of a slice tells which texts hold
a run long enough to be a candidate; only those are searched by pattern.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.llm.arrays import offsets_of, slices
from webgauge.llm.columns import map_whole_rows, quoted, without

#: Kinds in the order of the report; the first three are the plain ones.
KINDS = ("assign", "access", "hex", "key", "ssh", "token", "wrapped")
RANK = {kind: k for k, kind in enumerate(KINDS)}

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: A maximal run is long enough exactly when its first 16 or 32 characters fit.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Base64 in one piece or wrapped over lines; hex of either case; three parts of a signed token.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:(?:\r?\n|\\n)[A-Za-z0-9+/_-]{4,76})*={0,2}")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})")
LINE_END = re.compile(r"\r?\n|\\n")
SHORTEST_RUN = 20
IN_RUN = np.zeros(256, dtype=bool)
IN_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.ArrayType(SPAN)
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def der_parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER values that fill data[at:end] exactly; None if they do not."""
    parts = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:  # DER takes the shortest form
                return None
        if at + size > end:
            return None
        parts.append((tag, at, at + size))
        at += size
    return parts


def private_key(data: bytes) -> int:
    """Bytes of the DER private key that ``data`` begins with, 0 if it is none.

    Known shapes: PKCS#1 (version and eight integers), PKCS#8 (version, algorithm, octets), SEC1
    (version 1, octets) and encrypted PKCS#8 (algorithm, octets). Public keys and certificates are none.
    """
    if len(data) < 24 or data[0] != 0x30:
        return 0
    head = 2 + (data[1] & 0x7F if data[1] >= 0x80 else 0)
    size = data[1] if data[1] < 0x80 else int.from_bytes(data[2:head], "big")
    if head > 6 or head + size > len(data):
        return 0
    parts = der_parts(data, head, head + size)
    if not parts:
        return 0
    tags = [tag for tag, _, _ in parts]
    algorithm = next(((s, e) for tag, s, e in parts if tag == 0x30), None)
    named = algorithm is not None and (inner := der_parts(data, *algorithm)) and inner[0][0] == 0x06
    version = data[parts[0][1] : parts[0][2]] if tags[0] == 0x02 else None
    rsa = tags[:9] == [0x02] * 9 and version in (b"\0", b"\1") and parts[1][2] - parts[1][1] >= 32
    pkcs8 = tags[:3] == [0x02, 0x30, 0x04] and version in (b"\0", b"\1") and named
    sec1 = tags[:2] == [0x02, 0x04] and version == b"\1" and parts[1][2] - parts[1][1] >= 16
    encrypted = tags == [0x30, 0x04] and named
    return head + size if rsa or pkcs8 or sec1 or encrypted else 0


def ssh_key(data: bytes) -> int:
    """Bytes of the OpenSSH private key container that ``data`` begins with, 0 if it is none."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return 0
    at = len(magic)
    for k in range(6):  # cipher, kdf, kdf options, count of keys, public key, private part
        if at + 4 > len(data):
            return 0
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if k == 3:
            if size != 1:
                return 0
        elif at + size > len(data):
            return 0
        else:
            at += size
    return at


def from_base64(run: str) -> bytes:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return b""


def signed_token(head: str) -> bool:
    """Whether ``head`` is the base64 of a JSON object that names a signing algorithm."""
    try:
        header = json.loads(from_base64(head).decode())
    except (UnicodeDecodeError, ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and header["alg"].lower() not in ("", "none")


def plain(text: str) -> list[tuple[str, int, int]]:
    """Assignments, access ids and hex strings, leftmost and not overlapping within a kind."""
    lower = text.lower()
    found = []
    if any(word in lower for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found


def holds_secret(text: str) -> bool:
    return bool(plain(text)) or "PRIVATE KEY-----" in text or any(signed_token(m[1]) for m in TOKEN.finditer(text))


def confirmed(data: bytes) -> tuple[str, int]:
    """Kind of secret that ``data`` is and how many of its bytes belong to it; ("", 0) for none."""
    if size := private_key(data):
        return "key", size
    if size := ssh_key(data):
        return "ssh", size
    try:
        text = data.decode("ascii")
    except UnicodeDecodeError:
        return "", 0
    return ("wrapped", len(data)) if text.isprintable() or "PRIVATE KEY-----" in text else ("", 0)


def structured(text: str) -> list[tuple[str, int, int]]:
    """What decoding confirms: keys, key containers, signed tokens and wrapped secrets."""
    tokens = [m for m in TOKEN.finditer(text) if signed_token(m[1])]
    found = [("token", *m.span()) for m in tokens]
    for pattern, decode, per_byte in ((BASE64, from_base64, 4 / 3), (ANY_HEX, bytes.fromhex, 2)):
        for m in pattern.finditer(text):
            pieces = list(_pieces(m))
            joined = "".join(piece for piece, _ in pieces)
            kind, size = confirmed(decode(joined))
            if kind == "wrapped":
                # Lines below may be other text: only the run itself counts unless it is one key in PEM form.
                kind = "wrapped" if holds_secret(decode(joined).decode("ascii")) else ""
            if not kind:
                continue
            used = len(joined) if kind == "wrapped" else min(len(joined), -int(-size * per_byte // 1))
            found.append((kind, m.start(), _end(pieces, used, text)))
    inside = [m.span() for m in tokens]
    return [x for x in found if x[0] != "wrapped" or not any(s <= x[1] and x[2] <= e for s, e in inside)]


def _pieces(match: re.Match) -> Iterator[tuple[str, int]]:
    """The lines of a candidate and where each begins in the text."""
    at = match.start()
    for line_end in [*LINE_END.finditer(match[0]), None]:
        end = match.start() + line_end.start() if line_end else match.end()
        yield match.string[at:end], at
        at = match.start() + line_end.end() if line_end else end


def _end(pieces: list[tuple[str, int]], used: int, text: str) -> int:
    """Where the first ``used`` characters of the joined lines end in the text, with what padding follows."""
    for piece, at in pieces:
        if used <= len(piece):
            end = at + used
            while end < at + len(piece) and text[end] == "=":
                end += 1
            return end
        used -= len(piece)
    return pieces[-1][1] + len(pieces[-1][0])


def spans_of(text: str, candidate: bool = True) -> list[tuple[str, int, int]]:
    """All spans by start, then kind; ``candidate`` False promises that no run of 20 characters occurs."""
    found = plain(text)
    if candidate:
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        found += structured(text)
    return sorted(set(found), key=lambda x: (x[1], RANK[x[0]], x[2]))


def long_runs(column: pa.Array) -> np.ndarray:
    """Which texts hold a run of at least ``SHORTEST_RUN`` base64 characters (a run over two texts counts too)."""
    data, offsets = offsets_of(column)
    inside = np.concatenate([[False], IN_RUN[data], [False]])
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = flips[::2], flips[1::2]
    long = ends - starts >= SHORTEST_RUN
    marks = np.zeros(len(column) + 1, dtype=np.int64)
    rows = np.searchsorted(offsets, starts[long], side="right") - 1
    last = np.searchsorted(offsets, ends[long] - 1, side="right") - 1
    np.add.at(marks, rows, 1)
    np.add.at(marks, last + 1, -1)
    return np.cumsum(marks[:-1]) > 0


def _scan(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, column):
        texts = part.column(column)
        found = [
            [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(text or "", candidate)]
            for text, candidate in zip(texts.to_pylist(), long_runs(texts).tolist())
        ]
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, ARROW)], [*part.schema.names, "secrets"])


def find_secrets(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with a column ``secrets``: the spans found, as (kind, start, end) in code points.

    Null and empty texts hold none; repeated rows are scanned each on its own; all columns pass through,
    except that a column ``secrets`` is replaced. Spans of different kinds may overlap.
    """
    source = docs.select(*[F.col(quoted(c)) for c in without(docs, "secrets")])
    return map_whole_rows(source, _scan, text, T.StructField("secrets", FOUND))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the plain kinds, a digest of the plain spans, and all spans as text."""
    spans = F.col("secrets")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:3]))
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redact(found: DataFrame, *, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``text`` with every span replaced; overlapping spans become one mask. Expects ``find_secrets`` output."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, span):
        cut = F.substring(F.col(text), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        fresh = F.struct(span["end"].alias("at"), F.concat(state["out"], cut, F.lit(mask)).alias("out"))
        longer = F.struct(F.greatest(state["at"], span["end"]).alias("at"), state["out"].alias("out"))
        return F.when(span["start"] >= state["at"], fresh).otherwise(longer)

    rest = lambda s: F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), F.length(text)))
    return found.withColumn(text, F.aggregate("secrets", start, step, rest))
