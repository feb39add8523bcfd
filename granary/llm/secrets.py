"""Secrets in texts: patterns propose candidates, their inner structure confirms them.

A candidate of the method's own kinds is reported only if it can be taken apart: base64 or hex must
decode, DER must nest with exact lengths into the parts of a key, an SSH key's inner type must equal
its label, and a signed token's header must be JSON that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A greedy run of 24 or more begins where a run of any length does, so shorter ones needn't be visited.
_HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*(?:PRIVATE KEY|PUBLIC KEY|CERTIFICATE))-----([A-Za-z0-9+/=\s]{16,}?)-----END \1-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_SSH = re.compile(r"\b(ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-nistp(?:256|384|521)) (AAAA[A-Za-z0-9+/]+={0,2})")
_B64 = re.compile(r"(?<![A-Za-z0-9+/])M[A-Za-z0-9+/]{43,}={0,2}(?![A-Za-z0-9+/=])")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}(?![0-9A-Fa-f])")
KINDS = (*BASE, "der", "jwt", "pem", "ssh")


def unbase64(s: str, *, url: bool = False) -> bytes | None:
    """The bytes, or none if ``s`` is no base64; white space is skipped, padding may be missing."""
    s = re.sub(r"\s+", "", s).rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill ``data[at:end]`` exactly, or none if their lengths don't add up."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_key(data: bytes) -> bool:
    """True if ``data`` is one DER sequence that holds a key: PKCS#1, SEC 1, PKCS#8 or SubjectPublicKeyInfo."""
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der(data, top[0][1], top[0][2])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    if len(tags) >= 9 and all(t == 0x02 for t in tags[:9]):  # RSA: version, modulus and so on
        return True
    if tags[:2] == [0x02, 0x04]:  # elliptic curve: version and octets
        return parts[1][2] - parts[1][1] >= 16
    if tags[:3] == [0x02, 0x30, 0x04] or tags[:2] in ([0x30, 0x03], [0x30, 0x04]):  # an algorithm and a wrapped key
        algorithm = parts[1] if tags[0] == 0x02 else parts[0]
        inner = der(data, algorithm[1], algorithm[2])
        return bool(inner) and inner[0][0] == 0x06
    return False


def is_certificate(data: bytes) -> bool:
    """True for a DER sequence of a body, an algorithm and a signature."""
    top = der(data)
    parts = top and len(top) == 1 and top[0][0] == 0x30 and der(data, top[0][1], top[0][2])
    return bool(parts) and [t for t, _, _ in parts] == [0x30, 0x30, 0x03]


def ssh_fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields that fill ``data`` exactly."""
    at, out = 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _is_pem(label: str, inner: str) -> bool:
    data = unbase64(inner)
    if data is None:
        return False
    if label == "OPENSSH PRIVATE KEY":
        return data.startswith(b"openssh-key-v1\0")
    return is_certificate(data) if label == "CERTIFICATE" else is_key(data) or (label.startswith("ENCRYPTED") and der(data) is not None)


def _is_jwt(header: str, payload: str) -> bool:
    try:
        head, claims = (json.loads(unbase64(x, url=True) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(claims, dict)


def _is_ssh(label: str, inner: str) -> bool:
    fields = ssh_fields(data) if (data := unbase64(inner)) else None
    return bool(fields) and len(fields) >= 2 and fields[0] == label.encode()


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then in the order of ``KINDS``."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "-----BEGIN" in text:
        out += [(m.start(), m.end(), "pem") for m in _PEM.finditer(text) if _is_pem(m[1], m[2])]
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if _is_jwt(m[1], m[2])]
    if " AAAA" in text:
        out += [(m.start(), m.end(), "ssh") for m in _SSH.finditer(text) if _is_ssh(m[1], m[2])]
    out += [(m.start(), m.end(), "der") for m in _B64.finditer(text) if (d := unbase64(m[0])) and is_key(d)]
    out += [(m.start(), m.end(), "der") for m in _HEX_KEY.finditer(text) if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end, value).

    Spans stand by start, then in the order of ``KINDS``; positions count code points, ends are
    exclusive.  A null or empty text has none; repeated rows and null ids stay; columns other than
    doc_id and text are ignored; an empty table gives an empty one.  Whole texts are searched, where
    they were read, without a shuffle.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, b, k in spans_of(t)] if (t := x.as_py()) else [] for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    df = docs.select("doc_id", "text")
    return df.mapInArrow(search, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the text with each secret replaced by its kind in brackets; null texts stay null."""

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = []
                for x in part.column(1):
                    t, done, out = x.as_py(), 0, []
                    for a, b, k in spans_of(t) if t else []:
                        if b > done:
                            out += [t[done : max(a, done)], f"[{k}]" if a >= done else ""]
                            done = b
                    texts.append(t if t is None else "".join(out) + t[done:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    df = docs.select("doc_id", "text")
    return df.mapInArrow(hide, df.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    joined = lambda xs: F.concat_ws(",", F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_secrets": op7_secrets}
