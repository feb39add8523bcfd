import hashlib
import random
import re

from granary.llm.pii import find_pii, joined, mask_pii
from pyspark.sql import functions as F

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def spans(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return [(r[0], r[1]) for r in find_pii(df).select("doc_id", joined(F.col("spans"))).collect()]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(7)
    parts = ["a@b.c", "_d@e.f", ".x", "@", "1.2.3.4", ".5.6.7.8", "999.1.1.1", "4111 1111 1111 1111", "4111111111111111", "-1111", "+1 (415) 555-2671", "+12", "é😀", " ", "\n", "7", "-", "  ", "a-b@c-d.e_f@g.h", "+", "5500-0000-0000-0004", "0" * 25, "000255.1.1.01"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))), "en") for i in range(1500)]
    for (i, got), (_, text, _) in zip(spans(spark, rows), rows):
        assert [s for s in got.split(",") if s.split(":")[0] in BASE] == brute(text), text


def test_long_texts_and_odd_rows(spark):
    many = " ".join(f"u{i}@h{i}.org 10.0.{i % 256}.1" for i in range(3000))
    rows = [(1, None, None), (1, "", "x"), (None, "mail a@b.co", None), (2, "a" * 300_000 + " 1" * 50_000 + "." * 50_000, None), (3, many, None), (3, many, None)]
    got = spans(spark, rows)
    assert [g for _, g in got[:2]] == ["", ""] and got[2] == (None, "email:5:11") and got[3][1] == ""
    assert got[4] == got[5] and got[4][1].split(",") == brute(many)
    assert spans(spark, []) == []


def test_method_spans(spark):
    rows = [(1, "My IBAN: DE89 3704 0044 0532 0130 00.", ""), (2, "DE89 3704 0044 0532 0130 01", ""), (3, "social security 219-09-9999", ""), (4, "part 219-09-9999", "")]
    got = dict(spans(spark, rows))
    assert got[1] == "iban:9:36" and got[2] == "" and got[3] == "ssn:16:27" and got[4] == ""
    df = spark.createDataFrame([(1, "call a@b.co now", "en")], "doc_id long, text string, spans string")
    assert mask_pii(df).collect() == [(1, "call [email] now", "en")]
    assert find_pii(df).columns == ["doc_id", "spans"]


def test_masking_cuts_by_position(spark):
    """Pieces of one address in another stay together, overlapping spans go as one, and nulls stay."""
    text = "a@b.co and xa@b.com; 1.2.3.4 or 11.2.3.45"
    rows = [(1, text, "x"), (2, None, "y"), (3, "", None), (4, "é😀 " + text, None), (5, "+4111 1111 1111 1111 é", None), (5, "none", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _cuts string")
    got = mask_pii(df).collect()
    masked = "[email] and [email]; [ip] or [ip]"
    assert [r.text for r in got] == [masked, None, "", "é😀 " + masked, "+[card] é", "none"] and [r._cuts for r in got] == [r[2] for r in rows]


def test_query(spark):
    from granary.llm.pii import op4_pii

    d = "/root/testdata/sf0.001"
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op4_pii(spark, d).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(",".join(brute(want[r.doc_id])).encode()).hexdigest()
