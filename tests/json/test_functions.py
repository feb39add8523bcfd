"""Column expressions against the scanner, and both against plain programs."""

import json
import random

import pytest
from granary.functions import measure
from granary.functions import text as tx
from granary.functions.scan import failure_text, scan, scan_column, utf8_failure, utf8_failure_column
from granary.policy import Limits, Policy
from pyspark.sql import functions as F

TOKENS = ["{", "}", "[", "]", '"', ",", ":", '"a"', '"b":', "1", "-0", "1.5", "1e5", "true", "false", "null", " ", "\n", "\\", "\\n", "\\u00e9", "\\ud83d\\ude00", "\\ud800", "01", "1.", "-", ".5", "é", "\x01", "x", "\t"]


def noise(rng):
    return "".join(rng.choice(TOKENS) for _ in range(rng.randrange(0, 9)))


def document(rng, deep=0):
    r = rng.random()
    if deep > 4 or r < 0.35:
        return rng.choice(["1", "-0.5e+3", '"x\\u00e9é\\n"', "true", "null", '"\\ud83d\\ude00"', "12345", '""', '"\\u4e2d"'])
    if r < 0.65:
        return "[" + rng.choice([",", ", "]).join(document(rng, deep + 1) for _ in range(rng.randrange(0, 4))) + "]"
    return "{" + ", ".join('"%s" : %s' % (rng.choice(["a", "b", "kk", "é", "\\u0061"]), document(rng, deep + 1)) for _ in range(rng.randrange(0, 4))) + "}"


def plain_valid(t):
    def refuse(x):
        raise ValueError

    try:
        v = json.loads(t, parse_constant=refuse)
    except ValueError:
        return False
    return not any(0xD800 <= ord(c) <= 0xDFFF for c in json.dumps(v, ensure_ascii=False))


@pytest.mark.parametrize(
    "text, offset, line, column, reason",
    [
        (b"", 0, 1, 1, "unexpected_end"),
        (b'{"a" 1}', 5, 1, 6, "expected_colon"),
        (b"[1 2]", 3, 1, 4, "expected_comma_or_array_end"),
        (b'{"a":1 "b":2}', 7, 1, 8, "expected_comma_or_object_end"),
        (b'"\\x"', 2, 1, 3, "invalid_escape"),
        (b"01", 1, 1, 2, "invalid_number"),
        (b"true false", 5, 1, 6, "trailing_characters"),
        ('{\r\n  "中" 1}'.encode(), 11, 2, 7, "expected_colon"),
        (b'"\\ud800"', 7, 1, 8, "unpaired_surrogate"),
        (b'"\\u12"', 5, 1, 6, "invalid_unicode_escape"),
        (b'"\xff"', 1, 1, 2, "invalid_utf8"),
        (b"[1,]", 3, 1, 4, "unexpected_byte"),
        (b"{,}", 1, 1, 2, "expected_object_key"),
        (b"[tru]", 1, 1, 2, "unexpected_byte"),
        (b"truex", 4, 1, 5, "unexpected_byte"),
        (b"-", 1, 1, 2, "unexpected_end"),
        (b"1.e5", 2, 1, 3, "invalid_number"),
    ],
)
def test_places_and_reasons(text, offset, line, column, reason):
    s = scan(text)
    assert (s.offset, s.line, s.column, s.reason) == (offset, line, column, reason)


def test_accounting_and_limits():
    s = scan('{"items":["é",1e+3]}')
    assert (s.nodes, s.payload_bytes, s.depth, s.max_items, s.max_entries) == (4, 11, 3, 2, 1)
    assert scan('{"escaped":"中","number":1e+3}').payload_bytes == 20 and scan('{"a":["bc"]}').payload_bytes == 3 and scan("[null]").depth == 2
    assert scan("[" * 20_000, Limits(depth=128)).resource == "depth" and scan("[" * 100_000).reason == "unexpected_end"
    # A limit on one measurement is told before one on sums, and a sum says what is left.
    s = scan('["abc"]', Limits(string_bytes=2, payload_bytes=1))
    assert (s.resource, s.observed, s.maximum) == ("string_bytes", 3, 2)
    s = scan('["a","bc"]', Limits(payload_bytes=2))
    assert (s.resource, s.requested, s.remaining, s.payload_bytes) == ("payload_bytes", 2, 1, 1)
    s = scan('{"a":1,"a":2}', Limits(entries=1))
    assert (s.resource, s.observed) == ("entries", 2) and scan('{"x":{"a":1,"\\u0061":2}}').duplicate
    assert scan("[1,2,3]", Limits(items=2)).resource == "items" and scan("12345", Limits(number_bytes=4)).observed == 5


def test_scanner_matches_plain_parser():
    rng = random.Random(0)
    for _ in range(60_000):
        t = noise(rng)
        assert scan(t).valid == plain_valid(t), t


def test_columns_match_scanner(spark):
    measure.prepare(spark)
    rng = random.Random(1)
    rows = [(noise(rng),) for _ in range(3000)] + [(document(rng),) for _ in range(2000)] + [("1] [2",), ("1,2",), ('{"a":1} x',), ("",), (" ",), (None,)]
    t = F.col("t")
    df = spark.createDataFrame(rows, "t string").withColumn("s", scan_column(t)).withColumn("v", measure.is_valid(t))
    assert df.filter("v != s.valid").collect() == []
    assert df.filter("t is null").select("v", "s").collect() == [(None, None)]
    ok = df.filter("s.valid").withColumns({"nodes": measure.nodes(t), "depth": measure.depth(t), "payload_bytes": measure.payload_bytes(t), "keys": measure.keys(t), "max_key_bytes": measure.max_key_bytes(t), "max_string_bytes": measure.max_string_bytes(t), "max_number_bytes": measure.max_number_bytes(t), "root": measure.root_kind(t)})
    assert ok.count() > 2000
    for name in ("nodes", "depth", "payload_bytes", "keys", "max_key_bytes", "max_string_bytes", "max_number_bytes", "root"):
        assert ok.filter(F.col(name) != F.col("s")[name]).collect() == [], name
    whole = ok.select("t", "s", measure.profile(t).alias("m"), measure.repeats(t, F.try_parse_json(t)).alias("again"))
    for name in ("nodes", "depth", "payload_bytes", "keys", "max_key_bytes", "max_string_bytes", "max_number_bytes"):
        assert whole.filter(F.col("m")[name] != F.col("s")[name]).collect() == [], name
    assert whole.filter("again != s.duplicate").collect() == [] and whole.filter("again").count() > 5
    for limits in (Limits(depth=2), Limits(items=1), Limits(entries=1), Limits(nodes=2), Limits(key_bytes=1), Limits(string_bytes=1), Limits(number_bytes=1), Limits(payload_bytes=1)):
        assert ok.select(measure.may_break(t, limits).alias("may"), scan_column(t, limits).alias("l")).filter("not may and l.resource is not null").count() == 0


def escape(s):
    """The state machine: in a string, an open backslash takes the rest of the escape."""
    out, inside, pending = [], False, False
    for c in s:
        if inside and pending:
            pending = False
            out.append(tx.ESCAPES[c][1:] if c in tx.ESCAPES else c)
            continue
        if inside and c in tx.ESCAPES:
            out.append(tx.ESCAPES[c])
            continue
        if inside and c == "\\":
            pending = True
        elif c == '"':
            inside = not inside
        out.append(c)
    return "".join(out)


def test_escape_controls(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice('"\\\n\t\x01\x1b\rab,é') for _ in range(rng.randrange(0, 24))) for _ in range(4000)]
    rows += ['"' + "x" * n + chr(c) + '"' for c in range(32) for n in range(25)] + ['"' + "\\" * n + "\n" for n in range(5)] + ["a\n" * 20_000 + '"' + "b\n" * 20_000]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(tx.escape_controls(F.col("t"))).collect()
    assert [g[0] for g in got] == [escape(r) for r in rows]


FENCES = {
    "```json\n{}\n```": ("{}", "{}", "{}"),
    "~~~\n1\n~~~~": ("1", "1", "1"),
    "```python\n1\n```": (None, "1", None),
    "   ````JSONC x\r\n[1]\r\n  ````  \n": ("[1]", "[1]", "[1]"),
    "```\n1\n``": ("1\n``", "1\n``", None),
    "﻿ ```json\n1": ("1", "1", "```json\n1"),
    "```json 1 ```": (None, None, None),
    "~~~json\n{\n```": ("{\n```", "{\n```", None),
    "```json\r1\r```": ("1", "1", "1"),
    "```\n```": ("", "", ""),
    "```\n1\n\t```": ("1\n\t```", "1\n\t```", None),
    "```\n1\n    ```": ("1\n    ```", "1\n    ```", None),
    "```\n1\n ```": ("1\n ```", "1\n ```", None),
    "```json5\n1\n```": (None, "1", None),
    "``\n1\n``": (None, None, None),
}


def test_fences(spark):
    df = spark.createDataFrame([(k,) for k in FENCES], "t string")
    for i, policy in enumerate((Policy(), Policy(fence="any"), Policy(closing="required"))):
        got = [r[0] for r in df.select(tx.normalize(F.col("t"), policy)).collect()]
        assert got == [v[i] if v[i] is not None else k.strip() for k, v in FENCES.items()]
    assert [r[0] for r in df.select(tx.normalize(F.col("t"), Policy.strict())).collect()] == list(FENCES)


def test_trim_and_mark(spark):
    df = spark.createDataFrame([(tx.WHITE + "﻿" + tx.WHITE + "1" + tx.WHITE,), ("﻿﻿1",), ("​1",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.normalize(F.col("t"))).collect()] == ["1", "﻿1", "​1", None]


def test_policy_and_session(spark):
    assert Policy() == Policy.lenient() and Policy().but(fence="any").fence == "any"
    with pytest.raises(ValueError):
        Policy(fence="some")
    spark.conf.set(measure.DUPLICATES, "false")
    with pytest.raises(RuntimeError):
        measure.require(spark)
    measure.prepare(spark)
    measure.require(spark)


def test_fragments_words_and_utf8(spark):
    assert scan("[1]", above=3).depth == 5 and scan("[1]", Limits(depth=4), above=3).resource == "depth"
    df = spark.createDataFrame([("[1 2]", b"ab\xff"), ("[1]", b"ab"), (None, None)], "t string, b binary")
    assert [r[0] for r in df.select(failure_text(scan_column(F.col("t")))).collect()] == ["expected comma or array end at line 1 column 4 (byte offset 3)", None, None]
    assert [r[0] and tuple(r[0]) for r in df.select(utf8_failure_column(F.col("b"))).collect()] == [(2, 1), None, None]
    assert utf8_failure(b"a\xe4\xb8") == (1, None) and utf8_failure(b"\xe4\xb8x") == (0, 2)
