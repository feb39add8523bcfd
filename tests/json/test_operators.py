import pytest
from granary.functions import measure
from granary.functions.scan import with_scan
from granary.operators.decode import decode, decode_array, decode_object, decode_strict, strict_value, validate
from granary.operators.encode import encode_rows, float_text
from granary.operators.sessions import Usage, admit, run_sessions
from granary.operators.tree import Rule, account, mutate, register_tree, render, build, tree_nodes, walk
from granary.policy import Limits
from granary.sources import files
from pyspark.sql import functions as F

USER = "name string not null, age tinyint not null"


@pytest.fixture(autouse=True)
def prepared(spark):
    measure.prepare(spark)


def test_decode_object(spark):
    rows = ['{"name":"a","age":3}', '{"name":"a","age":300}', '{"name":1,"age":3}', '{"name":"a"}', '{"name":"a","age":null}', "[1]", "", '{"a":', None, '```json\n{"name":"a\nb","age":1}\n```', '{"name":"a","age":1,"age":2}', '{"age":"x","name":"a"', "﻿", "```\n```"]
    want = [None, "deserialize", "deserialize", "deserialize", "deserialize", "unexpected_top_level", "empty_input", "invalid_json", None, None, "deserialize", "invalid_json", "empty_input", "empty_input"]
    for exact in (True, False):
        got = decode_object(spark.createDataFrame([(r,) for r in rows], "t string"), "t", USER, exact=exact).collect()
        kinds = [r.error and r.error.kind for r in got]
        assert kinds == [None if not exact and i == 10 else k for i, k in enumerate(want)]
        assert [r.value is not None for r in got] == [k is None and t is not None for k, t in zip(kinds, rows)]
        assert got[6].error.normalized_bytes is None or got[6].error.normalized_bytes == 0
        assert got[12].error.normalized_bytes == 0 and got[13].error.normalized_bytes == 0
    assert got[9].value.name == "a\nb"


def test_bytes_limits_and_messages(spark):
    df = spark.createDataFrame([(b"\xff{}",), (b"[1]",), (b"\xff" * 50,)], "t binary")
    got = decode(df, "t", limits=Limits(input_bytes=40, depth=1)).collect()
    assert [r.error.kind for r in got] == ["invalid_utf8", "budget", "input_too_large"]
    assert got[1].error.resource == "depth" and got[1].error.observed == 2 and got[2].error.maximum == 40
    secret = decode_strict(spark.createDataFrame([('{"k": TOP_SECRET}',)], "t string"), "t").first().error
    assert secret.kind == "invalid_json" and (secret.line, secret.column) == (1, 7) and "SECRET" not in str(secret)
    big = decode(spark.createDataFrame([(' "\n" ',)], "t string"), "t", limits=Limits(normalized_bytes=3)).first().error
    assert (big.kind, big.normalized_bytes, big.maximum) == ("input_too_large", 4, 3)
    assert big.message == "the text is too long once repaired: 4 bytes of at most 3"
    assert (got[0].error.valid_up_to, got[0].error.error_len) == (0, 1) and got[1].error.valid_up_to is None
    with pytest.raises(ValueError):
        decode(df, "t", limits=Limits(depth=1), exact=False)


def test_arrays_and_nested_types(spark):
    df = spark.createDataFrame([('[{"a":[1,2]},{"a":[]}]',), ('[{"a":["1"]}]',), ("[{}]",), ('{"a":1}',), ("[null]",)], "t string")
    got = decode_array(df, "t", "struct<a: array<int> not null>").collect()
    kinds = [r.error and r.error.kind for r in got]
    assert kinds[:2] == [None, "deserialize"] and kinds[3] == "unexpected_top_level" and len(got[0].value) == 2
    exact = decode_object(spark.createDataFrame([('{"value":340282366920938463463374607431768211455}',)], "t string"), "t", "value decimal(38,0)").first()
    assert exact.error.kind == "deserialize"  # 39 digits don't fit; the text keeps them
    assert decode(df, "t").filter(F.col("value").isNotNull()).count() == 5
    assert [r.valid for r in validate(spark.createDataFrame([(b"[1]",), (b"\xff",), (None,)], "t binary"), "t").collect()] == [True, False, None]


def test_nothing_is_lost(spark):
    """Valid texts beyond the built-in parser end in a value or an error, in both ways, and are valid in both."""
    deep, long = "[" * 1500 + "]" * 1500, "7" * 1200
    df = spark.createDataFrame([(t,) for t in (deep, long, "[" * 998 + "]" * 998, "7" * 1000, deep[:-1], '{"k":' + long + "}")], "t string")
    for exact in (True, False):
        got = decode(df, "t", exact=exact).collect()
        assert all((r.value is None) != (r.error is None) for r in got)
        assert [r.error and r.error.kind for r in got] == (["deserialize", "deserialize", None, None, "invalid_json", "deserialize"] if exact else ["budget", "budget", None, None, "budget", "budget"])
        assert [r.valid for r in validate(df, "t", exact=exact).collect()] == [True, True, True, True, False, True]


def test_sessions_decode_encode_and_begin_anew(spark):
    df = spark.createDataFrame([(1, 1, "```\n[1]\n```", True), (1, 2, "", None), (1, 3, "[2", None), (1, 4, '["x"]', None), (1, 5, None, None), (1, 6, "[3]", True), (2, 1, "[4]", None)], "k int, i int, accepted string, used_nodes boolean")
    from granary.operators.sessions import decode_sessions, encode_sessions

    got = decode_sessions(df.withColumnRenamed("accepted", "t").withColumnRenamed("used_nodes", "fresh"), "t", key=["k"], order=["i"], limits=Limits(nodes=4), schema="array<int>", reset="fresh").orderBy("k", "i").collect()
    assert [(r.accepted, r.error_kind, r.value, r.used_nodes, r.used_input_bytes, r.used_normalized_bytes) for r in got] == [(True, None, [1], 2, 11, 3), (False, "empty_input", None, 2, 11, 3), (False, "invalid_json", None, 2, 13, 5), (True, "deserialize", None, 4, 18, 10), (True, None, None, 4, 18, 10), (True, None, [3], 2, 3, 3), (True, None, [4], 2, 3, 3)]
    assert run_sessions(df, "accepted", key=["k"], order=["i"], limits=Limits()).columns.count("accepted") == 1
    rows = spark.createDataFrame([(1, 1, "1"), (1, 2, "[1"), (1, 3, "22"), (1, 4, "3")], "k int, i int, r string")
    out = encode_sessions(rows, key=["k"], order=["i"], raw=["r"], limits=Limits(output_bytes=16)).orderBy("i").collect()
    assert [(r.accepted, r.json, r.error_kind, r.error_resource, r.used_output_bytes) for r in out] == [(True, '{"r":1}', None, None, 7), (False, None, "invalid_raw_json", None, 7), (True, '{"r":22}', None, None, 15), (False, None, "budget", "output_bytes", 15)]


def test_clashing_columns(spark):
    odd = spark.createDataFrame([("[1]", 1, 2, 3, 4, 5, 6, 7)], "t string, _first int, _made int, _scan int, _out int, _OK int, kind int, `a b` int")
    assert decode(odd, "t").columns == [*odd.columns, "value", "error"] and decode(odd, "t", exact=False).first()._first == 1
    assert validate(odd, "t").columns == [*odd.columns, "valid"] and validate(odd, "t", out="kind").first().kind is True
    assert tree_nodes(odd, "t").first()._scan == 3 and tree_nodes(odd, "t").count() == 2
    assert encode_rows(odd.select(F.col("kind").alias("_json"), "a b")).first().json == '{"_json":6,"a b":7}'
    df = spark.createDataFrame([("[1]", "x", "y")], "t string, value string, error string")
    got = decode(df, "t", value="v", error="e")
    assert got.columns == ["t", "value", "error", "v", "e"] and got.first().value == "x"


def test_names_with_dots(spark):
    df = spark.createDataFrame([('{"x":1}', 1)], "`a.b` string, `c.d` int")
    assert decode(df, "a.b", schema="x int").first()["value"]["x"] == 1
    assert validate(df, "a.b", exact=True).first()["valid"]
    assert df.select(strict_value("a.b").isNotNull()).first()[0]
    assert encode_rows(df, ["c.d", "a.b"], raw=["a.b"]).first()["json"] == '{"c.d":1,"a.b":{"x":1}}'
    assert tree_nodes(df, "a.b", keep=["c.d"]).count() == 2
    assert run_sessions(df, "a.b", key=["c.d"], order=["c.d"], limits=Limits(nodes=2)).first()["accepted"]
    assert with_scan(df, "a.b").first()["scan"]["valid"]


def test_tree(spark):
    rows = walk('{"b":[1,"x"],"a":{}}')
    assert [(r["enter_ord"], r["leave_ord"], r["depth"], r["loc"], r["idx"], r["key"], r["kind"]) for r in rows] == [
        (0, 4, 1, "root", None, None, "object"),
        (1, 0, 2, "object_value", None, "a", "object"),
        (2, 3, 2, "object_value", None, "b", "array"),
        (3, 1, 3, "array_element", 0, None, "number"),
        (4, 2, 3, "array_element", 1, None, "string"),
    ]
    assert len(walk('{"a":{"b":1}}', enter=lambda r: r["key"] != "a")) == 2 and walk("[") == []
    df = spark.createDataFrame([(1, "[1,2]"), (2, None), (3, "[")], "key long, text string")
    assert tree_nodes(df.withColumnRenamed("key", "doc"), "text").count() == 3
    register_tree(spark)
    df.createOrReplaceTempView("tree_docs")
    assert spark.sql("SELECT t.kind FROM tree_docs, LATERAL json_tree(tree_docs.text) t").count() == 3
    deep = "[" * 50_000 + "]" * 50_000
    assert render(build(deep)) == deep and account(deep, Limits(depth=128)).resource == "depth"
    a = account('{"a":1,"a":[2,3]}')
    assert (a.nodes, a.keys, a.payload_bytes, a.valid) == (4, 1, 3, True)
    assert account("[1,2,3]", Limits(nodes=2, items=2)).resource == "items" and account("[1").reason == "unexpected_end"


def test_mutate():
    second = '{"first":true,"second":{"nested":{"leaf":false}}}'
    assert mutate(second, (), Limits(nodes=2), "replace").text == '{"first":true,"second":"[redacted]"}'
    skipped = mutate(second, (), Limits(nodes=2), "skip")
    assert skipped.text == second and skipped.visited == 2
    assert mutate(second, (), Limits(nodes=2)).resource == "nodes"
    # Children of the new value are walked; what a rule passes over isn't charged.
    out = mutate('{"x":{"deep":[1,2]},"y":1}', (Rule(keys=frozenset("x"), put='{"z":{"w":1}}'), Rule(keys=frozenset("w"), put="2.50")))
    assert out.text == '{"x":{"z":{"w":2.50}},"y":1}' and out.visited == 5
    assert mutate('{"x":[1,2,3]}', (Rule(keys=frozenset("x"), skip=True),)).report.nodes == 2


def test_encode(spark):
    df = spark.sql("""select 1 i, 1.5D d, float('nan') f, 'q"\\\\\\n\\u0001\\u001f/é' s, X'00FF' b, X'' e, array(1, null) a, map(1.5D, 'x') m, cast(null as string) z,
        named_struct('p', true, 'n', cast(null as struct<q: int>)) st, cast(1.10 as decimal(5, 2)) dc, '{"r": 1}' raw, date'2020-01-02' dt, parse_json('{"b":1,"a":[]}') v""")
    got = encode_rows(df, raw=["raw"]).first()
    assert got.json == '{"i":1,"d":1.5,"f":null,"s":"q\\"\\\\\\n\\u0001\\u001f/é","b":[0,255],"e":[],"a":[1,null],"m":{"1.5":"x"},"z":null,"st":{"p":true,"n":null},"dc":1.10,"raw":{"r": 1},"dt":"2020-01-02","v":{"a":[],"b":1}}'
    xs = [0.0, -0.0, 1.0, 0.1, 1e-5, 1e-6, 123456.75, 1e7, 1.5e15, 1e16, -2.5e-7, 1e300, 12345678901234.5]
    shown = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(float_text(F.col("x"))).collect()]
    assert shown == ["0.0", "-0.0", "1.0", "0.1", "0.00001", "1e-6", "123456.75", "10000000.0", "1500000000000000.0", "1e16", "-2.5e-7", "1e300", "12345678901234.5"]
    limited = encode_rows(spark.createDataFrame([("[1 2]", 1)], "raw string, n int"), raw=["raw"], limits=Limits(output_bytes=5)).first()
    assert limited.json is None and limited.error.kind == "budget"
    with pytest.raises(ValueError):
        encode_rows(df, ["i"], limits=Limits(input_bytes=1))


def test_sessions(spark):
    used, limits = Usage(), Limits(payload_bytes=4, input_bytes=40)
    assert admit(used, limits, '["abc"]')[0] and used.payload_bytes == 3
    assert admit(used, limits, '["xy"]') == (False, "budget", "payload_bytes") and used.input_bytes == 13
    assert admit(used, limits, "[") == (False, "invalid_json", None) and used.input_bytes == 14
    assert admit(used, limits, '["z"]')[0] and used.payload_bytes == 4 and admit(used, limits, None)[0]
    assert admit(used, limits, "[" + " " * 40 + "]") == (False, "budget", "input_bytes") and used.input_bytes == 19
    df = spark.createDataFrame([(k, i, '["abc"]') for k in ("a", None) for i in range(3)], "k string, i int, t string")
    got = run_sessions(df, "t", key=["k"], order=["i"], limits=limits).orderBy("k", "i").collect()
    assert [r.accepted for r in got] == [True, False, False] * 2
    with pytest.raises(ValueError):
        run_sessions(df, "t", key=["k"], order=[], limits=limits)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([('{"a":1}',), ("[2]",)], "json string")
    files.write_lines(df, "json", str(tmp_path / "out"))
    assert sorted(r.text for r in files.read_lines(spark, str(tmp_path / "out")).collect()) == ["[2]", '{"a":1}']
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a.json").write_bytes(b"[1,\n2]")
    assert files.read_texts(spark, str(tmp_path / "whole")).first().text == "[1,\n2]"
    assert files.read_bytes(spark, str(tmp_path / "whole")).first()["size"] == 6
    assert files.read_column(spark, "/root/testdata/sf0.001/events.parquet", "props", "event_id").columns == ["event_id", "text"]
    assert files.stream_lines(spark, str(tmp_path / "out")).isStreaming
