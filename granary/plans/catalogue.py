"""The JSON queries, each with DuckDB SQL that says what it must return.

The tables hold little broken JSON, so hostile texts are made from ids by the same rule on both sides, and
the SQL states the known outcome of each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import measure
from granary.functions.scan import failure_text, scan_column
from granary.functions.text import normalize
from granary.operators.decode import decode, decode_array, decode_object, decode_strict, decode_unique, decode_with, parse_error_kind, stage_of, strict_value, validate
from granary.operators.encode import byte_array, encode_rows, tagged
from granary.operators.sessions import decode_sessions, encode_sessions, run_sessions
from granary.operators.tree import Rule, account_column, mutate_column, redact, tree_nodes
from granary.policy import Limits, Policy
from granary.sources.files import read_lines, write_lines
from granary.sources.scratch import run_to_end, scratch
from granary.streaming.sessions import stream_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The input tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table's files as a stream; as a pattern, the path may name a single file too."""
        return self.spark.readStream.schema(self(name).schema).parquet(f"{self.sf_dir}/{name}.parque[t]")


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            measure.prepare(spark)
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


def pick(id_: str, texts: list[str]) -> Column:
    """One of the texts, by an id."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col(id_) % len(texts) + 1).cast("int"))


def sql_pick(id_: str, values: list) -> str:
    """The same choice in SQL, among values of any kind."""
    shown = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v) for v in values]
    return "(CASE " + id_ + f" % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + " END)"


@query("""
SELECT event_type, count(*) AS n, count(k) AS n_decoded, CAST(sum(k) AS BIGINT) AS sum_k, min(k) AS min_k, max(k) AS max_k
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type
""")
def q_decode_props(t):
    """Repair, check and decode the events' properties, and sum them by type: the flagship."""
    df = decode(t("events").select("event_type", "props"), "props", schema="k bigint not null", exact=False)
    k = F.col("value.k")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("n_decoded"), F.sum(k).alias("sum_k"), F.min(k).alias("min_k"), F.max(k).alias("max_k"))


@query("""
SELECT doc_id, strlen(t) AS n_bytes, md5(t) AS digest FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)
""")
def q_trim_bom(t):
    """White space of every kind and one byte order mark come off."""
    ends = pick("doc_id", ["", " \n", "  ", "\t\r\n　"])
    noisy = t("documents").select("doc_id", F.concat(ends, pick("doc_id", ["", "\ufeff", " \ufeff"]), ends, "text", ends).alias("noisy"))
    clean = normalize(F.col("noisy"), Policy(fence="disabled", escape_controls=False))
    return noisy.withColumn("t", clean).select("doc_id", F.octet_length("t").cast("bigint").alias("n_bytes"), F.md5("t").alias("digest"))


FENCED = ["```json\n{0}\n```", "~~~\n{0}\n~~~~", "```JSONC x\r\n{0}\r\n   ```  \n", "```python\n{0}\n```", "```json\n{0}", "````\n{0}\n```", "    ```\n{0}\n```", "{0}", "```json {0} ```"]
_BODY = "[1, 2]"


def _fences(t, policy: Policy) -> DataFrame:
    df = t("events").select("event_id", pick("event_id", [f.replace("{0}", _BODY) for f in FENCED]).alias("text"))
    return df.select("event_id", normalize(F.col("text"), policy).alias("body"))


def _fence_sql(outcomes: list[str]) -> str:
    # Values by hand: b is the body, w the whole text (trimmed), o the body with a closing line that is too short.
    texts = [f.replace("{0}", _BODY) for f in FENCED]
    out = [{"b": _BODY, "w": texts[i].strip(), "o": f"{_BODY}\n```"}[o] for i, o in enumerate(outcomes)]
    cases = " ".join(f"WHEN {i} THEN '" + v.replace("\r", "\x01").replace("\n", "' || chr(10) || '").replace("\x01", "' || chr(13) || '") + "'" for i, v in enumerate(out))
    return f"SELECT event_id, CASE event_id % {len(out)} {cases} END AS body FROM events"


# An indented opening loses its indent to trimming and so counts.
@query(_fence_sql(list("bbbwbobww")))
def q_fence_json(t):
    """A fence labelled json, jsonc or nothing comes off, closed or not."""
    return _fences(t, Policy())


@query(_fence_sql(list("bbbbbobww")))
def q_fence_any(t):
    """Any fence comes off."""
    return _fences(t, Policy(fence="any"))


@query(_fence_sql(list("bbbwwwbww")))
def q_fence_required(t):
    """A fence comes off only if it is closed."""
    return _fences(t, Policy(closing="required"))


@query("""
SELECT doc_id, strlen(j) AS n_bytes, md5(j) AS digest, length(inner_text) AS n_chars
FROM (SELECT doc_id, inner_text, '{"text":"' || replace(replace(replace(inner_text, chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '"}' AS j
      FROM (SELECT doc_id, replace(replace(text, '\\', '/'), '"', '''') AS inner_text FROM documents))
""".replace("\\\\", "\\"))
def q_escape_controls(t):
    """Raw line breaks and tabs in strings become escapes, and the text decodes to what it was."""
    inner = F.translate("text", '\\"', "/'")
    df = t("documents").select("doc_id", F.concat(F.lit('{"text":"'), inner, F.lit('"}')).alias("j"))
    df = df.withColumn("clean", normalize(F.col("j"), Policy(trim=False)))
    df = df.withColumn("value", F.from_json("clean", "text string"))
    return df.select("doc_id", F.octet_length("clean").cast("bigint").alias("n_bytes"), F.md5("clean").alias("digest"), F.length("value.text").cast("bigint").alias("n_chars"))


HOSTILE = ['{"a":1}', "[1,2,]", '{"a":NaN}', "[1 2]", '{"a":1} x', '"\\ud800"', '"\\ud83d\\ude00"', '{"a":1,"a":2}', "{'a':1}", "01", "1e400", "", " null ", "[", '{"a"}', "-", "true false", '[{"b":[[]]}]']
_VERDICT = [True, False, False, False, False, False, True, True, False, False, True, False, True, False, False, False, False, True]
_REASON = [None, "unexpected_byte", "unexpected_byte", "expected_comma_or_array_end", "trailing_characters", "unpaired_surrogate", None, None, "expected_object_key", "invalid_number", None, "unexpected_end", None, "unexpected_end", "expected_colon", "unexpected_end", "trailing_characters", None]
_OFFSET = [None, 5, 5, 3, 8, 7, None, None, 1, 1, None, 0, None, 1, 4, 1, 5, None]
_ROOT = ["object", "array", "object", "array", "object", "other", "other", "object", "object", "other", "other", "other", "other", "array", "object", "other", "other", "array"]


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS n_valid FROM events GROUP BY event_type")
def q_validate_props(t):
    """How many of the events' properties are valid."""
    df = validate(t("events").select("event_type", "props"), "props")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"))


@query(f"SELECT event_id, {sql_pick('event_id', _VERDICT)} AS valid, {sql_pick('event_id', _VERDICT)} AS exact FROM events")
def q_validate_hostile(t):
    """The built-in formula and the scanner agree on broken texts."""
    df = t("events").select("event_id", pick("event_id", HOSTILE).alias("text"))
    return validate(validate(df, "text"), "text", exact=True, out="exact").select("event_id", "valid", "exact")


@query(f"SELECT event_id, {sql_pick('event_id', _REASON)} AS reason, CAST(coalesce({sql_pick('event_id', _OFFSET)}, -1) AS BIGINT) AS at FROM events")
def q_syntax_reason(t):
    """Why and where texts fail; -1 where they don't."""
    df = t("events").select("event_id", scan_column(pick("event_id", HOSTILE)).alias("s"))
    return df.select("event_id", "s.reason", F.coalesce("s.offset", F.lit(-1)).cast("bigint").alias("at"))


@query("""
SELECT doc_id, lines + 1 AS line, tail + 3 AS col, CAST(strlen(inner_text) + 3 AS BIGINT) AS at
FROM (SELECT doc_id, inner_text, len(regexp_extract_all(inner_text, '\\r\\n|\\r|\\n')) AS lines, length(regexp_extract(inner_text, '[^\\r\\n]*$')) + CASE WHEN regexp_matches(inner_text, '[\\r\\n]') THEN 0 ELSE 1 END AS tail
      FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\r\\n]', ' ', 'g') || CASE doc_id % 4 WHEN 1 THEN chr(13) WHEN 2 THEN chr(13) || chr(10) WHEN 3 THEN chr(10) || chr(13) ELSE '' END AS inner_text FROM documents))
""".replace("\\\\", "\\"))
def q_line_column(t):
    """The line and column of an error after many lines, however they end."""
    ends = F.coalesce(pick("doc_id", ["", "\r", "\r\n", "\n\r"]), F.lit(""))
    blank = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\r\\n]", " "), ends)
    df = t("documents").select("doc_id", F.concat(F.lit("["), blank, F.lit("1 2]")).alias("j"))
    df = df.withColumn("s", scan_column(F.col("j")))
    return df.select("doc_id", F.col("s.line").alias("line"), (F.col("s.column")).alias("col"), F.col("s.offset").alias("at"))


@query(f"SELECT event_id, {sql_pick('event_id', _ROOT)} AS hint, {sql_pick('event_id', [r if v else None for r, v in zip(_ROOT, _VERDICT)])} AS kind, {sql_pick('event_id', ['object', 'array', 'other', None])} AS named FROM events")
def q_root_kind(t):
    """Kinds by first character, by parsed value and by name."""
    df = decode_strict(t("events").select("event_id", pick("event_id", HOSTILE).alias("text")), "text")
    names = pick("event_id", ["Object", "ARRAY", "other", "list"])
    return df.select("event_id", measure.root_kind(F.col("text")).alias("hint"), measure.root_kind_of(F.col("value")).alias("kind"), measure.parse_root_kind(names).alias("named"))


@query("SELECT event_id, unnest([event_id, user_id, event_id % 7]) AS item FROM events")
def q_decode_array_explode(t):
    """Arrays decode to typed arrays."""
    text = F.concat(F.lit("```\n["), F.concat_ws(", ", "event_id", "user_id", F.col("event_id") % 7), F.lit("]\n```"))
    df = decode_array(t("events").select("event_id", text.alias("text")), "text", "bigint", exact=False)
    # An outer explode, as the inner one makes Spark decode twice more for a filter of its own.
    return df.select("event_id", F.explode_outer("value").alias("item")).filter("item is not null")


USERS = ['{"name":"Ann","age":30}', '{"name":"Bo","age":300}', '{"name":"Cy"}', '{"name":7,"age":1}', '{"name":"Di","age":"5"}', "[1]", '{"name":"Ed","age":1,"age":2}', '{"name":"Fy","age":0,"x":[1]}', '{"name":"Gi","age":1', "  ", None]
_USER_ERROR = [None, "deserialize", "deserialize", "deserialize", "deserialize", "unexpected_top_level", "deserialize", None, "invalid_json", "empty_input", None]


@query(f"""
SELECT event_id, {sql_pick('event_id', ['Ann', None, None, None, None, None, None, 'Fy', None, None, None])} AS name, CAST(coalesce({sql_pick('event_id', [30, None, None, None, None, None, None, 0, None, None, None])}, -1) AS BIGINT) AS age,
       {sql_pick('event_id', _USER_ERROR)} AS kind, {sql_pick('event_id', [e and {'deserialize': 'deserialize', 'unexpected_top_level': 'top_level_check', 'invalid_json': 'parse', 'empty_input': 'normalize'}[e] for e in _USER_ERROR])} AS stage
FROM events
""")
def q_decode_typed(t):
    """Typed decoding, and how it fails; an age of -1 for none."""
    texts = [F.lit(u) for u in USERS]
    df = t("events").select("event_id", F.element_at(F.array(*texts), (F.col("event_id") % len(USERS) + 1).cast("int")).alias("text"))
    df = decode_object(df, "text", "name string not null, age smallint not null")
    # Ages are bytes without sign in the type that is asked for.
    over = F.col("value.age") > 255
    return df.select("event_id", F.when(~over, F.col("value.name")).alias("name"), F.coalesce(F.when(~over, F.col("value.age")), F.lit(-1)).cast("bigint").alias("age"), F.when(over, "deserialize").otherwise(F.col("error.kind")).alias("kind"), F.when(over, "deserialize").otherwise(F.col("error.stage")).alias("stage"))


@query(f"""
SELECT kind, stage, count(*) AS n FROM (SELECT {sql_pick('event_id', ['invalid_json' if not v and h.strip() else 'empty_input' if not h.strip() else None for h, v in zip(HOSTILE, _VERDICT)])} AS kind,
  {sql_pick('event_id', ['parse' if not v and h.strip() else 'normalize' if not h.strip() else None for h, v in zip(HOSTILE, _VERDICT)])} AS stage FROM events) GROUP BY kind, stage
""")
def q_error_profile(t):
    """Errors by kind and stage."""
    df = decode(t("events").select(pick("event_id", HOSTILE).alias("text")), "text")
    return df.groupBy(F.col("error.kind").alias("kind"), F.col("error.stage").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, {sql_pick('event_id', ['budget', 'empty_input', 'invalid_utf8', None])} AS kind, {sql_pick('event_id', ['admission', 'normalize', 'decode_text', None])} AS stage FROM events")
def q_error_names(t):
    """Kinds of errors by name, and their stages."""
    kind = parse_error_kind(pick("event_id", ["BUDGET", "Empty_Input", "invalid_utf8", "oops"]))
    return t("events").select("event_id", kind.alias("kind"), stage_of(kind).alias("stage"))


@query(f"SELECT event_id, {sql_pick('event_id', ['object', None, 'other', None, None])} AS root, {sql_pick('event_id', [None, 'invalid_utf8', None, 'input_too_large', 'empty_input'])} AS kind, CAST({sql_pick('event_id', [9, 3, 6, 64, 2])} AS BIGINT) AS raw_bytes FROM events")
def q_decode_bytes(t):
    """Bytes: their size is looked at before they are read as UTF-8."""
    hexes = ["7b2261223a2031207d"[:18], "5bff5d", "22c3a92221"[:8] + "2020", "ff" * 64, "2020"]
    df = t("events").select("event_id", F.unhex(pick("event_id", hexes)).alias("content"))
    df = decode(df, "content", limits=Limits(input_bytes=32))
    return df.select("event_id", measure.root_kind_of(F.col("value")).alias("root"), F.col("error.kind").alias("kind"), F.octet_length("content").cast("bigint").alias("raw_bytes"))


REPEATED = ['{"a":1,"b":2}', '{"a":1,"a":2}', '{"x":{"a":1,"\\u0061":2}}', "[{},{}]", '[{"k":[{"z":1,"z":1}]}]', '{"a":']


@query(f"SELECT event_id, {sql_pick('event_id', [True, False, False, True, False, False])} AS strict_ok, {sql_pick('event_id', [True, True, True, True, True, False])} AS lenient_ok, {sql_pick('event_id', ['1', '2', None, None, None, None])} AS last_a FROM events")
def q_strict_duplicates(t):
    """Repeated keys at any depth: refused by the strict value; elsewhere the last one counts."""
    df = t("events").select("event_id", pick("event_id", REPEATED).alias("text"))
    df = df.withColumns({"strict": strict_value("text"), "lenient": F.try_parse_json("text")})
    return df.select("event_id", F.col("strict").isNotNull().alias("strict_ok"), F.col("lenient").isNotNull().alias("lenient_ok"), F.try_variant_get("lenient", "$.a", "string").alias("last_a"))


@query("""
SELECT o_orderkey, CAST(5 + o_orderkey % 4 AS BIGINT) AS nodes, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 3 END AS BIGINT) AS depth, CAST(1 + 1 + strlen(CAST(o_orderkey AS VARCHAR)) + 1 + strlen(o_orderstatus) + 1 + 5 + 4 * (o_orderkey % 4) AS BIGINT) AS payload,
       CAST(4 AS BIGINT) AS n_keys, CAST(1 AS BIGINT) AS key_bytes, CAST(greatest(strlen(o_orderstatus), 5) AS BIGINT) AS string_bytes,
       CAST(greatest(strlen(CAST(o_orderkey AS VARCHAR)), CASE WHEN o_orderkey % 4 > 0 THEN 4 ELSE 0 END) AS BIGINT) AS number_bytes
FROM orders
""")
def q_nodes_depth_payload(t):
    """What documents measure, by built-in functions."""
    numbers = F.array_join(F.slice(F.array(*[F.lit("1e+3")] * 4), F.lit(1), (F.col("o_orderkey") % 4).cast("int")), ", ")
    text = F.concat(F.lit('{"o": '), F.col("o_orderkey").cast("string"), F.lit(', "s" : "'), "o_orderstatus", F.lit('", "l":['), numbers, F.lit('], "u": "\\u4e2d\\n\\""}'))
    df = t("orders").select("o_orderkey", text.alias("text"))
    x = F.col("text")
    df = df.select("o_orderkey", measure.profile(x).alias("m"))
    names = {"nodes": "nodes", "depth": "depth", "payload": "payload_bytes", "n_keys": "keys", "key_bytes": "max_key_bytes", "string_bytes": "max_string_bytes", "number_bytes": "max_number_bytes"}
    return df.select("o_orderkey", *[F.col("m")[of].cast("bigint").alias(name) for name, of in names.items()])


@query("""
SELECT conv_id, turn, CASE WHEN strlen(role) > 6 THEN 'string_bytes' WHEN turn > 3 THEN 'items' END AS resource,
       CAST(CASE WHEN strlen(role) > 6 THEN strlen(role) WHEN turn > 3 THEN 4 ELSE -1 END AS BIGINT) AS observed FROM conversations
""")
def q_point_limits(t):
    """The first limit that a document breaks, in the order of the text."""
    items = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.col("turn"), F.lit(0))), lambda i: F.lit("1")), ",")
    text = F.concat(F.lit('{"role":"'), "role", F.lit('","n":['), F.when(F.col("turn") > 0, F.substring(items, F.lit(3), F.length(items))).otherwise(""), F.lit("]}"))
    s = scan_column(F.col("text"), Limits(string_bytes=6, items=3))
    return t("conversations").select("conv_id", "turn", text.alias("text")).withColumn("s", s).select("conv_id", "turn", "s.resource", F.coalesce("s.observed", F.lit(-1)).cast("bigint").alias("observed"))


@query(f"SELECT event_id, {sql_pick('event_id', ['depth', 'nodes', 'nodes'])} AS lexical, {sql_pick('event_id', ['depth', 'items', None])} AS tree FROM events")
def q_lexical_and_tree(t):
    """The scanner counts members as they come and repeated keys each; a tree is counted whole and once."""
    text = pick("event_id", ["[[[[1]]]]", "[1,2,3,4,5,6]", '{"a":1,"a":2,"a":3,"a":4,"a":5}'])
    limits = Limits(depth=4, nodes=4, items=5)
    df = t("events").select("event_id", text.alias("text"))
    return df.withColumns({"s": scan_column(F.col("text"), limits), "w": account_column(F.col("text"), limits)}).select("event_id", F.col("s.resource").alias("lexical"), F.col("w.resource").alias("tree"))


_SESSION_SQL = """
WITH RECURSIVE d AS (
  SELECT conv_id, turn, strlen(role) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations),
s AS (
  SELECT conv_id, turn, n, p <= 12 AS accepted, CASE WHEN p <= 12 THEN p ELSE 0 END AS used FROM d WHERE n = 1
  UNION ALL
  SELECT d.conv_id, d.turn, d.n, s.used + d.p <= 12, CASE WHEN s.used + d.p <= 12 THEN s.used + d.p ELSE s.used END FROM s JOIN d ON d.conv_id = s.conv_id AND d.n = s.n + 1)
SELECT conv_id, turn, accepted, CAST(used AS BIGINT) AS used FROM s
"""


@query(_SESSION_SQL)
def q_session_greedy(t):
    """A budget shared by a conversation's turns; a rejected turn leaves its part to the next."""
    df = t("conversations").select("conv_id", "turn", "role", "text", F.concat(F.lit('["'), "role", F.lit('"]')).alias("json"))
    df = run_sessions(df, "json", key=["conv_id"], order=["turn", "role", "text"], limits=Limits(payload_bytes=12))
    return df.select("conv_id", "turn", "accepted", F.col("used_payload_bytes").alias("used"))


@query(_SESSION_SQL)
def q_session_stream(t):
    """The same budget over a stream of turns, as keyed state."""
    stream = t.stream("conversations").select("conv_id", "turn", "role", "text", F.concat(F.lit('["'), "role", F.lit('"]')).alias("json"))
    out = stream_sessions(stream, "json", key=["conv_id"], order=["turn", "role", "text"], limits=Limits(payload_bytes=12))
    return run_to_end(out.select("conv_id", "turn", "accepted", F.col("used_payload_bytes").alias("used")))


@query("""
SELECT o_custkey % 10 AS k, count(*) AS n_nodes, CAST(sum(b) AS BIGINT) AS bytes, max(depth) AS depth FROM (
  SELECT o_custkey, unnest([3, 2, strlen(o_orderstatus), strlen(CAST(o_orderkey AS VARCHAR)), strlen(o_orderpriority), 1]) AS b, unnest([1, 2, 3, 3, 2, 2]) AS depth FROM orders) GROUP BY k
""")
def q_tree_nodes(t):
    """Documents as tables of their nodes."""
    text = F.concat(F.lit('{"p": "'), "o_orderpriority", F.lit('", "a": ["'), "o_orderstatus", F.lit('", '), F.col("o_orderkey").cast("string"), F.lit('], "n": 7}'))
    nodes = tree_nodes(t("orders").select((F.col("o_custkey") % 10).alias("k"), text.alias("text")), "text")
    return nodes.groupBy("k").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("bytes").alias("bytes"), F.max("depth").cast("int").alias("depth"))


@query("""
SELECT event_id, '{"keep":' || CAST(user_id AS VARCHAR) || ',"nested":{"child":[1.50,{"secret":"[redacted]"}]},"secret":"[redacted]"}' AS safe FROM events
""")
def q_redact(t):
    """Values of a key replaced at any depth; numbers stay as written."""
    text = F.concat(F.lit('{"secret": {"token": ["x", '), F.col("event_id").cast("string"), F.lit(']}, "keep": '), F.col("user_id").cast("string"), F.lit(', "nested": {"child": [1.50, {"secret": null}]}}'))
    return t("events").select("event_id", text.alias("text")).select("event_id", redact(F.col("text"), ["secret"]).alias("safe"))


@query(f"""SELECT event_id, {sql_pick('event_id', [None, '{"a":{"b":[1,2]},"c":0}', '{"a":{"b":[1,2]},"c":0}'])} AS text, {sql_pick('event_id', ['nodes', None, None])} AS resource, CAST({sql_pick('event_id', [2, 3, 6])} AS BIGINT) AS visited FROM events""")
def q_mutate_limits(t):
    """Rewriting under a limit: given up, or passing over what is below a rule."""
    text = F.lit('{"c":1,"a":{"b":[1,2]}}')
    zero, over = Rule(keys=frozenset(["c"]), put="0"), Rule(keys=frozenset(["a"]), skip=True)
    df = t("events").select("event_id", text.alias("text"))
    # Each row is rewritten in one of the ways only.
    own = lambda i: F.when(F.col("event_id") % 3 == i, F.col("text"))
    made = {"a": mutate_column(own(0), (zero,), Limits(nodes=2)), "b": mutate_column(own(1), (zero, over)), "c": mutate_column(own(2), (zero,))}
    df = df.withColumns(made).withColumn("m", F.coalesce("a", "b", "c"))
    return df.select("event_id", "m.text", "m.resource", "m.visited")


@query("""
SELECT o_orderkey, '{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || CAST(o_totalprice AS VARCHAR) || ',"o_orderpriority":"' || o_orderpriority || '"}' AS json FROM orders
""")
def q_encode_struct(t):
    """Rows as compact objects."""
    return encode_rows(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")).select("o_orderkey", "json")


@query(f"""
SELECT event_id, '{{"z":null,"f":' || {sql_pick('event_id', ['null', 'null', '1e16', '1.5e-7', '0.0001', '1.0', '123456789.25'])} || ',"b":[0,' || CAST(event_id % 7 AS VARCHAR) || ',255],"s":"a\\"\\\\\\n\\u001b","m":{{"' || CAST(event_id AS VARCHAR) || '":true}}}}' AS json,
       '{{"Some":[' || CAST(event_id % 7 AS VARCHAR) || ']}}' AS tagged, '"None"' AS unit
FROM events
""")
def q_encode_special(t):
    """Nulls, numbers that aren't finite, bytes, escapes, keys that are numbers, and variants."""
    f = F.element_at(F.array(*[F.lit(x) for x in (float("nan"), float("inf"), 1e16, 1.5e-7, 1e-4, 1.0, 123456789.25)]), (F.col("event_id") % 7 + 1).cast("int"))
    small = F.unhex(F.lpad(F.hex(F.col("event_id") % 7), 2, F.lit("0")))
    df = t("events").select("event_id", F.lit(None).cast("string").alias("z"), f.alias("f"), F.concat(F.unhex(F.lit("00")), small, F.unhex(F.lit("FF"))).alias("b"), F.lit('a"\\\n\x1b').alias("s"), F.create_map("event_id", F.lit(True)).alias("m"))
    df = encode_rows(df, ["z", "f", "b", "s", "m"])
    return df.select("event_id", "json", tagged("Some", byte_array(F.unhex(F.lpad(F.hex(F.col("event_id") % 7), 2, F.lit("0"))))).alias("tagged"), tagged("None").alias("unit"))


@query("""
SELECT l_orderkey, '{"order":' || CAST(l_orderkey AS VARCHAR) || ',"lines":[' || string_agg('{"line":' || CAST(l_linenumber AS VARCHAR) || ',"quantity":' || CAST(l_quantity AS VARCHAR) || ',"price":' || CAST(l_extendedprice AS VARCHAR) || '}', ',' ORDER BY l_linenumber, l_quantity, l_extendedprice) || ']}' AS json
FROM lineitem GROUP BY l_orderkey
""")
def q_encode_nested(t):
    """Orders with their lines; lines are gathered by order, of which each has a few."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    df = t("lineitem").groupBy(F.col("l_orderkey").alias("order")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return encode_rows(df).select(F.col("order").alias("l_orderkey"), "json")


@query(f"""
SELECT event_id, {sql_pick('event_id', ['{"raw":[1, 2]}', '{"raw":null}', None])} AS json, {sql_pick('event_id', [None, None, 'invalid_raw_json'])} AS kind, NULL::VARCHAR AS resource FROM events
""")
def q_encode_raw(t):
    """Fragments of JSON are checked and put in as they are."""
    df = t("events").select("event_id", F.element_at(F.array(F.lit("[1, 2]"), F.lit(None), F.lit("[1 2]")), (F.col("event_id") % 3 + 1).cast("int")).alias("raw"))
    return encode_rows(df, ["raw"], raw=["raw"], limits=Limits(output_bytes=100)).select("event_id", "json", "error.kind", "error.resource")


@query("SELECT event_id, CASE WHEN user_id >= 10 THEN NULL ELSE '{\"u\":' || user_id || '}' END AS json, CASE WHEN user_id >= 10 THEN 'output_bytes' END AS resource FROM events")
def q_encode_limit(t):
    """Output over its limit is refused whole."""
    df = encode_rows(t("events").select("event_id", F.col("user_id").alias("u")), ["u"], limits=Limits(output_bytes=7))
    return df.select("event_id", "json", "error.resource")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 2 AS twice FROM events")
def q_decode_seed(t):
    """Decoding to what a caller's function makes of the value."""
    df = decode_with(t("events").select("event_id", "props"), "props", lambda v: F.try_variant_get(v, "$.k", "double") * 2, exact=False)
    return df.select("event_id", F.col("value").alias("twice"))


DEEP, LONG = "[" * 1500 + "]" * 1500, "7" * 1200
BEYOND = [DEEP, "[" * 1500, DEEP + "]", LONG, "0" * 1200, f'{{"a":{LONG}}}', f'"{LONG}"', f"[{DEEP},{LONG},]"]
_BEYOND = [True, False, False, True, False, True, True, False]


@query(f"SELECT event_id, {sql_pick('event_id', _BEYOND)} AS valid, {sql_pick('event_id', _BEYOND)} AS exact, {sql_pick('event_id', ['deserialize' if v and i != 6 else None if v else 'invalid_json' for i, v in enumerate(_BEYOND)])} AS kind, {sql_pick('event_id', ['parser' if v and i != 6 else None for i, v in enumerate(_BEYOND)])} AS resource FROM events")
def q_validate_beyond(t):
    """Texts deeper than the built-in parser goes, and numbers longer than it takes: valid all the same, and never lost without an error."""
    df = t("events").select("event_id", pick("event_id", BEYOND).alias("text"))
    df = decode(validate(validate(df, "text"), "text", exact=True, out="exact"), "text")
    return df.select("event_id", "valid", "exact", F.when(F.col("value").isNull() & F.col("error").isNull(), "lost").otherwise(F.col("error.kind")).alias("kind"), "error.resource")


#: Each with the number as it is to come out, or how it fails.
EXACT = {
    '{"v":340282366920938463463374607431768211455}': "340282366920938463463374607431768211455",
    '{"v":1e3,"s":{"a":1},"l":[{"a":1},{"a":2}],"d":1.23}': "1e3",
    '{"v":-0.10,"x":{"a":1,"a":2}}': "-0.10",
    '{"v":1,"s":{"a":1,"a":2}}': None,
    '{"v":1,"l":[{"a":1},{"a":2,"\\u0061":2}]}': None,
    '{"v":1,"v":1}': None,
    '{"v":"1"}': None,
    '{"v":1,"d":1.239}': None,
    '{"v":1,"d":123456789.5}': None,
    '{"v":true}': None,
}


@query(f"SELECT event_id, {sql_pick('event_id', list(EXACT.values()))} AS v, {sql_pick('event_id', [None if v else 'deserialize' for v in EXACT.values()])} AS kind FROM events")
def q_decode_exact(t):
    """Numbers of any length as they are written, repeated fields at any depth refused, nothing rounded."""
    df = t("events").select("event_id", pick("event_id", list(EXACT)).alias("text"))
    df = decode_object(df, "text", "v string not null, s struct<a: int>, l array<struct<a: int>>, d decimal(10,2)", lexemes=("v",))
    return df.select("event_id", "value.v", "error.kind")


@query(f"SELECT event_id, {sql_pick('event_id', [None, 'duplicate_key', 'duplicate_key', None, 'duplicate_key', 'unexpected_end'])} AS reason, CAST(coalesce({sql_pick('event_id', [None, 7, 12, None, 14, 5])}, -1) AS BIGINT) AS at FROM events")
def q_duplicate_places(t):
    """Repeated keys as errors, with the place of the key."""
    df = decode_unique(t("events").select("event_id", pick("event_id", REPEATED).alias("text")), "text")
    return df.select("event_id", "error.reason", F.coalesce("error.offset", F.lit(-1)).cast("bigint").alias("at"))


@query(f"SELECT event_id, {sql_pick('event_id', [None, 'invalid_utf8', 'invalid_utf8', 'invalid_utf8'])} AS kind, CAST(coalesce({sql_pick('event_id', [None, 2, 0, 1])}, -1) AS BIGINT) AS valid_up_to, CAST(coalesce({sql_pick('event_id', [None, 1, 2, None])}, -1) AS BIGINT) AS error_len FROM events")
def q_utf8_places(t):
    """How many bytes are sound before those that are no UTF-8, and how many of these; -1 for none."""
    df = t("events").select("event_id", F.unhex(pick("event_id", ["5b5d", "2261ff22", "e4b878", "61e4b8"])).alias("content"))
    df = decode(df, "content")
    return df.select("event_id", "error.kind", *[F.coalesce(f"error.{c}", F.lit(-1)).cast("bigint").alias(c) for c in ("valid_up_to", "error_len")])


def _greedy_sql(size: str, most: int, columns: str, fresh: str = "FALSE") -> str:
    """A budget that each document takes its size from if that is left, anew where ``fresh`` holds."""
    before = f"CASE WHEN {fresh} THEN 0 ELSE s.used END"
    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, role, {size} AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations),
s AS (
  SELECT conv_id, turn, role, p, n, p <= {most} AS accepted, CASE WHEN p <= {most} THEN p ELSE 0 END AS used FROM d WHERE n = 1
  UNION ALL
  SELECT d.conv_id, d.turn, d.role, d.p, d.n, {before} + d.p <= {most}, {before} + CASE WHEN {before} + d.p <= {most} THEN d.p ELSE 0 END FROM s JOIN d ON d.conv_id = s.conv_id AND d.n = s.n + 1)
SELECT conv_id, turn, accepted, CAST(used AS BIGINT) AS used, {columns} FROM s
"""


_ORDER = {"key": ["conv_id"], "order": ["turn", "role", "text"]}


@query(_greedy_sql("strlen(role)", 12, "CASE WHEN accepted THEN role END AS role, CAST(sum(strlen(role) + 4) OVER w AS BIGINT) AS repaired, CAST(sum(strlen(role) + 12) OVER w AS BIGINT) AS raw").replace("FROM s\n", "FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY n)\n"))
def q_session_decode(t):
    """Fenced texts decoded within a session; bytes are charged before and after repair, whether a text is accepted or not."""
    df = t("conversations").select("conv_id", "turn", "role", "text", F.concat(F.lit('```\n["'), "role", F.lit('"]\n```')).alias("json"))
    df = decode_sessions(df, "json", **_ORDER, limits=Limits(payload_bytes=12), schema="array<string>")
    return df.select("conv_id", "turn", "accepted", F.col("used_payload_bytes").alias("used"), F.get("value", F.lit(0)).alias("role"), F.col("used_normalized_bytes").alias("repaired"), F.col("used_input_bytes").alias("raw"))


@query(_greedy_sql("strlen(role) + 8", 40, """CASE WHEN accepted THEN '{"r":"' || role || '"}' END AS json, CASE WHEN NOT accepted THEN 'output_bytes' END AS resource"""))
def q_session_encode(t):
    """Rows encoded within a session, as long as there is room for the output."""
    df = t("conversations").select("conv_id", "turn", "role", "text", F.col("role").alias("r"))
    df = encode_sessions(df, ["r"], **_ORDER, limits=Limits(output_bytes=40))
    return df.select("conv_id", "turn", "accepted", F.col("used_output_bytes").alias("used"), "json", F.col("error_resource").alias("resource"))


@query(_greedy_sql("strlen(role) + 1", 14, "role", "d.turn % 3 = 0"))
def q_session_tree(t):
    """Sessions that charge trees, in which of equal keys the last counts alone, and that begin anew every third turn."""
    value = F.concat(F.lit('"'), "role", F.lit('"'))
    df = t("conversations").select("conv_id", "turn", "role", "text", F.concat(F.lit('{"a":'), value, F.lit(',"a":'), value, F.lit("}")).alias("json"), (F.col("turn") % 3 == 0).alias("fresh"))
    df = run_sessions(df, "json", **_ORDER, limits=Limits(payload_bytes=14), mode="tree", reset="fresh")
    return df.select("conv_id", "turn", "accepted", F.col("used_payload_bytes").alias("used"), "role")


@query("SELECT event_id, '{\"k\":' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) || '}' AS text FROM events")
def q_mutate_visit(t):
    """Values rewritten by a caller's function: numbers by their last digit."""
    last = tuple(Rule(put=str(i)) for i in range(10))
    return t("events").select("event_id", mutate_column(F.col("props"), visit=lambda node: last[int(node["scalar"][-1])] if node["kind"] == "number" else None)["text"].alias("text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS more FROM events")
def q_seed_bytes(t):
    """Bytes decoded to what a caller's function makes of the value."""
    df = t("events").select("event_id", F.encode("props", "UTF-8").alias("content"))
    df = decode_with(df, "content", lambda v: F.try_variant_get(v, "$.k", "double") + 1, exact=False)
    return df.select("event_id", F.col("value").alias("more"))


#: Bytes, whether they are JSON, and why and where those that aren't fail.
BYTES = {
    "7b2261223a317d": (True, None, None),
    "22ff22": (False, "invalid_utf8", 1),
    "22c3a922": (True, None, None),
    "22c3": (False, "unexpected_end", 1),
    "5b22c08022": (False, "invalid_utf8", 2),
    "ff": (False, "unexpected_byte", 0),
    "5b5d": (True, None, None),
    "22eda08022": (False, "invalid_utf8", 1),
    "22c3a9f09f988022": (True, None, None),
    "22f5808080": (False, "invalid_utf8", 1),
    "2261e4b8": (False, "unexpected_end", 2),
    "22e4b822": (False, "invalid_utf8", 1),
}


@query(f"SELECT event_id, {', '.join(f'{sql_pick('event_id', [b[0] for b in BYTES.values()])} AS {c}' for c in ('valid', 'exact'))}, {sql_pick('event_id', [b[1] for b in BYTES.values()])} AS reason, CAST(coalesce({sql_pick('event_id', [b[2] for b in BYTES.values()])}, -1) AS BIGINT) AS at FROM events")
def q_validate_bytes(t):
    """Bytes that are JSON, and those that are no UTF-8, within texts or outside; -1 for no place."""
    df = t("events").select("event_id", F.unhex(pick("event_id", list(BYTES))).alias("content"))
    df = validate(validate(df, "content"), "content", exact=True, out="exact").withColumn("s", scan_column(F.col("content")))
    return df.select("event_id", "valid", "exact", "s.reason", F.coalesce("s.offset", F.lit(-1)).cast("bigint").alias("at"))


#: Texts, and of those that fail the kind, and the bytes before and after repair.
REPAIRED = {
    "```json\n```": ("empty_input", 11, 0),
    "\ufeff": ("empty_input", 3, 0),
    '  {"a":1}  ': (None, None, None),
    '"aaaaaaaaaa"': ("input_too_large", 12, 12),
    '"\n\n\n"': (None, None, None),
    '"\n\n\n\n"': ("input_too_large", 6, 10),
    "   ": ("empty_input", 3, None),
    '```\n"aaaaaa"\n```': (None, None, None),
}


@query(f"SELECT event_id, {sql_pick('event_id', [k for k, _, _ in REPAIRED.values()])} AS kind, {', '.join(f'CAST(coalesce({sql_pick('event_id', [v[i] for v in REPAIRED.values()])}, -1) AS BIGINT) AS {c}' for i, c in ((1, 'raw'), (2, 'repaired')))}, CAST({sql_pick('event_id', [8 if k == 'input_too_large' else -1 for k, _, _ in REPAIRED.values()])} AS BIGINT) AS most FROM events")
def q_repaired_size(t):
    """Texts that are empty, or too long, only once they are repaired; -1 for what an error doesn't tell."""
    df = decode(t("events").select("event_id", pick("event_id", list(REPAIRED)).alias("text")), "text", limits=Limits(normalized_bytes=8))
    sizes = {"raw": "raw_bytes", "repaired": "normalized_bytes", "most": "maximum"}
    return df.select("event_id", "error.kind", *[F.coalesce(f"error.{of}", F.lit(-1)).cast("bigint").alias(c) for c, of in sizes.items()])


#: Texts in need of one repair each, and which of them each policy makes JSON.
NEEDY = ["```json\n[1]\n```", "\ufeff[1]", " [1] ", '["\t"]', "~~~x\n[1]\n~~~", "```\n[1]", "[1]"]
POLICIES = {
    "strict": (Policy.strict(), "0010001"),
    "lenient": (Policy.lenient(), "1111011"),
    "any_fence": (Policy().but(fence="any"), "1111111"),
    "closed": (Policy().but(closing="required"), "1111001"),
    "as_typed": (Policy().but(escape_controls=False), "1110011"),
    "with_bom": (Policy().but(strip_bom=False), "1011011"),
    "no_fence": (Policy().but(fence="disabled"), "0111001"),
}


@query(f"SELECT event_id, {', '.join(f'{sql_pick('event_id', [c == '1' for c in ok])} AS {name}' for name, (_, ok) in POLICIES.items())} FROM events")
def q_policies(t):
    """What each choice of repairs makes of the same texts."""
    df = t("events").select("event_id", pick("event_id", NEEDY).alias("text"))
    for name, (policy, _) in POLICIES.items():
        df = decode(df, "text", policy=policy, exact=False, value=name, error=f"{name}_error")
    return df.select("event_id", *[F.col(f"{name}_error").isNull().alias(name) for name in POLICIES])


_WRONG = ["[1 2]", '{"a":1}', " ", "[7]", "[1,2,3]"]
_SAID = ["the text is no JSON at line 1 column 4", "the root is of another kind: expected array, got object", "there is no text", None, "a limit is reached: items"]


@query(f"SELECT event_id, {sql_pick('event_id', _SAID)} AS said, {sql_pick('event_id', [s and s + (': expected_comma_or_array_end' if i == 0 else '') for i, s in enumerate(_SAID)])} AS detailed FROM events")
def q_error_messages(t):
    """Messages of errors: by default without the scanner's reason, and in detail with it."""
    df = t("events").select("event_id", pick("event_id", _WRONG).alias("text"))
    df = decode_array(df, "text", limits=Limits(items=2))
    df = df.select("event_id", "text", F.col("error.message").alias("said"))
    return decode_array(df, "text", limits=Limits(items=2), policy=Policy(detailed=True)).select("event_id", "said", F.col("error.message").alias("detailed"))


@query(f"SELECT event_id, {sql_pick('event_id', [r and f'{r.replace("_", " ")} at line 1 column {o + 1} (byte offset {o})' for r, o in zip(_REASON, _OFFSET)])} AS said FROM events")
def q_failure_text(t):
    """Failures of the scanner in words."""
    return t("events").select("event_id", failure_text(scan_column(pick("event_id", HOSTILE))).alias("said"))


@query(f"SELECT event_id, {sql_pick('event_id', [None, None, 'depth', 'depth', 'nodes'])} AS resource, {', '.join(f"CAST({sql_pick('event_id', v)} AS BIGINT) AS {c}" for c, v in (('observed', [-1, -1, 5, 5, -1]), ('requested', [-1, -1, -1, -1, 1]), ('remaining', [-1, -1, -1, -1, 0])))} FROM events")
def q_scan_above(t):
    """Fragments that will stand within two containers count these into their depth, but not into their nodes; limits on one value tell what was observed, those on sums what was left.  -1 for neither."""
    s = scan_column(pick("event_id", ["1", "[[]]", "[[1]]", '{"a":[1]}', "[[],[],[]]"]), Limits(depth=4, nodes=3), above=2)
    return t("events").select("event_id", s.alias("s")).select("event_id", "s.resource", *[F.coalesce(f"s.{c}", F.lit(-1)).cast("bigint").alias(c) for c in ("observed", "requested", "remaining")])


@query("""
SELECT event_id, unnest(['', 'n', '', 'p', 'secret']) AS key, CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS entered, CAST(unnest([4, 1, 0, 2, 3]) AS BIGINT) AS left_at, unnest([NULL, NULL, CAST(event_id AS VARCHAR), 'x', NULL]) AS scalar FROM events
""")
def q_tree_enter(t):
    """A caller's visitor that passes over what is below some nodes, and the orders of entering and leaving."""
    text = F.concat(F.lit('{"p":"x","secret":{"y":[1,2]},"n":['), F.col("event_id").cast("string"), F.lit("]}"))
    nodes = tree_nodes(t("events").select("event_id", text.alias("text")), "text", enter=lambda node: node["key"] != "secret")
    return nodes.select("event_id", F.coalesce("key", F.lit("")).alias("key"), F.col("enter_ord").alias("entered"), F.col("leave_ord").alias("left_at"), "scalar")


@query(f"""SELECT event_id, {sql_pick('event_id', [None, '{"a":[1,2,3],"b":"x"}', '{"a":0,"b":"x"}', None])} AS text, {sql_pick('event_id', ['items', None, None, None])} AS resource, {sql_pick('event_id', [None, None, None, 'expected_colon'])} AS reason, CAST({sql_pick('event_id', [1, 2, 2, 0])} AS BIGINT) AS visited FROM events""")
def q_mutate_over(t):
    """Nodes over a limit: the walk ends, they stay as they are, or something else takes their place; broken texts have a reason."""
    x = F.when(F.col("event_id") % 4 == 3, '{"a"}').otherwise('{"b": "x", "a": [1, 2, 3]}')
    turns = [("abort", (0, 3)), ("skip", (1,)), ("replace", (2,))]
    made = [mutate_column(F.when((F.col("event_id") % 4).isin(*of), x), (), Limits(items=2), how, "0") for how, of in turns]
    df = t("events").select("event_id", *[m.alias(how) for m, (how, _) in zip(made, turns)])
    return df.select("event_id", F.coalesce(*[how for how, _ in turns]).alias("m")).select("event_id", "m.text", "m.resource", "m.reason", "m.visited")


@query(f"""
SELECT event_id, {sql_pick('event_id', ['{"raw":[12, 3]}', None, None, None, None])} AS json, {sql_pick('event_id', [None, 'budget', 'budget', 'invalid_raw_json', 'budget'])} AS kind,
       {sql_pick('event_id', [None, 'depth', 'number_bytes', None, 'number_bytes'])} AS resource, CAST({sql_pick('event_id', [-1, 4, 4, -1, 5])} AS BIGINT) AS observed FROM events
""")
def q_encode_budgets(t):
    """What is in raw fragments counts as any other value; a broken limit comes before a broken fragment."""
    df = t("events").select("event_id", pick("event_id", ["[12, 3]", "[1,[2]]", "1234", "[1 2]", "[12345"]).alias("raw"))
    df = encode_rows(df, ["raw"], raw=["raw"], limits=Limits(depth=3, number_bytes=3))
    return df.select("event_id", "json", "error.kind", "error.resource", F.coalesce("error.observed", F.lit(-1)).cast("bigint").alias("observed"))


@query("SELECT '{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS json FROM orders")
def q_write_lines(t):
    """Rows written as lines of JSON, and read again."""
    rows = encode_rows(t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    path = scratch(t.spark, "lines")
    write_lines(rows, "json", path)
    return read_lines(t.spark, path).select(F.col("text").alias("json"))
