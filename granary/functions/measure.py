"""Validity and measurements of JSON text, as Column expressions.

``is_valid`` is true only of valid texts.  Of those that are nested more than 999 deep, or have a number of
over 1000 digits, a key of over 50,000 letters or a string of over 20,000,000, it is false too, as the
built-in parser gives up on them; the scanner in ``functions.scan`` has no such bounds, and
``operators.decode`` asks it about whatever is false here.  The measurements hold for valid texts, and are
null for others where that is said.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import let
from granary.policy import Limits

DUPLICATES = "spark.sql.variant.allowDuplicateKeys"
_SENTINEL = "granary:7c1f6d1e"
_KEY = r'"(?:[^"\\]|\\.)*+"(?=[ \n\r\t]*:)'
_STRING = r'"(?:[^"\\]|\\.)*+"'
_NUMBER = r"-?[0-9][0-9.eE+-]*+"
_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def prepare(spark: SparkSession) -> None:
    """Sets the one session setting that these functions need: repeated keys are no syntax error."""
    spark.conf.set(DUPLICATES, "true")


def require(spark: SparkSession) -> None:
    """Fails unless the session is prepared."""
    if spark.conf.get(DUPLICATES, "false") != "true":
        raise RuntimeError(f"{DUPLICATES} must be true; call granary.functions.measure.prepare(spark) once")


def _alone(text: Column) -> Column:
    """True if an escape of a lone surrogate is left once pairs and escaped backslashes are gone."""
    return F.regexp_replace(F.regexp_replace(text, r"\\\\", ""), _PAIR, "").rlike(r"\\u[dD][89a-fA-F]")


def is_valid(text: Column) -> Column:
    """True if the text is exactly one JSON value and white space around it.

    The text is parsed as the first element of an array that ends in a mark, so that whatever stands
    after a complete value shows.  Lone surrogates, which the parser lets pass, are looked for apart.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_SENTINEL}"]')))
    whole = let(parsed, lambda v: F.try_variant_get(v, "$[1]", "string").eqNullSafe(F.lit(_SENTINEL)) & F.try_variant_get(v, "$[2]", "string").isNull() & F.is_variant_null(v).eqNullSafe(F.lit(False)))
    blank = text.rlike(r"^[ \n\r\t]*+$")
    return F.when(text.isNull(), F.lit(None).cast("boolean")).otherwise(whole & ~blank & ~F.when(F.contains(text, F.lit("\\u")), _alone(text)).otherwise(False))


def parsed(text: Column) -> Column:
    """The text as a variant, or null unless ``is_valid`` holds; parsed once."""
    every = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_SENTINEL}"]')))
    whole = let(every, lambda v: F.when(F.try_variant_get(v, "$[1]", "string").eqNullSafe(F.lit(_SENTINEL)) & F.try_variant_get(v, "$[2]", "string").isNull(), F.try_variant_get(v, "$[0]", "variant")))
    return F.when(~(text.rlike(r"^[ \n\r\t]*+$") | F.when(F.contains(text, F.lit("\\u")), _alone(text)).otherwise(False)), whole)


def repeats(text: Column, variant: Column) -> Column:
    """True if an object of a valid text, here also parsed with the last of equal keys, repeats a key.

    A repeated key is gone from the parsed value, and so is at least one string.
    """
    strings = lambda t: F.regexp_count(t, F.lit("(?s)" + _STRING))
    return strings(text) > strings(F.to_json(variant))


def may_break(text: Column, limits: Limits) -> Column:
    """False only where sizes alone show that a valid text is within all limits on values."""
    size = F.octet_length(text)
    times = lambda *marks: size - F.octet_length(F.translate(text, "".join(marks), ""))
    most = {"depth": lambda: times("[", "{") + 1, "items": lambda: times(",") + 1, "entries": lambda: times(":"), "nodes": lambda: times(",", "[", "{") + 1}
    out = F.lit(False)
    for name, limit in limits.set.items():
        if name in most:
            out = out | (most[name]() > limit)
        elif name in ("key_bytes", "string_bytes", "number_bytes", "payload_bytes"):
            out = out | (size > limit)
    return out


def shape(text: Column) -> Column:
    """One letter a token: K key, S string, N number, L literal, and the brackets; nothing else."""
    masked = F.regexp_replace(F.regexp_replace(text, "(?s)" + _KEY, "K"), "(?s)" + _STRING, "S")
    masked = F.regexp_replace(F.regexp_replace(masked, _NUMBER, "N"), "true|false|null", "L")
    return F.regexp_replace(masked, "[ \\n\\r\\t,:]++", "")


def nodes(text: Column) -> Column:
    """How many values the text has; keys are none."""
    return F.regexp_count(shape(text), F.lit("[\\[{SNL]")).cast("bigint")


def keys(text: Column) -> Column:
    """How many keys, repeated ones counted."""
    return F.regexp_count(shape(text), F.lit("K")).cast("bigint")


def depth(text: Column) -> Column:
    """The deepest value, the root being at 1."""

    def step(acc: Column, c: Column) -> Column:
        opens, closes = c.isin("[", "{"), c.isin("]", "}")
        now = acc["now"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        here = F.when(opens, now).when(c.isin("S", "N", "L"), acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], here).alias("most"))

    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    # Flat runs between brackets matter only by whether they hold a value.
    short = F.regexp_replace(F.regexp_replace(shape(text), "K", ""), "[SNL]++", "L")
    return F.aggregate(F.split(short, "(?!^)"), zero, step, lambda acc: acc["most"])


def _decoded_bytes(token: Column) -> Column:
    """UTF-8 bytes of the text that a string token stands for."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)

    def escaped(t: Column) -> Column:
        # Each escape is replaced by as many letters as the bytes it stands for.
        t = F.regexp_replace(t, r'\\[^u]', "x")
        t = F.regexp_replace(t, _PAIR, "xxxx")
        t = F.regexp_replace(t, r"\\u00[0-7][0-9a-fA-F]", "x")
        t = F.regexp_replace(t, r"\\u0[0-7][0-9a-fA-F]{2}", "xx")
        return F.octet_length(F.regexp_replace(t, r"\\u[0-9a-fA-F]{4}", "xxx"))

    return F.when(F.contains(inner, F.lit("\\")), escaped(inner)).otherwise(F.octet_length(inner))


def _strings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)" + _STRING), F.lit(0))


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(text, "(?s)" + _STRING, "S"), F.lit(_NUMBER), F.lit(0))


def payload_bytes(text: Column) -> Column:
    """Bytes of all keys, strings and numbers."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return total(F.transform(_strings(text), _decoded_bytes)) + total(F.transform(_numbers(text), F.octet_length))


def max_key_bytes(text: Column) -> Column:
    """Bytes of the longest key, 0 without any."""
    found = F.regexp_extract_all(text, F.lit("(?s)" + _KEY), F.lit(0))
    return F.coalesce(F.array_max(F.transform(found, _decoded_bytes)), F.lit(0))


def max_string_bytes(text: Column) -> Column:
    """Bytes of the longest string value, 0 without any."""
    values = F.regexp_extract_all(F.regexp_replace(text, "(?s)" + _KEY, ""), F.lit("(?s)" + _STRING), F.lit(0))
    return F.coalesce(F.array_max(F.transform(values, _decoded_bytes)), F.lit(0))


def max_number_bytes(text: Column) -> Column:
    """Bytes of the longest number as written, 0 without any."""
    return F.coalesce(F.array_max(F.transform(_numbers(text), F.octet_length)), F.lit(0))


def profile(text: Column) -> Column:
    """All measurements in one struct: nodes, depth, keys, payload_bytes, max_key_bytes, max_string_bytes, max_number_bytes.

    The text is cut into tokens once, and all figures come from these.
    """
    tokens = F.regexp_extract_all(text, F.lit(f"(?s){_STRING}(?:[ \\n\\r\\t]*+:)?|{_NUMBER}|[\\[\\]{{}}tfn]"), F.lit(0))

    def measured(token: Column) -> Column:
        """How a token changes the depth, and what it counts."""
        first = F.left(token, F.lit(1))
        text_ = first == '"'
        key = text_ & F.endswith(token, F.lit(":"))
        size = F.when(text_, _decoded_bytes(F.when(key, F.regexp_replace(token, '"[ \\n\\r\\t]*+:$', '"')).otherwise(token))).when(first.rlike("[-0-9]"), F.octet_length(token)).otherwise(0)
        kind = F.when(key, 0).when(text_, 1).when(first.rlike("[-0-9]"), 2).when(first.isin("[", "{"), 3).when(first.isin("]", "}"), 4).otherwise(5)
        return F.struct(kind.alias("kind"), size.alias("size"))

    names = ("nodes", "depth", "keys", "payload_bytes", "max_key_bytes", "max_string_bytes", "max_number_bytes")

    def step(acc: Column, x: Column) -> Column:
        kind, size = x["kind"], x["size"]
        now = acc["now"] + F.when(kind == 3, 1).when(kind == 4, -1).otherwise(0)
        value = ~kind.isin(0, 4)
        depth = F.when(kind == 3, now).when(value, now + 1).otherwise(0)
        most = lambda name, k: F.when(kind == k, F.greatest(acc[name], size)).otherwise(acc[name]).alias(name)
        return F.struct(now.alias("now"), (acc["nodes"] + value.cast("bigint")).alias("nodes"), F.greatest(acc["depth"], depth).alias("depth"), (acc["keys"] + (kind == 0).cast("bigint")).alias("keys"), (acc["payload_bytes"] + size).alias("payload_bytes"), most("max_key_bytes", 0), most("max_string_bytes", 1), most("max_number_bytes", 2))

    zero = F.struct(F.lit(0).alias("now"), *[F.lit(0).cast("int" if n == "depth" or n.startswith("max") else "bigint").alias(n) for n in names])
    return F.aggregate(F.transform(tokens, measured), zero, step, lambda acc: F.struct(*[acc[n].alias(n) for n in names]))


def root_kind(text: Column) -> Column:
    """object, array or other, by the first character."""
    first = F.left(F.ltrim(text, F.lit(" \n\r\t")), F.lit(1))
    return F.when(first == "{", "object").when(first == "[", "array").when(text.isNotNull(), "other")


def root_kind_of(value: Column) -> Column:
    """object, array or other, of a variant."""
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(value.isNotNull(), "other")


def parse_root_kind(name: Column) -> Column:
    """The kind that a name stands for, in either case; null for any other name."""
    low = F.lower(name)
    return F.when(low.isin("object", "array", "other") & (F.octet_length(low) == F.octet_length(name)), low)
