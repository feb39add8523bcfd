"""Decoding: repair, check, parse and type a column of JSON, with one error struct for whatever goes wrong.

No row raises.  Where a row fails, its value is null and its error says at which stage and why; errors
never hold text of the input.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import measure
from granary.functions.scan import scan_column, utf8_failure_column
from granary.functions.text import WHITE, escape_controls, free, let, unwrapped
from granary.policy import Limits, Policy

#: Only texts of more bytes can be beyond the built-in parser.
BEYOND = 1000
#: Kinds of errors, and the stages at which they come up.  Fixed names.
STAGES = {
    "budget": "admission",
    "input_too_large": "normalize",
    "empty_input": "normalize",
    "invalid_utf8": "decode_text",
    "invalid_json": "parse",
    "unexpected_top_level": "top_level_check",
    "deserialize": "deserialize",
}
_FIELDS = {"kind": "string", "stage": "string", "raw_bytes": "bigint", "normalized_bytes": "bigint", "maximum": "bigint", "offset": "bigint", "line": "bigint", "column": "bigint", "reason": "string", "expected": "string", "actual": "string", "resource": "string", "observed": "bigint", "requested": "bigint", "remaining": "bigint", "valid_up_to": "bigint", "error_len": "bigint", "message": "string"}
ERROR = "struct<" + ", ".join(f"{k}: {v}" for k, v in _FIELDS.items()) + ">"
#: A number outside of strings in valid JSON, after all that stands between it and the last one.
_NUMBERS = r'(?s)\G((?:[^"0-9-]++|"(?:[^"\\]|\\.)*+")*+)(-?[0-9][0-9.eE+-]*+)'
_MESSAGES = {
    "budget": "a limit is reached",
    "input_too_large": "the text is too long",
    "empty_input": "there is no text",
    "invalid_utf8": "the bytes are no UTF-8",
    "invalid_json": "the text is no JSON",
    "unexpected_top_level": "the root is of another kind",
    "deserialize": "the value doesn't fit the type",
}


def parse_error_kind(name: Column) -> Column:
    """The kind that a name stands for, in either case; null for any other name."""
    low = F.lower(name)
    return F.when(low.isin(*STAGES) & (F.octet_length(low) == F.octet_length(name)), low)


def stage_of(kind: Column) -> Column:
    """The stage at which errors of a kind come up."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair]), kind)


def _error(kind: str, detailed: bool = False, **known: Column) -> Column:
    message = F.lit(_MESSAGES[kind])
    if kind == "unexpected_top_level":
        message = F.concat(message, F.lit(": expected "), known["expected"], F.lit(", got "), known["actual"])
    if kind == "input_too_large":
        repaired = "normalized_bytes" in known
        size = known["normalized_bytes" if repaired else "raw_bytes"].cast("string")
        message = F.concat(message, F.lit(" once repaired: " if repaired else ": "), size, F.lit(" bytes of at most "), known["maximum"].cast("string"))
    if "resource" in known:
        message = F.concat(message, F.lit(": "), known["resource"])
    if "line" in known:
        message = F.concat(message, F.lit(" at line "), known["line"].cast("string"), F.lit(" column "), known["column"].cast("string"))
    if detailed and "reason" in known:
        message = F.concat(message, F.lit(": "), known["reason"])
    known |= {"kind": F.lit(kind), "stage": F.lit(STAGES[kind]), "message": message}
    return F.struct(*[(known[k] if k in known else F.lit(None)).cast(t).alias(k) for k, t in _FIELDS.items()])


def misfit(variant: Column, value: Column, kind: T.DataType, required: bool = False, lexemes: frozenset[str] = frozenset(), path: str = "") -> Column:
    """True if a parsed value doesn't hold what the JSON holds: wrong types, numbers out of range or rounded, missing required fields.

    Texts don't count as numbers nor numbers as texts, but for the texts at the paths ``lexemes``, which take
    numbers alone, as they are written.  Extra fields are no fault; binary floats hold the nearest number.
    """
    absent = variant.isNull() | F.is_variant_null(variant)
    if isinstance(kind, T.StructType):
        parts = [misfit(F.try_variant_get(variant, "$['" + f.name.replace("'", "\\'") + "']", "variant"), value[f.name], f.dataType, not f.nullable, lexemes, f"{path}.{f.name}".lstrip(".")) for f in kind.fields]
        wrong = value.isNull() | ~F.schema_of_variant(variant).startswith("OBJECT")
        for p in parts:
            wrong = wrong | p
    elif isinstance(kind, T.ArrayType):
        both = F.arrays_zip(F.try_variant_get(variant, "$", "array<variant>").alias("j"), value.alias("v"))
        wrong = value.isNull() | ~F.schema_of_variant(variant).startswith("ARRAY") | F.exists(both, lambda e: misfit(e["j"], e["v"], kind.elementType, not kind.containsNull, lexemes, f"{path}.*".lstrip(".")))
    else:
        json = F.schema_of_variant(variant)
        wrong = value.isNull() | (json == "STRING" if not isinstance(kind, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BinaryType)) else F.lit(False))
        if isinstance(kind, T.StringType):
            wrong = value.isNull() | (json.rlike("^(STRING|BOOLEAN|OBJECT|ARRAY)") if path in lexemes else json != "STRING")
        elif isinstance(kind, T.DecimalType):
            # A number with more places than the type has would be rounded.
            wrong = wrong | ~F.try_variant_get(variant, "$", "string").try_cast(f"decimal(38,{min(kind.scale + 12, 38)})").eqNullSafe(value.cast(f"decimal(38,{min(kind.scale + 12, 38)})"))
    return F.when(absent, F.lit(required)).otherwise(F.coalesce(wrong, F.lit(True)))


def _fitting(kind: T.DataType, required: bool = True) -> str | None:
    """A pattern of the schemas of parsed values that hold every value of a type, or none if a schema can't tell."""
    if isinstance(kind, T.StructType):
        # The schema of an array's elements doesn't tell whether each has a field.
        parts = [(f.name, _fitting(f.dataType, required)) for f in sorted(kind.fields, key=lambda f: f.name)]
        if any(p is None or not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", n) for n, p in parts) or not (required or all(f.nullable for f in kind.fields)):
            return None
        return "OBJECT<" + ", ".join(f"{n}: {p}" for n, p in parts) + ">"
    if isinstance(kind, T.ArrayType):
        inner = _fitting(kind.elementType, False)
        return inner and f"ARRAY<{inner}>"
    return {"bigint": "BIGINT", "string": "STRING", "boolean": "BOOLEAN", "double": r"(?:BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\))"}.get(kind.simpleString())


def _fields_of(kind: T.DataType, path: tuple = ()) -> list[tuple]:
    """Paths of the fields of all structs in a type, "*" standing for any element."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in [(*path, f.name), *_fields_of(f.dataType, (*path, f.name))]]
    return _fields_of(kind.elementType, (*path, "*")) if isinstance(kind, T.ArrayType) else []


def decode(df: DataFrame, column: str, *, schema: str | T.DataType | None = None, policy: Policy | None = None, root: str | None = None, limits: Limits = Limits(), exact: bool = True, unique: bool = False, lexemes: tuple[str, ...] = (), value: str = "value", error: str = "error", scan: str | None = None) -> DataFrame:
    """``df`` with the decoded ``value`` and the ``error`` of a column of texts or bytes.

    ``schema`` (DDL or type) types the value; without it, it is a variant.  ``root`` asks for an object or
    array, which is told only of whole valid JSON.  ``policy`` repairs the text first; ``Policy.strict()``
    repairs nothing.  ``unique`` makes a repeated key at any depth an error.  ``lexemes`` names fields of
    type string of the root struct that take a number of any length as it is written.

    Texts are first parsed by built-in functions.  ``exact`` asks the scanner about those that failed, may
    break a limit or repeat a key; it knows places and reasons, and that a repeated field of a struct is an
    error.  Without it an error has no place and repeated fields pass, the last one counting.  A valid text
    on which the parser gives up (see ``functions.measure``) is an error of kind ``deserialize`` that names
    ``parser`` as the resource; without ``exact`` it can't be told from a broken one if it is long, and is
    one of kind ``budget``.  ``scan`` names a column for the scanner's report, then made for every row.

    Null input gives a null value and no error.  Errors come in the order of the stages: size, UTF-8,
    empty, repaired size, syntax or limits (whichever comes first in the text), root, repeated key, type.
    Other columns stay, whatever their names; columns called like ``value`` and ``error`` are replaced.
    """
    spark = df.sparkSession
    measure.require(spark)
    policy = policy or Policy.lenient()
    if lexemes and not isinstance(schema if isinstance(schema, T.DataType) else T._parse_datatype_string(schema or "null"), T.StructType):
        raise ValueError("lexemes are fields of a struct")
    if (limits.of_values or unique) and not exact:
        raise ValueError("limits on values and unique keys need exact=True")
    binary = isinstance(df.schema[column].dataType, T.BinaryType)
    first_, made_, scan_, out_, utf8_ = free(df.columns, "_first", "_made", "_scan", "_out", "_utf8")
    raw = F.col(f"`{column}`")
    text = raw.cast("string") if binary else raw
    size = F.octet_length(raw).cast("bigint")
    sound = F.is_valid_utf8(text) if binary else F.lit(True)
    fits = size <= limits.input_bytes if limits.input_bytes is not None else F.lit(True)
    strict = policy == Policy.strict().but(detailed=policy.detailed)
    if binary and exact:
        df = df.withColumn(utf8_, utf8_failure_column(F.when(fits & ~sound, raw)))

    def early(t: Column, norm: Column) -> Column:
        """The first thing wrong before parsing."""
        blank = (F.octet_length(F.trim(t, F.lit(WHITE))) == 0) if policy.trim else (size == 0)
        after = F.octet_length(norm).cast("bigint")
        checks = []
        if limits.input_bytes is not None:
            checks.append((~fits, _error("input_too_large", raw_bytes=size, maximum=F.lit(limits.input_bytes))))
        if binary:
            place = {k: F.col(utf8_)[k] for k in ("valid_up_to", "error_len")} if exact else {}
            checks.append((~sound, _error("invalid_utf8", raw_bytes=size, **place)))
        if not strict:
            checks.append((blank, _error("empty_input", raw_bytes=size)))
        if limits.normalized_bytes is not None:
            checks.append((after > limits.normalized_bytes, _error("input_too_large", raw_bytes=size, normalized_bytes=after, maximum=F.lit(limits.normalized_bytes))))
        if not strict:
            checks.append((after == 0, _error("empty_input", raw_bytes=size, normalized_bytes=after)))
        out = F.lit(None).cast(ERROR)
        for condition, problem in reversed(checks):
            out = F.when(condition, problem).otherwise(out)
        return out

    repaired = lambda t: let(unwrapped(t, policy), escape_controls) if policy.escape_controls else unwrapped(t, policy)
    typed = None if schema is None else schema if isinstance(schema, T.DataType) else T._parse_datatype_string(schema)
    declared = frozenset(_fields_of(typed)) if typed is not None else frozenset()
    first = lambda t: let(F.when(fits & sound, repaired(t)), lambda n: F.struct(n.alias("norm"), early(t, n).alias("early")))

    def typed_value(t: Column) -> Column:
        if typed is None:
            return F.try_parse_json(t)
        value_ = F.from_json(t, typed)
        if lexemes:
            # Numbers as texts, for the fields that take them as written; others from the text as it is.
            written = F.from_json(F.regexp_replace(t, _NUMBERS, '$1"$2"'), T.StructType([f for f in typed.fields if f.name in lexemes]))
            value_ = let(value_, lambda v: let(written, lambda w: F.when(v.isNotNull(), F.struct(*[(w if f.name in lexemes else v)[f.name].alias(f.name) for f in typed.fields]))))
        return value_

    def fault(t: Column, j: Column) -> Column:
        if typed is None:
            return F.lit(False)
        each, pattern = let(typed_value(t), lambda v: misfit(j, v, typed, True, frozenset(lexemes))), None if lexemes else _fitting(typed)
        # Where the schema of the whole value fits, no part of it needs to be looked at.
        return F.when(j.isNotNull(), each if pattern is None else ~F.schema_of_variant(j).rlike(f"^{pattern}$") & each)

    def made(t: Column, j: Column) -> Column:
        """What the parser makes of a text, and whether the scanner must see it."""
        doubt = j.isNull() | (measure.may_break(t, limits) if limits.of_values else F.lit(False))
        if unique or declared:
            doubt = doubt | measure.repeats(t, j)
        return F.struct(j.isNotNull().alias("parsed"), measure.root_kind(t).alias("root"), fault(t, j).alias("wrong"), F.coalesce(doubt, F.lit(True)).alias("doubt"))

    def sizes_of(norm: Column) -> dict[str, Column]:
        return {"raw_bytes": size, "normalized_bytes": F.octet_length(norm).cast("bigint")}

    def outcome(early_: Column, norm: Column, valid: Column, m: Column, syntax: Column, repeated: Column, again: dict[str, Column]) -> Column:
        """Of errors, that of the earliest stage."""
        sizes, late = sizes_of(norm), syntax
        if root is not None:
            late = late.when(valid & (m["root"] != root), _error("unexpected_top_level", **sizes, expected=F.lit(root), actual=m["root"]))
        if unique:
            late = late.when(valid & repeated, _error("deserialize", **sizes, reason=F.lit("duplicate_key"), **again))
        late = late.when(valid & ~m["parsed"], _error("deserialize", **sizes, resource=F.lit("parser")))
        if typed is not None:
            late = late.when(valid & (m["wrong"] | repeated), _error("deserialize", **sizes))
        return F.when(raw.isNotNull(), F.coalesce(early_, late))

    if exact:
        df = df.withColumn(first_, let(text, first))
        f = F.col(first_)
        df = df.withColumn(made_, let(F.when(f["early"].isNull(), f["norm"]), lambda t: let(measure.parsed(t), lambda j: made(t, j))))
        m = F.col(made_)
        asked = F.lit(True) if scan else m["doubt"]
        df = df.withColumn(scan_, scan_column(F.when(f["early"].isNull() & asked, f["norm"]), limits, 0, declared))
        s, sizes = F.col(scan_), sizes_of(f["norm"])
        valid = f["early"].isNull() & F.coalesce(s["valid"], m["parsed"], F.lit(False))
        syntax = F.when(s["reason"].isNotNull(), _error("invalid_json", policy.detailed, **sizes, **{k: s[k] for k in ("offset", "line", "column", "reason")}))
        syntax = syntax.when(s["resource"].isNotNull(), _error("budget", **sizes, **{k: s[k] for k in ("resource", "observed", "maximum", "requested", "remaining")}))
        repeated = F.coalesce(s["duplicate" if unique else "field_duplicate"], F.lit(False))
        problem = outcome(f["early"], f["norm"], valid, m, syntax, repeated, {k: s[f"duplicate_{k}"] for k in ("offset", "line", "column")})
        df = df.withColumn(out_, F.struct(f["norm"].alias("norm"), problem.alias("error")))
    else:

        def whole(f: Column) -> Column:
            def with_made(m: Column) -> Column:
                sizes = sizes_of(f["norm"])
                failed = f["early"].isNull() & ~m["parsed"]
                # A text this long may be valid and only beyond the parser.
                syntax = F.when(failed & (F.octet_length(f["norm"]) > BEYOND), _error("budget", **sizes, resource=F.lit("parser"))).when(failed, _error("invalid_json", **sizes))
                return F.struct(f["norm"].alias("norm"), outcome(f["early"], f["norm"], m["parsed"], m, syntax, F.lit(False), {}).alias("error"))

            return let(F.when(f["early"].isNull(), f["norm"]), lambda t: let(measure.parsed(t), lambda j: let(made(t, j), with_made)))

        # All in one expression that names its input once, so that a filter which Spark moves through it stays small.
        df = df.withColumn(out_, let(text, lambda t: let(first(t), whole)))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (first_, made_, scan_, out_, utf8_, value, error, scan)]
    # The value is made last and on its own: passed through inner expressions, it would be copied by each.
    got = F.when(F.col(out_)["error"].isNull(), typed_value(F.col(out_)["norm"]))
    return df.select(*kept, got.alias(value), F.col(out_)["error"].alias(error), *([F.col(scan_).alias(scan)] if scan and exact else []))


def decode_strict(df: DataFrame, column: str, schema: str | None = None, **options) -> DataFrame:
    """Decoding without any repair."""
    return decode(df, column, schema=schema, policy=Policy.strict(), **options)


def decode_object(df: DataFrame, column: str, schema: str | None = None, **options) -> DataFrame:
    """Decoding of texts whose root must be an object."""
    return decode(df, column, schema=schema, root="object", **options)


def decode_array(df: DataFrame, column: str, element: str | None = None, **options) -> DataFrame:
    """Decoding of texts whose root must be an array of ``element`` (DDL)."""
    return decode(df, column, schema=f"array<{element}>" if element else None, root="array", **options)


def decode_with(df: DataFrame, column: str, seed, **options) -> DataFrame:
    """Decoding to whatever ``seed`` makes of the variant: a function from Column to Column."""
    out = options.pop("value", "value")
    return decode(df, column, value=out, **options).withColumn(out, seed(F.col(out)))


def validate(df: DataFrame, column: str, *, exact: bool = False, limits: Limits = Limits(), out: str = "valid") -> DataFrame:
    """``df`` with true or false for each text or bytes value, null for null; no value is built.

    Texts are parsed by built-in functions.  The scanner is asked about texts that fail and are long enough
    to be beyond the parser, and about those that may break one of ``limits``; with ``exact``, about every
    text that fails.
    """
    measure.require(df.sparkSession)
    raw = F.col(f"`{column}`")
    binary = isinstance(df.schema[column].dataType, T.BinaryType)
    text = raw.cast("string") if binary else raw
    ok_, scan_ = free(df.columns, "_ok", "_scan")
    good = measure.is_valid(text)
    df = df.withColumn(ok_, F.coalesce(F.when(F.is_valid_utf8(text), good) if binary else good, F.lit(False)))
    asked = ~F.col(ok_) if exact else ~F.col(ok_) & (F.octet_length(raw) > BEYOND)
    if limits.of_values:
        asked = asked | measure.may_break(text, limits)
    df = df.withColumn(scan_, scan_column(F.when(asked, raw), limits))
    answer = F.when(raw.isNotNull(), F.coalesce(F.col(scan_)["valid"], F.col(ok_)))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (ok_, scan_, out)], answer.alias(out))


def strict_value(column: str) -> Column:
    """A variant, or null where the text is no JSON or repeats a key at any depth; ``decode_unique`` says why and where."""
    text = F.col(f"`{column}`")
    return let(measure.parsed(text), lambda j: F.when(~measure.repeats(text, j), j))


def decode_unique(df: DataFrame, column: str, **options) -> DataFrame:
    """Strict decoding where a repeated key at any depth is an error, with the place of the key."""
    return decode(df, column, policy=Policy.strict(), unique=True, **options)
