"""Encoding of columns as compact JSON, as Column expressions made from the columns' types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import measure
from granary.functions.text import escape_each, free, let
from granary.operators.decode import ERROR
from granary.policy import Limits


def quoted(text: Column) -> Column:
    """A JSON string; control characters as escapes in lower case."""
    marked = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    safe = F.when(text.rlike("[\\x00-\\x1f]"), escape_each(marked)).otherwise(marked)
    return F.concat(F.lit('"'), F.when(text.rlike('["\\\\\\x00-\\x1f]'), safe).otherwise(text), F.lit('"'))


def float_text(x: Column) -> Column:
    """A finite number in decimals from 1e-5 to below 1e16, else as 1.5e-7 or 1e16; null for anything not finite.

    Digits are those that the JVM prints.
    """

    def parts(t: Column) -> Column:
        sign = F.when(F.startswith(t, F.lit("-")), "-").otherwise("")
        whole = F.regexp_extract(t, r"^-?([0-9]+)\.", 1)
        rest = F.regexp_replace(F.regexp_extract(t, r"\.([0-9]+)", 1), "^0$", "")
        power = F.regexp_extract(t, r"E(-?[0-9]+)$", 1).cast("int")
        long = F.when(F.length(rest) <= power, F.concat(whole, F.rpad(rest, power, F.lit("0")), F.lit(".0"))).otherwise(F.concat(whole, F.left(rest, power), F.lit("."), F.substring(rest, power + 1, F.length(rest))))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), whole, rest)
        scientific = F.concat(whole, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), power.cast("string"))
        shown = F.when(power.between(0, 15), long).when(power.between(-5, -1), small).otherwise(scientific)
        return F.when(F.contains(t, F.lit("E")), F.concat(sign, shown)).otherwise(t)

    # Named once: the JVM prints a number slowly.
    return let(x.cast("string"), lambda t: F.when(t.rlike("[0-9]"), parts(t)))


def byte_array(x: Column) -> Column:
    """Bytes as an array of numbers."""
    digits = F.hex(x)
    numbers = F.transform(F.sequence(F.lit(1), F.octet_length(x)), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10))
    return F.when(F.octet_length(x) == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(numbers, ","), F.lit("]")))


def _key(x: Column, kind: T.DataType) -> Column:
    """A map's key; numbers and truth values as their text."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return quoted(float_text(x))
    return quoted(x.cast("string"))


def encode(x: Column, kind: T.DataType, raw: frozenset[str] = frozenset()) -> Column:
    """The JSON of a column of the given type.

    Nulls are written, also as fields; numbers that are not finite are null; bytes are arrays of numbers;
    decimals, dates and times are written as Spark prints them, the latter two as texts.  Fields named in
    ``raw`` are JSON already and are put in as they are.
    """
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        out = float_text(x)
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        out = x.cast("string")
    elif isinstance(kind, T.StringType):
        out = quoted(x)
    elif isinstance(kind, T.BinaryType):
        out = byte_array(x)
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: encode(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(x), lambda e: F.concat(_key(e["key"], kind.keyType), F.lit(":"), encode(e["value"], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts: list[Column] = [F.lit("{")]
        for n, f in enumerate(kind.fields):
            inner = F.coalesce(x[f.name], F.lit("null")) if f.name in raw else encode(x[f.name], f.dataType)
            parts += [F.concat(F.lit("," if n else ""), quoted(F.lit(f.name)), F.lit(":")), inner]
        out = F.concat(*parts, F.lit("}"))
        return F.when(x.isNull(), "null").otherwise(out)
    elif isinstance(kind, T.VariantType):
        out = F.to_json(x)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        out = quoted(x.cast("string"))
    return F.coalesce(out, F.lit("null"))


def tagged(tag: str, body: Column | None = None) -> Column:
    """A variant of an enumeration: its name alone, or an object with its name and encoded content."""
    name = quoted(F.lit(tag))
    return name if body is None else F.concat(F.lit("{"), name, F.lit(":"), body, F.lit("}"))


def encode_rows(df: DataFrame, columns: list[str] | None = None, *, raw: list[str] | None = None, limits: Limits = Limits(), out: str = "json", error: str = "error") -> DataFrame:
    """``df`` with each row as a JSON object of ``columns`` (all by default), and an error where that fails.

    ``raw`` columns hold JSON, which is checked and put in as it is.  Limits are those on output bytes,
    depth, nodes and sizes of the finished text; a broken limit comes before a bad fragment, and either
    leaves ``out`` null.
    """
    measure.require(df.sparkSession)
    columns, raw = list(columns or df.columns), list(raw or [])
    col = lambda c: F.col(f"`{c}`")
    row = F.struct(*[col(c).alias(c) for c in columns])
    kind = T.StructType([df.schema[c] for c in columns])
    json_, problem_ = free(df.columns, "_json", "_problem")
    df = df.withColumn(json_, encode(row, kind, frozenset(raw)))
    j = F.col(json_)
    sizes = {"depth": measure.depth, "nodes": measure.nodes, "payload_bytes": measure.payload_bytes, "key_bytes": measure.max_key_bytes, "string_bytes": measure.max_string_bytes, "number_bytes": measure.max_number_bytes, "output_bytes": F.octet_length}
    problem = F.lit(None).cast(ERROR)
    broken = lambda kind, **known: F.from_json(F.to_json(F.struct(F.lit(kind).alias("kind"), *[v.alias(k) for k, v in known.items()])), ERROR)
    if raw:
        bad = F.lit(False)
        for c in raw:
            bad = bad | (col(c).isNotNull() & ~measure.is_valid(col(c)))
        problem = F.when(bad, broken("invalid_raw_json", stage=F.lit("encode"), message=F.lit("a raw fragment is no JSON"))).otherwise(problem)
    for name, most in reversed(list(limits.set.items())):
        if name in sizes:
            got = sizes[name](j).cast("bigint")
            problem = F.when(got > most, broken("budget", stage=F.lit("encode"), message=F.lit(f"a limit is reached: {name}"), resource=F.lit(name), observed=got, maximum=F.lit(most))).otherwise(problem)
        else:
            raise ValueError(f"no limit on {name} when encoding")
    df = df.withColumn(problem_, problem)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (json_, problem_, out, error)]
    return df.select(*kept, F.when(F.col(problem_).isNull(), j).alias(out), F.col(problem_).alias(error))
