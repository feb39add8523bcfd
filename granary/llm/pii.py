"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans; checksums (Luhn for cards, mod 97 for IBANs) and value rules
confirm them; words nearby raise a span's score.  Everything runs inside the JVM and without a
shuffle: each text is searched where it was read.

Spark can extract matches but doesn't say where they stand.  Splitting a text by the same pattern
gives the gaps between the matches, and the lengths of gaps and matches give the positions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import body, table

#: How many characters on either side of a span are searched for context words.
NEARBY = 40
#: Lengths are summed in runs of so many, which keeps the work far below the square of the matches.
_RUN = 256


def _luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn test."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _mod_97(iban: Column) -> Column:
    """True if an IBAN without spaces leaves 1 when divided by 97, letters counting from A = 10."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        v = F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int")
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``hint`` is a text without which no match is possible, or none.  A span is kept if ``confirm``
    holds and its score, ``score`` or ``score + raised`` beside a context word, reaches ``least``.
    """

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    context: str
    score: float
    raised: float
    least: float = 0.0
    hint: str = ""


# Runs are taken whole (possessive), so that no match needs deep recursion, and may begin only where a
# run begins or the last match ended (\G), so that a long run is not searched again from its middle.
_LOCAL, _PART = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The first four are the base kinds; their order is the order of the digest.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_PART}++(?:\.{_PART}++)++", lambda m: F.lit(True), r"(?i)e-?mail|contact|write|courriel|correo|kontakt", 0.85, 0.1, hint="@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), r"(?i)\bip\b|address|host|server|login", 0.6, 0.2, hint="."),
    # Only whole runs of digits, as a separator may stand between any two: no digit before, none after.
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])", lambda m: _luhn(_digits(m)), r"(?i)card|visa|master|amex|payment|carte|tarjeta|karte", 0.8, 0.15),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(8, 15), r"(?i)phone|tel|call|mobile|fax|llama|appel|anruf", 0.6, 0.3, hint="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", lambda m: _mod_97(F.regexp_replace(m, " ", "")), r"(?i)iban|bank|account|konto|compte|cuenta", 0.8, 0.15),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), r"(?i)\bssn\b|social security", 0.3, 0.5, least=0.5),
)
BASE = ("email", "ip", "card", "phone")


def _found(df: DataFrame, kind: Kind) -> DataFrame:
    """``df`` with column ``_<kind>``: an array of (kind, start, end, value, score)."""
    out, text = f"_{kind.name}", F.col("_text")
    hits, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    if kind.hint:
        near = F.contains(text, F.lit(kind.hint))
        hits, gaps = F.when(near, hits).otherwise(F.array().cast("array<string>")), F.when(near, gaps).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_hits", hits)
    df = df.withColumn("_gaps", F.when(F.size("_hits") > 0, gaps).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_lens", F.transform("_hits", lambda m, i: F.length(m) + F.length(F.get("_gaps", i))))
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_lens") / _RUN).cast("int")), lambda r: F.aggregate(F.slice("_lens", r * _RUN + 1, F.lit(_RUN)), F.lit(0), lambda a, x: a + x))
    df = df.withColumn("_runs", F.when(F.size("_hits") > 0, runs))

    def span(m: Column, i: Column) -> Column:
        whole = F.floor(i / _RUN).cast("int")
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
        start = (total(F.slice("_runs", F.lit(1), whole)) + total(F.slice("_lens", whole * _RUN + 1, i % _RUN)) + F.length(F.get("_gaps", i))).cast("bigint")
        around = F.concat(F.right(F.get("_gaps", i), F.lit(NEARBY)), F.lit("\n"), F.left(F.get("_gaps", i + 1), F.lit(NEARBY)))
        score = F.lit(kind.score) + F.when(around.rlike(kind.context), F.lit(kind.raised)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), F.round(score, 3).alias("score"))

    spans = F.filter(F.transform("_hits", span), lambda s: kind.confirm(s["value"]) & (s["score"] >= kind.least))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>")
    return df.withColumn(out, F.when(F.size("_hits") > 0, spans).otherwise(empty)).drop("_hits", "_gaps", "_lens", "_runs")


def find_pii(docs: DataFrame, *, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end, value, score).

    Spans stand in the order of ``kinds``, then of their starts, counted in code points; ends are
    exclusive.  Spans of one kind don't overlap, those of different kinds may.  A null or empty text
    has no spans; repeated rows and null ids stay as they are; columns other than doc_id and text are
    ignored; an empty table gives an empty one.  A text of any length is searched whole.
    """
    df = docs.select("doc_id", body().alias("_text"))
    for kind in kinds:
        df = _found(df, kind)
    return df.select("doc_id", F.concat(*[F.col(f"_{k.name}") for k in kinds]).alias("spans"))


def mask_pii(docs: DataFrame, *, least: float = 0.5) -> DataFrame:
    """``docs`` with every found span of at least that score replaced in the text by its kind in brackets.

    Texts are cut by the spans' positions, so that nothing else changes.  Of spans that overlap, the one that
    begins first, then the longer one, names what is replaced; what others reach beyond it goes too.  Null
    texts stay null.
    """
    found = docs.select("doc_id", body().alias("_text"), F.struct("*").alias("_row"))
    for kind in KINDS:
        found = _found(found, kind)
    spans = F.concat(*[F.col(f"_{k.name}") for k in KINDS])
    ordered = F.array_sort(F.transform(F.filter(spans, lambda s: s["score"] >= least), lambda s: F.struct(s["start"].cast("int").alias("start"), (-s["end"]).cast("int").alias("back"), s["kind"].alias("kind"))))
    found = found.withColumn("_cuts", ordered)

    def cut(done: Column, s: Column) -> Column:
        end, at, parts = -s["back"], done["at"], done["parts"]
        before = F.substring(F.col("_text"), at + 1, s["start"] - at)
        longer = F.when(s["start"] >= at, F.concat(parts, F.array(before, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(parts)
        return F.struct(F.greatest(at, end).alias("at"), longer.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    hidden = F.aggregate("_cuts", start, cut, lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(F.col("_text"), done["at"] + 1, F.length("_text"))))
    out = found.withColumn("_hidden", F.when(F.col("_row.text").isNotNull(), F.when(F.size("_cuts") > 0, hidden).otherwise(F.col("_text"))))
    return out.select(*[F.col("_hidden").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), best.alias("top_score"))


QUERIES = {"op4_pii": op4_pii}
