"""Mixing sources to target weights along a curriculum.

Each source has a weight that changes over the training time from 0 to 1.  Its integral over the whole
time is the source's share; its integral up to a time is how much of the share is wanted by then.
A source's words stand in one line, its documents in a drawn order, repeated as often as its target
asks for; inverting the cumulative demand turns a place in that line into a training time.  Sorting
by that time, over ranges, gives the order of training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import body, checkpoint, draw, running, sized, slice_sums, table

#: Shares of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: How a weight moves over the training: from (1 - slope) to (1 + slope) of its mean; repeating.
SLOPES = (-0.5, 0.0, 0.5)
#: No source is taken more than so many times.
MOST = 3


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def targets(sources: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = MOST) -> DataFrame:
    """For (source, source_size), one row a source: adds ``weight``, ``slope`` and ``target``.

    Sources stand by name, null last, and take weights and slopes in turn.  All sizes together are
    shared by weight; a source that would get over ``most`` times its size gets that, and what it
    leaves is shared again.  The level at which every source gets the smaller of its cap and
    level x weight is found by one pass over the sources in the order of cap / weight, so that no
    loop is needed.  There is a row for each source, not for each document, in the one task that
    this takes.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (i % len(xs) + 1).cast("int"))
    df = sources.withColumn("_rank", F.row_number().over(order) - 1)
    df = df.withColumn("weight", pick(weights, F.col("_rank"))).withColumn("slope", pick(slopes, F.col("_rank"))).withColumn("_cap", F.col("source_size") * most)
    filled = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(filled), F.lit(0))
    load = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    df = df.withColumn("_level", left / load)
    # The first source, in that order, whose cap isn't reached at its level sets the level for all.
    df = df.withColumn("_open", F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level")))
    df = df.withColumn("_final", F.min_by("_open", F.when(F.col("_open").isNotNull(), F.struct(F.col("_cap") / F.col("weight"), F.col("_rank")))).over(whole))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_final") * F.col("weight"), F.col("_cap").cast("double")))
    return df.withColumn("target", target).select("source", "source_size", "weight", "slope", "target")


def training_time(part: Column, slope: Column) -> Column:
    """The time at which ``part`` (0 to 1) of a source's words have been asked for.

    A weight that runs straight from 1 - slope to 1 + slope has asked for (1 - slope) t + slope t^2 at
    time t; this is the inverse, in a form that holds for a slope of 0 too.
    """
    low = 1 - slope
    return 2 * part / (low + F.sqrt(F.greatest(low * low + 4 * slope * part, F.lit(0.0))))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, positions.

    ``size`` counts words, null texts have none.  ``taken`` is how many of the words the mix takes,
    repeats counted: the source's line is cut at its target, so the sum over a source is the target
    rounded down, every document is taken as often as its source is repeated in full, and at most one
    document of a source is taken in part.  ``positions`` are the training times, from 0 to 1, of the
    copies' middles, one for each copy.  Documents of size 0 and those beyond the target are not taken
    and have no positions.

    The order within a source is drawn from the id, or from the text where there is none, so reruns agree.
    Repeated rows are documents of their own; where rows share an id and a size too, they may swap
    places.  Columns other than doc_id, source, text and those in ``carry`` are ignored.
    """
    rows = docs.select("doc_id", "source", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], n_words(body()).alias("size"), F.when(F.col("doc_id").isNotNull(), draw("doc_id")).otherwise(F.md5(body())).alias("_draw"))
    # Thin rows are kept, and texts so read once; rows that carry more are read again.
    rows = rows if carry else checkpoint(rows)
    sums = checkpoint(slice_sums(rows, "source", "_draw", "size"))
    sources = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    goal = targets(sources, weights=weights, slopes=slopes, most=most).withColumnRenamed("source", "_source")
    placed = running(rows, sums, "source", ["doc_id", "size"], "_draw", "size")
    df = placed.join(sized(checkpoint(goal)), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    budget = F.floor("target")
    df = df.withColumn("_rounds", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    rest = budget - F.col("_rounds") * F.col("source_size")
    df = df.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before"))).cast("bigint"))
    df = df.withColumn("taken", F.col("_rounds") * F.col("size") + F.col("_part"))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("_rounds") + F.when(F.col("_part") > 0, 1).otherwise(0)).cast("int")
    middle = lambda e: e * F.col("source_size") + F.col("_before") + F.when(e < F.col("_rounds"), F.col("size")).otherwise(F.col("_part")) / 2
    place = lambda e: training_time(F.least(middle(e) / F.greatest(budget, F.lit(1)), F.lit(1.0)), F.col("slope"))
    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), place)).otherwise(F.array().cast("array<double>"))
    return df.select("doc_id", "source", *[f"_c{i}" for i in range(len(carry))], "size", "source_size", "target", "taken", positions.alias("positions"), "_draw")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The copies that the mix takes, as rows with the columns of ``docs``, in the order of training.

    A document comes once for each of its positions; the one document of a source that is taken in part
    comes whole.
    """
    mixed = mix(docs.select("doc_id", "source", "text", F.struct("*").alias("_row")), carry=("_row",), **options)
    copies = mixed.select("_c0", F.explode("positions").alias("_position"), "_draw")
    # By ranges of the position; the draw breaks ties.
    return copies.orderBy("_position", "_draw").select("_c0.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0))
    thin = mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), F.size("positions").alias("copies"), "_draw")
    ordered = thin.orderBy(F.col("first_position").asc_nulls_last(), "_draw").drop("_draw")
    # Documents that the mix doesn't take stand last, with -1.
    return ordered.withColumn("first_position", F.coalesce("first_position", F.lit(-1.0)))


ORACLE_SQL = {
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS draw
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CASE r % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope, source_size * 3 AS cap
  FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
f AS (SELECT level AS final FROM l WHERE level * weight <= cap ORDER BY ratio, r LIMIT 1),
t AS (
  SELECT source, source_size, slope, least(CAST(cap AS DOUBLE), coalesce((SELECT final FROM f) * weight, CAST(cap AS DOUBLE))) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, CAST(floor(t.target) AS BIGINT) AS budget,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS rounds,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, budget - rounds * source_size - before)) AS part FROM p),
m AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE rounds + CASE WHEN part > 0 THEN 1 ELSE 0 END END AS copies,
    least((before + CASE WHEN rounds > 0 THEN size ELSE part END / 2.0::DOUBLE) / greatest(budget, 1), 1.0::DOUBLE) AS mid
  FROM q)
SELECT doc_id, size, source_size, target, CAST(rounds * size + part AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
  CASE WHEN copies > 0 THEN 2 * mid / ((1 - slope) + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * mid, 0))) ELSE -1 END AS first_position
FROM m
"""
}

QUERIES = {"op1_mixing": op1_mixing}
