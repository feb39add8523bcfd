"""Helpers that several of the text operators share."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sources.scratch import checkpoint, scratch, shared_dir

__all__ = ["attach", "body", "checkpoint", "draw", "running", "scratch", "shared_dir", "sized", "slice_sums", "table", "uniform"]

#: A side of a join is broadcast only after its rows, and the bytes of texts in them, were counted and found to be this few.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 64 << 20


#: Rows that Python workers get at once; texts may be long.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the session's batches to Python are held to ARROW_ROWS."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``size`` bytes of texts; else as it is, for a shuffled join.

    ``df`` should be thin, and cheap to compute or checkpointed, since its rows are counted.
    """
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(functools.reduce(Column.__add__, texts, F.lit(0)).cast("bigint")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


#: Over so many copies of an entry the rows of a hot key are spread.
SPREAD = 32


def attach(df: DataFrame, side: DataFrame, key: str, by: str) -> DataFrame:
    """``df`` with the columns of ``side``, which has one row at most for each ``key``; null without one.

    Few rows are broadcast.  Otherwise each row of ``side`` is copied, and the rows of ``df`` are dealt out
    among the copies by ``by``, so that a key which a third of all rows share doesn't meet in one task.
    """
    small = sized(side)
    if small is not side:
        return df.join(small, key, "left")
    copies = side.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return df.withColumn("_copy", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).join(copies, [key, "_copy"], "left").drop("_copy")


def body(text: Column | str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def draw(*key: Column | str) -> Column:
    """32 hexadecimal digits that follow from the key alone; null counts as the empty string.

    MD5 is used so that another engine can repeat the draw.
    """
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("")) for k in key]))


def uniform(hexed: Column) -> Column:
    """A double in (0, 1) from the first 13 hexadecimal digits, 52 bits."""
    return (F.conv(F.substring(hexed, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))


#: Into how many ranges of the drawn order each group is cut.
SLICES = 4096


def _group_key(group: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def _slice(hexed: str) -> Column:
    return F.floor(F.conv(F.substring(hexed, 1, 6), 16, 10).cast("bigint") * SLICES / (1 << 24)).cast("int")


def slice_sums(df: DataFrame, group: str, hexed: str, size: str) -> DataFrame:
    """(group, _g, _s, _sum): the sum of ``size`` for each group and range of ``hexed``, evenly spread hexadecimal digits."""
    return df.groupBy(group, _group_key(group).alias("_g"), _slice(hexed).alias("_s")).agg(F.sum(size).alias("_sum"))


def running(df: DataFrame, sums: DataFrame, group: str, order: list[str], hexed: str, size: str) -> DataFrame:
    """Adds ``_before``, the sum of ``size`` over the rows that come earlier in their group.

    Rows are ordered by ``hexed``, then by ``order``.  ``sums`` is what ``slice_sums`` says of the same
    rows.  As a group is cut into ranges, one that holds a third of all rows is still summed in many
    tasks; only the sums of ranges meet.  The cut doesn't change the result.  Rows equal in all of
    ``order`` may swap places.
    """
    base = F.sum("_sum").over(Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("_g", "_s", F.coalesce(base, F.lit(0)).alias("_base"))
    within = Window.partitionBy("_gk", "_sk").orderBy(hexed, *order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumns({"_gk": _group_key(group), "_sk": _slice(hexed)}).withColumn("_own", F.coalesce(F.sum(size).over(within), F.lit(0)))
    joined = own.join(sized(bases), (F.col("_gk") == F.col("_g")) & (F.col("_sk") == F.col("_s")))
    return joined.withColumn("_before", F.col("_own") + F.col("_base")).drop("_own", "_base", "_g", "_s", "_gk", "_sk")
