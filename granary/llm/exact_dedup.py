"""Exact deduplication as a stream with state on disk.

The documents' files are a stream.  Its state, kept by RocksDB on the executors' disks and saved in the
shared folder, has one entry for each digest of a normalised text and never expires: the smallest id,
where that document stands (file and row), and how many there were.  Equal digests are hits; their full
texts are compared before any row is dropped.  A later run with the same state folder goes on from there
and reads new files only.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import body, checkpoint, scratch, sized

#: State on disk; without space set aside ahead, which would be megabytes for each of many small partitions.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str = "text") -> Column:
    """The text, null as empty, with each run of ``[\\x20\\x09-\\x0D]`` as one space."""
    return F.regexp_replace(body(text), "[\\x20\\x09-\\x0D]+", " ")


def _located(df: DataFrame) -> DataFrame:
    """(doc_id, norm, digest, loc); loc orders the rows of a digest: smallest id first, null last, then by place."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    df = df.select("doc_id", normalised().alias("norm"), F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), *place).alias("loc"))
    return df.withColumn("digest", F.sha2(F.col("norm"), 256))


#: Files in a micro-batch: what is read again if a run is broken off.
FILES_A_BATCH = 10_000


def _escaped(path: str) -> str:
    """A path as a pattern that fits it alone."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _pattern(path: str) -> str:
    """The same, with one letter as a choice of itself: as a pattern, a path may name a single file to a stream too."""
    return re.sub(r"([A-Za-z0-9])([^A-Za-z0-9]*)$", r"[\1]\2", _escaped(path.rstrip("/")))


def update_state(spark: SparkSession, path: str, state_dir: str) -> None:
    """Takes the Parquet files at ``path`` that are new since the last call into the state.

    ``path`` is a file or a folder.  Each micro-batch is aggregated where it is read, so that a digest
    that many rows share sends one row from each task.
    """
    old = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        # No file is too old to count.
        files = spark.readStream.schema(spark.read.parquet(_pattern(path)).schema).option("maxFilesPerTrigger", FILES_A_BATCH).option("maxFileAge", "100000d")
        stream = files.parquet(_pattern(path))
        counted = _located(stream).groupBy("digest").agg(F.min("loc").alias("loc"), F.count(F.lit(1)).alias("n"))
        query = counted.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state(spark: SparkSession, state_dir: str) -> DataFrame:
    """(digest, loc, n) of every digest seen so far."""
    return spark.read.format("statestore").load(state_dir).select("key.digest", F.col("value.min").alias("loc"), F.col("value.count").alias("n"))


def exact_dedup(spark: SparkSession, path: str, state_dir: str | None = None) -> DataFrame:
    """One row per row at ``path``: doc_id, keep_id, group_size, kept, text_sha256, keep_file, keep_row.

    Texts are equal when identical after each run of white space is replaced by one space; null counts
    as empty.  Of equal texts the smallest id stays, null ids last; of repeated rows with that id the
    first by file and place.  ``keep_id`` is null only where no id of the group is known.  Columns other
    than doc_id and text are ignored; an empty table gives an empty one.

    Which row stays and how large a group is come from the state, so that documents of earlier runs with
    the same ``state_dir`` count too.  Hits are verified against the full text of the document that stays,
    which is read again by its locator if it stands in a file of an earlier run.  Should two texts at
    ``path`` ever share a digest, each is a group of its own there.
    """
    known = state_dir is not None
    state_dir = state_dir or scratch(spark, "dedup-state")
    update_state(spark, path, state_dir)
    hits = checkpoint(state(spark, state_dir).filter("n > 1").withColumnsRenamed({"loc": "keep", "n": "size"}))
    docs = _located(spark.read.parquet(_pattern(path)))
    repeated = docs.join(sized(hits.select("digest")), "digest", "left_semi")
    sources = repeated.select("digest", "norm")
    if known:
        sources = sources.unionByName(_elsewhere(spark, docs, hits))
    # Full bytes are compared by grouping, which sends each different text once from a task.
    clash = sources.distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").limit(1).count() > 0
    key = ["digest", "second"] if clash else ["digest"]
    if clash:
        hits = checkpoint(repeated.groupBy("digest", "norm").agg(F.min("loc").alias("keep"), F.count(F.lit(1)).alias("size")).select("digest", F.md5("norm").alias("second"), "keep", "size"))
    thin = docs.select("doc_id", "loc", "digest", *([F.md5("norm").alias("second")] if clash else []))
    joined = thin.join(sized(hits), key, "left")
    mine, keep = F.col("loc"), F.coalesce("keep", "loc")
    return joined.select(
        "doc_id",
        keep["doc_id"].alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (keep == mine).alias("kept"),
        F.col("digest").alias("text_sha256"),
        keep["file"].alias("keep_file"),
        keep["row"].alias("keep_row"),
    )


def _elsewhere(spark: SparkSession, docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(digest, norm) of the documents that stay and stand in files of earlier runs."""
    files = docs.select(F.col("loc.file").alias("_file")).distinct()
    away = checkpoint(hits.join(files, F.col("keep.file") == F.col("_file"), "left_anti").select("digest", F.col("keep").alias("loc")))
    # Names of files, not of rows.
    named = [_escaped(unquote(r[0])) for r in away.select("loc.file").distinct().collect()]
    if not named:
        return docs.select("digest", "norm").limit(0)
    return _located(spark.read.parquet(*named)).join(sized(away), ["digest", "loc"], "left_semi").select("digest", "norm")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").drop("keep_file", "keep_row")


ORACLE_SQL = {
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
}

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
