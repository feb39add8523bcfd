"""Sharding by a weighted hash tree: region, then rack, then shard.

At each node every child draws an exponential clock from a hash of the document's key and the child's
name, divided by the child's weight; the smallest clock wins.  Raising a child's weight only speeds up
its own clock, so rows move only into that child, and other subtrees keep their own rows.  A shard that
is added later comes as a region with one rack of its own, so that rows move only into it; one that is put
in a rack would also draw rows into its siblings, as its rack and region get heavier.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import body, checkpoint, draw, running, sized, slice_sums, table, uniform


@dataclass(frozen=True)
class Tree:
    """Weights of the shards by region and rack, numbered in that order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, numbered last, in a region and rack of its own."""
        return Tree((*self.regions, ((weight,),)))


def even(regions: int = 2, racks: int = 4, shards: int = 5) -> Tree:
    """A tree of equal shards."""
    return Tree(((((1.0,) * shards),) * racks,) * regions)


#: 40 shards.
TREE = even()
#: A document costs so many bytes besides its text.
OVERHEAD = 16
#: Rows that stand together in the input are numbered in stretches of so many.
STRETCH = 1 << 14


def _clock(key: Column, name: str, weight: float) -> Column:
    return -F.ln(uniform(F.md5(F.concat(key, F.lit(f":{name}"))))) / F.lit(weight)


def _winner(key: Column, prefix: str, weights: list[float]) -> Column:
    """The child that wins; children without weight never do."""
    return F.array_min(F.array(*[F.struct(_clock(key, f"{prefix}{i}", w).alias("clock"), F.lit(i).alias("child")) for i, w in enumerate(weights) if w > 0]))["child"]


def assign(df: DataFrame, key: str, tree: Tree, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row's key, a string; equal keys go to one shard."""
    k, first, n = F.col(key), {}, 0
    for r, region in enumerate(tree.regions):
        for q, rack in enumerate(region):
            first[r, q], n = n, n + len(rack)
    df = df.withColumn("_region", _winner(k, "r", [sum(map(sum, region)) for region in tree.regions]))
    here = F.col("_region")
    racks = [F.when(here == r, _winner(k, f"r{r}k", [sum(x) for x in region])) for r, region in enumerate(tree.regions) if sum(map(sum, region)) > 0]
    df = df.withColumn("_rack", F.coalesce(*racks))
    leaves = [F.when((here == r) & (F.col("_rack") == q), _winner(k, f"r{r}k{q}s", list(tree.regions[r][q])) + at) for (r, q), at in first.items() if sum(tree.regions[r][q]) > 0]
    # A leaf always wins; said to be never null, the shard brings no filter with it, which would draw all over again.
    return df.withColumn(out, F.coalesce(*leaves, F.lit(-1)).cast("int")).drop("_region", "_rack")


def _with_place(docs: DataFrame) -> DataFrame:
    """``docs`` with _file, a number and a name, and _row_at, which say where each row stands.

    Rows read from files stand by the number in the file's name (that of the task that wrote it), its path,
    and their place in it.  Others stand as they come out; they are kept first, since they come out once.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        at = docs.metadataColumn("_metadata")
        path = at["file_path"]
        number = F.coalesce(F.regexp_extract(path, "part-([0-9]+)[^/]*$", 1).try_cast("bigint"), F.lit(0))
        return docs.select("*", F.struct(number.alias("number"), path.alias("path")).alias("_file"), at["row_index"].alias("_row_at"))
    return checkpoint(docs.select("*", F.struct(F.lit(0).cast("bigint").alias("number"), F.lit("").alias("path")).alias("_file"), F.monotonically_increasing_id().alias("_row_at")))


def _in_order(df: DataFrame) -> DataFrame:
    """Adds ``_before``, how many rows of the shard stand earlier; only the counts of stretches meet in one task a shard."""
    df = df.withColumn("_stretch", F.floor(F.col("_row_at") / STRETCH))
    sums = df.groupBy("shard", "_file", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("shard").orderBy("_file", "_stretch").rowsBetween(Window.unboundedPreceding, -1))
    bases = checkpoint(sums.select(F.col("shard").alias("_s"), F.col("_file").alias("_f"), F.col("_stretch").alias("_t"), F.coalesce(earlier, F.lit(0)).alias("_base")))
    own = F.row_number().over(Window.partitionBy("shard", "_file", "_stretch").orderBy("_row_at")) - 1
    joined = df.withColumn("_own", own).join(sized(bases), (F.col("shard") == F.col("_s")) & (F.col("_file") == F.col("_f")) & (F.col("_stretch") == F.col("_t")))
    return joined.withColumn("_before", F.col("_own") + F.col("_base"))


def shard(docs: DataFrame, *, tree: Tree = TREE, carry: tuple[str, ...] = (), in_order: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the tree decide.  ``size`` is the text's bytes, none for null, plus
    ``OVERHEAD``; ``text_crc32`` is unsigned and that of no bytes for null.  ``slot`` counts the rows of
    a shard from 0 without gaps.  ``grown_shard`` is the shard in the tree with one more.  Rows without
    an id share the empty key, and repeated ids share a shard.  Slots rise in the order of the input (see
    ``_with_place``), or, if not ``in_order``, in an order drawn from the key, where rows equal in id, size
    and crc may swap.  Columns in ``carry`` are kept as _c0, _c1 and so on, others are ignored; an empty
    table gives an empty one.
    """
    docs = docs.select("doc_id", "text", *carry)
    place = ["_file", "_row_at"] if in_order else []
    docs = _with_place(docs) if in_order else docs
    df = docs.select("doc_id", *place, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], (F.octet_length(body()) + OVERHEAD).cast("bigint").alias("size"), F.crc32(F.encode(body(), "UTF-8")).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"))
    df = assign(assign(df, "_key", tree), "_key", tree.grown(), "grown_shard")
    # Rows without an id share a shard; what they hold draws their order, so that their counting is spread too.
    df = df.withColumn("_draw", F.when(F.col("doc_id").isNotNull(), draw("_key")).otherwise(draw("size", "text_crc32"))).withColumn("_one", F.lit(1).cast("bigint")).drop("_key")
    # Thin rows are kept, and texts so read once; rows that carry more are read again.
    df = df if carry else checkpoint(df)
    placed = _in_order(df) if in_order else running(df, checkpoint(slice_sums(df, "shard", "_draw", "_one")), "shard", ["doc_id", "size", "text_crc32"], "_draw", "_one")
    return placed.select("doc_id", *[f"_c{i}" for i in range(len(carry))], "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("_before").cast("bigint").alias("slot"), "grown_shard")


def sharded(docs: DataFrame, *, tree: Tree = TREE) -> DataFrame:
    """``docs`` with ``shard_id`` and ``shard_slot``, ready to be written by shard; columns of those names are replaced.

    Within a shard slots keep the order of ``docs``.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard_id", "shard_slot")]
    placed = shard(docs.select("doc_id", "text", F.struct(*own).alias("_row")), tree=tree, carry=("_row",))
    return placed.select("_c0.*", F.col("shard").alias("shard_id"), F.col("slot").alias("shard_slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), in_order=False)


def _levels_sql(regions: int, name: str) -> str:
    """Region, rack and shard of each key among ``regions`` regions of 4 racks of 5 shards, and, as the last, one of a single shard."""
    clock = lambda child: f"-ln((CAST('0x' || substr(md5(key || ':' || {child}), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    weight = "CASE WHEN i < 2 THEN 20.0::DOUBLE ELSE 1.0::DOUBLE END"
    return f"""
{name}_r AS (SELECT key, arg_min(i, {clock("'r' || i")} / ({weight})) AS r FROM keys, range({regions}) t(i) GROUP BY key),
{name}_k AS (SELECT key, r, arg_min(i, {clock("'r' || r || 'k' || i")}) AS k FROM {name}_r, range(4) t(i) WHERE r < 2 OR i = 0 GROUP BY key, r),
{name} AS (SELECT key, CAST(r * 20 + k * 5 + arg_min(i, {clock("'r' || r || 'k' || k || 's' || i")}) AS INTEGER) AS shard FROM {name}_k, range(5) t(i) WHERE r < 2 OR i = 0 GROUP BY key, r, k)"""


ORACLE_SQL = {
    "op2_sharding": f"""
WITH steps AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i)),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps),
d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (
  SELECT doc_id, key, size, CAST(xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS BIGINT) AS text_crc32 FROM d, crc),
keys AS (SELECT DISTINCT key FROM c),{_levels_sql(2, "now")},{_levels_sql(3, "later")}
SELECT c.doc_id, c.size, c.text_crc32, 'key' AS law, now.shard,
  row_number() OVER (PARTITION BY now.shard ORDER BY CASE WHEN doc_id IS NULL THEN md5(size || ':' || text_crc32) ELSE md5(c.key) END, doc_id, size, text_crc32) - 1 AS slot, later.shard AS grown_shard
FROM c JOIN now ON c.key = now.key JOIN later ON c.key = later.key
"""
}

QUERIES = {"op2_sharding": op2_sharding}
