import zlib
from collections import Counter

import duckdb
from granary.llm.sharding import ORACLE_SQL, TREE, Tree, assign, even, op2_sharding, shard, sharded


def keys(spark, n=20000):
    return spark.range(n).selectExpr("cast(id as string) k", "id")


def test_shares_and_growth(spark):
    df = assign(assign(keys(spark), "k", TREE), "k", TREE.grown(), "g").collect()
    n = Counter(r.shard for r in df)
    assert sorted(n) == list(range(40)) and all(380 < v < 630 for v in n.values())
    moved = [r for r in df if r.shard != r.g]
    assert {r.g for r in moved} == {40} and 380 < len(moved) < 600


def test_movement_stays_in_the_subtree(spark):
    old = Tree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0))))
    new = Tree((((1.0, 1.0), (1.0, 3.0)), ((1.0, 1.0), (1.0, 1.0))))
    rows = assign(assign(keys(spark), "k", old), "k", new, "g").collect()
    region, rack = (lambda s: s // 4), (lambda s: s // 2)
    for r in rows:
        if region(r.shard) != region(r.g):
            assert region(r.g) == 0
        elif rack(r.shard) != rack(r.g):
            assert rack(r.g) == 1
        elif r.shard != r.g:
            assert r.g == 3
    again = assign(assign(keys(spark, 2000), "k", even(1, 1, 3)), "k", even(1, 1, 3).grown().grown(), "g").collect()
    assert {r.g for r in again if r.g != r.shard} == {3, 4}
    # Racks and shards of no weight get nothing, wherever they stand.
    odd = assign(keys(spark, 2000), "k", Tree((((0.0,), (1.0, 0.0, 1.0)), ((0.0,),)))).collect()
    assert {r.shard for r in odd} == {1, 3}


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "é", 8), (None, "x", 7), (2, "", 1)] + [(i, "t", 0) for i in range(10, 300)], "doc_id long, text string, shard int")
    got = shard(df).collect()
    assert len(got) == 295
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    by = {(r.doc_id, r.size): r for r in got}
    assert by[1, 16].text_crc32 == 0 and by[None, 18].text_crc32 == zlib.crc32("é".encode()) and by[None, 18].shard == by[None, 17].shard
    assert all(r.grown_shard in (r.shard, 40) and r.law == "key" for r in got)
    assert shard(df.limit(0)).collect() == []
    full = sharded(df)
    assert full.columns == [*df.columns, "shard_id", "shard_slot"]
    assert sorted((r.shard_id, r.shard_slot) for r in full.collect()) == sorted((r.shard, r.slot) for r in got)


def test_oracle(spark):
    """All columns follow from MD5 draws, in another engine."""
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = op2_sharding(spark, "/root/testdata/sf0.001")
    cols = sorted(df.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op2_sharding']})").fetchall())


def test_query(spark):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op2_sharding(spark, d).collect()
    assert {r.doc_id for r in got} == text.keys() and len(got) == len(text)
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in got)
