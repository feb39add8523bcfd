"""The stages one after another, each held against what its operator says of its own input and against plain programs."""

from collections import Counter

import corpus_pipeline
from granary.llm.decontaminate import distance, normalise, prepare
from granary.llm.mixing import mix, training_order
from granary.llm.quality import classify
from granary.llm.sharding import shard
from test_near_dedup import brute

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        made[name] = (before, docs)
        assert docs.columns == columns + ["shard_id", "shard_slot"] * (name == "sharding")
    ids = {name: (Counter(r.doc_id for r in a.collect()), Counter(r.doc_id for r in b.collect())) for name, (a, b) in made.items()}

    before, _ = made["quality"]
    judged = classify(before, spark.read.parquet(f"{D}/labels.parquet")).collect()
    assert ids["quality"][1] == Counter(r.doc_id for r in judged if r.kept)

    before, _ = made["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids["near_duplicates"][1] == Counter(set(brute(rows)[0]))

    before, _ = made["decontamination"]
    items = [prepare(*r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids["decontamination"][1] == Counter(r.doc_id for r in before.collect() if not any(distance(x, normalise(r.text)) <= x.budget for x in items))

    before, _ = made["mixing"]
    assert ids["mixing"][1] == +Counter({r.doc_id: len(r.positions) for r in mix(before).collect()})

    before, after = made["sharding"]
    assert sorted((r.doc_id, r.shard, r.slot) for r in shard(before).collect()) == sorted((r.doc_id, r.shard_id, r.shard_slot) for r in after.collect())
    assert ids["sharding"][0] == ids["sharding"][1]


def test_slots_rise_with_training_time(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    times = {r.doc_id: [(t, r._draw) for t in r.positions] for r in mix(docs).collect()}
    training_order(docs).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    for got in (corpus_pipeline.sharding(spark, mixed, D), corpus_pipeline.sharding(spark, training_order(docs), D)):
        shards = {}
        for r in got.collect():
            shards.setdefault(r.shard_id, []).append((r.shard_slot, r.doc_id))
        assert sum(map(len, shards.values())) == sum(map(len, times.values()))
        for rows in shards.values():
            ids = [d for _, d in sorted(rows)]
            assert ids == [d for _, d in sorted((t, d) for d in set(ids) for t in times[d])]


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert {"doc_id", "text", "shard_id", "shard_slot"} <= set(out.columns) and out.count() > 0


def test_odd_tables(spark):
    """Nulls everywhere, repeated rows, odd and clashing names, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int, kept boolean, value string, `a b` int, shard_id int, n_tokens long"
    rows = [(None,) * 11, (None,) * 11, (1, None, None, None, None, 1, True, "v", 2, 3, 4), (2, "", "en", "s", 0, None, None, None, None, None, None)]
    rows += [(i, f"word{i} " * 20 + "the end of it all", "en", f"s{i % 3}", 1, 2, False, "w", 3, 4, 5) for i in range(3, 40)] * 2
    rows.append((99, "long " * 60_000, "en", None, 1, 1, True, "x", 1, 1, 1))
    df = spark.createDataFrame(rows, schema)
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, D)
            assert [c for c in out.columns if c not in ("shard_id", "shard_slot")] == [c for c in docs.columns if c != "shard_id"], name
            got = out.collect()
            assert bool(got) == (docs is df), name
            if name == "near_duplicates" and got:
                assert Counter(r.doc_id for r in got)[5] == 1
