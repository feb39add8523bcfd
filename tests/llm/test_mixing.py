import re
from collections import Counter, defaultdict

import duckdb
import pytest
from granary.llm.mixing import ORACLE_SQL, mix, op1_mixing, targets, training_order


def fill(sizes):
    """Targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        load = sum(w[s] for s in free)
        t = {s: (total - sum(capped.values())) * w[s] / load for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **t}
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 0, "b": 0}, {"x": 9}, {f"s{i:02}": (i * 37) % 50 for i in range(30)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(df).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want), sizes


def test_mix(spark):
    rows = [(i, "s%d" % (i % 3), " ".join("w" * (i % 7)), i) for i in range(200)] + [(None, None, "a b", 1), (5, "s0", None, 1), (7, "s1", "", 2), (7, "s1", "x y z", 2), (7, "s1", "x y z", 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, taken long")
    got = mix(df).collect()
    assert len(got) == len(rows)
    size, taken, want = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        want[r.source] = r.target
        assert r.taken <= 3 * r.size and len(r.positions) == -(-r.taken // max(r.size, 1)) and all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
    assert want == pytest.approx(fill(size)) and all(abs(taken[s] - want[s]) < 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(3)).collect()))
    assert mix(df.limit(0)).collect() == []


def test_falling_sources_come_early(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "a b c d") for i in range(3000)], "doc_id long, source string, text string")
    mean = defaultdict(list)
    for r in mix(df).collect():
        mean[r.source] += r.positions
    a, b, c = (sum(v) / len(v) for _, v in sorted(mean.items()))
    assert a < 0.45 < b < 0.55 < c


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rel = con.sql(ORACLE_SQL["op1_mixing"])
    df = op1_mixing(spark, d)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op1_mixing']})").fetchall()) or pytest.fail("rows differ")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])) for r in df.collect())


def test_training_order(spark):
    rows = [(i, "s%d" % (i % 3), " ".join("w" * (i % 7)), i) for i in range(200)] + [(None, None, "a b", 1), (7, "s1", "x y z", 2), (7, "s1", "x y z", 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, taken long")
    out = training_order(df)
    assert out.columns == df.columns
    want = Counter()
    for r in mix(df).collect():
        want[r.doc_id] += len(r.positions)
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert training_order(df.limit(0)).collect() == []
