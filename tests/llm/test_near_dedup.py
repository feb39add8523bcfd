import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from granary.llm import common
from granary.llm.bagminhash import signatures, weighted_jaccard
from granary.llm.graph import components
from granary.llm.near_dedup import ORACLE_SQL, PART, keep_one, links_of, near_dedup, op3_near_dedup, sign
from granary.llm.tokens import mix
from pyspark.sql import functions as F


def bag(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows):
    """The smallest id of each row's class, by all pairs."""
    texts = [" ".join(bagged) if (bagged := (t or "").lower().split()) else "" for _, t in rows]
    bags = [bag(t) for t in texts]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            every = sum((bags[i] | bags[j]).values())
            if texts[i] == texts[j] or every and both / every >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(rows))], [len(least[find(i)]) for i in range(len(rows))]


def make(seed=4, groups=12, each=6):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.randrange(1, each)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), rng.choice((" ", "  ")).join(copy)))
    return rows


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 200).astype(np.uint64)
    a = rng.integers(0, 9, 200)
    b = np.maximum(0, a + rng.integers(-2, 3, 200))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = []
    for s in range(100):
        h = mix(e + np.uint64(s))
        t = signatures(np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)], np.r_[h[a > 0], h[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 64)
        got.append((t[0] == t[1]).mean())
    assert np.mean(got) == pytest.approx(want, abs=0.02)
    assert weighted_jaccard(np.array([1, 1, 2]), np.array([1, 2, 2])) == 0.5 and weighted_jaccard(np.zeros(0), np.zeros(0)) == 1


def test_links_of_a_large_bucket_keep_it_together():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 125)
    sigs = np.array([np.where(rng.random(125) < 0.9, base, rng.integers(0, 256, 125)) for _ in range(600)], np.uint8)
    pairs, leaders = links_of(sigs)
    assert len(pairs) < 600 * 8 and len(leaders) < 60
    assert {x for p in pairs for x in p} == set(range(600))


def family(n, planted, private, shared, common=150):
    """n texts of one template with words of their own; pairs of the first ``planted`` texts share more, and all pairs' similarity is known."""
    head = " ".join(f"c{i}" for i in range(common))
    tail = lambda i: [f"p{i // 2}x{j}" if i < planted and j < shared else f"u{i}x{j}" for j in range(private)]
    same, alone = common - 4, private
    assert same / (same + 2 * alone) < 0.8 <= (same + shared) / (same + shared + 2 * (alone - shared))
    return [(i, " ".join([head, *tail(i)])) for i in range(n)], {i: i // 2 * 2 if i < planted else i for i in range(n)}


def test_links_of_a_family_just_below_are_all_found(spark):
    rows, want = family(700, 120, 19, 4)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_links_across_the_parts_of_a_bucket(spark):
    # Within the template 73 % of all registers agree, so that buckets of over 2,048 texts are there.
    rows, want = family(4200, 200, 19, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert sign(df).select(F.explode("bands").alias("key")).groupBy("key").count().agg(F.max("count")).first()[0] > PART
    assert {r.doc_id: r.class_id for r in near_dedup(df).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_classes_match_brute_force(spark):
    rows = make()
    rows += [(None, rows[0][1]), (1000, None), (1001, " \n"), (1002, "one two"), (1003, "ONE  two"), (1004, "one two three"), (2, rows[2][1]), (1005, "z " * 30_000), (1006, "z " * 30_001), (None, "alone and without an id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = near_dedup(df).collect()
    ids, sizes = brute(rows)
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=key) == sorted(((d, i, n) for (d, _), i, n in zip(rows, ids, sizes)), key=key)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted(set(ids), key=key)
    assert near_dedup(df.limit(0)).collect() == [] and keep_one(df.limit(0)).collect() == []


def test_ids_that_stand_for_several_texts(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (3, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in keep_one(df).collect()) == [(1, a), (1, b)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    ids, _ = brute(rows)
    assert {r.doc_id: r.class_id for r in op3_near_dedup(spark, d).collect()} == {d: i for (d, _), i in zip(rows, ids)}


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    df = op3_near_dedup(spark, d)
    cols = sorted(df.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op3_near_dedup']})").fetchall())


def test_attach_spreads_a_hot_key(spark, monkeypatch):
    df = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(600)] + [(1000, None)], "node long, root long")
    side = spark.createDataFrame([(7, "seven"), (9, "nine"), (8, "none")], "root long, name string")
    want = sorted((r.node, {7: "seven", 9: "nine"}.get(r.root)) for r in df.collect())
    for shuffled in (False, True):
        if shuffled:
            monkeypatch.setattr(common, "sized", lambda d: d)
        got = common.attach(df, side, "root", "node")
        assert sorted(got.columns) == ["name", "node", "root"] and sorted((r.node, r.name) for r in got.collect()) == want
