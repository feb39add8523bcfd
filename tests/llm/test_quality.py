import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from granary.llm.quality import HELD, SHRINK, classify, fit, keep_good, op9_quality
from granary.llm.tokens import column_bytes


class Plain:
    """The same model over word strings, by dictionaries."""

    def __init__(self, texts):
        three = Counter()
        for t in texts:
            line = ["<s>", "<s>", *t.lower().split(), "</s>"]
            three.update(zip(line, line[1:], line[2:]))
        two = Counter((b, c) for _, b, c in three)
        one = Counter(c for _, c in two)
        self.tables = [self.level(three, lambda g: g[:2]), self.level(two, lambda g: g[:1]), self.level({(k,): v for k, v in one.items()}, lambda g: ())]
        self.unknown = self.tables[2][1].get((), 1.0) / (max(len(one), 1) + 1)

    @staticmethod
    def level(counts, context):
        n = [sum(v == i for v in counts.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) if n[i] else 0.5 for i in range(3)]
        total, off = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[context(g)] += c
            off[context(g)] += d[min(c, 3) - 1]
        return {g: (c - d[min(c, 3) - 1]) / total[context(g)] for g, c in counts.items()}, {k: off[k] / total[k] for k in total}

    def score(self, text):
        line, out = ["<s>", "<s>", *text.lower().split(), "</s>"], 0.0
        for a, b, c in zip(line, line[1:], line[2:]):
            p = self.tables[2][0].get((c,), 0.0) + self.unknown
            p = self.tables[1][0].get((b, c), 0.0) + self.tables[1][1].get((b,), 1.0) * p
            p = self.tables[0][0].get((a, b, c), 0.0) + self.tables[0][1].get((a, b), 1.0) * p
            out += math.log10(p)
        return out


def test_model_matches_plain(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "C", "d", "é", "f"], int(rng.integers(0, 30)), p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05])) for _ in range(60)]
    plain, model = Plain(texts), fit(spark.createDataFrame([(t,) for t in texts], "text string")).held()
    asked = ["a b c", "", "zz a zz", "a a a a b", *texts[:20]]
    got, counts = model.score(*column_bytes(pa.array(asked)))
    assert list(counts) == [len(t.split()) + 1 for t in asked]
    assert list(got) == pytest.approx([plain.score(t) for t in asked], rel=1e-5)
    mass = sum(10 ** model.score(*column_bytes(pa.array([f"a b {w}"])))[0][0] / 10 ** 0 for w in ("a",))
    assert 0 < mass < 1


def rows(n):
    rng = np.random.default_rng(3)
    good = ["the", "cat", "sat", "on", "a", "mat", "and", "ran", "home", "again"]
    out = [(i, " ".join(rng.choice(good, 60)), "en" if i % 2 else None, i) for i in range(n)]
    return out + [(n + i, " ".join(f"x{rng.integers(1 << 40)}!!" for _ in range(60)), "en", 0) for i in range(10)]


def test_classify(spark):
    data = rows(400) + [(None, None, None, 0), (9000, "", "xx", 0), (9001, "the cat " * 50_000, "en", 0), (3, "the cat sat", "en", 1), (3, "the cat sat", "en", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, value int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(i, 0, 0) for i in range(290, 320)] + [(None, 1, 0), (9000, None, None)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == len(data)
    junk = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 410]
    clean = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert not any(r.kept for r in junk) and sum(r.kept for r in clean) >= 0.97 * len(clean)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def percentile(values, p):
    return sorted(values)[max(math.ceil(p * len(values)) - 1, 0)]


def test_values_limits_and_joins(spark):
    """Every figure by a plain program; joins to the dealt-out counts say the same as the model in one place."""
    data = [r[:3] for r in rows(400)] + [(None, None, None), (9000, "", "xx"), (9001, "the cat " * 3000, "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    drawn = sorted(range(300), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    text = {r[0]: r[1] for r in data}
    plain = Plain([text[i] for i in drawn[:100]])
    own = {i: (-plain.score(t or ""), len((t or "").split()) + 1) for i, t, _ in data}
    limits = {}
    for lang in ("en", None, "every"):
        some = [own[i] for i in drawn[100:] if lang == "every" or ("en" if i % 2 else None) == lang]
        median = percentile([a / n for a, n in some], 0.5)
        limits[lang] = median, percentile([(SHRINK * median + a) / (n + SHRINK) for a, n in some], 0.9)
    for most in (HELD, 0):
        got = classify(docs, labels, sample=100, quantile=0.9, most=most).collect()
        assert len(got) == len(data)
        for r in got:
            a, n = own[r.doc_id]
            median, limit = limits.get(r.lang, limits["every"])
            value = (SHRINK * median + a) / (n + SHRINK)
            assert (r.n_tokens, r.kept) == (n, value <= limit * (1 + 1e-9)) or abs(value / limit - 1) < 1e-5
            assert (r.log10_prob, r.value, r.limit) == pytest.approx((-a, value, limit), rel=1e-5)
        kept = Counter(r.doc_id for r in keep_good(docs, labels, sample=100, quantile=0.9, most=most).collect())
        assert kept == Counter(r.doc_id for r in got if r.kept)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in classify(docs, none).collect()] == [True, True]
    assert classify(docs.limit(0), none).collect() == [] and keep_good(docs.limit(0), none).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op9_quality(spark, d).collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    good = [got[i].kept for i, r in labels.items() if r.quality == 1]
    bad = [got[i].kept for i, r in labels.items() if r.quality == 0]
    print(sum(good), len(good), sum(bad), len(bad))
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.5 * len(bad)
