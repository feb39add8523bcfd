import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from granary.llm import context_mixing as cm
from granary.llm.lm_score import count_tables, gather, held_out, learn, lexicon_of, lm_score, op6_lm_score
from granary.llm.tokens import column_bytes


def base(rows):
    """(n_tokens, n_known, base_score) of each row, and N."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for _, t in rows]
    out = [zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for d, _ in rows]
    c = Counter(w for ws, o in zip(tokens, out) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in tokens], out, n


def model_of(texts, learnt=True):
    """A model of some texts, without Spark."""
    data, at = column_bytes(pa.array(texts))
    starts, _ = cm.segments(data, at)
    hashes, n = np.unique(cm.word_hashes(data, starts, np.r_[starts[1:], len(data)]), return_counts=True)
    often = n > 3
    lexicon, sizes = cm.Lexicon(hashes[often], n[often], int(n[~often].sum()), len(texts)), cm.Sizes.of(int(n.sum()))
    counts = cm.new_counts(lexicon, sizes)
    parsed = cm.parse(data, at, lexicon)
    cm.count(parsed, lexicon, sizes, counts)
    out = cm.Model(lexicon, sizes, [cm.coded(c) for c in counts])
    if learnt:
        out.learn(parsed)
    return out


def test_prefix_code():
    rng = random.Random(3)
    for n in (2, 3, 7, 200):
        weights = np.array([rng.randrange(1, 1000) for _ in range(n)])
        code = cm.prefix_code(weights)
        ways = {tuple(code.bit[code.first[i] : code.first[i + 1]]) for i in range(n)}
        assert len(ways) == n and abs(sum(2.0**-len(w) for w in ways) - 1) < 1e-12
        # No code is shorter on the whole: by repeatedly joining the two lightest.
        rest, total = sorted(weights.tolist()), 0
        while len(rest) > 1:
            a, b = rest.pop(0), rest.pop(0)
            total += a + b
            rest = sorted([*rest, a + b])
        assert (code.lengths * weights).sum() == total
    assert abs(sum(2.0**-cm.BYTES.lengths) - 1) < 1e-9


def test_counts_in_a_byte():
    n = np.array([0, 1, 31, 32, 1000, 10**6, 2**40])
    got = cm.coded(np.repeat(n, 2))
    assert (got & 255 == got >> 8).all()
    value = cm._VALUES[got & 255]
    assert (value[:3] == n[:3]).all() and (np.abs(value[3:6] / n[3:6] - 1) < 0.09).all() and value[6] > 1e9


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "cat", "Sat", "é", "on,", f"x{rng.randrange(30)}"]) for _ in range(50)) for _ in range(200)]
    m = model_of(texts)

    def total_over(code, costs_of, n):
        total = 0
        for s in range(n):
            total += 2.0 ** -(costs_of(s) / cm.UNIT)
        return total

    for key in range(3):
        keys = tuple(np.array([cm.mix(np.array([key + 5 * j], np.uint64))[0]]) for j in range(3))

        def of_symbol(s):
            # An escape with nothing spelled after it.
            where = np.zeros(int(s == cm.ESCAPE), np.int64)
            p = cm.Parsed(np.array([s]), np.zeros(1, int), keys, np.zeros(0, np.int64), np.zeros(2, np.int64), np.ones(1, np.int64), where)
            return m.cost(p).sum()

        assert total_over(m.lexicon.code, of_symbol, len(m.lexicon.hashes) + 2) == pytest.approx(1, abs=1e-4)

    def of_bytes(data):
        p = cm.Parsed(np.zeros(0, int), np.zeros(0, int), (), np.array(data), np.array([0, len(data)]), np.ones(1, np.int64), np.zeros(0, np.int64))
        return m.spelled(p)[0]

    for start in ([], [32], [32, 120], [99, 7]):
        rest = of_bytes(start) if start else 0
        assert total_over(cm.BYTES, lambda b, start=start, rest=rest: of_bytes([*start, b]) - rest, 257) == pytest.approx(1, abs=1e-4)
    assert len(m.cost(cm.parse(*column_bytes(pa.array(["", None, "the"])), m.lexicon))) == 4


def test_learnt_weights_beat_equal_ones():
    """On texts where the word before tells the next one, and the one two before says nothing."""
    rng = random.Random(4)
    follow = {f"w{i}": [f"w{rng.randrange(60)}" for _ in range(2)] for i in range(60)}

    def text():
        out = ["w0"]
        for _ in range(80):
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.9 else f"w{rng.randrange(60)}")
        return " ".join(out)

    train, test = [text() for _ in range(300)], [text() for _ in range(60)]
    test = column_bytes(pa.array(test))
    got = {}
    for learnt in (True, False):
        m = model_of(train, learnt)
        got[learnt] = m.cost(cm.parse(*test, m.lexicon)).sum()
    assert got[True] < got[False] * 0.97
    # And the words before count: without them a text takes far more.
    m.tables[1][:] = m.tables[2][:] = m.tables[3][:] = 0
    assert m.cost(cm.parse(*test, m.lexicon)).sum() > got[False] * 1.2


def test_files_do_not_matter(spark, tmp_path):
    """One file and eight, in another order, give equal scores to the last digit."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    docs.repartition(8).sortWithinPartitions(F.desc("doc_id")).write.parquet(str(tmp_path / "eight"))
    one, eight = ({r.doc_id: (r.score, r.bits_per_byte, r.n_known) for r in lm_score(spark.read.parquet(str(tmp_path / n))).collect()} for n in ("one", "eight"))
    assert one == eight and len(one) == 1000


LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _bytes_of(texts):
    data, at = column_bytes(pa.array(texts))
    return data, at[:-1], at[1:]


def test_fit(spark):
    """Tables that Spark adds up are those of all texts counted at once; what is learnt doesn't leave the start alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    train = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    got = gather(train)
    lexicon = lexicon_of(got, 500)
    texts = [r.text for r in train.collect()]
    parsed = cm.parse(*column_bytes(pa.array(texts)), lexicon)
    assert (np.diff(np.unique(lexicon.hashes)) > 0).all() and len(lexicon.hashes) == 500
    sizes = cm.Sizes(16, 15)
    counts = cm.new_counts(lexicon, sizes)
    cm.count(parsed, lexicon, sizes, counts)
    tables, named = count_tables(train, lexicon, sizes)
    own = {int(h): w for w, h in zip(*(lambda s: (s, cm.word_hashes(*_bytes_of(s))))(sorted({w.translate(LOWER) for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)})))}
    spoken = {m for t in texts for m in re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", t)}
    of = {int(h): s.strip(" \t\n\v\f\r").translate(LOWER) for s, h in zip(spoken, cm.word_hashes(*_bytes_of(list(spoken))))}
    assert [own.get(int(n), "") for n in named[2:]] == [of[int(h)] for h in lexicon.hashes]
    assert all((a == cm.coded(b)).all() for a, b in zip(tables, counts)) and len(tables) == len(counts)
    model = learn(train, cm.Model(lexicon, sizes, tables), 100_000)
    assert model.words.refined.sum() > 10_000 and (model.words.weights != 0.35).any() and (model.bytes.weights != 0.35).any()


def test_rows(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["The", "É"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randrange(0, 40)))) for i in range(300)]
    rows += [(None, "a b a"), (None, None), (7000, ""), (7001, "x" * 100_000 + " y"), (5, rows[5][1]), (7002, " \n\t "), (7003, "ab " * 30_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int")
    want, out, n = base(rows)
    for head in (1_000_000, 10, 0):
        got = lm_score(df, head=head).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1])
        a = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out) for r in got), key=key)
        b = sorted(((d, w[0], w[1], round(w[2], 6), o) for (d, _), w, o in zip(rows, want, out)), key=key)
        assert a == b
        assert {r.train_tokens for r in got} == {n}
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_score(df.limit(0)).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want, out, _ = base(rows)
    got = {r.doc_id: r for r in op6_lm_score(spark, d).collect()}
    for (i, _), w, o in zip(rows, want, out):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.held_out) == (w[0], w[1], o) and r.base_score == pytest.approx(w[2], rel=1e-9)
    # Held-out texts take clearly fewer bits than single bytes by their frequency, about 4.6.
    held = [r for r in got.values() if r.held_out]
    size = sum(len(t.encode()) for i, t in rows if got[i].held_out)
    bits = -sum(r.score for r in held) * math.log2(10) / size
    assert bits < 2.8
