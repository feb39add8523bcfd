import time

import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from granary.functions.scan import Unfit, distinct
from granary.operators.tree import _quickly, build, mutate_column, render


def test_quick_trees():
    text = ' {"b": [1.50, -0, 1e400, {}], "a": null, "b": [true, "x", [], 7]}\n'
    assert render(_quickly(text)) == render(build(text)) == '{"a":null,"b":[true,"x",[],7]}'
    for odd in ('"\\ud800"', "NaN", "[-Infinity]", "01", "[1,]", '"\t"', "﻿1", "", "[1] 2", "1.", '"\\u12_4"'):
        assert _quickly(odd) is None
        with pytest.raises(Unfit):
            build(odd)
    deep = "[" * 50_000 + "]" * 50_000
    assert render(build(deep)) == deep


def test_equal_texts_are_rewritten_once(spark):
    texts, at = distinct(pa.array(["b", None, "a", "b"]))
    assert [texts[i] for i in at.to_pylist()] == ["b", None, "a", "b"] and len(texts) == 3
    big = "[" + ",".join('{"k":1}' for _ in range(10_000)) + "]"
    df = spark.range(1000).select("id", F.when(F.col("id") % 5 > 0, F.lit(big)).alias("text")).coalesce(1)
    begin = time.time()
    got = df.select("id", mutate_column(F.col("text")).alias("m")).select("id", "m.visited", (F.col("m.text") == big).alias("same")).collect()
    assert time.time() - begin < 30
    assert all((r.visited, r.same) == ((20_001, True) if r.id % 5 else (None, None)) for r in got)
