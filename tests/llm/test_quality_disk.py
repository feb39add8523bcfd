import glob
import os

import numpy as np
from granary.llm.quality import HELD, classify, fit, score


def test_scoring_shuffles_no_ngrams(spark):
    """A model larger than a task keeps is read from the shared folder; documents stay where they are."""
    texts = spark.range(3000).selectExpr("id as doc_id", "concat('the cat ', id % 7, ' sat w', id % 500) as text", "'en' as lang")
    counts = fit(texts, 0)
    scored = score(texts, counts, ["doc_id"])
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    same = {r.doc_id: r.log10_prob for r in score(texts, fit(texts, HELD), ["doc_id"]).collect()}
    got = {r.doc_id: r.log10_prob for r in scored.collect()}
    assert got == same


def test_disk_of_the_model(spark):
    """What is written for a model of 300,000 places, all of them different, in bytes a place."""
    rng = np.random.default_rng(5)
    texts = spark.createDataFrame([(" ".join(f"w{x}" for x in rng.integers(0, 5000, 1000)),) for _ in range(300)], "text string")
    model = fit(texts).model
    size = sum(os.path.getsize(f) for p in model.paths for f in glob.glob(f"{p.removeprefix('file:')}/**/*.parquet", recursive=True))
    assert model.size > 300_000 and size / 300_000 < 50
