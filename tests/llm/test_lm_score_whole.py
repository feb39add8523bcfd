import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from granary.llm import context_mixing as cm
from granary.llm.lm_score import count_tables, gather, held_out, learn, lexicon_of
from granary.llm.tokens import column_bytes


def test_all_training_documents_teach(spark):
    """Every bit of every training document, words and spelled bytes, is in what is learnt from."""
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3).filter(~held_out(F.col("doc_id"))).select("doc_id", "text")
    lexicon, sizes = lexicon_of(gather(train), 500), cm.Sizes(16, 15)
    tables, _ = count_tables(train, lexicon, sizes)
    model = learn(train, cm.Model(lexicon, sizes, tables), 10_000)
    p = cm.parse(*column_bytes(pa.array([r.text for r in train.collect()])), lexicon)
    assert model.words.refined.sum() == lexicon.code.lengths[p.symbols].sum()
    of_bytes = np.add.reduceat(cm.BYTES.lengths[p.data], p.at[:-1])
    assert model.bytes.refined.sum() == (of_bytes * p.times).sum()
    one = cm.Model(lexicon, sizes, tables)
    one.learn(p)
    assert (one.words.weights == model.words.weights).all() and (one.bytes.weights == model.bytes.weights).all()
