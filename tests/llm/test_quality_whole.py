from granary.llm.quality import train


def test_all_trusted_documents_count(spark):
    """Each document has a word of its own, so the model's words tell how many it is fitted on; the others set the limits."""
    n = 8000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('the cat sat w', id) as text", "'en' as lang")
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    classifier, _ = train(docs, labels)
    fitted = docs.selectExpr("count_if(md5(cast(doc_id as string)) < '8')").first()[0]
    # And the, cat, sat, the end, and the mark before a text.
    words = classifier.counts.one.count()
    assert 3900 < fitted < 4100 and words - fitted in (4, 5)
    one = train(docs.filter("doc_id = 1"), labels)[0]
    assert one.counts.size > 0
