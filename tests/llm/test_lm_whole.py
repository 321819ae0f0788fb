"""The language model's filters hold whatever the training rows have."""

from pyspark.sql import functions as F

from citeflow.llm import common, lm

SF = "/root/testdata/sf0.001"


def test_filters_have_no_cap(spark, monkeypatch):
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    scores = lambda: {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") % 5 != 1).collect()}
    found = scores()
    monkeypatch.setattr(lm, "MOST_BITS", 1 << 12, raising=False)
    assert scores() == found


def test_pairs_seen_once_count(spark):
    rows = [(k, f"left{k} right{k}") for k in range(400)]
    rows += [(1000, " ".join(f"left{k} right{k}" for k in range(40))), (1001, " ".join(f"left{k} right{(k + 1) % 40}" for k in range(40)))]
    found = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000).collect()}
    assert abs(found[1000].base_score - found[1001].base_score) < 1e-6
    assert found[1000].score > found[1001].score + 20
