import corpus_pipeline as P
from colloquy.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_the_stage_drops_what_the_operator_predicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score_texts(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).select("doc_id", "score", "predicted").collect()
    toxic = {r["doc_id"] for r in scored if r["predicted"]}
    kept = {r["doc_id"] for r in P.reject_toxic(spark, docs, SF).select("doc_id").collect()}
    print(len(toxic), sum(0.3 <= r["score"] < 0.5 for r in scored))
    assert any(0.3 <= r["score"] < 0.5 for r in scored)
    assert kept == {r["doc_id"] for r in scored} - toxic
