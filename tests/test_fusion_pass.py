"""Fusions of both rankings: texts are read once, and queries come out once."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from colloquy.operators import retrieval
from colloquy.plans import retrieval_queries as P

DATA = "/root/testdata/sf0.01"


def read_of(spark, docs):
    """docs(doc_id, text), and a counter of the rows that are read of it."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return docs.mapInArrow(seen, docs.schema), read


def test_fusion_reads_texts_once(spark, monkeypatch):
    """one pass over the documents yields both rankings, as the single queries have them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = {(r["query_id"], r["doc_id"]): 0.0 for ranking in (P.bm25_ranking, P.cosine_ranking) for r in ranking(spark, DATA).collect()}
    for ranking in (P.bm25_ranking, P.cosine_ranking):
        for r in ranking(spark, DATA).collect():
            want[r["query_id"], r["doc_id"]] += 1 / (60 + r["rank"])
    watched, read = read_of(spark, docs)
    monkeypatch.setattr(P, "docs", lambda spark, d: watched)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in P.rrf_fusion(spark, DATA).collect()}
    assert read.value == docs.count()
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


@pytest.mark.parametrize("fusion", ["rrf_fusion", "convex_fusion", "logodds_fusion"])
def test_a_pair_comes_out_once(spark, monkeypatch, fusion):
    """With more partitions than the tests' four, sides of a union that Spark takes to be partitioned alike were not put together."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = [(r["query_id"], r["doc_id"]) for r in P.Q[fusion](spark, DATA).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(rows) == len(set(rows)) > 400


@pytest.mark.parametrize("words", [500_000, 50])
def test_early_terms_are_whole(spark, monkeypatch, words):
    """The first terms by alphabet, found with many that sink out of a task's first ones on the way: vocabulary and vectors as counted by hand."""
    rng = np.random.default_rng(9)
    names = sorted({f"{w:03x}" for w in range(400)} | {"я", "ёж", "а1", "ab", "é"})
    docs = [(i, " ".join(rng.choice(names, int(rng.integers(1, 30))))) for i in range(300)] + [(300, None), (301, ""), (302, "000 1 22")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(0, "00a 0ab 001"), (1, "ab 10a 10a")], "query_id int, text string")
    said = {i: [w for w in (t or "").split() if len(w) > 1 and not w.isdigit() and w != "é"] for i, t in docs}
    df = Counter(w for ws in said.values() for w in set(ws))
    first = sorted(df)[:20]
    idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in first}
    monkeypatch.setattr(retrieval, "MOST_WORDS", words)
    v = retrieval.tfidf_vocabulary(d, 20)
    assert [(r["term"], r["df"]) for r in v.orderBy("idx").collect()] == [(w, df[w]) for w in first]
    vector = lambda ws: {w: n / len(ws) * idf[w] for w, n in Counter(ws).items() if w in idf}
    unit = lambda x: {w: y / math.sqrt(sum(z * z for z in x.values())) for w, y in x.items()}
    want = {}
    for i, ws in said.items():
        for j, text in ((0, "00a 0ab"), (1, "ab 10a 10a")):
            x, y = unit(vector(ws)), unit(vector([w for w in text.split() if not w.isdigit()]))
            if (s := round(sum(x[w] * y[w] for w in x if w in y), 6)) > 0:
                want.setdefault(j, []).append((-s, i))
    got = retrieval.bm25_and_cosine(d, "doc_id", q, dimension=20).where("channel = 'dense'").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(j, i) for j in sorted(want) for _, i in sorted(want[j])[:10]]
    assert [r["score"] for r in got] == pytest.approx([-s for j in sorted(want) for s, _ in sorted(want[j])[:10]], abs=1e-6)


def test_boost_reads_texts_twice(spark, monkeypatch):
    """once for the rankings and once for the entities of the few documents they leave; gains as added up by hand."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    fused = {}
    for r in P.rrf_fusion(spark, DATA).collect():
        fused.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    long = lambda text: {w for w in re.findall("[а-яёa-z0-9]+", (text or "").lower()) if len(w) >= 12}
    said, asked = ({r[0]: long(r[1]) for r in df.collect()} for df in (docs, P.asked(spark, DATA)))
    want = {(q, i): round(-s + sum(0.15 if len(w) >= 14 else 0.1 for w in said[i] & asked[q]), 6) for q, found in fused.items() for s, i in sorted(found)[:10]}
    watched, read = read_of(spark, docs)
    monkeypatch.setattr(P, "docs", lambda spark, d: watched)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in P.ner_boost(spark, DATA).collect()}
    assert read.value == 2 * docs.count()
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def joined(plan):
    """Rows that the joins of an executed plan have made."""
    children = plan.children()
    rows = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return rows + sum(joined(children.apply(i)) for i in range(children.size()))


def test_boost_compares_the_pairs_it_is_given(spark):
    """an entity of all queries and all documents makes rows for the pairs that are to be boosted, not for each query and document."""
    n = 300
    fused = spark.createDataFrame([(q, d % n, 1.0) for q in range(n) for d in (q, q + 1)], "query_id long, doc_id long, score double")
    asked = spark.createDataFrame([(q, w, w, "ORG") for q in range(n) for w in ("everywhere", f"only {q}")], "query_id long, entity string, normal string, kind string")
    docs = spark.createDataFrame([(d, w) for d in range(n) for w in ("everywhere", f"only {d}")], "doc_id long, entity string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        boosted = retrieval.boost_by_entities(fused, "doc_id", asked, docs)
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in boosted.collect()}
        made = joined(boosted._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {(q, d % n): 1.2 if d == q else 1.1 for q in range(n) for d in (q, q + 1)}
    assert 0 < made <= 9 * n  # 4 n entities of the pairs' queries, 3 n of them met, 2 n pairs with their gain
