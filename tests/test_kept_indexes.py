"""Kept indexes: vectors against exact search after every step, postings against BM25 without an index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import retrieval
from colloquy.sources import lexical
from colloquy.sources.lexical import LexicalIndex
from colloquy.sources.vectors import VectorIndex

SCHEMA = "vec_id long, dialogue_id string, embedding array<double>"


def exact(held, queries, k):
    out = []
    for q, x in queries:
        s = [(-round(float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x))) if np.linalg.norm(v) else 0.0, 6) + 0.0, i, d) for i, (d, v) in held.items()]
        out += [(q, i, d, -s or 0.0, r + 1) for r, (s, i, d) in enumerate(sorted(s)[:k])]
    return sorted(out)


def test_vectors_agree_with_exact_search_after_every_step(spark, tmp_path):
    rng = np.random.default_rng(4)
    vec = lambda: [float(x) for x in rng.normal(size=5)]
    index, held = VectorIndex(spark, str(tmp_path / "v"), 5), {}
    queries = [(q, vec()) for q in range(6)]
    asked = spark.createDataFrame(queries, "query_id int, query array<double>")

    def same(index=index):
        got = sorted((r["query_id"], r["vec_id"], r["dialogue_id"], r["score"], r["rank"]) for r in index.search(asked, 4).collect())
        assert got == exact(held, queries, 4)

    def add(rows):
        refused = index.add(spark.createDataFrame(rows, SCHEMA)).count()
        held.update({i: (d, v) for i, d, v in rows if v is not None and len(v) == 5})
        return refused

    assert index.search(asked, 4).collect() == []
    assert add([(i, f"d{i % 5}", vec()) for i in range(40)] + [(98, "d1", [1.0]), (99, "d1", None)]) == 2
    same()
    size = index.store.segments("vectors")
    add([(100, "d7", vec()), (3, "d7", vec()), (101, "d8", [0.0] * 5)])  # vector 3 is replaced, 101 is zero
    same()
    new = [s for s in index.store.segments("vectors") if s not in size]
    assert sum(spark.read.parquet(s["path"]).count() for s in new if s["kind"] == "rows") == 3
    index.delete_dialogues(spark.createDataFrame([("d2",), ("d7",), ("none",)], "dialogue_id string"))
    held = {i: x for i, x in held.items() if x[0] not in ("d2", "d7")}
    same()
    add([(200, "d2", vec())])  # a dialogue that was deleted comes back
    same()
    assert index.compact() > 0 and len(index.store.segments("vectors")) == 1
    same()
    same(VectorIndex(spark, str(tmp_path / "v"), 5))  # read again by another
    index.replace_dialogues(spark.createDataFrame([(300, "d1", vec())], SCHEMA))
    last = index.live().where("vec_id = 300").first()
    held = {i: x for i, x in held.items() if x[0] != "d1"} | {300: ("d1", last["embedding"])}
    same()
    assert tuple(index.stats().first()) == (len(held), len({d for d, _ in held.values()}), len(held) * 20)
    some = spark.createDataFrame([("d3",), ("d3",)], "dialogue_id string")
    assert {r["dialogue_id"] for r in index.search(asked, 4, some).collect()} == {"d3"}


def test_both_ways_of_vector_search_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(300)] + [(300, None), (301, []), (302, [1.0]), (303, [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (1, [1.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [])], "query_id int, query array<double>")
    got = []
    for limit in (1 << 25, 0):
        monkeypatch.setattr(retrieval, "MOST_QUERY_BYTES", limit)
        got.append(sorted(tuple(r) for r in retrieval.vector_top_k(vectors, "vec_id", asked, 7, 50).collect()))
    assert got[0] == got[1] and len(got[0]) == 35


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(2000)]
    p = 1 / np.arange(1, 2001)
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)), p=p / p.sum()))) for i in range(4000)] + [(9000, None), (9001, ""), (9002, "и в во")]
    asked = [(q, docs[int(rng.integers(0, 4000))][1]) for q in range(15)] + [(90, "nothing"), (91, None)]
    return spark.createDataFrame(docs, "doc_id long, text string").cache(), spark.createDataFrame(asked, "query_id int, text string").cache()


def test_postings_rank_like_bm25_and_leave_blocks_out(spark, tmp_path, texts):
    docs, asked = texts
    index = LexicalIndex(spark, str(tmp_path / "l"))
    rows = lambda df, key: sorted((r["query_id"], r[key], r["score"], r["rank"]) for r in df.collect())
    assert index.search(asked).collect() == []
    parts = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")]
    for i, part in enumerate(parts):
        index.add(part, "doc_id")
        held = docs if i else part
        assert rows(index.search(asked), "key") == rows(retrieval.bm25(held, "doc_id", asked), "doc_id")
    read: dict[int, dict] = {}
    for k in (1, 10, 4000):
        read[k] = {}
        index.search(asked, k, read=read[k]).collect()
    assert read[1]["postings_scored"] < read[10]["postings_scored"] < read[4000]["postings_scored"] == read[4000]["postings"]
    assert read[1]["postings_scored"] < 0.5 * read[1]["postings"]


def test_an_added_segment_leaves_the_others(spark, tmp_path, texts):
    docs, _ = texts
    index = LexicalIndex(spark, str(tmp_path / "l"))
    index.add(docs.where("doc_id < 100"), "doc_id")
    before = index.store.segments("postings")
    index.add(docs.where("doc_id >= 3900"), "doc_id")
    assert index.store.segments("postings")[:1] == before and len(index.store.segments("postings")) == 2
    index.store.compact("postings")
    assert len(index.store.segments("postings")) == 1
    heads = index.store.read("postings")
    assert heads.where("n <> size(docs) or max_tf <> array_max(transform(docs, d -> d.tf)) or min_dl <> array_min(transform(docs, d -> d.dl))").count() == 0
    assert heads.agg(F.max("n")).first()[0] <= 4 * lexical.BLOCK
