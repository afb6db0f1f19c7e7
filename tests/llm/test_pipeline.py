from collections import Counter, defaultdict

import duckdb
import pytest
from test_mixing_sharding import check_shards
from test_neardup import brute, shingles

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in P.STAGES:
        out.append(P.materialise(f(spark, out[-1], SF), f"test-{name}"))
    return out


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_columns(stages):
    assert [s.columns for s in stages[1:-1]] == [stages[0].columns] * 4 and P.ORACLE_SQL is None


def test_toxic_documents_go_and_clean_ones_stay(stages):
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    kept = {d for d, _ in texts(stages[1])}
    gone = {d for d, _ in texts(stages[0])} - kept
    assert sum(toxic[d] for d in gone if d in toxic) > 0.6 * sum(toxic.values()) and sum(d in kept for d, t in toxic.items() if not t) > 0.97 * sum(not t for t in toxic.values())


def test_one_of_each_group_stays(stages):
    want = {d for d, _, c, kept in brute(texts(stages[1]), 80) if kept}
    assert {d for d, _ in texts(stages[2])} == want


def test_documents_with_items_go(stages):
    items = [s for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall() if len(s := shingles((t or "").lower())) and len(next(iter(s))) == 5]
    leak = lambda t: (s := shingles(t.lower())) and any(len(i & s) >= 0.8 * len(i) for i in items)
    assert texts(stages[3]) == [x for x in texts(stages[2]) if not leak(x[1])]


def test_mix_keeps_sources_near_their_targets(spark, stages):
    target = {r["source"]: r["target"] for r in P.mixing.mix_sources(stages[3]).select("source", "target").distinct().collect()}
    words, times = Counter(), defaultdict(int)
    for r in stages[4].collect():
        words[r["source"]] += len(r["text"].split())
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 3
    assert abs(sum(words.values()) / sum(target.values()) - 1) < 0.1


def test_shards_hold_all(stages):
    out = stages[5].collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in stages[4].collect())
    sizes = check_shards(out, 16)
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in out)


def test_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    assert docs.limit(0).columns == docs.columns


CLASHES = ["size", "taken", "target", "source_size", "shard", "slot", "_group", "_own", "predicted", "score", "lang", "rid", "words", "doc_id_", "_gone_id_", "_leak_id_"]


def test_columns_that_are_named_like_added_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").drop("lang")
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, P.F.concat(P.F.lit(f"{i}:"), P.F.col("doc_id")))
    for name, f in P.STAGES[:-1]:
        out = P.materialise(f(spark, docs, "/root/testdata/sf0.001"), f"clash-{name}")
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"`{c}` <> concat('{i}:', doc_id)" for i, c in enumerate(CLASHES))).count() == 0
        docs = out
    last = P.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert last.count() == docs.count() and last.where("_group <> concat('6:', doc_id)").count() == 0
