from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


def test_long_documents_do_not_move_a_source_from_its_target(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = {r["source"]: r["target"] for r in P.mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    words, times = Counter(), Counter()
    for r in P.mix(spark, docs, SF).collect():
        words[r["source"]] += len(r["text"].split())
        times[r["doc_id"]] += 1
    assert max(times.values()) <= P.CAP
    for s, t in target.items():
        assert abs(words[s] - t) <= 0.01 * t, (s, words[s], t)


def test_rows_without_an_id_do_not_round_alike(spark):
    rows = [(None, f"s{i % 2}", f"w{i} " + "x " * 99) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    target = {r["source"]: r["target"] for r in P.mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    words = {r["source"]: r["n"] for r in P.mix(spark, docs, "").groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    for s, t in target.items():
        assert abs(words[s] - t) <= 100, (s, words[s], t)


def test_whole_copies():
    sizes = np.array([5000, 900] + [20] * 50 + [0])
    taken = sizes * 2 // 5
    got = P.whole_copies(sizes, taken, np.full(len(sizes), 0.9))  # without the longest: it is more than all that is taken
    assert got[0] == got[-1] == 0 and got.max() <= 3 and abs((got * sizes).sum() - taken.sum()) <= 10
    assert P.whole_copies(np.array([100]), np.array([60]), np.array([0.0])).tolist() == [1]
    assert P.whole_copies(np.array([100]), np.array([300]), np.array([0.5])).tolist() == [3]
