"""Ranking by presence masks against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import maskrank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=20):
    terms = lambda text: TERM.findall((text or "").translate(LOWER))
    held = [(d, Counter(t)) for d, text in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = Counter(t for text in {x for i, x in items if i == item} for t in terms(text))
        scored = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(times * w(t) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)] + ["été", "日本", "Straße", "x9"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum()))) for i in range(600)]
    docs += [(600, None), (601, ""), (602, " ?! "), (None, "w3 w4 w5 w250"), (None, "w3"), (603, "W3,w3;W3-w3"), (5, "w3 w3"), (5, "w3 w3"), (604, "w299 " * 30_000 + "w5"), (605, "a" * 3_000_000 + " w7")]
    docs += [(1000 + i, "w10 w20 w30") for i in range(90)]  # ties
    items = [(j, " ".join(rng.choice(words, 30))) for j in range(12)]
    items += [(12, None), (13, ""), (14, "no such term"), (None, "w7 w8"), (15, "w3"), (15, "w3"), (15, "w5 W5"), (16, "w10 w20 w30"), (17, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("block", [64, 8192])
def test_ranks_like_brute_force(spark, monkeypatch, block):
    docs, items = corpus()
    monkeypatch.setattr(maskrank, "BLOCK", block)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("x"), "score": F.lit(2), "rank": F.lit(0)}).repartition(7)
    i = spark.createDataFrame(items, "item_id int, text string").withColumns({"times": F.lit(1), "term": F.lit("t"), "doc_id": F.lit(9)})
    got = maskrank.rank_documents(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_slices_of_items_give_the_same(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(maskrank, "SLICE_BYTES", 2_000)
    got = maskrank.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 3)


def test_masks_below_the_floor_are_not_scored():
    rng = np.random.default_rng(1)
    off, terms = [0], []
    for _ in range(5000):
        terms += sorted(set(rng.integers(0, 60, 4)))
        off.append(len(terms))
    adds = rng.integers(900, 1000, len(terms))
    block = maskrank.Block(np.arange(5000), np.ones(5000, bool), np.array(off), np.array(terms), adds)
    asked, times, best, every = np.arange(8), np.ones(8, np.int64), maskrank.Best(20), np.zeros(60, np.int64)
    best.search(block, asked, times, every)
    whole = np.array([sum(a for a, t in zip(adds[x:y], terms[x:y], strict=True) if t < 8) for x, y in zip(off[:-1], off[1:], strict=True)])
    order = np.lexsort((np.arange(5000), -whole))[:20]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == whole[order].tolist()
    assert best.evaluated < 0.1 * (whole > 0).sum()


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert maskrank.rank_documents(none, items).collect() == []
    assert maskrank.rank_documents(some, items.limit(0)).collect() == []
