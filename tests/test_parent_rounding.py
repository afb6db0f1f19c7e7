"""Ties of Parent windows: the window's ends are sums on the parent's time, rounded there."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import search, timegap
from colloquy.operators.dictionary import Condition, Limit, Node

#: (earlier, later) times of fifteenths, ten seconds apart, each pair a dialogue.
TIED = [(i / 15, (i + 150) / 15) for i in range(3000)]


def dialogues_of(spark, parent, hit):
    frame = lambda rows: spark.createDataFrame(rows, "dialogue_id string, start_offset double, end_offset double, ord int")
    return frame([(str(i), p[parent], p[parent], 0) for i, p in enumerate(TIED)]), frame([(str(i), p[hit], p[hit], 0) for i, p in enumerate(TIED)])


def test_ties_after_a_parent(spark):
    parents, hits = dialogues_of(spark, 0, 1)
    got = {r[0] for r in timegap.near_parent(hits, parents, Limit("Parent", True, 10, selector="First", direction="After")).select("dialogue_id").collect()}
    assert got == {str(i) for i, (t, s) in enumerate(TIED) if s <= t + 10}
    assert any((s <= t + 10) != (s - 10 <= t) for t, s in TIED)


def test_ties_before_a_parent(spark):
    parents, hits = dialogues_of(spark, 1, 0)
    got = {r[0] for r in timegap.near_parent(hits, parents, Limit("Parent", True, 10, selector="Each", direction="Before")).select("dialogue_id").collect()}
    assert got == {str(i) for i, (e, t) in enumerate(TIED) if e >= t - 10}
    assert any((e >= t - 10) != (e + 10 >= t) for e, t in TIED)


@pytest.mark.parametrize("direction", ["After", "Before"])
def test_ties_in_a_dictionary_search(spark, direction):
    said = [(str(i), k, "Клиент", word, at, at) for i, p in enumerate(TIED) for k, (word, at) in enumerate(zip(("up", "down") if direction == "After" else ("down", "up"), p, strict=True))]
    turns = spark.createDataFrame(said, "dialogue_id string, turn_index int, speaker string, text string, start_offset double, end_offset double")
    child = Node("child", [Condition("down", exact=True, limits=[Limit("Parent", True, 10, direction=direction)])])
    got = search.search(turns, [Node("root", [Condition("up", exact=True)], [child])])[0].where(F.col("quarter") == "child")
    good = (lambda p: p[1] <= p[0] + 10) if direction == "After" else (lambda p: p[0] >= p[1] - 10)
    assert {r[0] for r in got.select("dialogue_id").collect()} == {str(i) for i, p in enumerate(TIED) if good(p)}
