"""Kept hits against a full search, after dialogues, nodes and limits change."""

import random

from pyspark.sql import functions as F
from test_dictionary_tables import random_dialogues, random_node, rows_of, table_of

from colloquy.operators import dicttables
from colloquy.operators.dictionary import Condition, Limit
from colloquy.operators.incremental import KeptSearch, fingerprints
from colloquy.operators.search import search


def test_only_what_has_changed_is_matched_again(spark, tmp_path):
    r = random.Random(21)
    dialogues, roots = random_dialogues(r, 100), [random_node(r, 2, f"R{i}") for i in range(3)]
    kept = KeptSearch(spark, str(tmp_path / "k"), ttl_seconds=3600)
    at = lambda hours: F.timestamp_seconds(F.lit(1_700_000_000 + 3600.0 * hours))

    def same(hours, whole=True):
        turns = table_of(spark, dialogues)
        if whole:
            matches, levels, done = kept.search(turns, *dicttables.from_nodes(spark, roots), now=at(hours))
            assert rows_of(matches, levels) == rows_of(*search(turns, roots))
        else:
            done = kept.refresh(turns, dicttables.from_nodes(spark, roots)[1], at(hours))
        return done["dialogues"], done["patterns"], done["hits"]

    first = same(0, False)
    assert first[0] == 100 and first[1] > 3 and same(0.5, False) == (0, 0, 0)
    dialogues["d7"] = dialogues["d7"] + [dict(dialogues["d7"][-1], text="a b c d e f")]
    again = same(0.6, False)
    assert again[0] == 1 and again[1] == 0 and 0 < again[2] < first[2] / 10  # one of a hundred
    roots[1].conditions.append(Condition("f", 1, "CLIENT", True, operator="OR"))
    assert same(0.7, False)[:2] == (0, 1)  # one new phrase, in all dialogues
    roots[1].conditions[-1].limits = [Limit(value=4)]
    roots[0], roots[2] = roots[2], roots[0]
    assert same(0.8) == (0, 0, 0)  # neither limits nor places are matched
    del dialogues["d9"]
    roots[1].conditions.pop()
    assert same(0.9, False) == (0, 0, 0)
    assert kept.store.read("dialogues").count() == 99 and kept.store.read("hits").where("dialogue_id = 'd9'").count() == 0
    assert same(1.5, False)[0] == 98 and same(1.55, False)[0] == 0  # all but d7 were matched over an hour ago
    kept.compact()
    kept.clear()
    assert kept.store.read("hits").count() == 0 and same(1.6)[0] == 99


def test_fingerprints_tell_turns_apart(spark):
    schema = "dialogue_id string, turn_index int, speaker string, text string, start_offset double, end_offset double"
    rows = [("a", 0, "x", "hi", None, None), ("b", 0, "x", "hi", 0.0, None), ("c", 0, "x", None, None, None), ("d", 0, None, "hi", None, None), ("e", 0, "x", "hi", None, None), ("e", 0, "x", "hi", None, None), ("f", 0, "x", "hi", None, None)]
    got = {r["dialogue_id"]: (r["a"], r["b"], r["n"]) for r in fingerprints(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"] == got["f"] and len({got[k] for k in "abcde"}) == 5
