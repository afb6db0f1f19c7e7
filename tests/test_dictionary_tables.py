"""Dictionaries as tables: search against a plain recursive one, labels, channels, limits and plan size."""

import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.operators import dicttables, timegap
from colloquy.operators import search as search_module
from colloquy.operators.dictionary import Condition, Limit, Node, Token, conditions_of, holds
from colloquy.operators.search import search, search_tables
from colloquy.schemas import CHANNELS, CLIENT, OPERATOR
from colloquy.sources import dictionary_xml

WORDS = ["a", "b", "c", "d", "e", "f"]


def plain(dialogues, roots, cascade=True):
    """One dialogue and node after the other: (matches, level counts)."""
    matches, levels = [], []
    for did, turns in dialogues.items():
        toks = [re.findall("[а-яёa-z0-9]+", t["text"]) for t in turns]
        counts: dict = {}
        found: list = []

        def inside(i, x, times, turns=turns):
            s, e, n = turns[i]["start"], turns[i]["end"], float(x.value)
            if x.event == "Parent":
                if not times or x.unit != "Seconds" or x.direction not in ("Before", "After"):
                    return True
                some = {"First": times[:1], "Last": times[-1:]}.get(x.selector, times)
                ws = [(t - n, t) if x.direction == "Before" else (t, t + n) for t in some]
                return any(s <= b and e >= a for a, b in ws) == x.only
            mine = [j for j, t in enumerate(turns) if x.channel == "ANY" or t["speaker"] == CHANNELS[x.channel]]
            if x.value <= 0 or not mine:
                return True
            if x.unit == "Phrases":
                return (i in (mine[: x.value] if x.end == "First" else mine[-x.value :])) == x.only
            if x.unit == "Seconds":
                low, high = (turns[mine[0]]["start"], turns[mine[0]]["start"] + n) if x.end == "First" else (turns[mine[-1]]["end"] - n, turns[mine[-1]]["end"])
            else:
                spoken = [j for j in mine if turns[j]["text"].split()]
                if not spoken:
                    return True
                run, at = 0, None
                for j in spoken if x.end == "First" else spoken[::-1]:
                    run += len(turns[j]["text"].split())
                    if run >= x.value:
                        at = j
                        break
                if x.end == "First":
                    low, high = turns[spoken[0]]["start"], turns[spoken[-1] if at is None else at]["end"]
                else:
                    low, high = turns[spoken[0] if at is None else at]["start"], turns[spoken[-1]]["end"]
            return (s <= high and e >= low) == x.only

        def visit(node, name, level, order, times, turns=turns, toks=toks, counts=counts, found=found):
            if node.conditions:
                own, got, own_times, barred = [], set(), [], False
                for c in node.conditions:
                    hit = [i for i, t in enumerate(toks) if c.text in t and (c.channel == "ANY" or turns[i]["speaker"] == CHANNELS[c.channel])]
                    hit = [i for i in hit if all(inside(i, x, times) for x in c.limits if x.enabled)]
                    if c.negated and hit:
                        barred = True
                    if not c.negated and hit:
                        got.add(c.text)
                        own += [(name, c.text, i, level, order) for i in hit]
                        own_times += [turns[i]["start"] for i in hit]
                counts[level] = counts.get(level, 0) + (0 if barred else len(own))
                found += [] if barred else own
                if barred or not (holds(node.conditions, got) if node.gated_by_tree else got):
                    return
                level, times = level + 1, own_times
            for child in node.children:
                visit(child, child.name, level, order, times)

        for k, root in enumerate(roots):
            before = len(found)
            visit(root, root.name, 1, k + 1, None)
            if cascade and len(found) == before:
                break
        matches += [(did, *m) for m in found]
        levels += [(did, level, n) for level, n in counts.items()]
    return sorted(matches), sorted(levels)


def random_limit(r):
    if r.random() < 0.5:
        return Limit("Parent", r.random() < 0.5, r.randint(1, 20), selector=r.choice(["Each", "First", "Last"]), direction=r.choice(["Before", "After"]), enabled=r.random() < 0.9)
    return Limit("StartEnd", r.random() < 0.7, r.randint(0, 12), r.choice(["Seconds", "Words", "Phrases"]), r.choice(["ANY", "CLIENT", "OPERATOR"]), r.choice(["First", "Last"]))


def random_node(r, depth, name):
    conditions = []
    for _ in range(r.choice([0, 1, 2, 3, 3])):
        limits = [random_limit(r) for _ in range(r.choice([0, 0, 0, 1, 2]))]
        conditions.append(Condition(r.choice(WORDS), 2, r.choice(["ANY", "ANY", "CLIENT", "OPERATOR"]), r.random() < 0.5, r.random() < 0.2, r.choice(["", "AND", "OR", "ИЛИ"]), limits))
    children = [random_node(r, depth - 1, f"{name}{i}") for i in range(r.randint(0, 3))] if depth else []
    return Node(name, conditions, children, gated_by_tree=r.random() < 0.8)


def random_dialogues(r, n):
    out = {}
    for d in range(n):
        at, turns = 0.0, []
        for _ in range(r.randint(1, 7)):
            turns.append({"speaker": r.choice([CLIENT, OPERATOR]), "text": " ".join(r.choice([*WORDS, "x", "y"]) for _ in range(r.randint(0, 4))), "start": at})
            at += r.randint(0, 6)
        for t, after in zip(turns, [*turns[1:], turns[-1]], strict=True):
            t["end"] = after["start"]
        out[f"d{d}"] = turns
    return out


def table_of(spark, dialogues):
    rows = [(d, i, t["speaker"], t["text"], None, t["start"], t["end"]) for d, turns in dialogues.items() for i, t in enumerate(turns)]
    return spark.createDataFrame(rows, "dialogue_id string, turn_index int, speaker string, text string, timestamp string, start_offset double, end_offset double")


def rows_of(matches, levels):
    m = [(r["dialogue_id"], r["quarter"], r["phrase_text"], r["turn_index"], r["dict_level"], r["cascade_order"]) for r in matches.collect()]
    return sorted(m), sorted((r["dialogue_id"], r["dict_level"], r["matches"]) for r in levels.collect())


@pytest.mark.parametrize(("seed", "cascade"), [(1, True), (2, True), (3, False), (4, True)])
def test_random_trees(spark, seed, cascade):
    r = random.Random(seed)
    dialogues = random_dialogues(r, 60)
    roots = [random_node(r, 3, f"R{i}") for i in range(4)]
    assert rows_of(*search(table_of(spark, dialogues), roots, cascade=cascade)) == plain(dialogues, roots, cascade)


def test_open_without_hits(spark):
    dialogues = {"d": [{"speaker": CLIENT, "text": "c", "start": 0.0, "end": 1.0}], "e": [{"speaker": CLIENT, "text": "a c", "start": 0.0, "end": 1.0}], "f": [{"speaker": CLIENT, "text": "z", "start": 0.0, "end": 1.0}]}
    roots = [Node("no a", [Condition("a", negated=True)], [Node("box", [], [Node("c", [Condition("c")])])])]
    got = rows_of(*search(table_of(spark, dialogues), roots))
    assert got == plain(dialogues, roots) and got[0] == [("d", "c", "c", 0, 2, 1)] and ("f", 2, 0) in got[1]


def test_files_give_the_same_tables(spark, tmp_path):
    r = random.Random(8)
    roots = [random_node(r, 3, f"R{i}") for i in range(3)]

    def plainer(n):
        n.gated_by_tree = True
        for c in n.conditions:
            c.limits = [Limit(value=4, channel="CLIENT")] if n.name.endswith("1") else []
            c.operator = {"": "AND", "ИЛИ": "OR"}.get(c.operator, c.operator)
        for c in n.conditions[:1]:
            c.operator = ""
        for x in n.children:
            plainer(x)

    for i, root in enumerate(roots):
        plainer(root)
        (tmp_path / f"{i}.xml").write_text(dictionary_xml.serialize(root))
    nodes, conditions = dicttables.labelled(dictionary_xml.read_dictionaries(spark, str(tmp_path)))
    wanted = dicttables.from_nodes(spark, roots)
    for got, want in zip((nodes, conditions), wanted, strict=True):
        want = want.drop("node_id")  # a file's root is 0, trees at hand are numbered
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    dialogues = random_dialogues(r, 30)
    assert rows_of(*search_tables(table_of(spark, dialogues), nodes, conditions)) == plain(dialogues, roots)
    got = rows_of(*search_tables(table_of(spark, dialogues), nodes, conditions, names=["R1"]))
    assert got == plain(dialogues, roots[1:2])


def test_plan_does_not_grow_with_the_dictionary(spark):
    turns = table_of(spark, random_dialogues(random.Random(5), 20))

    def tree(n):
        leaf = lambda i: Node(f"n{i}", [Condition(WORDS[i % 6], limits=[Limit(value=1 + i % 3)]), Condition(f"w{i}", operator="OR")])
        return [Node("root", [Condition("a"), Condition("b", operator="OR")], [Node(f"g{j}", [Condition(WORDS[j % 6])], [leaf(i) for i in range(j, n, 100)]) for j in range(100)])]

    sizes = {}
    for n in (200, 20_000):
        matches, levels = search(turns, tree(n))
        found = matches.groupBy("dict_level").count().collect()
        assert len(found) == 3
        sizes[n] = len(matches._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert sizes[200] == sizes[20_000]


def test_channels_in_any_case(spark):
    tokens = [Token("a", channel="client"), Token("ИЛИ", "LEXEME"), Token("b", channel="Operator"), Token("OR", "LEXEME"), Token("c", channel="other")]
    found = conditions_of(tokens)
    assert [(c.text, c.channel, c.operator) for c in found] == [("a", "CLIENT", ""), ("b", "OPERATOR", "OR"), ("c", "ANY", "OR")]
    dialogues = {"d": [{"speaker": CLIENT, "text": "a b", "start": 0.0, "end": 1.0}, {"speaker": OPERATOR, "text": "a b", "start": 1.0, "end": 2.0}]}
    got = search(table_of(spark, dialogues), [Node("n", [Condition("a", channel="client"), Condition("b", channel=" operator", operator="OR")])])[0]
    assert {(r["phrase_text"], r["turn_index"]) for r in got.collect()} == {("a", 0), ("b", 1)}


def test_marks_are_terminals():
    quote = Token('"', "TERMINAL")
    assert [(c.text, c.exact) for c in conditions_of([Token('"'), Token("a"), Token('"')])] == [('" a "', False)]
    assert [(c.text, c.exact) for c in conditions_of([quote, Token("a"), quote, quote, Token("b"), quote, Token("c")])] == [("a", True), ("b", True), ("c", False)]
    assert [(c.text, c.exact) for c in conditions_of([quote, Token("a"), Token("(", "TERMINAL"), Token("b")])] == [("a", True), ("b", False)]


def test_parent_windows_of_one_long_dialogue(spark):
    n = 100_000
    hits = spark.range(n).select(F.lit("d").alias("dialogue_id"), F.col("id").cast("int").alias("turn_index"), (F.col("id") * 3.0).alias("start_offset"), (F.col("id") * 3.0 + 1).alias("end_offset"))
    parents = hits.where("turn_index % 7 = 0").select("dialogue_id", "start_offset", F.col("turn_index").alias("ord"))
    got = {r[0] for r in timegap.near_parent(hits, parents, Limit("Parent", True, 4)).select("turn_index").collect()}
    assert got == {i for i in range(n) if any(j < n and 3 * i <= 3 * j and 3 * i + 1 >= 3 * j - 4 for j in (i + d for d in range(3)) if j % 7 == 0)}


def test_hits_are_not_written_for_every_condition(spark, monkeypatch):
    """Fifty trees with the same word: without limits a row for each of its turns is written, not one for each tree and turn."""
    roots = [Node(f"R{i}", conditions=[Condition("раз")], children=[Node(f"C{i}", conditions=[Condition("два")])]) for i in range(50)]
    turns = table_of(spark, {f"d{i}": [{"speaker": CLIENT, "text": "раз два раз", "start": 0.0, "end": 2.0}, {"speaker": OPERATOR, "text": "раз", "start": 2.0, "end": 3.0}] for i in range(4)})
    sizes, write = [], search_module.written
    monkeypatch.setattr(search_module, "written", lambda df, name: (out := write(df, name), sizes.append((name, out.count())))[0])
    matches, levels = search(turns, roots, cascade=False)
    assert matches.count() == 4 * 50 * 3 and {tuple(r)[1:] for r in levels.collect()} == {(1, 100), (2, 50)}
    assert dict(sizes)["search-found"] == 4 * 3 and max(n for name, n in sizes) <= 4 * 50 * 2
