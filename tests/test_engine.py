import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import chunker, corpus, dictops, pii, retrieval, search, timegap
from colloquy.operators.dictionary import Condition, Limit, Node, Token, conditions_of, flatten, holds, select_roots
from colloquy.operators.matcher import match_phrases, phrase_row
from colloquy.sources import dictionary_xml, rtf, turns
from colloquy.sources.tables import Table

C, O = "Клиент", "Сотрудник"


def dialogue(spark, rows):
    return spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "dialogue_id string, turn_index int, speaker string, text string, start_offset double, end_offset double")


def greedy(text, phrase, wd):
    """Scan windows from the left; give each phrase word the first unused equal token."""
    toks = [(m.group(), m.start(), m.end()) for m in re.finditer(X.TOKEN, text.lower())]
    words = re.findall(X.TOKEN, phrase.lower())
    for i in range(len(toks) - len(words) + 1 if words else 0):
        window, used = toks[i : i + len(words) + wd], []
        for w in words:
            j = next((j for j, t in enumerate(window) if t[0] == w and j not in used), None)
            if j is None:
                break
            used.append(j)
        else:
            return min(window[j][1] for j in used), max(window[j][2] for j in used)
    return None


def test_matcher_equals_greedy_scan(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice(["да", "нет", "мы", "ё", "A", "b1"]) + rng.choice([" ", ", ", "! ", "é"]) for _ in range(n))
    rows = [(C, text(rng.randrange(12)), None, None) for _ in range(150)] + [(C, None, None, None), (C, "", None, None)]
    conds = [(p, wd) for p in ("да нет", "мы мы", "ё", "a b1 да", "нет да нет", "!!!") for wd in (0, 1, 3)]
    got = {(r["cond_id"], r["turn_index"]): (r["matched_start"], r["matched_end"]) for r in match_phrases(dialogue(spark, rows), [phrase_row(f"{p}|{wd}", p, wd, "ANY", True) for p, wd in conds]).collect()}
    want = {(f"{p}|{wd}", i): greedy(t or "", p, wd) for p, wd in conds for i, (_, t, _, _) in enumerate(rows)}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("wd,turns_hit", [(0, {0, 1}), (1, {0, 1, 2}), (2, {0, 1, 2})])
def test_word_distance(spark, wd, turns_hit):
    rows = [(C, t, None, None) for t in ("перейду на другую связь", "я перейду на другую связь", "я перейду завтра на другую связь", "я перейду вот прямо сейчас на другую связь", "перейду связь")]
    got = match_phrases(dialogue(spark, rows), [phrase_row("p", "перейду на другую связь", wd, "CLIENT")])
    assert {r["turn_index"] for r in got.collect()} == turns_hit


def test_canonical_forms(spark):
    lemmas = spark.createDataFrame([("переходить", "переходить"), ("перешёл", "перейти")], "form string, lemma string")
    rows = [(C, t, None, None) for t in ("буду переходить на мтс", "я буду переходить от вас на мтс", "перешёл на мтс")]
    got = lambda wd: {r["turn_index"] for r in match_phrases(dialogue(spark, rows), [phrase_row("p", "перейти мтс", wd)], lemmas).collect()}
    assert got(1) == {0, 2} and got(2) == {0, 2}


def found(spark, rows, roots, **kw):
    m, levels = search.search(dialogue(spark, rows), roots, **kw)
    return sorted((r["quarter"], r["phrase_text"], r["turn_index"], r["dict_level"]) for r in m.collect()), {r["dict_level"]: r["matches"] for r in levels.collect()}


def test_gates_cascade_containers_and_suppression(spark):
    rows = [(C, t, None, None) for t in ("расторгнуть договор", "отказываюсь диагностики", "расторгнуть отказываюсь")]
    q2 = Node("Q2", [Condition("отказываюсь")])
    got, levels = found(spark, rows, [Node("Q1", [Condition("расторгнуть", 1, "CLIENT")], [q2])])
    assert [g[::2] for g in got] == [("Q1", 0), ("Q1", 2), ("Q2", 1), ("Q2", 2)] and levels == {1: 2, 2: 2}
    assert found(spark, rows, [Node("Q1", [Condition("нет")], [q2])]) == ([], {1: 0})
    two = [Node("A", [Condition("нет")]), Node("B", [Condition("договор")])]
    assert found(spark, rows, two)[0] == [] and len(found(spark, rows, two, cascade=False)[0]) == 1
    got, levels = found(spark, rows, [Node("box", children=[Node("inner", children=[q2])])])
    assert {g[3] for g in got} == {1} and levels == {1: 2}
    no = Node("Q", [Condition("расторгнуть"), Condition("диагностики", negated=True)], [q2])
    assert found(spark, rows, [no]) == ([], {1: 0})
    assert found(spark, rows, two, names=["B"])[0][0][0] == "B" and select_roots(two, ["B"]) == [two[1]]
    assert found(spark, [], two) == ([], {})


T5 = [(C, "привет всем", 0.0, 5.0), (O, "здравствуйте", 5.0, 10.0), (C, "хочу расторгнуть договор", 25.0, 30.0), (O, "давайте обсудим", 30.0, 35.0), (C, "отказываюсь", 55.0, 60.0)]


@pytest.mark.parametrize(
    "limit,kept",
    [
        (Limit(value=10, only=False), {2, 3, 4}),
        (Limit(value=10), {0, 1}),
        (Limit(value=15, end="Last"), {4}),
        (Limit(value=10, channel="CLIENT"), {0, 1}),
        (Limit(value=10, unit="Words", only=False), set()),
        (Limit(value=3, unit="Words"), {0, 1}),
        (Limit(value=2, unit="Words", end="Last"), {2, 3, 4}),
        (Limit(value=2, unit="Words", channel="CLIENT"), {0, 1}),
        (Limit(value=10, unit="Phrases", channel="OPERATOR", only=False), {0, 2, 4}),
        (Limit(value=2, unit="Phrases"), {0, 1}),
        (Limit(value=2, unit="Phrases", end="Last"), {3, 4}),
        (Limit(value=0), {0, 1, 2, 3, 4}),
        (Limit(value=5, unit="Years"), {0, 1, 2, 3, 4}),
    ],
)
def test_windows(spark, limit, kept):
    t = timegap.in_window(dialogue(spark, T5), limit, "w").where(timegap.passes(F.col("w"), limit.only))
    assert {r["turn_index"] for r in t.collect()} == kept
    bare = timegap.in_window(dialogue(spark, [(s, x, None, None) for s, x, _, _ in T5]), limit, "w").where(timegap.passes(F.col("w"), limit.only))
    assert bare.count() == 5


@pytest.mark.parametrize("limit,kept", [(Limit("Parent", True, 5), {2, 4}), (Limit("Parent", True, 5, selector="First", direction="After"), {2, 3}), (Limit("Parent", False, 5), {0, 1, 3}), (Limit("Parent", True, 5, selector="Last"), {4}), (Limit("Parent", True, 5, direction="?"), {0, 1, 2, 3, 4})])
def test_parent_windows(spark, limit, kept):
    parents = spark.createDataFrame([("d", 25.0, 0), ("d", 55.0, 1)], "dialogue_id string, start_offset double, ord int")
    assert {r["turn_index"] for r in timegap.near_parent(dialogue(spark, T5), parents, limit).collect()} == kept
    assert timegap.near_parent(dialogue(spark, T5), parents.limit(0), limit).count() == 5


def test_expressions():
    c = lambda t, op="", neg=False: Condition(t, operator=op, negated=neg)
    assert not holds([c("A"), c("B", "AND")], {"A"}) and holds([c("A"), c("B", "OR")], {"B"}) and holds([c("A", neg=True)], set())
    assert holds([c("A"), c("B", "OR"), c("C", "AND")], {"A"}) and not holds([c("A"), c("B", "OR"), c("C", "AND")], {"B"}) and not holds([c("A"), c("B")], {"A"}) and holds([], set())
    toks = [Token("a", channel="CLIENT", distance="0"), Token(" ", "WHITESPACE"), Token("b"), Token("ИЛИ", "LEXEME"), Token("НЕ", "LEXEME"), Token("(", "TERMINAL"), Token('"', "TERMINAL"), Token("c"), Token('"', "TERMINAL"), Token(")", "TERMINAL"), Token("d")]
    got = [(x.text, x.distance, x.channel, x.exact, x.negated, x.operator) for x in conditions_of(toks)]
    assert got == [("a b", 0, "CLIENT", False, False, ""), ("c", 2, "ANY", True, True, "OR"), ("d", 2, "ANY", False, False, "")]


def test_dictionary_xml_round_trip(spark, tmp_path):
    leaf = Node("leaf", [Condition("один два", 3, "CLIENT", limits=[Limit(value=7)]), Condition("три", exact=True, negated=True, operator="OR", limits=[Limit(value=7)])])
    root = Node("root", children=[leaf, Node("rest", remainder=True)])
    xml = dictionary_xml.serialize(root)
    assert dictionary_xml.parse(xml) == root and dictionary_xml.serialize(dictionary_xml.parse(xml)) == xml
    (tmp_path / "a.xml").write_text(xml)
    (tmp_path / "b.xml").write_text("<broken")
    (tmp_path / "c.xml").write_text("")
    rows = dictionary_xml.read_dictionaries(spark, str(tmp_path)).collect()
    assert sorted(r["phrase"] for r in rows if r["phrase"]) == ["один два", "три"] and sorted(r["error"] == "empty" for r in rows if r["error"]) == [False, True]
    assert [p.level for p in flatten([root])] == [1, 1, 1]


def test_rtf_and_plain_text(spark, tmp_path):
    body = "".join(rf"\u{ord(c)}?" if ord(c) > 127 else c for c in "Клиент: да") + r"\par " + r"\'ed\'e5\'f2\par Сотрудник: ок".encode("cp1251").decode("latin-1")
    (tmp_path / "x.rtf").write_bytes((r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 " + body + "}").encode("latin-1"))
    (tmp_path / "y.rtf").write_bytes(rb"{\rtf1 }")
    got, bad = rtf.read_dialogues(spark, str(tmp_path))
    assert [(r["speaker"], r["text"]) for r in got.orderBy("turn_index").collect()] == [(C, "да"), (O, "нет"), (O, "ок")] and bad.count() == 1
    plain = turns.from_plain_text(spark.createDataFrame([("d", "раз\n\nдва\nКлиент: три\nчетыре"), ("e", None)], "dialogue_id string, text string"))
    assert [(r["speaker"], r["text"]) for r in plain.orderBy("turn_index").collect()] == [(O, "раз"), (C, "два"), (C, "три"), (O, "четыре")]


def value(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_scalars(spark):
    assert value(spark, X.clock_seconds, "00:00:15", "01:02:03", "00:15", "5:48", "15,5", "  0:01:30  ", "0:00:15.250", "", "invalid", "0:99:00", "0:00:99", "99:99") == [15, 3723, 15, 348, 15.5, 90, 15] + [None] * 5
    assert value(spark, X.snils_valid, "112-233-445 95", "112-233-445 00", "1") == [True, False, False]
    assert value(spark, X.inn_valid, "7707083893", "7707083890", "500100732259", "500100732250", "") == [True, False, True, False, False]
    assert value(spark, X.luhn_valid, "4111111111111111", "4111111111111112", "", "4111-1111-1111-1111") == [True, False, False, True]
    assert value(spark, X.normalize_phrase, ' "Hello   World" ', "«Да»", "'", None) == ["hello world", "да", "'", ""]
    assert value(spark, X.timespan_seconds, "1.02:03:04.5", "00:00:10", "1000000.00:00:00", "x") == [93784.5, 10, None, None]
    assert value(spark, lambda c: X.humanize_seconds(c.cast("double")), "5", "65", "3600") == ["5 сек", "1 мин 5 сек", "1 ч"]
    assert value(spark, X.last_json, 'a {"x": 1} b {"y": {"z": 2}} c', "none", '```json\n{"k": 1}\n```') == ['{"y": {"z": 2}}', None, '{"k": 1}']
    assert value(spark, X.repeats_itself, "ab\n" * 90, "short", "x y z " * 60 + "unlike") == [True, False, True]
    assert value(spark, lambda c: X.one_of(c, X.CONFIDENCE, "uncertain"), " Relevant", "NOT RELEVANT", "?") == ["relevant", "irrelevant", "uncertain"]
    assert value(spark, X.snippet, "a" * 300, " b ") == ["a" * 240 + "…", "b"]


def test_masking(spark):
    texts = ["тел 89161234567", "+7(916)123-45-67 и 8(916)123-45-67", "1234567", "паспорт 45 10 789012", "00 10 789012", "карта 4111 1111 1111 1111!", "снилс 112-233-445 95", "договор № 12", "a.b@c.io", None, "ЛС 12345"]
    got = [r["masked"] for r in pii.mask(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["тел <PHONE>", "<PHONE> и <PHONE>", "1234567", "паспорт <PASSPORT>", "00 10 789012", "карта <CARD>!", "снилс <SNILS>", "<CONTRACT>", "<EMAIL>", "", "<BILLING>"]


def test_chunks(spark):
    t = spark.createDataFrame([("d", 0, C, " ".join(f"w{i}." for i in range(30))), ("d", 1, C, "short"), ("d", 2, C, None)], "dialogue_id string, turn_index int, speaker string, text string")
    got = chunker.chunk(t, 10, 3).orderBy("turn_index", "chunk_index").collect()
    long = [r["text"].split() for r in got if r["turn_index"] == 0]
    assert all(len(c) <= 10 for c in long) and all(a[-3:] == b[:3] for a, b in itertools.pairwise(long)) and list(dict.fromkeys(w for c in long for w in c)) == [f"w{i}." for i in range(30)]
    assert [r["text"] for r in got if r["turn_index"] == 1] == ["short"]
    w = chunker.char_windows(F.lit("x" * 2500))
    assert [len(x) for x in spark.range(1).select(w.alias("w")).first()["w"]] == [2000, 700]


def test_fusion_and_metrics(spark):
    r = spark.createDataFrame([("q", "dense", 0, 0.95, 1), ("q", "dense", 1, 0.7, 3), ("q", "dense", 2, 0.85, 2), ("q", "sparse", 0, 0.9, 1), ("q", "sparse", 1, 0.1, 3), ("q", "sparse", 2, 0.5, 2)], "query_id string, channel string, doc long, score double, rank int")
    assert {x["doc"]: x["score"] for x in retrieval.rrf(r, "doc").collect()}[0] == round(2 / 61, 6)
    assert max(retrieval.log_odds(r, "doc").collect(), key=lambda x: x["score"])["doc"] == 0
    assert {x["doc"]: x["score"] for x in retrieval.convex(r, "doc").collect()}[0] == 1.0
    same = r.withColumn("score", F.lit(0.5))
    assert {x["score"] for x in retrieval.convex(same, "doc").collect()} == {1.0}
    with pytest.raises(ValueError):
        retrieval.fuse("other", r, "doc")
    qrels = spark.createDataFrame([("q", 0, 3), ("q", 9, 1)], "query_id string, doc long, grade int")
    m = retrieval.retrieval_metrics(r.where("channel = 'dense'"), qrels, "doc", 3).first()
    assert (m["recall"], m["precision"], m["rr"]) == (0.5, 0.333333, 1.0) and 0.8 < m["ndcg"] < 0.9


def test_dictionary_checks(spark):
    c = spark.createDataFrame([(1, "Hello World", True, "ANY", 2), (2, '"hello  world"', True, "ANY", 2), (3, "world hello", False, "ANY", 2), (4, "(x", True, "BOSS", -1), (5, "", True, "ANY", 9)], "cond_id int, phrase string, exact boolean, channel string, distance int")
    got = {(r["kind"], tuple(r["ids"])) for r in dictops.duplicates(c).collect()}
    assert got == {("full", (1, 2)), ("soft", (1, 2, 3))}
    issues = {(r["cond_id"], r["issue"]) for r in dictops.validate(c).collect()}
    assert issues == {(4, "unknown channel"), (4, "negative distance"), (4, "unbalanced brackets"), (5, "wide distance"), (5, "empty phrase")}
    many = spark.createDataFrame([(i, f"p{i}") for i in range(700)], "pos int, phrase string")
    assert sorted(r["pos"] for r in dictops.stratified_sample(many).collect()) == sorted({int(j * 700 / 250) for j in range(250)})


def test_tables_and_providers(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "id int, v string", ["id"])
    assert t.read().count() == 0
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"))
    t.delete(spark.createDataFrame([(1,)], "id int"))
    assert sorted(tuple(r) for r in t.read().collect()) == [(2, "c"), (3, "d")]
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "yy")], "id int, p string")
    got = corpus.provider_map(rows, "p", "answer", lambda ps: [p.upper() for p in ps]).orderBy("id").collect()
    assert [r["answer"] for r in got] == ["X", "X", "YY"]


def test_attribute_expressions_and_reports(spark):
    from colloquy.operators import attributes, reports

    df = spark.createDataFrame([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], "a int, b int, c int")
    leaf = attributes.comparison({"a", "b", "c"})
    got = lambda text: {tuple(r) for r in df.where(attributes.compile_expression(text, leaf)).collect()}
    rows = list(itertools.product((0, 1), repeat=3))
    assert got("(a=1 OR b=1) AND c=1") == {r for r in rows if (r[0] or r[1]) and r[2]}
    assert got("a=1 OR b=1 AND NOT (c=1 AND a=0)") == {r for r in rows if r[0] or (r[1] and not (r[2] and not r[0]))}
    assert got("") == set(rows) and got('a=1 "b=1"') == {r for r in rows if r[0] and r[1]}
    with pytest.raises(ValueError):
        attributes.compile_expression("x=1", leaf)
    rows = [("ADD", " p ", "2"), ("odd", "x", "1"), ("split", "q", "z"), ("add", None, "1")]
    items = spark.createDataFrame([(rows,)], "i array<struct<kind:string,phrase:string,distance:string>>")
    assert [tuple(x) for x in items.select(reports.recommendations(F.col("i")).alias("r")).first()["r"]] == [("add", "p", 2), ("split", "q", None)]
