import random

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import graph, mutate
from colloquy.operators import retrieval as R
from colloquy.plans import mining_queries
from colloquy.sources import dictionary_xml, rtf, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["tree_add_nodes", "tree_add_refused", "tree_delete_nodes", "conditions_reorder", "phrase_audit", "checked_labels", "decoded_attributes", "braces_and_summaries", "coerced_lists", "knn_then_session_filter"])
def test_queries_against_sql(spark, con, name):
    df = mining_queries.Q[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({mining_queries.SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want))


def brute_merge(topics, least):
    kept = {}
    for i, (name, terms) in enumerate(topics):
        kept[name] = next((k for k, t in topics[:i] if kept[k] == k and len(t & terms) >= least * len(t | terms)), name)
    return kept


def test_topics_merge_by_their_own_terms(spark):
    assert brute_merge([("x", {"a", "b", "c"}), ("y", {"a", "b", "c", "d"}), ("z", {"b", "c", "d", "e"})], 0.6) == {"x": "x", "y": "x", "z": "z"}
    rng = random.Random(1)
    topics = [(f"t{i}", set(rng.sample("abcdef", rng.randrange(1, 5)))) for i in range(60)]
    df = spark.createDataFrame([(n, i, sorted(t)) for i, (n, t) in enumerate(topics)], "topic string, ord int, terms array<string>")
    assert {r["topic"]: r["into"] for r in graph.merge_topics(df).collect()} == brute_merge(topics, 0.6)
    assert graph.merge_topics(df.limit(0)).count() == 0


def test_changes_of_trees(spark):
    nodes = spark.createDataFrame([("r", None, "R"), ("a", "r", "A"), ("b", "a", "B")], "node_id string, parent_id string, name string")
    left, refused = mutate.delete_nodes(nodes, spark.createDataFrame([("a",), ("b",), ("x",)], "node_id string"))
    assert [r[0] for r in left.select("node_id").collect()] == ["r"] and sorted(tuple(r) for r in refused.collect()) == [("b", "too deep"), ("x", "unknown node")]
    new = spark.createDataFrame([("q", None, " r "), ("w", None, "W"), ("v", None, "w")], nodes.schema)
    added, refused = mutate.add_nodes(nodes, new)
    assert added.count() == 4 and {tuple(r) for r in refused.collect()} == {("q", "name taken"), ("w", "name taken")}
    assert mutate.cycles(nodes).count() == 0


def test_exact_neighbours_do_not_hang_on_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)] + [(70, None), (71, [0.0] * 4), (72, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    one, many = (sorted(tuple(r) for r in R.vector_top_k(v, "vec_id", q, 5, per_block=n).collect()) for n in (1000, 7))
    assert one == many and len(one) == 40 and one[0] == (0, 0, 1.0, 1)


def test_files_that_are_refused(spark, tmp_path):
    (tmp_path / "empty.rtf").write_bytes(b"")
    (tmp_path / "big.rtf").write_bytes(b"{" + b"x" * (51 << 20))
    (tmp_path / "none.rtf").write_bytes(b"{\\rtf1 }")
    assert {r["dialogue_id"].rpartition("/")[2]: r["reason"] for r in rtf.read_dialogues(spark, str(tmp_path))[1].collect()} == {"big.rtf": "too large", "none.rtf": "no turn", "empty.rtf": "empty"}
    assert [[t for t, _ in cells] for _, _, cells in rtf.parse(rb"{\rtf1\trowd\intbl a\cell b {\b c}\cell\row\trowd d\cell\row}")] == [["a", "b c"], ["d"]]
    deep = "<SpeechLabRequest><Name>leaf</Name></SpeechLabRequest>"
    for i in range(22):
        deep = f"<SpeechLabRequest><Name>n{i}</Name><Requests>{deep}</Requests></SpeechLabRequest>"
    (tmp_path / "deep.xml").write_text(deep)
    (tmp_path / "empty.xml").write_bytes(b"")
    (tmp_path / "a.xml").write_text("<SpeechLabRequest><Name>a</Name><SavedState>on</SavedState><Attributes><Attribute Key='Duration' Value='1'/></Attributes></SpeechLabRequest>")
    rows = dictionary_xml.read_dictionaries(spark, str(tmp_path)).collect()
    errors = {(r["path"].rpartition("/")[2], r["error"]) for r in rows if r["error"]}
    assert errors == {("deep.xml", "n0 is deeper than 20"), ("empty.xml", "empty")}
    a = next(r for r in rows if r["name"] == "a")
    assert (a["saved_state"], a["attributes"]) == ("on", '{"Duration": "1"}')
    tree = dictionary_xml.parse((tmp_path / "a.xml").read_text())
    assert dictionary_xml.parse(dictionary_xml.serialize(tree)) == tree


def test_kept_tables(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"session_id": "s", "timestamp": "1"}\n\nnot json\n{"session_id": "t"}\n')
    assert tables.read_feedback(spark, str(tmp_path / "f.jsonl")).count() == 2
    assert [r["ts"] for r in tables.read_feedback(spark, str(tmp_path / "f.jsonl"), "s").collect()] == ["1"]
    spark.createDataFrame([("a", 0, 1, 1.0), ("b", 1, 1, 1.0)], "term string, idx int, df long, idf double").write.parquet(str(tmp_path / "v"))
    assert tables.load_vocabulary(spark, str(tmp_path / "v"), 1) is None and tables.load_vocabulary(spark, str(tmp_path / "v"), 2).count() == 2
    good, bad = tables.fitting_vectors(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "id int, embedding array<double>"), 2)
    assert [r["embedding"] for r in good.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0]] and bad.count() == 2


def test_texts_by_index_are_trimmed_of_blanks_only(spark):
    df = spark.createDataFrame([("0 line\n 1 \n 1\n2x",)], "t string")
    assert df.select(X.longest_line_run(F.col("t"))).first()[0] == 2
    long = spark.createDataFrame([("a" * 6000 + "".join(chr(97 + i % 26) * 3 + str(i) for i in range(40)) + ("loop of fifty characters that comes again and again! " * 6),)], "t string")
    assert long.select(X.repeats_itself(F.col("t"))).first()[0]


def test_changes_of_conditions_and_nodes(spark):
    conditions = spark.createDataFrame([(1, "a", 0, "one", "ANY", ""), (2, "a", 1, "two", "ANY", "OR"), (3, "a", 2, "three", "ANY", "AND"), (4, "b", 0, "four", "CLIENT", "")], "cond_id int, node_id string, ord int, phrase string, channel string, operator string")
    nodes = spark.createDataFrame([("a", "A", "on", "{}"), ("b", "B", None, None), ("c", "C", None, None)], "node_id string, name string, saved_state string, attributes string")
    new = spark.createDataFrame([(9, "a", " nine ", "client", "OR"), (8, "a", "eight", None, None), (7, "c", "seven", "ANY", ""), (6, "x", "six", None, None), (5, "a", " ", None, None), (10, "a", "ten", "BOTH", None), (11, "a", "x", None, "XOR"), (1, "b", "again", None, None)], "cond_id int, node_id string, phrase string, channel string, operator string")
    out, refused = mutate.add_conditions(conditions, nodes, new)
    assert sorted((r["node_id"], r["ord"], r["cond_id"], r["phrase"], r["channel"]) for r in out.where("cond_id >= 5").collect()) == [("a", 3, 8, "eight", None), ("a", 4, 9, "nine", "CLIENT"), ("c", 0, 7, "seven", "ANY")]
    assert {r["cond_id"]: r["reason"] for r in refused.collect()} == {6: "unknown node", 5: "empty phrase", 10: "unknown channel", 11: "unknown operator", 1: "id taken"}
    changes = spark.createDataFrame([("a", 1, "TWO ", None), ("b", 0, None, "operator"), ("b", 5, "x", None), ("a", 0, None, "BOTH")], "node_id string, ord int, phrase string, channel string")
    out, refused = mutate.update_conditions(conditions, changes)
    got = {r["cond_id"]: (r["phrase"], r["channel"], r["operator"]) for r in out.collect()}
    assert got == {1: ("one", "ANY", ""), 2: ("TWO", "ANY", "OR"), 3: ("three", "ANY", "AND"), 4: ("four", "OPERATOR", "")}
    assert {(r["node_id"], r["ord"], r["reason"]) for r in refused.collect()} == {("b", 5, "no such place"), ("a", 0, "unknown channel")}
    out, refused = mutate.delete_conditions(conditions, spark.createDataFrame([("a", 0), ("a", 9), ("b", 0)], "node_id string, ord int"))
    assert sorted((r["node_id"], r["ord"], r["cond_id"]) for r in out.collect()) == [("a", 0, 2), ("a", 1, 3)] and [tuple(r) for r in refused.collect()] == [("a", 9)]
    out, refused = mutate.update_nodes(nodes, spark.createDataFrame([("a", " ", "off", None), ("b", "BB", None, "{1}"), ("z", "Z", None, None)], "node_id string, name string, saved_state string, attributes string"))
    assert sorted(map(tuple, out.collect())) == [("a", "A", "off", "{}"), ("b", "BB", None, "{1}"), ("c", "C", None, None)] and refused.first()["node_id"] == "z"
