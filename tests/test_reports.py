import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.operators import corpus, dictops, pii, reports
from colloquy.operators import retrieval as R
from colloquy.operators.dictionary import Condition, Limit, Node, phrases_between
from colloquy.plans import report_queries, stream_queries
from colloquy.sources import dictionary_xml
from colloquy.streaming import dialogues

SF = "/root/testdata/sf0.001"
TABLES = "events documents conversations part".split()
FOUND = [(report_queries, name) for name in report_queries.Q] + [(stream_queries, name) for name in ("stream_sessions", "stream_phrase_matches")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("plan,name", FOUND, ids=[name for _, name in FOUND])
def test_queries_against_sql(spark, con, plan, name):
    df = plan.Q[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = con.execute(f"select {columns} from ({plan.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert got


def test_nested_phrases(spark):
    tokens = [
        ([("a", "WORD"), ("b", "WORD"), ("или", "LEXEME"), ("", "WORD"), ("c", "WORD"), ("x", "LEXEME"), ("d", "WORD")],),
        ([("AND", "LEXEME"), ("not", "LEXEME"), ("or", "WORD"), ("(", "TERMINAL")],),
        ([],),
        (None,),
    ]
    df = spark.createDataFrame(tokens, "t array<struct<text:string,kind:string>>")
    got = [r[0] for r in df.coalesce(1).select(phrases_between(F.col("t"))).collect()]
    assert got == [["a b", "c d"], ["or"], [], None]


def test_warnings(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", 2), ("c", None)], "node_id string, attributes int")
    conditions = spark.createDataFrame([("a", "X y", True), ("a", " x Y", True), ("b", None, True), ("b", "", False), ("b", "z", True)], "node_id string, phrase string, exact boolean")
    tokens = spark.createDataFrame([("b", "?", True), ("b", "?", True), ("b", "ok", False), ("b", "odd", None)], "node_id string, text string, is_error boolean")
    got = {tuple(r) for r in dictops.warnings(nodes, conditions, tokens).collect()}
    assert got == {
        ("a", "no attribute", None, 1),
        ("c", "no attribute", None, 1),
        ("a", "repeated phrase", "x y", 2),
        ("a", "all phrases exact", None, 2),
        ("b", "empty phrase", "", 2),
        ("b", "error token", "?", 2),
    }
    assert dictops.warnings(nodes.limit(0), conditions.limit(0), tokens.limit(0)).collect() == []
    counts = dictops.operator_counts(spark.createDataFrame([], "operator string, negated boolean"), spark.createDataFrame([("(", "TERMINAL"), (")", "WORD")], "text string, kind string"))
    assert {tuple(r) for r in counts.collect()} == {("AND", 0), ("OR", 0), ("NOT", 0), ("brackets", 1)}


def test_detections_of_a_model_join_the_others(spark):
    kind = pii.DETECTION
    rows = [
        (1, "Anna, a.b@c.io", [("PERSON", 0, 4, 0.9), ("PERSON", 3, 8, 0.6)]),
        (2, "call 8 916 123-45-67", None),
        (3, "short", [("ADDRESS", 2, 9, 0.9), ("PERSON", 0, 2, 0.1), ("PERSON", 3, 3, 0.9)]),
        (4, None, [("PERSON", 0, 1, 0.9)]),
        (5, "Oslo", [("ADDRESS", 0, 4, 0.5), ("ADDRESS", 0, 4, 0.5)]),
    ]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, model {kind}")
    got = {r["doc_id"]: r["masked"] for r in pii.mask(docs, more=F.col("model")).collect()}
    assert got == {1: "<PERSON>, <EMAIL>", 2: "call <PHONE>", 3: "short", 4: "", 5: "<ADDRESS>"}


def test_entities_meet_by_either_form(spark):
    fused = spark.createDataFrame([(1, d, 1.0) for d in range(5)], "query_id long, doc_id long, score double")
    asked = spark.createDataFrame([(1, "Moscow's", "moscow", "LOC"), (1, "anna", "anna", "PER")], "query_id long, entity string, normal string, kind string")
    docs = spark.createDataFrame(
        [(0, "moscow", "moscow", "LOC"), (1, "in moscow", "moscow", "PER"), (2, "anna", None, None), (3, "anna", "ann", "LOC"), (3, "anna", "anna", "LOC"), (4, None, None, None)],
        "doc_id long, entity string, normal string, kind string",
    )
    got = {r["doc_id"]: r["score"] for r in R.boost_by_entities(fused, "doc_id", asked, docs).collect()}
    assert got == {0: 1.1, 1: 1.15, 2: 1.15, 3: 1.15, 4: 1.0}
    plain = {r["doc_id"]: r["score"] for r in R.boost_by_entities(fused, "doc_id", asked, docs.select("doc_id", "entity")).collect()}
    assert plain == {0: 1.1, 1: 1.0, 2: 1.15, 3: 1.15, 4: 1.0}


def test_reports_of_nothing_and_of_repeats(spark):
    m = spark.createDataFrame([("d", 0, "p"), ("d", 0, "p"), ("e", 1, "p"), ("e", 1, None)], "dialogue_id string, turn_index int, phrase string")
    assert {tuple(r) for r in reports.phrase_counts(m).collect()} == {("p", 3, 2), (None, 1, 1)}
    assert {tuple(r[:3]) for r in reports.per_turn(m).collect()} == {("d", 0, 2), ("e", 1, 2)}
    assert reports.per_turn(m.limit(0)).collect() == [] and reports.phrase_counts(m.limit(0)).collect() == []


def test_analyses_of_expired_sessions_are_not_found(spark):
    sessions = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('b', timestamp'2024-01-03 00:00:00') t(session_id, last_accessed)")
    analyses = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("b", "y", 3), ("gone", "x", 4)], "session_id string, analysis_id string, last_accessed int")
    asked = spark.createDataFrame([("x",), ("x",), (None,)], "analysis_id string")
    now = F.lit("2024-01-03 12:00:00").cast("timestamp")
    look = lambda ttl: sorted(r["last_accessed"] for r in corpus.analyses_by_id(sessions, analyses, asked, now, ttl).collect())
    assert look(86400) == [2] and look(0) == [1, 2]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Two runs over one checkpoint: the second reads what is new and still knows the ids of the first."""
    source, base = str(tmp_path / "in"), str(tmp_path / "run")

    def run(rows):
        spark.createDataFrame(rows, dialogues.EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = dialogues.distinct_within(spark.readStream.schema(dialogues.EVENTS).parquet(source))
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["event_id"] for r in spark.read.parquet(f"{base}/out").collect())

    at = spark.sql("select timestamp'2024-01-01 10:00:00' t").first()[0]
    row = lambda i: (i, at, 1, "e", 1.0, "{}")
    assert run([row(1), row(2), row(2)]) == [1, 2]
    assert run([row(2), row(3)]) == [1, 2, 3]


def test_limits_of_one_node_are_alike_in_a_file():
    near, far = Limit(value=5), Limit(value=9)
    alike = Node("n", [Condition("a", limits=[near]), Condition("b", operator="OR", limits=[near])])
    assert [c.limits for c in dictionary_xml.parse(dictionary_xml.serialize(alike)).conditions] == [[near], [near]]
    for limits in ([far], []):
        with pytest.raises(ValueError):
            dictionary_xml.serialize(Node("n", [Condition("a", limits=[near]), Condition("b", operator="OR", limits=limits)]))
