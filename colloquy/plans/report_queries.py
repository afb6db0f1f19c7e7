"""Queries of match reports, dictionary warnings, nested phrases, added recognisers and look-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import corpus, dictops, pii, reports
from colloquy.operators.dictionary import phrases_between
from colloquy.operators.matcher import match_phrases, phrase_row
from colloquy.plans.prep_queries import PHRASES, phrases
from colloquy.plans.search_queries import TURNS, hits, table, turns

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- reports of matches

MATCHES = f"""{TURNS}, {hits('a', 'the of', 3)}, {hits('b', 'was')}, {hits('c', 'and in', 5)},
m AS (SELECT dialogue_id, turn_index, 'the of' AS phrase FROM a UNION ALL SELECT dialogue_id, turn_index, 'was' FROM b UNION ALL SELECT dialogue_id, turn_index, 'and in' FROM c)"""


def matches(spark, d):
    rows = [phrase_row("a", "the of", 3, "ANY", True), phrase_row("b", "was", 2, "ANY", True), phrase_row("c", "and in", 5, "ANY", True)]
    return match_phrases(turns(spark, d), rows).select("dialogue_id", "turn_index", "phrase")


@query(f"WITH {MATCHES} SELECT phrase, count(*) AS matches, count(DISTINCT dialogue_id) AS dialogues FROM m GROUP BY phrase")
def phrase_match_counts(spark, d):
    return reports.phrase_counts(matches(spark, d))


@query(f"WITH {MATCHES} SELECT dialogue_id, turn_index, count(*) AS matches, string_agg(phrase, '; ' ORDER BY phrase) AS phrases FROM m GROUP BY dialogue_id, turn_index")
def matches_per_turn(spark, d):
    return reports.per_turn(matches(spark, d)).withColumn("phrases", F.array_join("phrases", "; "))


# ---------------------------------------------------------------- dictionaries

OPERATORS = "CASE WHEN distance = 1 THEN 'AND' WHEN distance = 2 THEN 'OR' ELSE '' END"


@query(f"""WITH {PHRASES}, o AS (SELECT {OPERATORS} AS operator, channel = 'OPERATOR' AS negated FROM c)
SELECT 'AND' AS kind, count(*) FILTER (operator = 'AND') AS n FROM o UNION ALL SELECT 'OR', count(*) FILTER (operator = 'OR') FROM o UNION ALL SELECT 'NOT', count(*) FILTER (negated) FROM o
UNION ALL SELECT 'brackets', sum(length(text) - length(replace(replace(text, '(', ''), ')', '')))::BIGINT FROM documents""")
def dictionary_operators(spark, d):
    op = F.when(F.col("distance") == 1, "AND").when(F.col("distance") == 2, "OR").otherwise("")
    conditions = phrases(spark, d).select(op.alias("operator"), (F.col("channel") == "OPERATOR").alias("negated"))
    marks = F.regexp_extract_all("text", F.lit(r"([()])"), F.lit(1))
    tokens = table(spark, d, "documents").select(F.explode(marks).alias("text"), F.lit("TERMINAL").alias("kind"))
    return dictops.operator_counts(conditions, tokens)


@query("""WITH c AS (SELECT p_brand AS node_id, p_type AS phrase, p_size > 3 AS exact FROM part UNION ALL SELECT p_brand, ' ', true FROM part WHERE p_size = 7),
w AS (SELECT p_brand AS node_id, 'error token' AS warning, p_name AS what, count(*) AS n FROM part WHERE p_size % 10 = 0 GROUP BY ALL
UNION ALL SELECT node_id, CASE WHEN trim(phrase) = '' THEN 'empty phrase' ELSE 'repeated phrase' END, lower(trim(phrase)), count(*) FROM c GROUP BY ALL HAVING count(*) > 1 OR trim(any_value(phrase)) = ''
UNION ALL SELECT node_id, 'all phrases exact', NULL, count(*) FROM c GROUP BY node_id HAVING bool_and(exact)
UNION ALL SELECT DISTINCT p_brand, 'no attribute', NULL, 1 FROM part WHERE p_brand LIKE '%3')
SELECT node_id, warning, what, n FROM w""")
def dictionary_warnings(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_brand").alias("node_id"), F.when(F.endswith("p_brand", F.lit("3")), 0).otherwise(1).alias("attributes")).distinct()
    listed = p.select(F.col("p_brand").alias("node_id"), F.col("p_type").alias("phrase"), (F.col("p_size") > 3).alias("exact"))
    conditions = listed.union(p.where("p_size = 7").select("p_brand", F.lit(" "), F.lit(True)))
    tokens = p.select(F.col("p_brand").alias("node_id"), F.col("p_name").alias("text"), (F.col("p_size") % 10 == 0).alias("is_error"))
    return dictops.warnings(nodes, conditions, tokens)


@query("""WITH t AS (SELECT conv_id, turn, regexp_split_to_array(' ' || array_to_string(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), '  ') || ' ', ' (?:and|or|not|и|или|не) ') AS parts FROM conversations),
p AS (SELECT conv_id, turn, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '') AS found FROM t)
SELECT conv_id, turn, len(found)::INT AS n, array_to_string(found, '; ') AS phrases FROM p""")
def nested_phrases(spark, d):
    """Turns as token streams in which the operators are lexemes."""
    kind = lambda w: F.when(w.isin("and", "or", "not", "и", "или", "не"), "LEXEME").otherwise("WORD")
    tokens = F.transform(X.tokens(F.col("text")), lambda w: F.struct(w.alias("text"), kind(w).alias("kind")))
    c = table(spark, d, "conversations").select("conv_id", "turn", phrases_between(tokens).alias("found"))
    return c.select("conv_id", "turn", F.size("found").alias("n"), F.array_join("found", "; ").alias("phrases"))


# ---------------------------------------------------------------- personal data, kept sessions

ADDRESS = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"


@query(f"SELECT doc_id, regexp_replace(text, '{ADDRESS}', '<IP>', 'g') AS masked, len(regexp_extract_all(text, '{ADDRESS}'))::INT AS found FROM documents")
def pii_added_recognizer(spark, d):
    """A recogniser of the caller's own, here of network addresses."""
    own = (("IP_ADDRESS", "<IP>", "", ((ADDRESS, 0.6),)),)
    masked = pii.mask(table(spark, d, "documents").select("doc_id", "text"), recognizers=own)
    return masked.select("doc_id", "masked", F.size("detections").alias("found"))


@query("""WITH s AS (SELECT user_id, max(ts) AS last_accessed FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT e.event_id AS analysis_id, e.user_id AS session_id, e.props FROM events e JOIN s USING (user_id), n
WHERE e.event_id IN (SELECT p_partkey FROM part) AND s.last_accessed >= n.now - INTERVAL 2 DAY""")
def analyses_by_id(spark, d):
    e = table(spark, d, "events")
    sessions = e.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_accessed"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    analyses = e.select(F.col("event_id").alias("analysis_id"), F.col("user_id").alias("session_id"), "props")
    return corpus.analyses_by_id(sessions, analyses, table(spark, d, "part").select(F.col("p_partkey").alias("analysis_id")), now, 2 * 86400)
