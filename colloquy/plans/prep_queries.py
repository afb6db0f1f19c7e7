"""Queries of text preparation, dictionary analytics, mining and kept state, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import attributes, chunker, corpus, dictops, gazetteer, pii, reports, search
from colloquy.operators.dictionary import Condition, Node
from colloquy.operators.matcher import match_phrases, phrase_row
from colloquy.plans.search_queries import IN, TURNS, hits, table, turns

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- text


@query("SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]', '', 'g'), 1, 5000) AS clean FROM documents")
def sanitize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sanitize(F.col("text")).alias("clean"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) <= 240 THEN trim(text) ELSE rtrim(substr(trim(text), 1, 240)) || '…' END AS snippet, CASE WHEN length(text) > 300 THEN substr(text, 1, 297) || '...' ELSE text END AS source FROM documents")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"), X.source_snippet(F.col("text")).alias("source"))


@query("SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS phrase FROM conversations")
def normalize_phrase(spark, d):
    quoted = F.concat(F.lit(' "'), F.col("text"), F.lit('" '))
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalize_phrase(quoted).alias("phrase"))


@query("SELECT event_id, extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + extract(second FROM ts)::DOUBLE AS seconds, extract(minute FROM ts) * 60 + extract(second FROM ts)::DOUBLE AS short FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def timestamp_parse(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", X.clock_seconds(F.date_format("ts", "H:mm:ss.SSS")).alias("seconds"), X.clock_seconds(F.date_format("ts", "mm:ss")).alias("short"))


@query("SELECT o_orderkey, (o_orderkey % 3) * 86400 + extract(hour FROM o_orderdate) * 3600 + (o_orderkey % 60) * 60 + 7.5 AS seconds FROM orders")
def timespan_parse(spark, d):
    span = F.format_string("%d.%02d:%02d:07.5000000", F.col("o_orderkey") % 3, F.hour("o_orderdate"), F.col("o_orderkey") % 60)
    return table(spark, d, "orders").select("o_orderkey", X.timespan_seconds(span).alias("seconds"))


LUHN = """(list_sum(list_transform(range(1, length({n}) + 1), lambda i: CASE WHEN (length({n}) - i) % 2 = 1
  THEN (CASE WHEN substr({n}, i, 1)::INT * 2 > 9 THEN substr({n}, i, 1)::INT * 2 - 9 ELSE substr({n}, i, 1)::INT * 2 END) ELSE substr({n}, i, 1)::INT END)) % 10 = 0)""".format


@query(f"WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{{16}}\\b')) AS card FROM documents) SELECT doc_id, card, {LUHN(n='card')} AS valid FROM c")
def luhn_valid_cards(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\b[0-9]{16}\b)"), F.lit(1))).alias("card"))
    return found.select("doc_id", "card", X.luhn_valid(F.col("card")).alias("valid"))


def weighted(n, w):
    return " + ".join(f"{x} * substr({n}, {i + 1}, 1)::INT" for i, x in enumerate(w))


INN10 = f"(({weighted('n', [2, 4, 10, 3, 5, 9, 4, 6, 8])}) % 11 % 10 = substr(n, 10, 1)::INT)"
SNILS = f"((CASE WHEN t > 101 THEN CASE WHEN t % 101 = 100 THEN 0 ELSE t % 101 END WHEN t = 100 THEN 0 ELSE t END) = substr(s, 10, 2)::INT)"


@query(f"""WITH k AS (SELECT l_orderkey, l_linenumber, lpad((l_orderkey * 7919 + l_partkey * 104729)::VARCHAR, 10, '3') AS n, lpad((l_orderkey * 15485863 + l_suppkey * 32452843)::VARCHAR, 11, '4') AS s FROM lineitem),
t AS (SELECT *, {weighted('s', list(range(9, 0, -1)))} AS t FROM k)
SELECT l_orderkey, l_linenumber, {INN10} AS inn, {SNILS} AS snils FROM t""")
def inn_snils_checksum(spark, d):
    k = table(spark, d, "lineitem")
    n = F.lpad((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729).cast("string"), 10, "3")
    s = F.lpad((F.col("l_orderkey") * 15485863 + F.col("l_suppkey") * 32452843).cast("string"), 11, "4")
    return k.select("l_orderkey", "l_linenumber", X.inn_valid(n).alias("inn"), X.snils_valid(s).alias("snils"))


EMAIL = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}\\b"


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g') AS masked FROM documents")
def pii_mask(spark, d):
    return pii.mask(table(spark, d, "documents").select("doc_id", "text"), entities=("EMAIL_ADDRESS",)).select("doc_id", "masked")


@query(f"WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS x FROM documents) SELECT 'EMAIL_ADDRESS' AS entity, count(*) AS detections, count(DISTINCT doc_id) AS documents FROM e HAVING count(*) > 0")
def pii_counts(spark, d):
    return pii.counts(pii.mask(table(spark, d, "documents").select("doc_id", "text"), entities=("EMAIL_ADDRESS",)))


@query()
def pii_mask_all(spark, d):
    return pii.mask(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "masked", F.size("detections").alias("detections"))


@query()
def pii_counts_all(spark, d):
    return pii.counts(pii.mask(table(spark, d, "documents").select("doc_id", "text")))


@query()
def chunk_sentences(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("dialogue_id"), F.lit(0).alias("turn_index"), F.col("source").alias("speaker"), "text")
    return chunker.chunk(t)


@query()
def chunk_overlap_links(spark, d):
    return chunker.links(chunk_sentences(spark, d)).select("dialogue_id", "turn_index", "chunk_index", "overlap_with")


@query("""SELECT doc_id, k AS chunk_index, substr(text, k * 1800 + 1, 2000) AS chunk FROM
  (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 1800.0)::INT, 1)))::INT AS k FROM documents)""")
def chunk_char_window(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunker.char_windows(F.col("text"))).alias("chunk_index", "chunk"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM l WHERE trim(line) <> ''),
g AS (SELECT doc_id, line, i - row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM m)
SELECT doc_id, max(n)::INT AS longest_run FROM (SELECT doc_id, line, k, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id""")
def repetition_runs(spark, d):
    return table(spark, d, "documents").select("doc_id", X.longest_line_run(F.col("text")).alias("longest_run"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS n FROM events")
def json_extract_typed(spark, d):
    noisy = F.concat(F.lit("so: "), F.col("props"), F.lit(" done"))
    e = table(spark, d, "events").withColumn("j", corpus.typed_json(noisy, "k string, other int", {"k": None, "other": -1}))
    return e.select("event_id", F.col("j.k").alias("k"), F.coalesce(F.col("j.k").try_cast("int"), F.lit(-1)).alias("n"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'relevant' WHEN 'O' THEN 'irrelevant' ELSE 'uncertain' END AS label FROM orders")
def enum_normalize(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", " Релевантно ").when(F.col("o_orderstatus") == "O", "NOT relevant").otherwise("?")
    return table(spark, d, "orders").select("o_orderkey", X.one_of(raw, X.CONFIDENCE, "uncertain").alias("label"))


# ---------------------------------------------------------------- dictionaries


def phrases(spark, d):
    """Conditions from the parts: their names are phrases, their numbers the other fields."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("cond_id"), F.concat_ws(" ", "p_type", "p_brand").alias("phrase"), (F.col("p_size") % 2 == 0).alias("exact"), F.when(F.col("p_size") % 3 == 0, "CLIENT").when(F.col("p_size") % 3 == 1, "OPERATOR").otherwise("ANY").alias("channel"), (F.col("p_size") % 4).alias("distance"))


PHRASES = """c AS (SELECT p_partkey AS cond_id, p_type || ' ' || p_brand AS phrase, lower(trim(p_type || ' ' || p_brand)) AS norm, p_size % 2 = 0 AS exact,
  CASE p_size % 3 WHEN 0 THEN 'CLIENT' WHEN 1 THEN 'OPERATOR' ELSE 'ANY' END AS channel, p_size % 4 AS distance FROM part)"""


@query(f"WITH {PHRASES} SELECT norm AS phrase, list_sort(list(cond_id))::VARCHAR AS ids FROM c GROUP BY norm, exact, channel, distance HAVING count(*) > 1")
def duplicates_full(spark, d):
    found = dictops.duplicates(phrases(spark, d)).where("kind = 'full'")
    return found.select("phrase", F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("]")).alias("ids"))


@query(f"""WITH {PHRASES}, w AS (SELECT *, array_to_string(list_sort(list_distinct(string_split(norm, ' '))), ' ') AS words FROM c)
SELECT words AS phrase, count(*) AS members FROM w GROUP BY words HAVING count(DISTINCT (norm, exact, channel, distance)) > 1""")
def duplicates_soft(spark, d):
    return dictops.duplicates(phrases(spark, d)).where("kind = 'soft'").select("phrase", F.size("ids").cast("long").alias("members"))


@query(f"WITH {PHRASES}, w AS (SELECT cond_id, unnest(regexp_extract_all(norm, '[а-яёa-z0-9]+')) AS word, generate_subscripts(regexp_extract_all(norm, '[а-яёa-z0-9]+'), 1) AS i FROM c) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, min((cond_id, i)) LIMIT 20")
def word_frequency(spark, d):
    return dictops.word_frequency(phrases(spark, d).select(F.col("cond_id").alias("pos"), "phrase"), 20)


@query(f"""WITH {PHRASES} SELECT count(*) AS conditions, sum(len(string_split(norm, ' ')))::BIGINT AS words, count(*) FILTER (exact) AS exact, count(*) FILTER (channel = 'CLIENT') AS client,
  count(*) FILTER (channel = 'OPERATOR') AS operator, count(*) FILTER (channel = 'ANY') AS any_channel, (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split(norm, ' ')) AS w FROM c)) AS distinct_words FROM c""")
def dictionary_stats(spark, d):
    return dictops.statistics(phrases(spark, d))


@query(f"""WITH {PHRASES}, f AS (SELECT min(cond_id) AS pos FROM c GROUP BY norm), r AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n FROM f),
k AS (SELECT *, CASE WHEN n <= 200 THEN n WHEN n <= 500 THEN 200 WHEN n <= 1000 THEN 250 ELSE 300 END AS cap FROM r)
SELECT pos, phrase FROM k JOIN c ON c.cond_id = pos WHERE i IN (SELECT (j * n) // cap FROM (SELECT DISTINCT n, cap FROM k), range(0, 300) t(j) WHERE j < cap)""")
def stratified_sample(spark, d):
    return dictops.stratified_sample(phrases(spark, d).select(F.col("cond_id").alias("pos"), "phrase"))


@query(f"WITH {PHRASES} SELECT cond_id, 'wide distance' AS issue FROM c WHERE distance + 1 > 3 UNION ALL SELECT cond_id, 'odd quotes' FROM c WHERE cond_id % 7 = 0")
def validate_tokens(spark, d):
    p = phrases(spark, d).withColumn("distance", F.col("distance") + 1).withColumn("phrase", F.when(F.col("cond_id") % 7 == 0, F.concat("phrase", F.lit('"'))).otherwise(F.col("phrase")))
    return dictops.validate(p)


def tree(spark, d):
    """region > nation > customer as nodes."""
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name")
    return r.union(n).union(c)


TREE = """t AS (SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
x AS (SELECT node_id, node_id AS ancestor_id, 0 AS distance FROM t UNION ALL SELECT x.node_id, t.parent_id, x.distance + 1 FROM x JOIN t ON t.node_id = x.ancestor_id WHERE t.parent_id IS NOT NULL)"""


@query(f"WITH RECURSIVE {TREE} SELECT node_id, name FROM t JOIN x USING (node_id) GROUP BY node_id, name HAVING max(distance) < 2")
def tree_prune_depth(spark, d):
    t = tree(spark, d)
    deep = dictops.ancestors(t).groupBy("node_id").agg(F.max("distance").alias("depth"))
    return t.join(deep.where("depth < 2"), "node_id").select("node_id", "name")


@query(f"WITH RECURSIVE {TREE}, o AS (SELECT 'c' || o_custkey AS node_id, count(*) AS n FROM orders GROUP BY 1) SELECT ancestor_id AS node_id, sum(n)::BIGINT AS matches FROM o JOIN x USING (node_id) GROUP BY ancestor_id")
def tree_rollup_counts(spark, d):
    own = table(spark, d, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("node_id")).count()
    return own.join(dictops.ancestors(tree(spark, d)), "node_id").groupBy("ancestor_id").agg(F.sum("count").alias("matches")).withColumnRenamed("ancestor_id", "node_id")


@query(f"WITH RECURSIVE {TREE} SELECT DISTINCT ancestor_id AS node_id FROM x JOIN t USING (node_id) WHERE contains(lower(name), '7')")
def tree_search_keep_ancestors(spark, d):
    t = tree(spark, d)
    found = t.where(F.contains(F.lower("name"), F.lit("7"))).select("node_id")
    return found.join(dictops.ancestors(t), "node_id").select(F.col("ancestor_id").alias("node_id")).distinct()


# ---------------------------------------------------------------- mining, annotations, state


@query(f"""WITH {TURNS}, {hits('h', 'was')}, s AS (SELECT dialogue_id, max(len(list_filter(toks, lambda t: t = 'the')) / len(toks)) AS score FROM turns WHERE len(toks) > 0 GROUP BY dialogue_id)
SELECT dialogue_id, 'the' AS phrase, round(score, 6) AS score FROM s WHERE NOT {IN('h')} AND score >= 0.05""")
def false_negatives(spark, d):
    t = turns(spark, d)
    m = search.search(t, [Node("n", [Condition("was", exact=True)])])[0]
    share = F.size(F.filter(X.tokens(F.col("text")), lambda x: x == "the")) / F.size(X.tokens(F.col("text")))
    similar = t.where(F.size(X.tokens(F.col("text"))) > 0).select("dialogue_id", F.lit("the").alias("phrase"), share.alias("score"))
    found = corpus.false_negatives(t.select("dialogue_id").distinct(), m, similar, 0.05)
    return found.select("dialogue_id", "phrase", F.round("score", 6).alias("score"))


@query("""WITH f AS (SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 12)
SELECT label, max(score) AS score, arg_max(vec_id, (score, -vec_id)) AS vec_id FROM f GROUP BY label ORDER BY score DESC, label LIMIT 4""")
def similar_dialogues(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("score"))
    return corpus.best_per_group(e, "label", "vec_id", 4)


def category_scores(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    s = s.select("source", F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("category"), (F.col("quality") * 0.6 + F.col("toxic") * 0.3 + 0.1).alias("score"))
    return s.withColumn("level", corpus.level_of(F.col("score")))


@query("""WITH s AS (SELECT source, lang || '-' || doc_id AS category, quality * 0.6::DOUBLE + toxic * 0.3::DOUBLE + 0.1::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
a AS (SELECT source, round(avg(score), 4) AS overall, count(*) FILTER (score > 0.75) AS strengths, count(*) FILTER (score < 0.5) AS weaknesses FROM s GROUP BY source)
SELECT *, CASE WHEN overall > 0.75 THEN 'high' WHEN overall >= 0.5 THEN 'medium' ELSE 'low' END AS overall_level FROM a""")
def quality_rollup(spark, d):
    q = corpus.quality(category_scores(spark, d), "source")
    return q.select("source", "overall", F.size("strengths").cast("long").alias("strengths"), F.size("weaknesses").cast("long").alias("weaknesses"), "overall_level")


@query(f"""WITH {TURNS}, {hits('a', 'was')}, {hits('b', 'of the')}, s AS (SELECT dialogue_id, turn_index, true AS was FROM a), o AS (SELECT dialogue_id, turn_index, true AS ofthe FROM b)
SELECT dialogue_id, turn_index, coalesce(was, false) AS sentiment, coalesce(ofthe, false) AS topic FROM turns LEFT JOIN s USING (dialogue_id, turn_index) LEFT JOIN o USING (dialogue_id, turn_index)""")
def annotation_layers(spark, d):
    t = turns(spark, d)
    layer = lambda p: search.search(t, [Node("n", [Condition(p, exact=True)])])[0].select("dialogue_id", "turn_index", F.col("matched_text").alias("value"))
    got = corpus.layers(t.select("dialogue_id", "turn_index"), {"sentiment": layer("was"), "topic": layer("of the")})
    return got.select("dialogue_id", "turn_index", F.col("sentiment").isNotNull().alias("sentiment"), F.col("topic").isNotNull().alias("topic"))


@query("""WITH b AS (SELECT source, doc_id, substr(text, 1, 1000) AS body FROM documents), r AS (SELECT *, 12000 - coalesce(sum(length(body)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b)
SELECT source, doc_id, substr(body, 1, room::INT) AS body FROM r WHERE length(body) <= room OR room > 100""")
def rag_context_fill(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return corpus.context_fill(docs, "source", [F.col("doc_id")]).select("source", "doc_id", "body")


@query("SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds, max(ts) AS last_seen, (SELECT count(*) FROM orders WHERE o_custkey = user_id) AS orders FROM events GROUP BY user_id")
def session_summary(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_type").alias("kinds"), F.max("ts").alias("last_seen"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("orders"))
    return e.join(o, "user_id", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query("SELECT user_id, max(ts) AS last_accessed FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 7200 SECOND")
def ttl_expired(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("user_id").agg(F.max("ts").alias("last_accessed")).crossJoin(e.agg(F.max("ts").alias("_now")))  # one row
    return corpus.expired(s, F.col("_now"), 7200).drop("_now")


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, d):
    e = table(spark, d, "events")
    return corpus.latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100")
def feedback_latest(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "ts")


@query("SELECT user_id, CASE WHEN bool_and(value >= 0.5) THEN 'completed' WHEN bool_and(value < 0.5) THEN 'failed' ELSE 'partial' END AS status FROM events WHERE value IS NOT NULL GROUP BY user_id")
def batch_status(spark, d):
    ok = F.col("value") >= 0.5
    e = table(spark, d, "events").where("value is not null").groupBy("user_id")
    return e.agg(F.when(F.bool_and(ok), "completed").when(F.bool_and(~ok), "failed").otherwise("partial").alias("status"))


@query(f"""WITH {TURNS}, {hits('h', 'the of', 3)}, m AS (SELECT dialogue_id, turn_index, a AS s, b + 1 AS e FROM h),
c AS (SELECT dialogue_id, turn_index, unnest([s, e]) AS p FROM m), u AS (SELECT DISTINCT dialogue_id, turn_index, p FROM c)
SELECT dialogue_id, count(*) AS segments FROM m GROUP BY dialogue_id""")
def highlight_segments(spark, d):
    m = search.search(turns(spark, d), [Node("n", [Condition("the of", 3, exact=True)])])[0]
    marks = m.select("dialogue_id", "turn_index", F.col("matched_start").alias("start"), F.col("matched_end").alias("end"), (F.pmod(F.col("cascade_order") - 1, F.lit(5)) + 1).alias("depth"))
    return corpus.highlight(marks, ["dialogue_id", "turn_index"]).groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("segments"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, k""")
def session_window_events(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))
    return g.drop("session_window")


@query("""WITH r AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)
SELECT user_id, event_type, min(event_id) AS first, count(*) AS length FROM r GROUP BY user_id, event_type, k HAVING count(*) >= 2""")
def event_runs(spark, d):
    return corpus.runs(table(spark, d, "events"), "user_id", "event_id", "event_type").where("length >= 2")


@query("SELECT event_id FROM events WHERE (event_type = 'click' OR event_type = 'view') AND NOT (value < 20 AND user_id > 50)")
def attribute_expression(spark, d):
    test = attributes.compile_expression("(event_type=click ИЛИ event_type=view) И НЕ (value<20 И user_id>50)", attributes.comparison({"event_type", "value", "user_id"}))
    return table(spark, d, "events").where(test).select("event_id")


@query(f"WITH {TURNS}, {hits('h', 'and')}, {hits('n', 'was by', 8)} SELECT dialogue_id, turn_index FROM h WHERE NOT {IN('n')}")
def without_suppression(spark, d):
    t = turns(spark, d)
    got = match_phrases(t, [phrase_row("h", "and", 2, "ANY", True), phrase_row("n", "was by", 8, "ANY", True)])
    return reports.without(t, got.where("cond_id = 'h'"), got.where("cond_id = 'n'")).select("dialogue_id", "turn_index")


@query(f"""WITH {TURNS}, {hits('h', 'the of', 3)}, m AS (SELECT dialogue_id, count(*) AS matches FROM h GROUP BY dialogue_id)
SELECT dialogue_id, count(*) AS turns, coalesce(any_value(matches), 0) AS matches, CASE WHEN any_value(matches) > 0 THEN 1 ELSE 0 END AS phrases FROM turns LEFT JOIN m USING (dialogue_id) GROUP BY dialogue_id""")
def report_summary(spark, d):
    t = turns(spark, d)
    return reports.workbook(t, search.search(t, [Node("n", [Condition("the of", 3, exact=True)])])[0])["summary"]


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS line FROM conversations")
def report_lines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", reports.cut(F.col("text"), 200).alias("line"))


@query("""SELECT user_id, list_slice(list_concat(list_sort(list(DISTINCT event_type)), list_transform(range(0, 6), lambda i: 'none')), 1, 6)::VARCHAR AS kinds FROM events GROUP BY user_id""")
def list_padding(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    return e.select("user_id", F.concat(F.lit("["), F.array_join(reports.padded(F.col("k"), 6, "none"), ", "), F.lit("]")).alias("kinds"))


@query("SELECT speaker_kind, n_range, count(*) AS turns FROM (SELECT role AS speaker_kind, (length(text) // 500)::INT AS n_range FROM conversations) GROUP BY CUBE (speaker_kind, n_range)")
def turn_length_cube(spark, d):
    c = table(spark, d, "conversations").select(F.col("role").alias("speaker_kind"), F.floor(F.length("text") / 500).cast("int").alias("n_range"))
    return c.cube("speaker_kind", "n_range").agg(F.count(F.lit(1)).alias("turns"))


def names_of_items(spark, d):
    """Names for the finder: the first two words of each benchmark item, and its third."""
    w = F.col("w")
    items = table(spark, d, "benchmark").select(X.tokens(F.col("text")).alias("w"))
    both = F.array(F.struct(F.array_join(F.slice(w, 1, 2), " ").alias("name"), F.lit("PAIR").alias("entity")), F.struct(F.coalesce(F.get(w, F.lit(2)), F.lit("")).alias("name"), F.lit("WORD").alias("entity")))
    return items.select(F.explode(both).alias("n")).select("n.*")


NAMES = """tk AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[а-яёa-z0-9]+') AS toks FROM documents),
iw AS (SELECT regexp_extract_all(lower(text), '[а-яёa-z0-9]+') AS w FROM benchmark),
nm AS (SELECT DISTINCT words, entity FROM (SELECT w[1:2] AS words, 'PAIR' AS entity FROM iw UNION ALL SELECT w[3:3], 'WORD' FROM iw) WHERE len(words) > 0),
ps AS MATERIALIZED (SELECT doc_id, i, toks[i:i + 1] AS two, toks[i:i] AS one FROM tk, (SELECT unnest(range(1, (SELECT max(len(toks)) FROM tk) + 1)) AS i) WHERE i <= len(toks)),
ft AS (SELECT doc_id, entity, i - 1 AS first, len(words) AS n FROM ps JOIN nm ON words = (CASE WHEN entity = 'PAIR' THEN two ELSE one END))"""


@query(f"WITH {NAMES} SELECT doc_id, entity, first::INT AS first, (first + n - 1)::INT AS last FROM ft")
def names_from_tables(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return gazetteer.find_names(docs, "doc_id", names_of_items(spark, d), capital=False).select("doc_id", "entity", "first", "last")
