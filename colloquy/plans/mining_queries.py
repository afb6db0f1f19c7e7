"""Queries of dictionary changes, mining jobs, audits, explanations and model answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as X
from colloquy.operators import chunker, mining, mutate
from colloquy.operators import retrieval as R
from colloquy.operators.matcher import match_phrases, phrase_row
from colloquy.plans.prep_queries import PHRASES, TREE, phrases, tree
from colloquy.plans.retrieval_queries import centres
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


# ---------------------------------------------------------------- changes of dictionaries

NODES = TREE.partition(",\nx AS")[0]


def new_nodes(spark, d):
    """One child for each nation, named like a customer or after the supplier."""
    s = table(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.concat(F.lit("s"), F.col("s_suppkey") % 40))
    parent = F.when(F.col("s_suppkey") % 11 == 0, "n999").otherwise(F.concat(F.lit("n"), "s_nationkey"))
    return s.select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), parent.alias("parent_id"), name.alias("name"))


NEW = """a AS (SELECT 's' || s_suppkey AS node_id, CASE WHEN s_suppkey % 11 = 0 THEN 'n999' ELSE 'n' || s_nationkey END AS parent_id,
  CASE WHEN s_suppkey % 5 = 0 THEN 'customer#' || lpad(s_suppkey::VARCHAR, 9, '0') WHEN s_suppkey % 7 = 0 THEN ' ' ELSE 's' || (s_suppkey % 40) END AS name FROM supplier),
j AS (SELECT a.*, CASE WHEN trim(name) = '' THEN 'empty name' WHEN parent_id NOT IN (SELECT node_id FROM t) THEN 'unknown parent'
  WHEN EXISTS (SELECT 1 FROM t WHERE t.parent_id = a.parent_id AND lower(trim(t.name)) = lower(trim(a.name))) OR row_number() OVER (PARTITION BY parent_id, lower(trim(name)) ORDER BY node_id) > 1 THEN 'name taken' END AS reason FROM a)"""


@query(f"WITH {NODES}, {NEW} SELECT node_id, parent_id, name FROM t UNION ALL SELECT node_id, parent_id, name FROM j WHERE reason IS NULL")
def tree_add_nodes(spark, d):
    return mutate.add_nodes(tree(spark, d), new_nodes(spark, d))[0].select("node_id", "parent_id", "name")


@query(f"WITH {NODES}, {NEW} SELECT node_id, reason FROM j WHERE reason IS NOT NULL")
def tree_add_refused(spark, d):
    return mutate.add_nodes(tree(spark, d), new_nodes(spark, d))[1]


@query(f"WITH {NODES} SELECT node_id, CASE WHEN node_id LIKE 'c%' THEN 'renamed ' || node_id ELSE name END AS name FROM t")
def tree_rename_nodes(spark, d):
    t = tree(spark, d)
    asked = t.where("node_id like 'c%'").select("node_id", F.concat(F.lit("renamed "), "node_id").alias("new_name")).union(t.where("node_id like 'r%'").select("node_id", F.lit(" ")))
    return mutate.rename_nodes(t, asked).select("node_id", "name")


GONE = "g AS (SELECT node_id FROM t WHERE node_id IN ('r1', 'n3', 'n7', 'c5', 'c9'))"


def gone(spark, d):
    return tree(spark, d).where(F.col("node_id").isin("r1", "n3", "n7", "c5", "c9")).select("node_id")


@query(f"WITH RECURSIVE {TREE}, {GONE} SELECT node_id FROM t WHERE node_id NOT IN (SELECT x.node_id FROM x JOIN g ON g.node_id = x.ancestor_id WHERE g.node_id NOT LIKE 'c%')")
def tree_delete_nodes(spark, d):
    return mutate.delete_nodes(tree(spark, d), gone(spark, d))[0].select("node_id")


@query(f"WITH {NODES}, {GONE} SELECT node_id, 'too deep' AS reason FROM g WHERE node_id LIKE 'c%'")
def tree_delete_refused(spark, d):
    return mutate.delete_nodes(tree(spark, d), gone(spark, d))[1]


def placed_conditions(spark, d):
    p = table(spark, d, "part")
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return p.select(F.col("p_brand").alias("node_id"), rank.alias("ord"), F.col("p_partkey").alias("cond_id"))


@query("""WITH l AS (SELECT p_brand AS node_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT - 1 AS ord, p_partkey AS cond_id, count(*) OVER (PARTITION BY p_brand)::INT AS n FROM part)
SELECT node_id, cond_id, CASE WHEN n % 3 <> 0 THEN n - 1 - ord ELSE ord END AS ord FROM l""")
def conditions_reorder(spark, d):
    """Every node's conditions turned round; where their number is a multiple of three a place is named twice, and refused."""
    c = placed_conditions(spark, d)
    n = c.groupBy("node_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    back = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("n") - 1 - i)
    orders = n.select("node_id", F.when(F.col("n") % 3 == 0, F.array_repeat(F.lit(0), F.col("n"))).otherwise(back).alias("new_order"))
    return mutate.reorder_conditions(c, orders)[0].select("node_id", "cond_id", "ord")


def kept_conditions(spark, d):
    """A condition for each part, under its brand."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("phrase"), F.col("p_size").cast("int").alias("distance"))
    return placed_conditions(spark, d).join(p, F.col("cond_id") == F.col("p_partkey")).select("node_id", "ord", "cond_id", "phrase", "distance", F.lit("ANY").alias("channel"))


KEPT = """k AS (SELECT p_brand AS node_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT - 1 AS ord, p_partkey AS cond_id, p_name AS phrase, p_size::INT AS distance, 'ANY' AS channel FROM part)"""


@query(f"""WITH {KEPT}, b AS (SELECT node_id, max(ord) AS last FROM k GROUP BY node_id),
a AS (SELECT 'Brand#' || (11 + s_suppkey % 50) AS node_id, -s_suppkey AS cond_id, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE ' ' || s_name END AS phrase, CASE s_suppkey % 4 WHEN 0 THEN 'client' WHEN 1 THEN 'nobody' ELSE 'ANY' END AS channel FROM supplier),
g AS (SELECT a.*, last FROM a JOIN b USING (node_id) WHERE trim(phrase) <> '' AND channel <> 'nobody')
SELECT node_id, ord, cond_id, phrase, distance, channel FROM k
UNION ALL SELECT node_id, (last + row_number() OVER (PARTITION BY node_id ORDER BY cond_id))::INT, cond_id, trim(phrase), NULL, upper(channel) FROM g""")
def conditions_add(spark, d):
    s = table(spark, d, "supplier")
    phrase = F.when(F.col("s_suppkey") % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "s_name"))
    channel = F.when(F.col("s_suppkey") % 4 == 0, "client").when(F.col("s_suppkey") % 4 == 1, "nobody").otherwise("ANY")
    new = s.select((-F.col("s_suppkey")).alias("cond_id"), F.concat(F.lit("Brand#"), 11 + F.col("s_suppkey") % 50).alias("node_id"), phrase.alias("phrase"), channel.alias("channel"))
    c = kept_conditions(spark, d)
    return mutate.add_conditions(c, c.select("node_id"), new)[0]


@query(f"""WITH {KEPT} SELECT node_id, ord, cond_id, CASE WHEN ord % 3 = 0 THEN 'new ' || node_id ELSE phrase END AS phrase, CASE WHEN ord % 3 = 0 AND ord % 2 = 0 THEN 7 ELSE distance END AS distance, channel FROM k""")
def conditions_update(spark, d):
    c = kept_conditions(spark, d)
    rows = c.where("ord % 3 = 0").select("node_id", "ord", F.concat(F.lit("new "), "node_id", F.lit(" ")).alias("phrase"), F.when(F.col("ord") % 2 == 0, 7).alias("distance"), F.lit("any").alias("channel"))
    return mutate.update_conditions(c, rows.unionByName(rows.withColumn("ord", F.col("ord") + 100_000)))[0]


@query(f"""WITH {KEPT} SELECT node_id, (row_number() OVER (PARTITION BY node_id ORDER BY ord))::INT - 1 AS ord, cond_id, phrase, distance, channel FROM k WHERE ord % 4 <> 1""")
def conditions_delete(spark, d):
    c = kept_conditions(spark, d)
    return mutate.delete_conditions(c, c.where("ord % 4 = 1").select("node_id", "ord"))[0]


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS node_id, (p_partkey * 3) % 97 AS parent_id FROM part),
x AS (SELECT node_id, node_id AS up, 0 AS k FROM e UNION ALL SELECT x.node_id, e.parent_id, k + 1 FROM x JOIN e ON e.node_id = x.up WHERE k < 20)
SELECT DISTINCT node_id FROM x WHERE k > 0 AND node_id = up""")
def tree_cycles(spark, d):
    return mutate.cycles(table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), ((F.col("p_partkey") * 3) % 97).alias("parent_id")))


# ---------------------------------------------------------------- mining


@query("""SELECT user_id AS job_id, max(CASE WHEN event_type = 'click' THEN event_id ELSE 0 END) AS processed, max(event_id) AS total,
  round(CASE WHEN max(event_id) > 0 THEN max(CASE WHEN event_type = 'click' THEN event_id ELSE 0 END) / max(event_id) ELSE 0 END, 6) AS share FROM events GROUP BY user_id""")
def mining_progress(spark, d):
    e = table(spark, d, "events")
    points = e.where("event_type = 'click'").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("processed_count"))
    return mining.progress(points, e.groupBy(F.col("user_id").alias("job_id")).agg(F.max("event_id").alias("total")))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY o_custkey")
def running_jobs(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return mining.running(o, "o_custkey", "o_orderkey", ("O", "P"))


@query(f"WITH {PHRASES} SELECT s_suppkey, phrase FROM (SELECT s_suppkey, ' ' || upper((SELECT phrase FROM c WHERE cond_id = s_suppkey)) || CASE WHEN s_suppkey % 2 = 0 THEN ' new' ELSE ' ' END AS phrase FROM supplier) WHERE lower(trim(phrase)) NOT IN (SELECT lower(trim(phrase)) FROM c) AND phrase IS NOT NULL")
def suggestions_new(spark, d):
    p = phrases(spark, d)
    s = table(spark, d, "supplier").select("s_suppkey").join(p, F.col("s_suppkey") == F.col("cond_id"))
    s = s.select("s_suppkey", F.concat(F.lit(" "), F.upper("phrase"), F.when(F.col("s_suppkey") % 2 == 0, " new").otherwise(" ")).alias("phrase"))
    return mining.not_yet_there(s, p)


def audited(spark, d):
    """A model's answers: JSON in noise, every sixth missing, every tenth out of range."""
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 4 == 0, "ADD").when(F.col("p_size") % 4 == 1, "remove").when(F.col("p_size") % 4 == 2, "drop").otherwise("split")
    good = F.to_json(F.struct((F.col("p_size") / F.when(F.col("p_partkey") % 10 == 0, 10).otherwise(50)).alias("recall"), F.col("p_size").alias("missed_count"), F.array(F.struct(kind.alias("kind"), F.col("p_brand").alias("phrase"), F.col("p_size").alias("distance"))).alias("recommendations"), F.lit(" why ").alias("explanation")))
    return mining.audits(p.select("p_partkey", "p_type", F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit("Answer: "), good)).alias("raw")))


AUDIT = """a AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE least(1, p_size / CASE WHEN p_partkey % 10 = 0 THEN 10 ELSE 50 END) END AS recall,
  CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size END::INT AS missed_count, CASE WHEN p_partkey % 6 = 0 THEN 'model unavailable' ELSE 'why' END AS explanation,
  CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 'add' WHEN p_size % 4 = 1 THEN 'remove' WHEN p_size % 4 = 3 THEN 'split' END AS kind FROM part)"""


@query(f"WITH {AUDIT} SELECT p_partkey, round(recall, 6) AS recall, missed_count, explanation, kind FROM a")
def phrase_audit(spark, d):
    return audited(spark, d).select("p_partkey", F.round("recall", 6).alias("recall"), "missed_count", "explanation", F.get("recommendations.kind", F.lit(0)).alias("kind"))


@query(f"""WITH {AUDIT} SELECT p_type, count(*) AS phrases, round(avg(recall), 4) AS recall, sum(missed_count)::BIGINT AS missed, count(*) FILTER (kind = 'add') AS to_add, count(*) FILTER (kind = 'remove') AS to_remove, 0::BIGINT AS to_modify,
  count(*) FILTER (kind = 'split') AS to_split FROM a GROUP BY p_type""")
def dictionary_audit(spark, d):
    return mining.full_audit(audited(spark, d), "p_type")


@query(f"""WITH {TURNS}, {hits('a', 'the of', 3)}, {hits('b', 'and')}, m AS (SELECT dialogue_id, turn_index, 'p2' AS cond_id FROM a UNION ALL SELECT dialogue_id, turn_index, 'p1' FROM b)
SELECT dialogue_id, turn_index, min(cond_id) AS cond_id FROM m GROUP BY dialogue_id, turn_index""")
def first_match_per_turn(spark, d):
    m = match_phrases(turns(spark, d), [phrase_row("p2", "the of", 3, "ANY", True), phrase_row("p1", "and", 2, "ANY", True)])
    return mining.first_per_turn(m.select("dialogue_id", "turn_index", "cond_id"), [F.col("cond_id")])


@query("""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), 1) - 1 AS pos FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY (token IN ('the', 'of', 'and'))::INT DESC, pos)::INT AS rank, token, (token IN ('the', 'of', 'and'))::INT::DOUBLE AS contribution FROM t""")
def explain_matched_tokens(spark, d):
    e = mining.explain_tokens(F.col("text"), F.array(*[F.lit(w) for w in ("the", "of", "and")]))
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(e).alias("rank", "x")).select("conv_id", "turn", (F.col("rank") + 1).alias("rank"), "x.token", "x.contribution")


@query("SELECT conv_id, turn, CASE WHEN turn + 3 <= length(text) AND turn < turn + 3 THEN substr(text, turn + 1, 3) ELSE '' END AS span FROM conversations")
def matched_span_text(spark, d):
    at = F.col("turn").cast("int")
    return table(spark, d, "conversations").select("conv_id", "turn", mining.span_text(F.col("text"), at, at + 3).alias("span"))


@query("SELECT n_regionkey + 1 AS cascade_order, coalesce(arg_min(n_name, n_nationkey) FILTER (n_nationkey % 2 = 0 AND n_regionkey < 3), any_value(r_name)) AS name FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey")
def cascade_level_names(spark, d):
    named = table(spark, d, "nation").where("n_nationkey % 2 = 0 and n_regionkey < 3").select((F.col("n_regionkey") + 1).alias("cascade_order"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    return mining.level_names(named, table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("cascade_order"), F.col("r_name").alias("root")))


@query("SELECT source, lang, count(*) AS found, sum(count(*)) OVER (PARTITION BY source)::BIGINT AS total FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 GROUP BY source, lang")
def errors_by_category(spark, d):
    e = table(spark, d, "labels").where("toxic = 1").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    by = e.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("found"))
    total = by.groupBy("source").agg(F.sum("found").alias("total"))
    return by.join(total, "source").select("source", "lang", "found", "total")


@query("""WITH a AS (SELECT o_custkey, o_clerk, max(o_totalprice) AS left_score FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey, o_clerk, max(o_totalprice) AS right_score FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
SELECT o_custkey, o_clerk, left_score, right_score, round(coalesce(left_score, 0) * 0.5 + coalesce(right_score, 0) * 2, 6) AS score FROM a FULL JOIN b USING (o_custkey, o_clerk)""".replace("o_clerk", "o_orderpriority"))
def merged_channels(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.col("o_totalprice").alias("score"), "o_orderstatus")
    return mining.merge_channels(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["o_custkey", "o_orderpriority"], (0.5, 2.0))


# ---------------------------------------------------------------- filters and pages


@query("""WITH c AS (SELECT label AS query_id, list(x ORDER BY pos) AS query FROM (SELECT label, pos, avg(x) AS x FROM
  (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label),
s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], query), 6) AS score FROM embeddings, c),
k AS (SELECT query_id, vec_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10)
SELECT query_id, vec_id, score, rank FROM k WHERE label = query_id""")
def knn_then_session_filter(spark, d):
    """The filter comes after the cut to the k nearest, so fewer than k may be left."""
    e = table(spark, d, "embeddings")
    top = R.vector_top_k(e, "vec_id", centres(spark, d))
    return top.join(e.select("vec_id", "label"), "vec_id").where(F.col("label") == F.col("query_id")).select("query_id", "vec_id", "score", "rank")


@query("SELECT source, doc_id, substr(text, 1, 297) AS fragment FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0)")
def fragments_of_sessions(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    sessions = docs.groupBy("source").agg(F.min("doc_id").alias("m")).where("m % 2 = 0").select("source")
    return docs.join(sessions, "source", "left_semi").select("source", "doc_id", F.substring("text", 1, 297).alias("fragment"))


@query(f"WITH {PHRASES} SELECT cond_id, phrase FROM c WHERE contains(lower(phrase), 'promo') AND channel = 'CLIENT'")
def conditions_filtered(spark, d):
    return phrases(spark, d).where(F.contains(F.lower("phrase"), F.lit("promo")) & (F.col("channel") == "CLIENT")).select("cond_id", "phrase")


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE contains(lower(c_name), '11') OR contains(lower(n_name), 'an')")
def history_filtered(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.where(F.contains(F.lower("c_name"), F.lit("11")) | F.contains(F.lower("n_name"), F.lit("an"))).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def history_page(spark, d):
    return mining.page(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 25).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, least(100, greatest(1, p_size * 3 - 10))::INT AS top_k FROM part")
def clamped_inputs(spark, d):
    return table(spark, d, "part").select("p_partkey", F.least(F.lit(100), F.greatest(F.lit(1), F.col("p_size") * 3 - 10)).cast("int").alias("top_k"))


# ---------------------------------------------------------------- names, templates, stamps, model answers


@query("SELECT page_id, CASE WHEN b <> '' AND regexp_full_match(b, '[\\p{L}\\p{N}_\\s.\\-]+') THEN b END AS name FROM (SELECT page_id, replace(regexp_extract(url, '([^/\\\\]*)$', 1), '..', '') AS b FROM pages)")
def clean_file_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean_file_name(F.col("url")).alias("name"))


@query("SELECT c_custkey, 'Dear ' || c_name || ', {\"n\": ' || c_nationkey || '} {rest}' AS text FROM customer")
def filled_template(spark, d):
    t = X.fill_template(F.lit('Dear {name}, {"n": {nation}} {rest}'), {"name": F.col("c_name"), "nation": F.col("c_nationkey")})
    return table(spark, d, "customer").select("c_custkey", t.alias("text"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS stamp FROM events")
def iso_stamps(spark, d):
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, d, "events").select("event_id", X.canonical_stamp(ts).alias("stamp"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_type, ' '), lambda x: lower(x)), lambda x: x <> 'tin')::VARCHAR AS items FROM part")
def coerced_lists(spark, d):
    """Lists, bare texts and quoted ones, with blanks, as a model writes them."""
    words = F.transform(F.filter(F.split("p_type", " "), lambda x: F.lower(x) != "tin"), F.lower)
    raw = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.concat(words, F.array(F.lit(" "))))).when(F.col("p_partkey") % 3 == 1, F.array_join(words, " , ")).otherwise(F.concat(F.lit('"'), F.array_join(words, ","), F.lit('"')))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(X.coerced_list(raw), ", "), F.lit("]")).alias("items"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'uncertain' WHEN o_orderstatus = 'F' THEN 'relevant' ELSE 'uncertain' END AS value,
  CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 5 = 1 THEN 'wrong_type' WHEN o_orderstatus <> 'F' THEN 'invalid_value' END AS reason FROM orders""")
def checked_labels(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 == 1, "[1]").when(F.col("o_orderkey") % 5 != 0, F.when(F.col("o_orderstatus") == "F", " Релевантно").otherwise("so so"))
    o = table(spark, d, "orders").select("o_orderkey", X.checked_value(raw, X.CONFIDENCE, "uncertain").alias("c"))
    return o.select("o_orderkey", "c.value", "c.reason")


@query("""SELECT o_orderkey, '{"a": {"b": "}' || o_orderstatus || '"}, "n": ' || o_custkey || '}' AS object, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_custkey ELSE 'no object ' || o_custkey END AS summary FROM orders""")
def braces_and_summaries(spark, d):
    noisy = F.concat(F.lit('so: {"a": {"b": "}'), F.col("o_orderstatus"), F.lit('"}, "n": '), F.col("o_custkey"), F.lit("} and {more"))
    flat = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('ok {"summary": "s'), F.col("o_custkey"), F.lit('"}'))).otherwise(F.concat(F.lit("no object "), F.col("o_custkey")))
    return table(spark, d, "orders").select("o_orderkey", X.outer_object(noisy).alias("object"), X.summary_or_raw(flat).alias("summary"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Длительность >= ' || p_size || ' мин' WHEN 1 THEN 'Длительность ' || p_size || ' сек — ' || CASE WHEN p_size % 60 = 0 THEN p_size // 60 || ' ч' ELSE p_size || ' мин' END
  WHEN 2 THEN 'Направление: Входящий' WHEN 3 THEN 'Номер начинается с ' || p_size ELSE 'SIP-сервер из списка (2 шт.)' END AS text FROM part""")
def decoded_attributes(spark, d):
    k = F.col("p_partkey") % 5
    key = F.when(k < 2, "Duration").when(k == 2, "CallDirection").when(k == 3, "RemotePhoneNumber").otherwise("UserDef5")
    size = F.col("p_size")
    value = (
        F.when(k == 0, F.format_string("00:%02d:00;10675199.02:48:05.4775807", size))
        .when(k == 1, F.format_string("00:00:%02d;00:%02d:00", size, size))
        .when(k == 2, "PhoneCallDirectionIngoing")
        .when(k == 3, F.concat(F.lit("StartsWith|"), size))
        .otherwise(F.concat(F.lit("Equals|, a"), size, F.lit(" , b ,")))
    )
    return table(spark, d, "part").select("p_partkey", X.decoded_attribute(key, value).alias("text"))


@query("""WITH e AS (SELECT doc_id, k AS chunk_index, unnest(regexp_extract_all(substr(text, k * 1800 + 1, 2000), '[0-9]{4,}')) AS entity FROM
  (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 1800.0)::INT, 1)))::INT AS k FROM documents)) SELECT doc_id, chunk_index, entity, count(*) AS n FROM e GROUP BY ALL""")
def chunk_entities(spark, d):
    """A recogniser, here of long numbers, run on every chunk."""
    chunks = table(spark, d, "documents").select("doc_id", F.posexplode(chunker.char_windows(F.col("text"))).alias("chunk_index", "chunk"))
    found = chunker.entities(chunks, lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]{4,}"), F.lit(0)), "chunk")
    return found.groupBy("doc_id", "chunk_index", "entity").agg(F.count(F.lit(1)).alias("n"))
