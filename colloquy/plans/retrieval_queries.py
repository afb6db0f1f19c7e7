"""Queries of retrieval, fusion and metrics over documents, benchmark and embeddings, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from colloquy.operators import graph
from colloquy.operators import retrieval as R
from colloquy.operators.kept import written
from colloquy.plans.search_queries import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:  # else the engine of the SQL may join the parts in a poor order
            SQL[f.__name__] = re.sub(r"(?m)((?:^|WITH |, )[a-z]+) AS \(", r"\1 AS MATERIALIZED (", sql)
        return f

    return add


STOP = ", ".join(f"'{w}'" for w in R.STOP_WORDS)
PATTERN = "regexp_extract_all(lower(text), '[а-яёa-z0-9]+')"
TERMS = f"dt AS (SELECT doc_id, term FROM (SELECT doc_id, unnest({PATTERN}) AS term FROM documents) WHERE term NOT IN ({STOP}))"
BM25 = f"""{TERMS},
dl AS (SELECT doc_id, count(*) AS dl FROM dt GROUP BY doc_id),
p AS (SELECT doc_id, term, dl, count(*) AS tf FROM dt JOIN dl USING (doc_id) GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM dt) / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({PATTERN}) AS term FROM benchmark) WHERE term NOT IN ({STOP})),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM p JOIN df USING (term) JOIN qt USING (term), st GROUP BY query_id, doc_id),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE score > 0 QUALIFY rank <= 10)"""


def spelled(key: str, src: str) -> str:
    return f"(SELECT {key}, term FROM (SELECT {key}, unnest({PATTERN}) AS term FROM {src}) WHERE length(term) >= 2 AND regexp_matches(term, '[а-яёa-z]'))"


VOCAB = f"""v AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INT AS idx, df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM {spelled('doc_id', 'documents')}) GROUP BY term ORDER BY encode(term) LIMIT 1536))"""


def vec(name: str, key: str, src: str) -> str:
    return f"""{name}r AS (SELECT {key}, term, sum(count(*)) OVER (PARTITION BY {key}) AS dl, count(*) AS tf FROM {spelled(key, src)} GROUP BY {key}, term),
{name}w AS (SELECT {key}, idx, tf / dl * idf AS w FROM {name}r JOIN v USING (term)),
{name} AS (SELECT {key}, idx, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}w)"""


COSINE = f"""{VOCAB}, {vec("dv", "doc_id", "documents")}, {vec("qv", "item_id", "benchmark")},
cs AS (SELECT item_id AS query_id, doc_id, round(sum(dv.weight * qv.weight), 6) AS score FROM dv JOIN qv USING (idx) GROUP BY item_id, doc_id),
tf AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM cs WHERE score > 0 QUALIFY rank <= 10)"""
RANKS = "r AS (SELECT query_id, 'sparse' AS channel, doc_id, score, rank FROM bm UNION ALL SELECT query_id, 'dense', doc_id, score, rank FROM tf)"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_ranking(spark, d):
    return R.bm25(docs(spark, d), "doc_id", asked(spark, d))


def cosine_ranking(spark, d):
    v = R.tfidf_vocabulary(docs(spark, d))
    return R.sparse_cosine(R.tfidf_rows(docs(spark, d), "doc_id", v), "doc_id", R.tfidf_vectors(asked(spark, d), "query_id", v))


def both(spark, d):
    return R.bm25_and_cosine(docs(spark, d), "doc_id", asked(spark, d))


@query(f"WITH {TERMS} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS tokens, round(count(*) / (SELECT count(*) FROM documents), 4) AS avgdl, count(DISTINCT term) AS unique_terms FROM dt")
def bm25_index_stats(spark, d):
    return R.bm25_stats(docs(spark, d))


@query(f"WITH {BM25} SELECT * FROM bm")
def bm25_topk(spark, d):
    return bm25_ranking(spark, d)


LEMMA = "CASE WHEN length(term) >= 7 AND term IN (SELECT term FROM kf) THEN substr(term, 1, 5) ELSE term END"
LEMMAS = (
    f"kf AS (SELECT DISTINCT term FROM (SELECT unnest({PATTERN}) AS term FROM benchmark)), "
    + BM25.replace(f"WHERE term NOT IN ({STOP}))", f"WHERE {LEMMA} NOT IN ({STOP}))").replace("SELECT doc_id, term FROM (SELECT doc_id, unnest", f"SELECT doc_id, {LEMMA} AS term FROM (SELECT doc_id, unnest").replace("SELECT DISTINCT query_id, term FROM (SELECT item_id", f"SELECT DISTINCT query_id, {LEMMA} AS term FROM (SELECT item_id")
)


@query(f"WITH {LEMMAS} SELECT * FROM bm")
def bm25_lemmas_topk(spark, d):
    """Ranking with lemmas: the benchmark's words of seven letters or more count as their first five."""
    forms = asked(spark, d).select(F.explode(R.X.tokens(F.col("text"))).alias("form")).distinct().where(F.length("form") >= 7)
    return R.bm25(docs(spark, d), "doc_id", asked(spark, d), lemmas=forms.withColumn("lemma", F.substring("form", 1, 5)))


@query(f"WITH {VOCAB} SELECT term, idx, df, round(idf, 6) AS idf FROM v")
def tfidf_vocab(spark, d):
    return R.tfidf_vocabulary(docs(spark, d)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {VOCAB}, {vec('dv', 'doc_id', 'documents')} SELECT doc_id, idx, round(weight, 6) AS weight FROM dv")
def tfidf_vectors(spark, d):
    v = R.tfidf_vocabulary(docs(spark, d))
    return R.tfidf_vectors(docs(spark, d), "doc_id", v).withColumn("weight", F.round("weight", 6))


@query(f"WITH {COSINE} SELECT * FROM tf")
def tfidf_cosine_topk(spark, d):
    return cosine_ranking(spark, d)


def centres(spark, d):
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("query"))


@query("""WITH c AS (SELECT label AS query_id, list(x ORDER BY pos) AS query FROM (SELECT label, pos, avg(x) AS x FROM
  (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], query), 6) AS score FROM embeddings, c)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def vector_topk(spark, d):
    return R.vector_top_k(table(spark, d, "embeddings"), "vec_id", centres(spark, d))


@query("SELECT count(*) AS vectors, count(DISTINCT label) AS labels, sum(len(embedding) * 4)::BIGINT AS bytes FROM embeddings")
def vector_store_stats(spark, d):
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("label").alias("labels"), F.sum(F.size("embedding") * 4).alias("bytes"))


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 3)")
def vector_delete_by_key(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    gone = e.groupBy("label").count().orderBy(F.desc("count"), "label").limit(3).select("label")
    return e.join(gone, "label", "left_anti").select("vec_id", "label")


@query(f"WITH {BM25}, {COSINE}, {RANKS} SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 6) AS score FROM r GROUP BY query_id, doc_id")
def rrf_fusion(spark, d):
    return R.fuse("RRF", both(spark, d), "doc_id")


CONVEX = """x AS (SELECT query_id, doc_id, CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END AS x FROM
  (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM r WINDOW w AS (PARTITION BY query_id, channel)))"""


@query(f"WITH {BM25}, {COSINE}, {RANKS}, {CONVEX} SELECT query_id, doc_id, round(sum(0.5 * x), 6) AS score FROM x GROUP BY query_id, doc_id")
def convex_fusion(spark, d):
    return R.fuse("convex", both(spark, d), "doc_id")


@query(f"""WITH {BM25}, {COSINE}, {RANKS}, g AS (SELECT query_id, doc_id, max(score) FILTER (channel = 'dense') AS dn, max(score / 100) FILTER (channel = 'sparse') AS sp FROM r GROUP BY ALL),
f AS (SELECT query_id, coalesce((list(score ORDER BY score) FILTER (channel = 'dense' AND score > 0))[(count(*) FILTER (channel = 'dense' AND score > 0)) // 2 + 1], 0) AS beta,
  CASE WHEN stddev_pop(score) FILTER (channel = 'dense' AND score > 0) > 0 THEN 1 / stddev_pop(score) FILTER (channel = 'dense' AND score > 0) ELSE 1 END AS alpha FROM r GROUP BY query_id),
l AS (SELECT query_id, doc_id, dn, sp, greatest(-500, least(500, alpha * (dn - beta))) AS ld, ln(greatest(1e-10, least(1 - 1e-10, sp)) / (1 - greatest(1e-10, least(1 - 1e-10, sp)))) AS ls FROM g JOIN f USING (query_id))
SELECT query_id, doc_id, round(1 / (1 + exp(-(CASE WHEN dn IS NOT NULL AND sp IS NOT NULL THEN (0.5 * ld + 0.5 * ls) * sqrt(2) WHEN dn IS NOT NULL THEN 0.5 * ld ELSE 0.5 * ls END))), 6) AS score FROM l""")
def logodds_fusion(spark, d):
    r = both(spark, d).withColumn("score", F.when(F.col("channel") == "sparse", F.col("score") / 100).otherwise(F.col("score")))
    return R.fuse("logodds", r, "doc_id")


HYBRID = f"""{BM25}, {COSINE}, {RANKS}, fz AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 6) AS score FROM r GROUP BY ALL),
cut AS (SELECT * FROM fz QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10)"""


def first_words(df, key):
    """Stand-ins for entities: long words."""
    return df.select(key, F.explode(F.array_distinct(F.filter(R.X.tokens(F.col("text")), lambda t: F.length(t) >= 12))).alias("entity"))


def hybrid_cut(spark, d):
    return R.top_k(R.rrf(both(spark, d), "doc_id"), "query_id", "doc_id", 10).drop("rank")


ENT = "SELECT DISTINCT {k}, entity FROM (SELECT *, unnest(regexp_extract_all(lower(text), '[а-яёa-z0-9]{{12,}}')) AS entity FROM {t})".format
BOOST = f"""{HYBRID}, qe AS ({ENT(k="item_id AS query_id", t="benchmark")}), de AS ({ENT(k="doc_id", t="documents")}),
gn AS (SELECT query_id, doc_id, sum(0.1 * CASE WHEN length(entity) >= 14 THEN 1.5 ELSE 1 END) AS gain FROM qe JOIN de USING (entity) GROUP BY ALL),
bo AS (SELECT query_id, doc_id, round(score + coalesce(gain, 0), 6) AS score FROM cut LEFT JOIN gn USING (query_id, doc_id))"""


def boosted(spark, d):
    cut = written(hybrid_cut(spark, d), "hybrid-cut")
    named = docs(spark, d).join(F.broadcast(cut.select("doc_id").distinct()), "doc_id", "left_semi")  # ten a query
    q = first_words(asked(spark, d), "query_id").select("query_id", "entity", F.col("entity").alias("normal"), F.when(F.length("entity") >= 14, "PER").otherwise("ORG").alias("kind"))
    return R.boost_by_entities(cut, "doc_id", q, first_words(named, "doc_id"))


@query(f"WITH {BOOST} SELECT * FROM bo")
def ner_boost(spark, d):
    return boosted(spark, d)


@query(f"WITH {BOOST} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM bo QUALIFY rank <= 5")
def hybrid_search(spark, d):
    return R.top_k(boosted(spark, d), "query_id", "doc_id", 5)


@query(f"""WITH {COSINE}, best AS (SELECT query_id, doc_id FROM tf WHERE rank = 1),
n AS (SELECT query_id, b.doc_id, term, idx, idf, tf FROM best b JOIN dvr USING (doc_id) JOIN v USING (term)),
m AS (SELECT n.*, tf * idf AS w, coalesce(weight, 0) AS qw FROM n LEFT JOIN qv ON qv.item_id = n.query_id AND qv.idx = n.idx),
s AS (SELECT *, sum(w * qw) OVER z AS d, sum(w * w) OVER z AS n2, (tf - 1) * idf AS less FROM m WINDOW z AS (PARTITION BY query_id, doc_id)),
t AS (SELECT *, greatest(n2 - w * w + less * less, 0) AS a2 FROM s),
u AS (SELECT query_id, doc_id, term, round(d / sqrt(n2) - CASE WHEN a2 > 1e-12 THEN (d - w * qw + less * qw) / sqrt(a2) ELSE 0 END, 6) AS delta FROM t)
SELECT query_id, doc_id, term, delta, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY abs(delta) DESC, encode(term))::INT AS rank FROM u QUALIFY rank <= 5""")
def explain_leave_one_out(spark, d):
    v = R.tfidf_vocabulary(docs(spark, d))
    qv = R.tfidf_vectors(asked(spark, d), "query_id", v)
    best = R.sparse_cosine(R.tfidf_rows(docs(spark, d), "doc_id", v), "doc_id", qv).where("rank = 1").select("query_id", "doc_id")
    return R.leave_one_out(best.join(docs(spark, d), "doc_id"), "doc_id", v, qv)


QRELS = "qr AS (SELECT item_id AS query_id, doc_id, CASE WHEN contains(d.text, b.text) THEN 3 WHEN contains(d.text, substr(b.text, 1, 40)) THEN 1 ELSE 0 END AS grade FROM documents d, benchmark b)"


def relevant(spark, d):
    """Documents that hold an item's whole text, or its first 40 characters: found by the longest of their inner words, then tested."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    words = R.X.tokens(F.substring("item", 1, 40))
    inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    second = b.withColumn("word", F.coalesce(F.array_max(inner)["w"], F.get(words, F.lit(1))))
    have = docs(spark, d).withColumn("word", F.explode(F.array_distinct(R.X.tokens(F.col("text")))))
    grade = F.when(F.contains("text", "item"), 3).when(F.contains(F.col("text"), F.substring("item", 1, 40)), 1).otherwise(0)
    return have.join(R.small(second), "word").select("query_id", "doc_id", grade.alias("grade")).where("grade > 0")


METRICS = f"""{BM25}, {QRELS}, rel AS (SELECT * FROM qr WHERE grade > 0),
tot AS (SELECT query_id, count(*) AS n, sum(CASE WHEN k <= 10 THEN grade / log2(k + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS k FROM rel) GROUP BY query_id),
got AS (SELECT query_id, count(*) AS h, min(rank) AS f, sum(grade / log2(rank + 1)) AS dcg FROM bm JOIN rel USING (query_id, doc_id) GROUP BY query_id)"""


def measured(spark, d):
    return R.retrieval_metrics(bm25_ranking(spark, d), relevant(spark, d), "doc_id")


@query(f"WITH {METRICS} SELECT query_id, round(coalesce(h / n, 0), 6) AS recall, round(coalesce(h / 10, 0), 6) AS precision FROM tot LEFT JOIN got USING (query_id)")
def recall_precision_at_k(spark, d):
    return measured(spark, d).select("query_id", "recall", "precision")


@query(f"WITH {METRICS} SELECT round(avg(round(coalesce(1 / f, 0), 6)), 6) AS mrr, count(*) AS queries FROM tot LEFT JOIN got USING (query_id)")
def mrr(spark, d):
    return measured(spark, d).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.count(F.lit(1)).alias("queries"))


@query(f"WITH {METRICS} SELECT query_id, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM tot LEFT JOIN got USING (query_id)")
def ndcg_at_k(spark, d):
    return measured(spark, d).select("query_id", "ndcg")


KNN = """kn AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, w AS weight FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS w
  FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.299 QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= 5) WHERE w >= 0.3)"""


@query(f"WITH {KNN} SELECT DISTINCT * FROM kn")
def knn_graph(spark, d):
    return R.knn_graph(table(spark, d, "embeddings"), "vec_id")


@query(f"""WITH RECURSIVE {KNN}, ed AS (SELECT src, dst FROM kn UNION SELECT dst, src FROM kn),
re AS (SELECT DISTINCT src AS node, src AS top FROM ed UNION SELECT ed.dst, re.top FROM re JOIN ed ON re.node = ed.src)
SELECT node AS vec_id, min(top) AS topic FROM re GROUP BY node""")
def topic_components(spark, d):
    edges = R.knn_graph(table(spark, d, "embeddings"), "vec_id")
    return graph.groups(edges).select(F.col("node").alias("vec_id"), "topic")


@query()
def topic_communities(spark, d):
    edges = R.knn_graph(table(spark, d, "embeddings"), "vec_id")
    return graph.communities(edges).select(F.col("node").alias("vec_id"), "topic")


@query(f"""WITH {KNN}, w AS (SELECT src, dst, any_value(weight) AS w FROM kn GROUP BY ALL),
lb AS (SELECT vec_id, label FROM embeddings), ab AS (SELECT a.label AS x, b.label AS y, w FROM w JOIN lb a ON a.vec_id = src JOIN lb b ON b.vec_id = dst),
en AS (SELECT l, sum(w) AS total FROM (SELECT x AS l, w FROM ab UNION ALL SELECT y, w FROM ab) GROUP BY l),
nn AS (SELECT x AS l, 2 * sum(w) AS inside FROM ab WHERE x = y GROUP BY x)
SELECT round(sum(coalesce(inside, 0) / (SELECT sum(total) FROM en) - (total / (SELECT sum(total) FROM en)) ** 2), 6) AS modularity FROM en LEFT JOIN nn USING (l)""")
def label_modularity(spark, d):
    edges = R.knn_graph(table(spark, d, "embeddings"), "vec_id")
    return graph.modularity(edges, table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("topic")))


@query(f"""WITH tm AS (SELECT DISTINCT doc_id, term FROM {spelled('doc_id', 'documents')}), c AS (SELECT source AS topic, term, count(*) AS docs FROM tm JOIN documents USING (doc_id) GROUP BY ALL)
SELECT topic, term, docs, row_number() OVER (PARTITION BY topic ORDER BY docs DESC, encode(term))::INT AS rank FROM c QUALIFY rank <= 3""")
def topic_labels(spark, d):
    topics = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.col("source").alias("topic"))
    return graph.topic_labels(docs(spark, d), "doc_id", topics)
