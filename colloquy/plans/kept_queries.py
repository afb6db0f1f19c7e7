"""Queries of kept tables and indexes: built, changed and read again, with the SQL of what must come out."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.kept import shared_folder
from colloquy.plans.retrieval_queries import BM25, asked
from colloquy.plans.search_queries import table
from colloquy.sources.lexical import LexicalIndex
from colloquy.sources.store import Change, Store
from colloquy.sources.vectors import VectorIndex

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"(?m)((?:^|WITH |, )[a-z]+) AS \(", r"\1 AS MATERIALIZED (", sql)
        return f

    return add


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def changed_orders(spark: SparkSession, d: str) -> Store:
    """Orders and their lines, kept, then changed in several commits."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    store = Store(spark, place(spark, "orders"), {
        "orders": (", ".join(f"{c} {t}" for c, t in orders.dtypes), ["o_orderkey"]),
        "lines": (", ".join(f"{c} {t}" for c, t in lines.dtypes), ["o_orderkey", "l_linenumber"]),
    })

    def both(c: Change) -> None:
        c.append("orders", orders)
        c.append("lines", lines)

    store.change(both)
    partly = orders.where("o_orderstatus = 'P'").select("o_orderkey")
    one = lines.join(partly, "o_orderkey", "left_semi").groupBy("o_orderkey").agg(F.sum("l_quantity").alias("l_quantity")).select("o_orderkey", F.lit(0).cast(lines.schema["l_linenumber"].dataType).alias("l_linenumber"), "l_quantity")
    store.replace_children("lines", partly, one)
    store.update("orders", orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit(0.0).alias("o_totalprice")))
    large = orders.where("o_orderstatus = 'O' and o_totalprice > 100000").select("o_orderkey")

    def drop(c: Change) -> None:
        c.delete("orders", large)
        c.delete("lines", large)

    store.change(drop)
    store.compact("lines")
    store.upsert("lines", lines.where("l_linenumber = 1").join(large, "o_orderkey", "left_semi").groupBy("o_orderkey", "l_linenumber").agg((F.sum("l_quantity") + 1000).alias("l_quantity")))
    return store


CHANGED = """WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000),
p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"""


@query(f"""{CHANGED} SELECT o_orderkey, o_orderstatus, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END)::DOUBLE AS o_totalprice FROM orders ANTI JOIN g USING (o_orderkey)""")
def store_parents(spark, d):
    return changed_orders(spark, d).read("orders")


@query(f"""{CHANGED} SELECT l_orderkey AS o_orderkey, l_linenumber::INT AS l_linenumber, l_quantity::DOUBLE AS l_quantity FROM lineitem WHERE l_orderkey NOT IN (FROM p) AND l_orderkey NOT IN (FROM g)
UNION ALL SELECT l_orderkey, 0, sum(l_quantity)::DOUBLE FROM lineitem WHERE l_orderkey IN (FROM p) GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, 1, sum(l_quantity)::DOUBLE + 1000 FROM lineitem WHERE l_orderkey IN (FROM g) AND l_linenumber = 1 GROUP BY l_orderkey""")
def store_children(spark, d):
    return changed_orders(spark, d).read("lines").withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


def kept_vectors(spark: SparkSession, d: str) -> VectorIndex:
    """All embeddings, a segment for each half of the labels; one label's vectors are deleted, then added again turned round."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("dialogue_id"), "embedding")
    dimension = rows.select(F.max(F.size("embedding"))).first()[0]
    index = VectorIndex(spark, place(spark, "vectors"), dimension)
    index.add(rows.where("crc32(dialogue_id) % 2 = 0"))
    index.add(rows.where("crc32(dialogue_id) % 2 <> 0"))
    first = rows.agg(F.min("dialogue_id").alias("dialogue_id"))
    index.delete_dialogues(first)
    index.compact()
    last = rows.agg(F.max("dialogue_id").alias("dialogue_id"))
    index.replace_dialogues(rows.join(last, "dialogue_id", "left_semi").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    return index


LIVE = """WITH ends AS (SELECT min(label::VARCHAR) AS gone, max(label::VARCHAR) AS turned FROM embeddings),
live AS (SELECT vec_id, label::VARCHAR AS dialogue_id, list_transform(embedding, lambda x: (CASE WHEN label::VARCHAR = turned THEN -1 ELSE 1 END) * x::DOUBLE) AS v FROM embeddings, ends WHERE label::VARCHAR <> gone)"""


@query(f"""{LIVE}, asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, dialogue_id, round(list_cosine_similarity(v, q), 6) AS score FROM live, asked)
SELECT query_id, vec_id, dialogue_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def vector_index_topk(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return kept_vectors(spark, d).search(asked)


@query(f"""{LIVE} SELECT count(*) AS vectors, count(DISTINCT dialogue_id) AS dialogues, count(*) * max(len(v)) * 4 AS bytes FROM live""")
def vector_index_kept(spark, d):
    return kept_vectors(spark, d).stats()


def kept_terms(spark: SparkSession, d: str) -> LexicalIndex:
    """All documents, a segment for each language."""
    index = LexicalIndex(spark, place(spark, "lexical"))
    rows = table(spark, d, "documents").select("doc_id", "text", "lang")
    index.add(rows.where("lang = 'en'"), "doc_id")
    index.add(rows.where("lang <> 'en' or lang is null"), "doc_id")
    return index


@query(f"WITH {BM25} SELECT * FROM bm")
def lexical_index_topk(spark, d) -> DataFrame:
    return kept_terms(spark, d).search(asked(spark, d)).withColumnRenamed("key", "doc_id")
