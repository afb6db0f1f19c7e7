"""Benchmark decontamination: MinHash containment search by item size, verified on exact shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import GAP, broadcast_if, materialise


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _positions(words: Column, width) -> Column:
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.expr("cast(array() as array<int>)"))


def _names(words: Column, width: int) -> Column:
    """64-bit names of the shingles of so many words at every position of an array column."""
    return F.transform(_positions(words, width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))


def _sketch(words: Column, width: int, top: int) -> Column:
    """A document's hashes up to `top`, with their width."""
    least = F.filter(F.array_distinct(_names(words, width)), lambda x: x <= top)
    return F.transform(least, lambda x: F.struct(x.alias("name"), F.lit(width).alias("width")))


def _texts(words: Column, width: Column) -> Column:
    """The distinct shingles themselves."""
    return F.array_distinct(F.transform(_positions(words, width), lambda i: F.array_join(F.slice(words, i + 1, width), " ")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of every item that a document contains.

    An item is contained if at least that share of its distinct word shingles (lower-case words) is
    among the document's; the whole of an item of fewer words is its only shingle. Items are
    partitioned by size, in powers of two, as the largest one of a partition says how many shingles
    any may lack (L). An item's sketch is its 2 L + 2 least hashes. A document's sketch for a
    partition is all its hashes up to the largest one in the partition's sketches, so long documents
    are no weaker than short ones. Both sketches are joined; a pair is a candidate if all but L of
    the item's hashes meet, which every containing document does, so the search misses none. Only
    candidates read their texts again, and are verified on the shingles themselves.

    Null and empty items are found nowhere, null and empty texts contain nothing, and texts of any
    length are searched whole; a null id is an id like others. Repeated rows of items count once,
    those of documents give one row per document and item, and of several texts with one id the
    best counts, in ties the one with more shingles. Empty tables give an empty result; other
    columns, whatever their names, are not used.
    """
    w = F.col("item_words")
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    items = items.withColumn("width", F.least(F.lit(width), F.size(w)))
    by_width = F.lit(None).cast("array<bigint>")
    for k in range(1, width + 1):
        by_width = F.when(F.col("width") == k, _names(w, k)).otherwise(by_width)
    items = items.select("item_id", "width", _texts(w, F.col("width")).alias("item_texts"), F.array_sort(F.array_distinct(by_width)).alias("item_names")).distinct()
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("item_names")))).cast("int")
    items = items.withColumn("lacking", F.floor((1 - containment) * upper + 1e-9).cast("int"))
    items = items.withColumn("sketch", F.slice("item_names", 1, 2 * F.col("lacking") + 2)).drop("item_names")
    items = items.withColumn("need", F.greatest(F.lit(1), F.size("sketch") - F.col("lacking")))
    items = materialise(items.withColumn("item", F.xxhash64("item_id", "item_texts")), "leak-items")
    size = items.agg(F.sum(F.size("sketch") * 32), F.sum(F.aggregate("item_texts", F.lit(64), lambda a, x: a + F.octet_length(x) + 16))).first()
    index = broadcast_if(items.select("item", "width", "need", F.explode("sketch").alias("name")), size[0] or 0)
    whole = broadcast_if(items.select("item", "item_id", "width", "item_texts"), size[1] or 0)
    bounds = {r["width"]: r["top"] for r in items.groupBy("width").agg(F.max(F.array_max("sketch")).alias("top")).collect()}  # at most `width` rows

    rid = F.xxhash64("doc_id", "text")
    d = F.col("words")
    sketches = [_sketch(d, k, top) for k, top in sorted(bounds.items())]
    sketch = F.concat(*sketches) if sketches else F.expr("cast(array() as array<struct<name:bigint,width:int>>)")
    probes = docs.select(rid.alias("rid"), words_of(F.col("text")).alias("words")).select("rid", F.explode(sketch).alias("s")).select("rid", "s.name", "s.width")
    # A repeated row counts a hash again, which can only make one more candidate.
    met = probes.join(index, ["name", "width"]).groupBy("rid", "item").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    found = materialise(met.where("n >= need").select("rid", "item"), "leak-candidates")
    found = broadcast_if(found, 32 * found.count())

    read = docs.select("doc_id", rid.alias("rid"), words_of(F.col("text")).alias("words")).join(found, "rid").join(whole, "item")
    shared = F.size(F.array_intersect("item_texts", _texts(d, F.col("width"))))
    verified = read.select("doc_id", "item_id", F.size("item_texts").cast("long").alias("item_shingles"), shared.cast("long").alias("shared"))
    best = verified.where(F.col("shared") >= containment * F.col("item_shingles")).groupBy("doc_id", "item_id")
    best = best.agg(F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("containment"), "item_shingles", "shared")).alias("m"))
    return best.select("doc_id", "item_id", "m.item_shingles", "m.shared", "m.containment")


def without_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs that contain no item; a row without a doc_id goes only if another such row leaks.

    All columns stay, of whatever names; an empty table stays empty, and without items nothing goes.
    """
    leaks = find_leaks(docs.select("doc_id", "text"), benchmark, containment, width).select(F.col("doc_id").alias("_leak_id_")).distinct()
    leaks = materialise(leaks, "leaks")
    leaks = broadcast_if(leaks, 64 * leaks.count())
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_leak_id_"]), "left_anti")


def oracle(containment: float = 0.8) -> str:
    """DuckDB SQL of find_leaks over documents and benchmark."""
    words = "regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w"
    return f"""
WITH iw AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {words} FROM benchmark) WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, k, list_aggregate(list_slice(w, j, j + k - 1), 'string_agg', ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM iw)),
d AS (SELECT DISTINCT doc_id, k, list_aggregate(list_slice(w, j, j + k - 1), 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM (SELECT doc_id, {words} FROM documents), (SELECT DISTINCT k FROM iw))),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM i JOIN d USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE shared >= {containment} * item_shingles"""
