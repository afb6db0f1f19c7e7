"""Line deduplication: lines that many documents have stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import broadcast_if, lower_ascii, materialise

#: What is stripped at both ends of a line's key.
BLANK = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z lower-cased; all-ASCII lines take the short way to the same."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.char_length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(lower_ascii(bare))


def _kept(lines: Column, gone: Column) -> Column:
    """The lines between those at the sorted positions `gone`, run by run, so that the work is linear in the text."""
    first = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
    end = lambda i: F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i))
    runs = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, first(i) + 1, end(i) - first(i)))
    return F.array_join(F.flatten(runs), "\n")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): texts without the lines that at least min_docs documents have.

    Normalised lines are exploded with their positions and named by 128 bits of hashes. Documents are
    counted for each name; a frequent line of min_chars code points or more stays only in the least
    doc_id that has it (there every time), elsewhere its positions go. The text is put together again
    from the runs of lines between those positions. Names are written once, so texts are normalised
    once; a line that a third of all rows have is summed before any exchange, and in the join that
    finds its places it is broadcast or its rows are split.

    A null text is an empty one and has one empty line; texts of any length are handled whole. Rows of
    one doc_id, repeated or different, are one document, and each row is returned; a null doc_id is
    an id like others that comes after all, so it keeps a line only if no other document has it.
    Empty tables give an empty result; other columns, whatever their names, are not used.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text_name = F.xxhash64("text").alias("text_name")
    keys = rows.select("doc_id", text_name, F.posexplode(F.transform(F.split("text", "\n"), line_key)).alias("pos", "key"))
    marks = keys.where(F.char_length("key") >= min_chars).select("doc_id", "text_name", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))
    marks = materialise(marks, "line-marks")

    counts = [F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull().cast("int")).alias("nameless")]
    if min_docs <= 2:  # two ends that differ are two documents
        n = F.when(F.col("keeper").isNotNull(), F.when(F.col("keeper") < F.col("last"), 2).otherwise(1)).otherwise(0)
    else:
        counts.append(F.count_distinct("doc_id").alias("n"))
        n = F.col("n")
    held = marks.groupBy("a", "b").agg(*counts).where(n + F.col("nameless") >= min_docs).select("a", "b", "keeper")
    held = materialise(held, "line-frequent")
    held = broadcast_if(held, 64 * held.count())
    away = marks.join(held, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = away.groupBy("doc_id", "text_name").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    gone = materialise(gone.select(F.col("doc_id").alias("id"), F.col("text_name").alias("name"), "gone"), "line-places")
    measured = gone.agg(F.sum(4 * F.size("gone") + 64)).first()[0]
    gone = broadcast_if(gone, measured or 0)

    whole = rows.select("doc_id", "text", text_name, F.split("text", "\n").alias("lines"))
    found = whole.join(gone, whole["doc_id"].eqNullSafe(gone["id"]) & (whole["text_name"] == gone["name"]), "left")
    return found.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_kept(F.col("lines"), F.col("gone"))).alias("kept"),
    )


def oracle(min_chars: int = 10, min_docs: int = 2) -> str:
    """DuckDB SQL of op13 over documents."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, {blank}), '{upper}', '{upper.lower()}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
m AS (SELECT r, k.doc_id, pos, line, coalesce(k.doc_id <> keeper, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""
