"""Streaming queries run to the end of what is there, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.kept import shared_folder
from colloquy.operators.matcher import phrase_row
from colloquy.plans.search_queries import IN, TURNS, hits, sel, three_roots
from colloquy.streaming import dialogues, gates

Q: dict = {}
SQL: dict[str, str] = {}


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table of the shared folder; read that."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: a pattern of that one name takes both."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_of(spark, sf_dir, "events")
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dialogues.distinct_within(events(spark, sf_dir))
    return drained(e.select("event_id", "user_id", "event_type"))


Q["stream_unique_events"] = stream_unique_events
SQL["stream_unique_events"] = "SELECT DISTINCT event_id, user_id, event_type FROM events"


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(dialogues.windows(events(spark, sf_dir), "1 hour", "1 hour")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events")


#: Windows that the watermark has closed when the input ends.
Q["stream_window_counts"] = stream_window_counts
SQL["stream_window_counts"] = """WITH w AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drained(dialogues.sessions(events(spark, sf_dir)))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


#: Sessions that the watermark has closed when the input ends.
Q["stream_sessions"] = stream_sessions
SQL["stream_sessions"] = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", count(*) AS events FROM k GROUP BY user_id, k)
SELECT * FROM s WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


def stream_phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_of(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "user", "Клиент").when(F.col("role") == "assistant", "Сотрудник").otherwise("Неизвестный")
    turns = found.select(F.col("conv_id").cast("string").alias("dialogue_id"), F.col("turn").cast("int").alias("turn_index"), said.alias("speaker"), "text")
    rows = [phrase_row("a", "the of", 3, "CLIENT", True), phrase_row("b", "was by", 8, "ANY", True)]
    return drained(dialogues.stream_matches(turns, rows)).select("dialogue_id", "turn_index", "phrase")


Q["stream_phrase_matches"] = stream_phrase_matches
SQL["stream_phrase_matches"] = f"""WITH turns AS (SELECT conv_id::VARCHAR AS dialogue_id, turn::INT AS turn_index, text, 0 AS start_offset, 0 AS end_offset, regexp_extract_all(lower(text), '[а-яёa-z0-9]+') AS toks,
  CASE role WHEN 'user' THEN 'Клиент' WHEN 'assistant' THEN 'Сотрудник' ELSE 'Неизвестный' END AS speaker FROM conversations),
{hits('a', 'the of', 3, 'CLIENT')}, {hits('b', 'was by', 8)} SELECT dialogue_id, turn_index, 'the of' AS phrase FROM a UNION ALL SELECT dialogue_id, turn_index, 'was by' FROM b"""


def dialogue_clock(turns: DataFrame) -> DataFrame:
    """Conversations on a clock: one begins every minute, a turn takes ten seconds."""
    return turns.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("conv_id") + 10 * F.col("turn")))


def stream_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dialogue_clock(stream_of(spark, sf_dir, "conversations"))
    said = F.when(F.col("role") == "user", "Клиент").when(F.col("role") == "assistant", "Сотрудник").otherwise("Неизвестный")
    turns = found.select(F.col("conv_id").cast("string").alias("dialogue_id"), F.col("turn").cast("int").alias("turn_index"), said.alias("speaker"), "text", "ts")
    with gates.state_store(spark):
        return drained(gates.gated_matches(turns, three_roots(), "20 minutes", "10 minutes")).drop("matched_text")


#: Dialogues that the watermark has closed when the input ends.
Q["stream_cascade"] = stream_cascade
SQL["stream_cascade"] = f"""WITH {TURNS}, {hits('a', 'the of', 3)}, {hits('b', 'was')}, {hits('c', 'by')},
t AS (SELECT conv_id, max(60 * conv_id + 10 * turn) AS last FROM conversations GROUP BY conv_id),
closed AS (SELECT conv_id::VARCHAR AS dialogue_id FROM t WHERE last + 1200 <= (SELECT max(last) FROM t) - 600),
m AS ({sel('a', 'the of', 'first')} UNION ALL {sel('b', 'was', 'second', 1, 2, IN('a'))} UNION ALL {sel('c', 'by', 'third', 1, 3, IN('a') + ' AND ' + IN('b'))})
SELECT * FROM m JOIN closed USING (dialogue_id)"""
