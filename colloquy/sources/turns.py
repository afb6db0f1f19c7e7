"""Dialogue turns from tables and plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as X
from colloquy.schemas import CLIENT, OPERATOR, UNKNOWN

#: Characters a second of speech for tables without times.
SPEED = 15.0


def with_end_offsets(turns: DataFrame) -> DataFrame:
    """A turn ends where the next one starts, the last one where it starts itself; null without a start."""
    w = Window.partitionBy("dialogue_id").orderBy("turn_index")
    return turns.withColumn("end_offset", F.when(F.col("start_offset").isNotNull(), F.coalesce(F.lead("start_offset").over(w), F.col("start_offset"))))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Turns of conversations(conv_id, turn, role, text), timed by the length of what came before."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    role = F.when(F.col("role") == "user", CLIENT).when(F.col("role") == "assistant", OPERATOR).otherwise(UNKNOWN)
    turns = conversations.select(
        F.col("conv_id").cast("string").alias("dialogue_id"),
        F.col("turn").cast("int").alias("turn_index"),
        role.alias("speaker"),
        "text",
        F.lit(None).cast("string").alias("timestamp"),
        (F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)) / SPEED).alias("start_offset"),
    )
    return with_end_offsets(turns)


def from_plain_text(files: DataFrame) -> DataFrame:
    """Turns of files(dialogue_id, text): a line is a turn; a prefix names the speaker, else speakers alternate.

    The first line without a prefix is the employee's; each further one is the other's than before.
    """
    lines = files.select("dialogue_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    prefix = F.regexp_extract("raw", rf"(?i)^({CLIENT}|{OPERATOR})\s*:", 1)
    named = F.when(F.lower(prefix) == CLIENT.lower(), 0).when(F.lower(prefix) == OPERATOR.lower(), 1)
    w = Window.partitionBy("dialogue_id").orderBy("line")
    lines = lines.withColumn("k", F.row_number().over(w)).withColumn("who", named)
    last = F.last(F.when(F.col("who").isNotNull(), F.struct("who", "k")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    who = F.when(last.isNull(), F.col("k") % 2).otherwise((last["who"] + F.col("k") - last["k"]) % 2)
    return lines.select(
        "dialogue_id",
        (F.col("k") - 1).cast("int").alias("turn_index"),
        F.when(who == 0, CLIENT).otherwise(OPERATOR).alias("speaker"),
        F.trim(F.regexp_replace("raw", rf"(?i)^({CLIENT}|{OPERATOR})\s*:\s*", "")).alias("text"),
    )


def dialogue_texts(turns: DataFrame) -> DataFrame:
    """dialogue_id and its turns as `speaker: text` lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "speaker", "text"))), lambda t: F.concat(t["speaker"], F.lit(": "), t["text"]))
    return turns.groupBy("dialogue_id").agg(F.array_join(lines, "\n").alias("dialogue_text"))


def header(turns: DataFrame) -> DataFrame:
    """Turns by speaker of each dialogue, its length in words and its one speaker's channel, else ANY."""
    return turns.groupBy("dialogue_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(F.col("speaker") == CLIENT).alias("client_turns"),
        F.count_if(F.col("speaker") == OPERATOR).alias("operator_turns"),
        F.sum(X.word_count(F.col("text"))).alias("words"),
        F.when(F.min("speaker") != F.max("speaker"), "ANY").when(F.min("speaker") == CLIENT, "CLIENT").when(F.min("speaker") == OPERATOR, "OPERATOR").otherwise("ANY").alias("channel"),
    )
