"""Structured Streaming: the matcher on a stream of turns, sessions by gaps, and state with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.matcher import match_phrases

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream_matches(turns: DataFrame, conditions: list[tuple]) -> DataFrame:
    """Hits on a stream of turns: the window test needs no state."""
    return match_phrases(turns, conditions).select("dialogue_id", "turn_index", "cond_id", "phrase", "matched_text", "matched_start", "matched_end")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events between gaps, emitted once the watermark has passed their end."""
    windows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    counted = windows.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total")


def windows(events: DataFrame, size: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events")


def distinct_within(events: DataFrame, ttl: str = "2 hours") -> DataFrame:
    """Each event_id once; ids are forgotten when the watermark passes them."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["event_id"])
