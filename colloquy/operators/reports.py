"""Report tables and clean-ups of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without(turns: DataFrame, hits: DataFrame, barred: DataFrame) -> DataFrame:
    """Hits of dialogues in which none of the barred phrases is hit anywhere."""
    return hits.join(barred.select("dialogue_id").distinct(), "dialogue_id", "left_anti")


def cut(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last three dots where something is cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def workbook(turns: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a report: dialogue, matches, summary."""
    dialogue = turns.select("dialogue_id", "turn_index", "speaker", cut(F.col("text"), 200).alias("text"), "start_offset")
    found = matches.select("dialogue_id", "turn_index", cut(F.col("phrase_text"), 50).alias("phrase"), "quarter", "dict_level")
    spoken = turns.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("turns"))
    counted = matches.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("phrase_text").alias("phrases"))
    summary = spoken.join(counted, "dialogue_id", "left").na.fill(0, ["matches", "phrases"])
    return {"dialogue": dialogue, "matches": found, "summary": summary}


def padded(items: Column, n: int, default: object) -> Column:
    """A list cut or filled to the expected length."""
    return F.slice(F.concat(F.coalesce(items, F.array()), F.array_repeat(F.lit(default), n)), 1, n)


def recommendations(items: Column, kinds: tuple[str, ...] = ("add", "remove", "modify", "split")) -> Column:
    """Only those of struct(kind, phrase, distance) with a known kind and a phrase; a distance that is no integer is null."""
    good = F.filter(items, lambda x: F.lower(x["kind"]).isin(*kinds) & (F.trim(F.coalesce(x["phrase"], F.lit(""))) != ""))
    return F.transform(good, lambda x: F.struct(F.lower(x["kind"]).alias("kind"), F.trim(x["phrase"]).alias("phrase"), x["distance"].try_cast("int").alias("distance")))


def phrase_counts(matches: DataFrame) -> DataFrame:
    """(phrase, matches, dialogues) of matches(dialogue_id, phrase)."""
    per = matches.groupBy("phrase", "dialogue_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("phrase").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("dialogues"))


def per_turn(matches: DataFrame) -> DataFrame:
    """(dialogue_id, turn_index, matches, phrases in order) of the turns that have a match; repeated rows count again, their phrase is listed once."""
    grouped = matches.groupBy("dialogue_id", "turn_index")
    return grouped.agg(F.count(F.lit(1)).alias("matches"), F.array_sort(F.collect_set("phrase")).alias("phrases"))
