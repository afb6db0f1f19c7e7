"""Corpus mining, annotation roll-ups and kept state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as X


def false_negatives(corpus: DataFrame, matches: DataFrame, similar: DataFrame, least: float = 0.7) -> DataFrame:
    """Dialogues without a match whose best phrase similarity reaches `least`; similar(dialogue_id, phrase, score)."""
    missed = corpus.join(matches.select("dialogue_id").distinct(), "dialogue_id", "left_anti")
    best = similar.groupBy("dialogue_id").agg(F.max(F.struct("score", "phrase")).alias("m")).select("dialogue_id", F.col("m.phrase").alias("phrase"), F.col("m.score").alias("score"))
    return missed.join(best, "dialogue_id").where(F.col("score") >= least)


def best_per_group(scored: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """Each group's best row of the 3k best overall, and of those the k best groups."""
    top = scored.orderBy(F.desc("score"), key).limit(3 * k)
    best = top.groupBy(group).agg(F.max(F.struct("score", F.struct((-F.col(key)).alias("n"), F.col(key).alias("key")))).alias("m"))
    return best.select(group, F.col("m.score").alias("score"), F.col("m.col2.key").alias(key)).orderBy(F.desc("score"), group).limit(k)


def quality(scores: DataFrame, by: str = "dialogue_id") -> DataFrame:
    """Overall score and level, strengths and weaknesses of scores(by, category, score, level)."""
    mean = F.round(F.avg("score"), 4)
    listed = lambda level: F.array_sort(F.collect_list(F.when(F.col("level") == level, F.col("category"))))
    return scores.groupBy(by).agg(mean.alias("overall"), listed("high").alias("strengths"), listed("low").alias("weaknesses")).withColumn("overall_level", level_of(F.col("overall")))


def level_of(score: Column) -> Column:
    return F.when(score > 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def layers(turns: DataFrame, added: dict[str, DataFrame]) -> DataFrame:
    """Annotation layers joined to turns by place; what points beyond a dialogue's turns is ignored."""
    for name, layer in added.items():
        packed = layer.groupBy("dialogue_id", "turn_index").agg(F.array_sort(F.collect_list("value")).alias(name))
        turns = turns.join(packed, ["dialogue_id", "turn_index"], "left")
    return turns


def context_fill(fragments: DataFrame, by: str, order: list[Column], budget: int = 12_000, block: int = 1000, least: int = 100) -> DataFrame:
    """Fragments that fit a context of `budget` characters in order; the one at the edge is cut if `least` are left."""
    cut = fragments.withColumn("body", F.substring("text", 1, block))
    before = F.coalesce(F.sum(F.length("body")).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = cut.withColumn("room", budget - before)
    return room.where((F.length("body") <= F.col("room")) | (F.col("room") > least)).withColumn("body", F.expr("substring(body, 1, cast(room as int))")).drop("room")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Upsert: the last written row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def expired(sessions: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Sessions not touched within the TTL; none if it is 0 or less."""
    if ttl_seconds <= 0:
        return sessions.limit(0)
    return sessions.where(F.col("last_accessed") < now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def analyses_by_id(sessions: DataFrame, analyses: DataFrame, asked: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The rows of analyses(session_id, analysis_id, ...) with an asked analysis_id whose session(session_id, last_accessed) has not expired."""
    found = analyses.join(asked.select("analysis_id").distinct(), "analysis_id", "left_semi")
    return found.join(expired(sessions, now, ttl_seconds).select("session_id"), "session_id", "left_anti").join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of equal values in a row: (by, value, first, length)."""
    w = Window.partitionBy(by).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | F.lag(order).over(w).isNull()
    island = rows.withColumn("_i", F.sum(new.cast("int")).over(w))
    return island.groupBy(by, "_i", value).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("length")).drop("_i")


def highlight(marks: DataFrame, key: list[str]) -> DataFrame:
    """Segments between all cut points of marks(key, start, end, depth), each with the depth of its innermost mark."""
    cuts = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("start", "end")))))
    grouped = marks.groupBy(*key).agg(cuts.alias("cuts"), F.collect_list(F.struct("start", "end", "depth")).alias("marks"))
    pairs = grouped.withColumn("seg", F.explode(F.zip_with(F.slice("cuts", 1, F.size("cuts") - 1), F.slice("cuts", 2, F.size("cuts")), lambda a, b: F.struct(a.alias("start"), b.alias("end")))))
    cover = F.filter("marks", lambda m: (m["start"] <= F.col("seg.start")) & (m["end"] >= F.col("seg.end")))
    return pairs.withColumn("cover", cover).where(F.size("cover") > 0).select(*key, "seg.start", "seg.end", F.array_max(F.transform("cover", lambda m: m["depth"])).alias("depth"))


def provider_map(rows: DataFrame, prompt: str, out: str, provider: Callable[[Iterable[str]], list[str]], partitions: int | None = None) -> DataFrame:
    """Run an external model over a text column in batches: distinct prompts once, joined back by hash.

    `partitions` bounds the calls at a time.
    """
    asked = rows.select(F.sha2(prompt, 256).alias("_h"), F.col(prompt).alias("_p")).dropDuplicates(["_h"])
    asked = asked.repartition(partitions, "_h") if partitions else asked

    def run(batches: Iterator):
        for pdf in batches:
            pdf[out] = provider(pdf["_p"].tolist())
            yield pdf[["_h", out]]

    answers = asked.mapInPandas(run, f"_h string, {out} string")
    return rows.withColumn("_h", F.sha2(prompt, 256)).join(answers, "_h", "left").drop("_h")


def typed_json(text: Column, schema: str, defaults: dict[str, object]) -> Column:
    """The last JSON object in noisy text as a struct; a missing or bad field takes its default."""
    parsed = F.from_json(X.last_json(text), schema)
    return F.struct(*[F.coalesce(parsed[name], F.lit(value)).alias(name) for name, value in defaults.items()])
