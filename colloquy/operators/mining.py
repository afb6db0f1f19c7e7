"""Corpus mining: jobs and their progress, audits of phrases by a model's answers, suggestions, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as X
from colloquy.operators import reports


def progress(checkpoints: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, processed, total, share): the farthest checkpoint(job_id, processed_count) of jobs(job_id, total)."""
    far = checkpoints.groupBy("job_id").agg(F.max("processed_count").alias("processed"))
    done = jobs.join(far, "job_id", "left").withColumn("processed", F.coalesce("processed", F.lit(0)))
    return done.select("job_id", "processed", "total", F.round(F.when(F.col("total") > 0, F.col("processed") / F.col("total")).otherwise(0.0), 6).alias("share"))


def running(jobs: DataFrame, by: str, key: str, states: tuple[str, ...] = ("pending", "running")) -> DataFrame:
    """The first job of each `by` whose status is one of the states."""
    return jobs.where(F.col("status").isin(*states)).groupBy(by).agg(F.min(key).alias(key))


def not_yet_there(suggested: DataFrame, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Suggestions whose trimmed lower-case phrase no condition has, the first of each."""
    norm = F.lower(F.trim(phrase))
    known = phrases.select(norm.alias("_norm")).distinct()
    return suggested.withColumn("_norm", norm).where("_norm <> ''").join(known, "_norm", "left_anti").drop("_norm")


def audits(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Add recall, missed_count, recommendations and explanation of a model's JSON answer; without one an empty audit."""
    kind = "struct<recall:string,missed_count:string,recommendations:array<struct<kind:string,phrase:string,distance:string>>,explanation:string>"
    j = F.from_json(X.last_json(F.col(raw)), kind)
    return answers.withColumns(
        {
            "recall": X.clamp01(j["recall"]),
            "missed_count": F.coalesce(j["missed_count"].try_cast("int"), F.lit(0)),
            "recommendations": F.coalesce(reports.recommendations(j["recommendations"]), F.expr("cast(array() as array<struct<kind:string,phrase:string,distance:int>>)")),
            "explanation": F.when(F.col(raw).isNull(), "model unavailable").otherwise(F.coalesce(F.trim(j["explanation"]), F.lit(""))),
        }
    )


def full_audit(audit: DataFrame, by: str) -> DataFrame:
    """A dictionary's audit: phrases, mean recall, missed turns and recommendations by kind."""
    count = lambda kind: F.sum(F.size(F.filter("recommendations", lambda r: r["kind"] == kind))).alias(f"to_{kind}")
    return audit.groupBy(by).agg(F.count(F.lit(1)).alias("phrases"), F.round(F.avg("recall"), 4).alias("recall"), F.sum("missed_count").alias("missed"), *[count(k) for k in ("add", "remove", "modify", "split")])


def first_per_turn(matches: DataFrame, order: list[Column]) -> DataFrame:
    """The first match of each turn in the list's order."""
    w = Window.partitionBy("dialogue_id", "turn_index").orderBy(*order)
    return matches.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def explain_tokens(text: Column, words: Column) -> Column:
    """array<struct<at, token, contribution>>: 1 for tokens that are among the matched words, else 0; matched ones first."""
    t = X.tokens(text)
    marked = F.transform(t, lambda x, i: F.struct(i.alias("at"), x.alias("token"), F.array_contains(words, x).cast("double").alias("contribution")))
    return F.concat(F.filter(marked, lambda x: x["contribution"] == 1), F.filter(marked, lambda x: x["contribution"] == 0))


def span_text(text: Column, start: Column, end: Column) -> Column:
    """The matched text, empty where the offsets are not inside the text."""
    return F.when((start >= 0) & (start < end) & (end <= F.length(text)), text.substr(start + 1, end - start)).otherwise(F.lit(""))


def level_names(named: DataFrame, roots: DataFrame) -> DataFrame:
    """(cascade_order, name): the first dictionary named for an order, else the root at that place.

    named(cascade_order, name, ord), roots(cascade_order, root).
    """
    first = named.groupBy("cascade_order").agg(F.min_by("name", "ord").alias("name"))
    return roots.join(first, "cascade_order", "left").select("cascade_order", F.coalesce("name", "root").alias("name"))


def merge_channels(left: DataFrame, right: DataFrame, key: list[str], weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Full outer join of two channels(key, score): both scores and their weighted sum, a missing one counting 0."""
    a = left.groupBy(*key).agg(F.max("score").alias("left_score"))
    b = right.groupBy(*key).agg(F.max("score").alias("right_score"))
    total = F.coalesce("left_score", F.lit(0.0)) * weights[0] + F.coalesce("right_score", F.lit(0.0)) * weights[1]
    return a.join(b, key, "full_outer").withColumn("score", F.round(total, 6))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of rows in order; numbers below 1 count as 1, sizes are held to 1 .. 1000."""
    size = max(1, min(1000, size))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
