"""Time windows on matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as X
from colloquy.operators.dictionary import Limit
from colloquy.schemas import CHANNELS


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Closed intervals meet; false if an end is unknown."""
    return F.coalesce((start <= high) & (end >= low), F.lit(False))


#: What tells a limit from others.
SPEC = ("event", "only", "value", "unit", "channel", "end", "selector", "direction")


def judged(limit: Column) -> Column:
    """Whether a StartEnd limit says which window it means; others pass everything."""
    return (limit["value"] > 0) & limit["unit"].isin("Seconds", "Words", "Phrases") & limit["end"].isin("First", "Last")


def windows(turns: DataFrame, asked: DataFrame) -> DataFrame:
    """The windows of StartEnd limits: asked(dialogue_id, limit) with low and high, or first and last for Phrases.

    Every distinct limit of a dialogue is computed once, from all its turns in one pass. low and high are
    times, first and last the turns of the channel that count; both null where the limit cannot be
    judged: no times in the dialogue, no turn of the channel.
    """
    limit = F.col("limit")
    rows = turns.select("dialogue_id", "turn_index", "speaker", "text", "start_offset", "end_offset").join(asked.select("dialogue_id", "limit").distinct(), "dialogue_id")
    rows = rows.withColumn("mine", of_channel(F.col("speaker"), limit["channel"])).withColumn("words", F.when(F.col("mine"), X.word_count(F.col("text"))).otherwise(0))
    of = Window.partitionBy("dialogue_id", "limit")
    up = of.orderBy("turn_index").rowsBetween(Window.unboundedPreceding, 0)
    forward = limit["end"] == "First"
    count, run = F.sum(F.col("mine").cast("int")).over(up), F.sum("words").over(up)
    rows = rows.withColumn("nth", F.when(forward, count).otherwise(F.sum(F.col("mine").cast("int")).over(of) - count + 1))
    rows = rows.withColumn("run", F.when(forward, run).otherwise(F.sum("words").over(of) - run + F.col("words")))
    turn, n = F.col("turn_index"), limit["value"]
    known = F.when(F.col("mine") & F.col("start_offset").isNotNull() & F.col("end_offset").isNotNull(), turn)
    spoken = F.when(F.col("words") > 0, turn)
    reached = F.when((F.col("words") > 0) & (F.col("run") >= n), turn)
    counted = F.when(F.col("mine") & (F.col("nth") <= n), turn)
    found = rows.groupBy("dialogue_id", "limit").agg(
        F.max(F.col("start_offset").isNotNull()).alias("timed"),
        F.min_by("start_offset", known).alias("opens"), F.max_by("end_offset", known).alias("closes"),
        F.min_by("start_offset", spoken).alias("speaks"), F.max_by("end_offset", spoken).alias("falls_silent"),
        F.min_by("end_offset", reached).alias("reaches"), F.max_by("start_offset", reached).alias("reaches_back"),
        F.min(counted).alias("first"), F.max(counted).alias("last"),
    )
    seconds = limit["unit"] == "Seconds"
    low = F.when(seconds, F.when(forward, F.col("opens")).otherwise(F.col("closes") - n)).otherwise(F.when(forward, F.col("speaks")).otherwise(F.coalesce("reaches_back", "speaks")))
    high = F.when(seconds, F.when(forward, F.col("opens") + n).otherwise(F.col("closes"))).otherwise(F.when(forward, F.coalesce("reaches", "falls_silent")).otherwise(F.col("falls_silent")))
    by_turn = limit["unit"] == "Phrases"
    good = F.col("timed") & judged(limit)
    return found.select("dialogue_id", "limit", F.when(good & ~by_turn, low).alias("low"), F.when(good & ~by_turn, high).alias("high"), F.when(good & by_turn, F.col("first")).alias("first"), F.when(good & by_turn, F.col("last")).alias("last"))


def of_channel(speaker: Column, channel: Column) -> Column:
    """Whether a turn is of a limit's channel; channels that are not known take all."""
    named = F.when(channel == "CLIENT", CHANNELS["CLIENT"]).when(channel == "OPERATOR", CHANNELS["OPERATOR"])
    return named.isNull() | F.coalesce(speaker == named, F.lit(False))


def inside(limit: Column) -> Column:
    """Whether a turn, joined to its windows, is inside; null where the limit cannot be judged."""
    by_time = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), overlaps(F.col("start_offset"), F.col("end_offset"), F.col("low"), F.col("high")))
    by_turn = of_channel(F.col("speaker"), limit["channel"]) & F.col("turn_index").between(F.col("first"), F.col("last"))
    return F.when(F.col("first").isNotNull(), by_turn).otherwise(by_time)


def spec(limit: Limit) -> Column:
    return F.struct(*[F.lit(getattr(limit, c)).alias(c) for c in SPEC])


def in_window(turns: DataFrame, limit: Limit, name: str) -> DataFrame:
    """Add to turns the boolean `name`: whether a turn meets the window of a StartEnd limit; null if that cannot be judged."""
    found = windows(turns, turns.select("dialogue_id").distinct().withColumn("limit", spec(limit)))
    return turns.join(found, "dialogue_id", "left").withColumn(name, inside(F.col("limit"))).drop("limit", "low", "high", "first", "last")


def passes(inside: Column, only: Column | bool) -> Column:
    """A match passes if it is on the wanted side of the window, or if nothing can be judged."""
    return F.coalesce(F.when(only if isinstance(only, Column) else F.lit(only), inside).otherwise(~inside), F.lit(True))


def near_times(probes: DataFrame, times: DataFrame, on: list[str], name: str) -> DataFrame:
    """Add to probes(start_offset, end_offset, direction, seconds) the boolean `name`: whether a probe meets the window of a time of the same group; null for groups without times.

    A time's window goes from `seconds` before it to it, or from it to `seconds` after. The sum is taken on the
    time, as moving it to the probe's side would round ties another way. Of the windows before, that of the
    least time from the probe's start on reaches back farthest; of those after, that of the greatest time
    up to its end reaches on farthest. So one time decides, the one seen last in a sweep over both (with signs
    turned for those after): each row is looked at once and no pairs are formed, however many there are of
    either. A probe without start or end is outside.
    """
    before = F.col("direction") == "Before"
    s, e = F.col("start_offset").cast("double"), F.col("end_offset").cast("double")
    left = probes.withColumn("_at", F.when(s.isNotNull() & e.isNotNull(), F.when(before, s).otherwise(0.0 - e)))
    both = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), at.alias("_at")) for d, at in (("Before", s), ("After", 0.0 - s))])).alias("x")
    right = times.where("start_offset is not null").select(*on, s.alias("_time"), both).select(*on, "_time", "x.*")
    of = Window.partitionBy(*on, "direction")
    swept = left.unionByName(right.withColumn("_is_time", F.lit(True)), allowMissingColumns=True)
    back = of.orderBy(F.desc_nulls_last("_at"), F.col("_is_time").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = swept.withColumn("_next", F.last("_time", ignorenulls=True).over(back)).withColumn("_any", F.max("_is_time").over(of)).where("_is_time is null")
    meets = F.when(before, e >= F.col("_next") - F.col("seconds")).otherwise(s <= F.col("_next") + F.col("seconds"))
    near = F.coalesce(F.col("_at").isNotNull() & meets, F.lit(False))
    return found.withColumn(name, F.when(F.col("_any"), near)).drop("_at", "_time", "_is_time", "_next", "_any")


def by_selector(times: DataFrame, on: list[str]) -> DataFrame:
    """Times(on, start_offset, ord) for each selector: all for Each, the first and the last by `ord`."""
    timed = times.where("start_offset is not null")
    ends = timed.groupBy(*on).agg(F.min_by("start_offset", "ord").alias("First"), F.max_by("start_offset", "ord").alias("Last"))
    some = ends.select(*on, F.explode(F.array(*[F.struct(F.lit(s).alias("selector"), F.col(s).alias("start_offset")) for s in ("First", "Last")])).alias("x")).select(*on, "x.*")
    return timed.select(*on, F.lit("Each").alias("selector"), "start_offset").distinct().unionByName(some)


def near_parent(hits: DataFrame, parents: DataFrame, limit: Limit) -> DataFrame:
    """Hits that pass a Parent limit: hits(dialogue_id, start_offset, end_offset), parents(dialogue_id, start_offset, ord).

    `ord` is the order in which the parent's matches come; First and Last go by it. Dialogues without
    parent times pass everything.
    """
    if not limit.enabled or limit.unit != "Seconds" or limit.direction not in ("Before", "After"):
        return hits
    selector = limit.selector if limit.selector in ("First", "Last") else "Each"
    times = by_selector(parents, ["dialogue_id"]).where(F.col("selector") == selector)
    probes = hits.withColumn("direction", F.lit(limit.direction)).withColumn("seconds", F.lit(limit.value))
    found = near_times(probes, times, ["dialogue_id"], "_near")
    return found.where(passes(F.col("_near"), F.lit(limit.only))).select(*hits.columns)
