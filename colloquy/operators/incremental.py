"""Search that matches again only what has changed: dialogues by their content, phrases by what they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import search
from colloquy.operators.kept import written
from colloquy.sources.store import Change, Store

HITS = "dialogue_id string, turn_index int, speaker string, start_offset double, end_offset double, matched_text string, matched_start int, matched_end int, pattern string"
PRINTS = "dialogue_id string, a long, b long, n long, seen timestamp"
PATTERNS = "pattern string, phrase string, distance int, channel string, exact boolean"


def fingerprints(turns: DataFrame) -> DataFrame:
    """(dialogue_id, a, b, n): 128 bits of hashes over a dialogue's turns in any order, and their number."""
    turn = [F.col(c) if c in turns.columns else F.lit(None) for c in ("turn_index", "speaker", "text", "start_offset", "end_offset")]
    whole = F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(turn)]))  # nulls count as well
    return turns.groupBy("dialogue_id").agg(F.bit_xor(F.xxhash64(whole)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), whole)).alias("b"), F.count(F.lit(1)).alias("n"))


class KeptSearch:
    """The hits of all phrases in all dialogues, kept between searches.

    Hits do not depend on gates, limits or the tree, so a phrase that only moves to another node, and a
    limit that changes, need no matching at all. A refresh compares the dialogues' fingerprints and the
    phrases with those that are kept: changed dialogues are matched with all phrases, the others with new
    phrases only, and what is gone is taken away, all in one commit. Dialogues that were last matched
    more than `ttl_seconds` ago count as changed (0: never). Another table of lemmas needs `clear`.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = 0):
        self.ttl_seconds = ttl_seconds
        self.store = Store(spark, path, {"hits": (HITS, ["dialogue_id", "turn_index", "pattern"]), "dialogues": (PRINTS, ["dialogue_id"]), "patterns": (PATTERNS, ["pattern"])})

    def refresh(self, turns: DataFrame, conditions: DataFrame, now: Column | None = None, lemmas: DataFrame | None = None) -> dict[str, int]:
        """Bring the hits up to date; how many dialogues and phrases were new, and how many hits were matched again."""
        now = F.current_timestamp() if now is None else now
        done: dict[str, int] = {}

        def work(c: Change) -> None:
            prints = written(fingerprints(turns), "kept-prints")
            wanted = written(search.patterns_of(conditions).select("pattern", *search.ALIKE).distinct(), "kept-patterns")
            kept, known = c.read("dialogues"), c.read("patterns")
            if self.ttl_seconds > 0:
                kept = kept.where(F.col("seen") >= now - F.make_dt_interval(secs=F.lit(self.ttl_seconds)))
            changed = written(prints.join(kept, ["dialogue_id", "a", "b", "n"], "left_anti"), "kept-changed")
            new = written(wanted.join(known, "pattern", "left_anti"), "kept-new")
            away = changed.select("dialogue_id").unionByName(c.read("dialogues").join(prints, "dialogue_id", "left_anti").select("dialogue_id"))
            done.update(dialogues=changed.count(), patterns=new.count(), hits=0)
            parts = []
            if done["dialogues"]:
                parts.append(search.pattern_hits(turns.join(changed, "dialogue_id", "left_semi"), wanted, lemmas))
            if done["patterns"]:
                parts.append(search.pattern_hits(turns.join(changed, "dialogue_id", "left_anti"), new, lemmas))
            c.delete("hits", away)
            c.delete("dialogues", away)
            dropped = known.join(wanted, "pattern", "left_anti").select("pattern")
            c.delete("hits", dropped)
            c.delete("patterns", dropped)
            for part in parts:
                part = written(part, "kept-hits")
                done["hits"] += part.count()
                c.append("hits", part)
            c.append("dialogues", changed.select("dialogue_id", "a", "b", "n", now.cast("timestamp").alias("seen")))
            c.append("patterns", new)

        self.store.change(work)
        return done

    def search(self, turns: DataFrame, nodes: DataFrame, conditions: DataFrame, cascade: bool = True, now: Column | None = None, lemmas: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
        """(matches, level_counts) as `search_tables` gives them, and what the refresh has done."""
        done = self.refresh(turns, conditions, now, lemmas)
        matches, levels = search.search_tables(turns, nodes, conditions, None, cascade, lemmas, self.store.read("hits"))
        return matches, levels, done

    def clear(self) -> None:
        """Forget everything."""

        def work(c: Change) -> None:
            for table, (_, key) in self.store.tables.items():
                c.delete(table, c.read(table).select(*key))

        self.store.change(work)

    def compact(self) -> None:
        for table in self.store.tables:
            self.store.compact(table)
        self.store.vacuum()
