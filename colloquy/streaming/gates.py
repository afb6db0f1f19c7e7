"""Dictionary search on a stream of turns: a dialogue's hits are held until it closes, then gates and cascade decide."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.operators.dictionary import Node, Placed, flatten, holds
from colloquy.operators.matcher import match_phrases, phrase_row

OUT = "dialogue_id string, turn_index int, phrase_text string, matched_text string, quarter string, dict_level int, cascade_order int"
#: The state store that keeps lists and timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

Hit = tuple[int, int, int, str]  # number of the node, of its condition, turn, matched text


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that queries started inside use."""
    was = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], was) if was else spark.conf.unset(PROVIDER[0])


def decide(placed: list[Placed], hits: list[Hit], cascade: bool = True) -> list[Hit]:
    """The hits of one dialogue that are shown: as in `search`, for what one state holds."""
    number = {p.node_id: i for i, p in enumerate(placed)}
    matched: dict[int, set[str]] = {}
    barred = set()
    for i, c, _, _ in hits:
        condition = placed[i].node.conditions[c]
        if condition.negated:
            barred.add(i)
        else:
            matched.setdefault(i, set()).add(condition.text)

    @cache
    def is_open(i: int) -> bool:
        node, got = placed[i].node, matched.get(i, set())
        return i not in barred and (holds(node.conditions, got) if node.gated_by_tree else bool(got))

    shown = [h for h in hits if h[0] not in barred and not placed[h[0]].node.conditions[h[1]].negated and all(is_open(number[g]) for g in placed[h[0]].gates)]
    if cascade:
        trees, done = {placed[h[0]].path[0] for h in shown}, 0
        while done in trees:
            done += 1
        shown = [h for h in shown if placed[h[0]].path[0] < done]
    return sorted(set(shown))


class DialogueGates(StatefulProcessor):
    """Holds a dialogue's hits; a timer closes it `gap` after its last turn, which emits what is shown and frees the state."""

    def __init__(self, placed: list[Placed], gap_ms: int, cascade: bool):
        self.placed, self.gap_ms, self.cascade = placed, gap_ms, cascade

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "node int, cond int, turn int, matched string")
        self.closes = handle.getValueState("closes", "at long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        was = self.closes.get()[0] if self.closes.exists() else None
        at = was
        for batch in rows:
            at = max([int(batch["ms"].max()) + self.gap_ms] + ([at] if at is not None else []))
            found = batch[batch["node"].notna()]
            if len(found):
                self.hits.appendList([(int(n), int(c), int(t), m) for n, c, t, m in zip(found["node"], found["cond"], found["turn_index"], found["matched_text"], strict=True)])
        if at != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(at)
            self.closes.update((at,))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        hits = [tuple(h) for h in self.hits.get()] if self.hits.exists() else []
        rows = []
        for i, c, turn, text in decide(self.placed, hits, self.cascade):
            p = self.placed[i]
            rows.append((key[0], turn, p.node.conditions[c].text, text, p.node.name if len(p.path) > 1 else p.root, p.level, p.path[0] + 1))
        self.hits.clear()
        self.closes.clear()
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def gated_matches(turns: DataFrame, roots: list[Node], gap: str = "30 minutes", late: str = "10 minutes", cascade: bool = True) -> DataFrame:
    """Matches of the dictionaries in turns(dialogue_id, turn_index, speaker, text, ts), a stream, as dialogues close.

    A dialogue closes when the watermark (the latest time less `late`) is `gap` past its last turn; turns
    may come in any order until then, those that come after it begin anew. Repeated turns count once.
    State is a dialogue's hits and one timer, and goes when it closes. Start the query inside
    `state_store`. Windows of limits need a dialogue's every turn, so trees with limits are refused.
    """
    placed = flatten(roots)
    if any(x.enabled for p in placed for c in p.node.conditions for x in c.limits):
        raise ValueError("limits are not searched on a stream")
    gap_ms = turns.sparkSession.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {gap})").first()[0]
    rows = [phrase_row(f"{i}:{k}", c.text, c.distance, c.channel, c.exact) for i, p in enumerate(placed) for k, c in enumerate(p.node.conditions)]
    seen = turns.withWatermark("ts", late).select("dialogue_id", "turn_index", "speaker", "text", "ts")
    hits = match_phrases(seen, rows)
    at = F.split("cond_id", ":")
    head = [F.col("dialogue_id"), F.col("turn_index"), F.col("ts"), F.unix_millis("ts").alias("ms")]
    every = seen.select(*head, *[F.lit(None).cast("int").alias(c) for c in ("node", "cond")], F.lit(None).cast("string").alias("matched_text"))
    found = hits.select(*head, at[0].cast("int").alias("node"), at[1].cast("int").alias("cond"), "matched_text")
    keyed = every.unionByName(found).groupBy("dialogue_id")
    return keyed.transformWithStateInPandas(DialogueGates(placed, gap_ms, cascade), OUT, "Append", "EventTime")
