"""Hierarchical dictionary search over all dialogues at once, on tables of nodes and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators import dicttables, timegap
from colloquy.operators.dictionary import Node, select_roots
from colloquy.operators.kept import written
from colloquy.operators.matcher import match_phrases, phrase_rows

#: A hit's key.
HIT = ["dialogue_id", "turn_index", "enter", "ord"]
#: What tells patterns apart, and what is kept of their hits.
ALIKE = ["phrase", "distance", "channel", "exact"]
FOUND = ["dialogue_id", "turn_index", "speaker", "start_offset", "end_offset", "matched_text", "matched_start", "matched_end", "pattern"]
#: Nodes that are open without any hit, listed in one expression.
MOST_LISTED = 100_000


def patterns_of(conditions: DataFrame) -> DataFrame:
    """conditions with `pattern`, which equal phrases of many nodes share."""
    return conditions.withColumn("pattern", F.concat_ws("\x1f", "exact", "distance", F.coalesce("channel", F.lit("ANY")), "phrase"))


def _dealt(rows: DataFrame, *on: str) -> DataFrame:
    """Rows dealt to some tasks for every core, as the work on them is much more than their bytes tell."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *on)


def pattern_hits(turns: DataFrame, patterns: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """All hits of patterns(pattern, phrase, distance, channel, exact) in turns, each pattern matched once."""
    rows = phrase_rows(patterns.select(F.col("pattern").alias("cond_id"), *ALIKE).distinct(), lemmas)
    turns = _dealt(turns, "dialogue_id", "turn_index")
    return match_phrases(turns, rows, lemmas).withColumnRenamed("cond_id", "pattern").select(*FOUND)


def _about(nodes: DataFrame, conditions: DataFrame) -> DataFrame:
    """The conditions with their patterns and what matches show of their nodes."""
    quarter = F.when(F.col("enter") % dicttables.SPAN == 0, F.col("root")).otherwise(F.col("name")).alias("quarter")
    return patterns_of(conditions).join(nodes.select("enter", "tree", "level", "gate", "remainder", quarter), "enter").drop("operator")


def _within(turns: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that pass their StartEnd limits: each distinct limit of a dialogue is computed once and joined."""
    asked = hits.select(*HIT, "speaker", "start_offset", "end_offset", F.explode(F.filter("limits", lambda x: (x["event"] == "StartEnd") & timegap.judged(x))).alias("limit"))
    found = asked.join(timegap.windows(turns, asked), ["dialogue_id", "limit"])
    out = found.where(~timegap.passes(timegap.inside(F.col("limit")), F.col("limit.only")))
    return hits.join(out.select(*HIT).distinct(), HIT, "left_anti")


def _around(hits: DataFrame, level: int) -> DataFrame:
    """Hits of all levels, those of one level only where they pass all their Parent limits."""
    mine = hits.where((F.col("level") == level) & F.col("gate").isNotNull())
    good = lambda x: (x["event"] == "Parent") & (x["unit"] == "Seconds") & x["direction"].isin("Before", "After")
    asked = mine.select(*HIT, "gate", "start_offset", "end_offset", F.explode(F.filter("limits", good)).alias("limit"))
    selector = F.when(F.col("limit.selector").isin("First", "Last"), F.col("limit.selector")).otherwise("Each")
    probes = asked.select("*", F.col("limit.direction").alias("direction"), F.col("limit.value").alias("seconds"), selector.alias("selector"))
    above = hits.where(~F.col("negated")).select("dialogue_id", F.col("enter").alias("gate"), "start_offset", F.struct("ord", "turn_index").alias("ord"))
    on = ["dialogue_id", "gate"]
    times = timegap.by_selector(above.join(mine.select("gate").distinct(), "gate", "left_semi"), on)
    found = timegap.near_times(probes, times, [*on, "selector"], "near")
    out = found.where(~timegap.passes(F.col("near"), F.col("limit.only")))
    return hits.join(out.select(*HIT).distinct(), HIT, "left_anti")


def _states(seen: DataFrame, terms: DataFrame) -> DataFrame:
    """(dialogue_id, enter, open, barred, hit, n): the nodes that have hits, from seen(dialogue_id, enter, phrase, negated, n).

    A term's matched phrases are counted: it holds if all that it needs are there and none of those it
    forbids. A node whose terms include one that needs none is open wherever that one is not broken.
    All is grouped within dialogues, so the rows are dealt out once.
    """
    said = _dealt(seen, "dialogue_id").groupBy("dialogue_id", "enter", "phrase").agg(F.max("negated").alias("barred"), F.sum(F.when(~F.col("negated"), F.col("n")).otherwise(0)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("enter", "phrase").orderBy("term", "negated"))
    leaf = terms.select("enter", "phrase", "term", "need", F.col("negated").alias("forbids"), nth.alias("nth"), F.lit(True).alias("hit"))
    met = said.withColumn("hit", F.col("n") > 0).join(leaf, ["enter", "phrase", "hit"], "left")
    of = F.when(F.coalesce("nth", F.lit(1)) == 1, F.col("n")).otherwise(0)  # a phrase counts once, however many terms it is in
    by_term = met.groupBy("dialogue_id", "enter", "term", "need").agg(F.count_if(~F.col("forbids")).alias("have"), F.count_if("forbids").alias("broken"), F.max("barred").alias("barred"), F.max("hit").alias("hit"), F.sum(of).alias("n"))
    holds, lost = (F.col("need") > 0) & (F.col("have") == F.col("need")) & (F.col("broken") == 0), (F.col("need") == 0) & (F.col("broken") > 0)
    by_node = by_term.groupBy("dialogue_id", "enter").agg(F.coalesce(F.max(holds), F.lit(False)).alias("holds"), F.count_if(lost).alias("lost"), F.max("barred").alias("barred"), F.max("hit").alias("hit"), F.sum("n").alias("n"))
    free = terms.where("need = 0").groupBy("enter").agg(F.count_distinct("term").alias("free"))
    state = by_node.join(free, "enter", "left")
    return state.select("dialogue_id", "enter", ((F.col("holds") | (F.coalesce("free", F.lit(0)) > F.col("lost"))) & ~F.col("barred")).alias("open"), "barred", "hit", "n")


def _free(states: DataFrame, turns: DataFrame, nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(dialogue_id, enter) of gates that are open without any hit: in all dialogues, or where the gate above needs hits and is open, as elsewhere they are not reached."""
    gates = nodes.where("gate is not null").select(F.col("gate").alias("enter")).distinct()
    bare = terms.where("need = 0").select("enter").distinct().join(gates, "enter", "left_semi")
    above = bare.select(F.col("enter").alias("gate"), F.lit(True).alias("bare"))
    listed = written(bare.join(nodes.select("enter", "gate"), "enter").join(above, "gate", "left").select("enter", "gate", (F.col("gate").isNull() | F.col("bare").isNotNull()).alias("anywhere")), "search-free")
    bound = listed.where("not anywhere").select(F.col("gate").alias("enter"), F.col("enter").alias("below"))
    out = states.where("open").select("dialogue_id", "enter").join(bound, "enter").select("dialogue_id", F.col("below").alias("enter"))
    anywhere = [r[0] for r in listed.where("anywhere").select("enter").collect()]
    for a in range(0, len(anywhere), MOST_LISTED):
        some = ",".join(map(str, anywhere[a : a + MOST_LISTED]))
        out = out.unionByName(turns.select("dialogue_id").distinct().select("dialogue_id", F.explode(F.from_json(F.lit(f"[{some}]"), "array<bigint>")).alias("enter")))
    return out


def _reached(states: DataFrame, free: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dialogue_id, enter, tree, level, open, barred, hit, n, reached): whether all gates above a node are open.

    Open nodes begin and end intervals of places, which a sweep over a dialogue's places adds up: as many
    are open at a node as gates are above it, or else one is closed. No pair of a node and a gate is formed.
    """
    own = _dealt(states.withColumn("known", F.lit(True)).unionByName(free.withColumn("open", F.lit(True)), allowMissingColumns=True), "dialogue_id")
    flags = [F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("barred", "hit")]
    opened = F.coalesce(F.max(F.when(F.col("known"), F.col("open"))), F.lit(True)).alias("open")  # what the hits say goes before
    rows = own.groupBy("dialogue_id", "enter").agg(opened, *flags, F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    rows = rows.join(nodes.select("enter", "leave", "tree", "level"), "enter")
    ends = F.array(F.struct(F.col("enter").alias("at"), F.lit(0).alias("step")), F.struct((F.col("enter") + 1).alias("at"), F.lit(1).alias("step")), F.struct((F.col("leave") + 1).alias("at"), F.lit(-1).alias("step")))
    events = rows.withColumn("e", F.explode(F.when(F.col("open") & (F.col("leave") > F.col("enter")), ends).otherwise(F.slice(ends, 1, 1)))).select("*", "e.at", "e.step").drop("e", "leave")
    above = F.sum("step").over(Window.partitionBy("dialogue_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return events.withColumn("above", above).where("step = 0").select("dialogue_id", "enter", "tree", "level", "open", "barred", "hit", "n", (F.col("above") == F.col("level") - 1).alias("reached"))


def search_tables(turns: DataFrame, nodes: DataFrame, conditions: DataFrame, names: list[str] | None = None, cascade: bool = True, lemmas: DataFrame | None = None, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, level_counts) of dictionaries given as tables (`dicttables`) in all dialogues of turns.

    All hits are found in one pass, whatever the gates, and written once, a row for each pattern and turn. Nodes are
    decided by how often a dialogue has each pattern, and meet the turns again only where they are reached; only limits
    need a row for each condition and turn before. The nodes' expressions are rows
    (`dicttables.terms`) that are decided by counting what matched; a negated condition's hit bars its
    node. A sweep over the places of the tree then says which nodes are reached: children need all gates
    above open, and with cascade a tree needs matches of every tree before it. Limits are rows as well:
    StartEnd windows are computed once for each distinct limit of a dialogue, Parent limits level by level
    of the tree, all of a level in one join, as a level's times are what the level above has left. So the
    plan does not grow with the dictionary, and nothing is collected but the levels that have Parent
    limits and the nodes that are open without any hit (`НЕ` alone, or as an alternative). Hits of the
    conditions' patterns that are known already (`incremental`) come as `found`.
    """
    nodes, conditions = dicttables.selected(nodes, conditions, names)
    terms = dicttables.terms(nodes, conditions)
    limited = conditions.join(nodes.select("enter", "level", "gate"), "enter").select("level", "gate", F.explode("limits").alias("x"))
    parents = F.collect_set(F.when((F.col("x.event") == "Parent") & F.col("gate").isNotNull(), F.col("level")))
    levels, start_end = limited.agg(parents, F.max((F.col("x.event") == "StartEnd") & timegap.judged(F.col("x")))).first()

    about = _about(nodes, conditions)
    found = written(pattern_hits(turns, patterns_of(conditions), lemmas), "search-found") if found is None else found
    by_turn = bool(start_end or levels)
    if by_turn:
        hits = written(found.join(about, "pattern").drop("pattern"), "search-hits")
        if start_end:
            hits = written(_within(turns, hits), "search-hits")
        for level in sorted(levels):
            hits = written(_around(hits, level), "search-hits")
        seen = hits.select("dialogue_id", "enter", "phrase", "negated", F.lit(1).cast("long").alias("n"))
    else:
        times = written(found.groupBy("dialogue_id", "pattern").agg(F.count(F.lit(1)).alias("n")), "search-times")
        seen = times.join(about.select("pattern", "enter", "phrase", "negated"), "pattern").drop("pattern")

    states = written(_states(seen, terms), "search-states")
    reached = _reached(states, _free(states, turns, nodes, terms), nodes).where("reached")
    first_open = nodes.where("gate is null and conditioned").agg(F.min("tree").alias("first_tree"))
    with_gate = nodes.where("gate is not null").select(F.col("gate").alias("enter")).distinct().withColumn("leads", F.lit(True))
    reached = reached.join(with_gate, "enter", "left")
    dialogues = turns.select("dialogue_id").distinct()
    if cascade:
        trees = reached.where("hit and not barred").groupBy("dialogue_id").agg(F.array_sort(F.collect_set("tree")).alias("trees"))
        done = trees.select("dialogue_id", F.aggregate("trees", F.lit(0), lambda a, t: F.when(t == a + 1, t).otherwise(a)).alias("done"))
        reached = reached.join(done, "dialogue_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
        dialogues = dialogues.join(done, "dialogue_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    else:
        reached, dialogues = (x.withColumn("done", F.lit((1 << 31) - 2)) for x in (reached, dialogues))
    reached = written(reached, "search-nodes")

    taken = reached.where("hit and not barred and tree <= done")
    if by_turn:
        shown = hits.where(~F.col("negated")).join(taken.select("dialogue_id", "enter"), ["dialogue_id", "enter"], "left_semi")
    else:
        asked = about.where(~F.col("negated")).drop("negated", "limits", "gate")
        places = taken.select("dialogue_id", "enter").join(asked.select("enter", "ord", "pattern"), "enter")
        shown = found.join(places, ["dialogue_id", "pattern"]).drop("pattern").join(asked.drop("pattern"), ["enter", "ord"])
    matches = shown.select(
        "dialogue_id",
        F.col("phrase").alias("phrase_text"),
        "matched_text",
        "matched_start",
        "matched_end",
        "quarter",
        "turn_index",
        "speaker",
        F.when(F.col("exact"), "exact").otherwise("morph").alias("match_type"),
        F.col("level").alias("word_distance_used"),
        F.col("tree").alias("cascade_order"),
        F.col("exact").alias("is_exact_match"),
        F.col("distance").alias("word_distance"),
        F.col("channel").alias("channel_constraint"),
        F.col("level").alias("dict_level"),
        F.col("remainder").alias("is_remainder"),
    )
    # Every visited node with conditions writes its level, with 0 if it has no matches: nodes without a gate
    # in every dialogue that comes to their tree, others where their nearest gate is reached and open.
    top = dialogues.crossJoin(first_open).where(F.col("first_tree") <= F.col("done") + 1).select("dialogue_id", F.lit(1).alias("dict_level"))  # one row of first_open
    below = reached.where("open and leads and tree <= done + 1").select("dialogue_id", (F.col("level") + 1).alias("dict_level"))
    counted = taken.groupBy("dialogue_id", F.col("level").alias("dict_level")).agg(F.sum("n").alias("n"))
    visited = top.unionByName(below).distinct().join(counted, ["dialogue_id", "dict_level"], "left")
    return matches, visited.select("dialogue_id", "dict_level", F.coalesce("n", F.lit(0)).cast("long").alias("matches"))


def search(turns: DataFrame, roots: list[Node], names: list[str] | None = None, cascade: bool = True, lemmas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same for trees that are at hand as objects."""
    nodes, conditions = dicttables.from_nodes(turns.sparkSession, select_roots(roots, names))
    return search_tables(turns, nodes, conditions, None, cascade, lemmas)


def unmatched(turns: DataFrame, matches: DataFrame) -> DataFrame:
    """Turns without any match: what a remainder node stands for."""
    return turns.join(matches.select("dialogue_id", "turn_index").distinct(), ["dialogue_id", "turn_index"], "left_anti")
