"""Phrase dictionaries as two tables, nodes and conditions, with interval labels for the tree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators.dictionary import OR, Node, flatten
from colloquy.operators.kept import written

LIMIT = "struct<event:string,only:boolean,value:int,unit:string,channel:string,end:string,selector:string,direction:string>"
#: enter and leave: a node's place in the order of visits and the last place below it; gate: the nearest node with conditions above it.
NODES = "enter long, leave long, tree int, node_id string, name string, root string, level int, gate long, conditioned boolean, remainder boolean, gated_by_tree boolean"
CONDITIONS = f"enter long, ord int, phrase string, distance int, channel string, exact boolean, negated boolean, operator string, limits array<{LIMIT}>"

#: Places of one tree are this far from those of the next one.
SPAN = 1 << 32

_LIMIT = pa.struct([("event", pa.string()), ("only", pa.bool_()), ("value", pa.int32()), ("unit", pa.string()), ("channel", pa.string()), ("end", pa.string()), ("selector", pa.string()), ("direction", pa.string())])
_NODES = pa.schema([("enter", pa.int64()), ("leave", pa.int64()), ("tree", pa.int32()), ("node_id", pa.string()), ("name", pa.string()), ("root", pa.string()), ("level", pa.int32()), ("gate", pa.int64()), ("conditioned", pa.bool_()), ("remainder", pa.bool_()), ("gated_by_tree", pa.bool_())])
_CONDITIONS = pa.schema([("enter", pa.int64()), ("ord", pa.int32()), ("phrase", pa.string()), ("distance", pa.int32()), ("channel", pa.string()), ("exact", pa.bool_()), ("negated", pa.bool_()), ("operator", pa.string()), ("limits", pa.list_(_LIMIT))])


def from_nodes(spark: SparkSession, roots: list[Node]) -> tuple[DataFrame, DataFrame]:
    """(nodes, conditions) of trees that are at hand as objects."""
    placed = flatten(roots)
    enter: dict[str, int] = {}
    leave: dict[str, int] = {}
    for p in placed:
        tree = (p.path[0] + 1) * SPAN
        enter[p.node_id] = max(enter[placed[len(enter) - 1].node_id] + 1, tree) if enter else tree
    for p in placed:
        for k in range(1, len(p.path) + 1):
            above = ".".join(map(str, p.path[:k]))
            leave[above] = max(leave.get(above, 0), enter[p.node_id])
    nodes, conditions = [], []
    for p in placed:
        n, me = p.node, enter[p.node_id]
        nodes.append((me, leave[p.node_id], p.path[0] + 1, p.node_id, n.name, p.root, p.level, enter[p.gates[-1]] if p.gates else None, bool(n.conditions), n.remainder, n.gated_by_tree))
        for i, c in enumerate(n.conditions):
            limits = [{"event": x.event, "only": x.only, "value": x.value, "unit": x.unit, "channel": x.channel, "end": x.end, "selector": x.selector, "direction": x.direction} for x in c.limits if x.enabled]
            conditions.append((me, i, c.text, c.distance, c.channel, c.exact, c.negated, c.operator, limits))
    made = lambda rows, schema: spark.createDataFrame(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [()] * len(schema), schema, strict=True)], schema=schema))
    return made(nodes, _NODES), made(conditions, _CONDITIONS)


def labelled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, conditions) of rows as dictionary files give them: path, node_id, name, is_remainder and a condition each.

    Trees come in the order of their paths, nodes in that of their places (`0.2.1` is the second child of
    the third child). A node's ancestors are the beginnings of its place, so the tree is closed by one
    explosion of as many rows as nodes are deep, and nothing is walked level by level. Rows without a
    node (warnings, refused files) are left out. Both tables are written, so they are labelled once.
    """
    rows = rows.where("node_id is not null")
    trees = rows.select("path").distinct().select("path", F.row_number().over(Window.orderBy("path")).alias("tree"))  # a row each
    heads = rows.groupBy("path", "node_id").agg(F.first("name").alias("name"), F.first("is_remainder").alias("remainder"), F.max(F.col("phrase").isNotNull()).alias("conditioned"))
    places = F.transform(F.split("node_id", r"\."), lambda x: x.cast("int"))
    order = Window.partitionBy("path").orderBy("place")
    heads = heads.join(trees, "path").withColumn("place", places)
    heads = heads.withColumn("enter", F.col("tree") * F.lit(SPAN) + F.row_number().over(order) - 1)
    up = heads.select("path", "enter", "conditioned", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size("place")), lambda k: F.slice("place", 1, k))).alias("place"))
    closure = up.withColumnsRenamed({"enter": "low", "conditioned": "_c", "name": "_n"}).join(heads.select("path", "place", F.col("enter").alias("high"), F.col("conditioned").alias("gated"), F.col("name").alias("above")), ["path", "place"])
    leave = closure.groupBy(F.col("high").alias("enter")).agg(F.max("low").alias("leave"))
    gates = closure.groupBy(F.col("low").alias("enter")).agg(
        F.max(F.when(F.col("gated") & (F.col("high") < F.col("low")), F.col("high"))).alias("gate"),
        F.count_if(F.col("gated") & (F.col("high") < F.col("low"))).alias("gates"),
        F.min_by("above", "high").alias("root"),
    )
    nodes = heads.join(leave, "enter").join(gates, "enter").select("enter", "leave", "tree", "node_id", "name", "root", (F.col("gates") + 1).cast("int").alias("level"), "gate", "conditioned", "remainder", F.lit(True).alias("gated_by_tree"))
    parsed = F.from_json("limits", "array<struct<event:string,only:boolean,value:int,unit:string,channel:string,end:string,selector:string,direction:string,enabled:boolean>>")
    enabled = F.transform(F.filter(F.coalesce(parsed, F.expr("array()")), lambda x: x["enabled"]), lambda x: F.struct(*[x[c].alias(c) for c in ("event", "only", "value", "unit", "channel", "end", "selector", "direction")]))
    conditions = rows.where("phrase is not null").join(heads.select("path", "node_id", "enter"), ["path", "node_id"])
    conditions = conditions.select("enter", F.col("cond_ord").alias("ord"), "phrase", "distance", "channel", "exact", "negated", "operator", enabled.alias("limits"))
    return written(nodes, "dictionary-nodes"), written(conditions, "dictionary-conditions")


def selected(nodes: DataFrame, conditions: DataFrame, names: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The trees that are named or have a named node, numbered anew from 1 on; all without names."""
    if not names:
        return nodes, conditions
    trees = nodes.where(F.col("name").isin(names)).select("tree").distinct()
    trees = trees.withColumn("_new", F.row_number().over(Window.orderBy("tree")))  # a row each
    kept = nodes.join(trees, "tree").withColumn("tree", F.col("_new")).select(*nodes.columns)
    return kept, conditions.join(kept.select("enter"), "enter", "left_semi")


def terms(nodes: DataFrame, conditions: DataFrame) -> DataFrame:
    """(enter, term, phrase, negated, need): the nodes' expressions as disjunctions, a row for each phrase of a term.

    A term holds where all its `need` phrases without a negation are matched and none with one is; a node
    is open if any of its terms holds. Where any hit opens the node every phrase is a term of its own.
    """
    starts = (F.col("ord") > 0) & F.upper(F.coalesce("operator", F.lit(""))).isin(*sorted(OR))
    of = Window.partitionBy("enter").orderBy("ord")
    rows = conditions.join(nodes.select("enter", "gated_by_tree"), "enter").where("gated_by_tree or not negated")
    term = F.when(F.col("gated_by_tree"), F.sum(starts.cast("int")).over(of)).otherwise(F.col("ord"))
    leaves = rows.withColumn("term", term.cast("int")).select("enter", "term", "phrase", "negated").distinct()
    return leaves.withColumn("need", F.sum((~F.col("negated")).cast("int")).over(Window.partitionBy("enter", "term")))

