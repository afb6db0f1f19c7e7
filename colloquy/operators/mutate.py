"""Changes of dictionaries kept as tables of nodes(node_id, parent_id, name) and conditions(cond_id, node_id, ord, ...).

Every operation returns the whole changed table, so that it can be written as a new version, and
rows that a rule forbids are returned apart with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators.dictionary import AND, OR
from colloquy.operators.dictops import ancestors
from colloquy.operators.kept import written


def add_nodes(nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the new ones, refused(node_id, reason)); a name is unique among the roots or siblings without case."""
    key = F.lower(F.trim("name"))
    n = new.withColumn("_name", key).withColumn("_k", F.row_number().over(Window.partitionBy("parent_id", "_name").orderBy("node_id")))
    taken = nodes.select(F.col("parent_id").alias("_p"), key.alias("_taken")).distinct()
    n = n.join(taken, F.col("parent_id").eqNullSafe(F.col("_p")) & (F.col("_name") == F.col("_taken")), "left")
    known = nodes.select(F.col("node_id").alias("_parent")).distinct()
    n = n.join(known, F.col("parent_id") == F.col("_parent"), "left")
    reason = (
        F.when(F.coalesce(F.col("_name"), F.lit("")) == "", "empty name")
        .when(F.col("parent_id").isNotNull() & F.col("_parent").isNull(), "unknown parent")
        .when(F.col("_taken").isNotNull() | (F.col("_k") > 1), "name taken")
    )
    n = n.withColumn("reason", reason)
    return nodes.unionByName(n.where("reason is null").select(*nodes.columns)), n.where("reason is not null").select("node_id", "reason")


def rename_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """names(node_id, new_name); a blank new name changes nothing."""
    asked = names.where(F.trim("new_name") != "").groupBy("node_id").agg(F.min("new_name").alias("new_name"))
    out = nodes.join(asked, "node_id", "left").withColumn("name", F.coalesce("new_name", "name"))
    return out.select(*nodes.columns)


def delete_nodes(nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes without those and all below them, refused(node_id, reason)): only a root or a child of a root may go."""
    parents = nodes.select(F.col("node_id").alias("_up"), F.col("parent_id").alias("_upper"))
    asked = gone.select("node_id").distinct().join(nodes.select("node_id", "parent_id", F.lit(True).alias("_is")), "node_id", "left").join(parents, F.col("parent_id") == F.col("_up"), "left")
    reason = F.when(F.col("_is").isNull(), "unknown node").when(F.col("parent_id").isNotNull() & F.col("_upper").isNotNull(), "too deep")
    judged = asked.withColumn("reason", reason)
    below = ancestors(nodes).join(judged.where("reason is null").select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_semi").select("node_id").distinct()
    return nodes.join(below, "node_id", "left_anti"), judged.where("reason is not null").select("node_id", "reason")


def reorder_conditions(conditions: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conditions with new ord, refused(node_id)); orders(node_id, new_order): the old places in their new order.

    An order has to be a permutation of 0 .. n - 1 of the node's n conditions.
    """
    n = conditions.groupBy("node_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    judged = orders.join(n, "node_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    fits = (F.col("_n") > 0) & (F.array_sort("new_order") == F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)))
    judged = judged.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    moved = judged.where("_fits").select(F.col("node_id").alias("_node"), F.posexplode("new_order").alias("_to", "_from"))
    out = conditions.join(moved, (F.col("node_id") == F.col("_node")) & (F.col("ord") == F.col("_from")), "left")
    return out.withColumn("ord", F.coalesce(F.col("_to").cast(conditions.schema["ord"].dataType), F.col("ord"))).select(*conditions.columns), judged.where("not _fits").select("node_id")


def update_nodes(nodes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with other names, states or attributes, refused(node_id, reason)).

    changes(node_id, and any other columns of nodes): null leaves a value as it is, and so does a blank
    name; of several changes of a node the least value counts. Only nodes that are there are changed.
    """
    columns = [c for c in changes.columns if c != "node_id" and c in nodes.columns]
    asked = changes.groupBy("node_id").agg(*[F.min(F.when(F.trim(c) != "", F.col(c)) if c == "name" else F.col(c)).alias(f"_new_{c}") for c in columns])
    out = nodes.join(asked, "node_id", "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in nodes.columns])
    unknown = asked.select("node_id").join(nodes.select("node_id").distinct(), "node_id", "left_anti")
    return out, unknown.withColumn("reason", F.lit("unknown node"))


def _faults(rows: DataFrame, blank: bool) -> Column:
    """Why a condition's values cannot be taken: a channel or an operator that does not exist, a phrase of nothing."""
    reason = F.lit(None).cast("string")
    if "channel" in rows.columns:
        reason = F.when(F.col("channel").isNotNull() & ~F.upper(F.trim("channel")).isin("CLIENT", "OPERATOR", "ANY"), "unknown channel").otherwise(reason)
    if "operator" in rows.columns:
        reason = F.when(F.col("operator").isNotNull() & ~F.upper("operator").isin("", *sorted(AND | OR)), "unknown operator").otherwise(reason)
    if blank and "phrase" in rows.columns:
        reason = F.when(F.coalesce(F.trim("phrase"), F.lit("")) == "", "empty phrase").otherwise(reason)
    return reason


def _tidy(rows: DataFrame) -> DataFrame:
    for c, f in (("channel", lambda x: F.upper(F.trim(x))), ("phrase", F.trim)):
        rows = rows.withColumn(c, f(c)) if c in rows.columns else rows
    return rows


def add_conditions(conditions: DataFrame, nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conditions with the new ones behind those of their nodes, refused(cond_id, reason)).

    new(cond_id, node_id, and any other columns of conditions but `ord`); several of a node come in the
    order of their ids. A cond_id that is taken is refused.
    """
    known = nodes.select(F.col("node_id").alias("_node")).distinct()
    taken = conditions.select(F.col("cond_id").alias("_taken")).distinct()
    judged = new.join(known, F.col("node_id") == F.col("_node"), "left").join(taken, F.col("cond_id") == F.col("_taken"), "left")
    again = F.row_number().over(Window.partitionBy("cond_id").orderBy("node_id")) > 1
    judged = judged.withColumn("reason", F.when(F.col("_node").isNull(), "unknown node").when(F.col("_taken").isNotNull() | again, "id taken").otherwise(_faults(new, True)))
    last = conditions.groupBy(F.col("node_id").alias("_of")).agg(F.max("ord").alias("_last"))
    good = _tidy(judged.where("reason is null").drop("_node", "_taken", "reason")).join(last, F.col("node_id") == F.col("_of"), "left")
    place = F.coalesce(F.col("_last") + 1, F.lit(0)) + F.row_number().over(Window.partitionBy("node_id").orderBy("cond_id")) - 1
    good = good.withColumn("ord", place.cast(conditions.schema["ord"].dataType)).drop("_of", "_last")
    return conditions.unionByName(good, allowMissingColumns=True).select(*conditions.columns), judged.where("reason is not null").select("cond_id", "reason")


def update_conditions(conditions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conditions with other values, refused(node_id, ord, reason)); changes(node_id, ord, and any other columns), null leaves a value."""
    columns = [c for c in changes.columns if c not in ("node_id", "ord", "cond_id") and c in conditions.columns]
    places = conditions.select(F.col("node_id").alias("_node"), F.col("ord").alias("_ord"))
    judged = changes.join(places, (F.col("node_id") == F.col("_node")) & (F.col("ord") == F.col("_ord")), "left")
    judged = judged.withColumn("reason", F.when(F.col("_node").isNull(), "no such place").otherwise(_faults(changes, False)))
    good = _tidy(judged.where("reason is null")).groupBy("node_id", "ord").agg(*[F.min(c).alias(f"_new_{c}") for c in columns])
    out = conditions.join(good, ["node_id", "ord"], "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in conditions.columns])
    return out, judged.where("reason is not null").select("node_id", "ord", "reason")


def delete_conditions(conditions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conditions without those at gone(node_id, ord), the others moved up, refused(node_id, ord))."""
    asked = gone.select("node_id", "ord").distinct()
    left = conditions.join(asked, ["node_id", "ord"], "left_anti")
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("ord")) - 1
    left = left.withColumn("ord", place.cast(conditions.schema["ord"].dataType)).select(*conditions.columns)
    return left, asked.join(conditions.select("node_id", "ord"), ["node_id", "ord"], "left_anti")


def cycles(nodes: DataFrame, depth: int = 20) -> DataFrame:
    """Nodes that are above themselves, `depth` levels at most: what a tree must not have.

    What has no node below it, or none above, is on no cycle and is left out first, for a few rounds. The others
    climb one level a round, each round a table of its own; nothing is broadcast.
    """
    edges = written(nodes.select("node_id", "parent_id").where("node_id is not null and parent_id is not null").distinct(), "cycle-edges")
    n = edges.count()
    for _ in range(3):
        below, above = edges.select(F.col("parent_id").alias("node_id")).distinct(), edges.select(F.col("node_id").alias("parent_id")).distinct()
        edges = written(edges.join(below.hint("shuffle_merge"), "node_id", "left_semi").join(above.hint("shuffle_merge"), "parent_id", "left_semi").select("node_id", "parent_id"), "cycle-edges")
        was, n = n, edges.count()
        if n in (0, was):
            break
    walk = edges.select("node_id", F.col("parent_id").alias("at"))
    up = edges.select(F.col("node_id").alias("at"), "parent_id")
    found = walk.where("at = node_id").select("node_id")
    for _ in range(depth - 1 if n else 0):
        step = walk.where("at <> node_id").join(up.hint("shuffle_merge"), "at").select("node_id", F.col("parent_id").alias("at"))
        walk = written(step.distinct(), "cycle-walk")
        found = found.union(walk.where("at = node_id").select("node_id"))
        if walk.isEmpty():
            break
    return found.distinct()
