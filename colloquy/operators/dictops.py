"""Dictionary analytics over tables of conditions and trees of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as X
from colloquy.operators.kept import written

#: Words that word lists leave out (fixed values).
STOP_WORDS = (
    "и или не в во на по для с со к от до из без при что это эту этот этом этих как так но а же ли бы "
    "вы вам вас мы нам нас он она они оно я меня мне тебя тебе его её их если то же бы только уже ещё еще "
    "вот там тут здесь где когда тогда нет ну мм ээ"
).split()


def duplicates(conditions: DataFrame) -> DataFrame:
    """(kind, phrase, ids) of conditions(cond_id, phrase, exact, channel, distance) that repeat.

    full: alike in normalised text, exactness, channel and distance. soft: the same set of words and
    not alike in all four. Groups are returned, not all their pairs.
    """
    c = conditions.withColumn("norm", X.normalize_phrase(F.col("phrase"))).withColumn("words", F.array_join(F.array_sort(F.array_distinct(F.split("norm", " "))), " "))
    full = c.groupBy("norm", "exact", "channel", "distance").agg(F.array_sort(F.collect_list("cond_id")).alias("ids")).where(F.size("ids") > 1)
    kinds = F.countDistinct("norm", "exact", "channel", "distance")
    soft = c.where("words <> ''").groupBy("words").agg(F.array_sort(F.collect_list("cond_id")).alias("ids"), kinds.alias("k")).where("k > 1")
    return full.select(F.lit("full").alias("kind"), F.col("norm").alias("phrase"), "ids").unionByName(soft.select(F.lit("soft").alias("kind"), F.col("words").alias("phrase"), "ids"))


def word_frequency(phrases: DataFrame, top: int = 50) -> DataFrame:
    """The most frequent words of phrases(pos, phrase), ties by where they first come."""
    w = phrases.select("pos", F.posexplode(X.tokens(F.col("phrase"))).alias("at", "word")).where(~F.col("word").isin(STOP_WORDS))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "at")).alias("first")).orderBy(F.desc("n"), "first").limit(top).select("word", "n")


def statistics(conditions: DataFrame) -> DataFrame:
    words = F.filter(F.split(X.normalize_phrase(F.col("phrase")), " "), lambda x: x != "")
    c = conditions.withColumn("w", words)
    one = c.agg(F.count(F.lit(1)).alias("conditions"), F.sum(F.size("w")).alias("words"), F.count_if(F.col("exact")).alias("exact"), F.count_if(F.col("channel") == "CLIENT").alias("client"), F.count_if(F.col("channel") == "OPERATOR").alias("operator"), F.count_if(F.col("channel") == "ANY").alias("any_channel"))
    return one.crossJoin(c.select(F.explode("w").alias("x")).agg(F.countDistinct("x").alias("distinct_words")))  # one row each


def stratified_sample(phrases: DataFrame, cap: int | None = None) -> DataFrame:
    """Every k-th of the phrases(pos, phrase) that differ without case: all up to 200, else 200 to 300 by number."""
    key = F.lower(F.trim("phrase"))
    first = written(phrases.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where("k = 1").select("pos", "phrase"), "sample-phrases")
    n = first.count()
    size = cap or (n if n <= 200 else 200 if n <= 500 else 250 if n <= 1000 else 300)
    ranked = _ranked(first)
    if n <= size:
        return ranked.select("pos", "phrase")
    # i is sampled if some j has int(j * n / size) = i.
    j = F.ceil(F.col("i") * size / n)
    return ranked.where((F.floor(j * n / size) == F.col("i")) & (j < size)).select("pos", "phrase")


def _ranked(rows: DataFrame) -> DataFrame:
    """Row numbers by pos over ranges, without one task seeing all rows."""
    parts = written(rows.repartitionByRange("pos").withColumn("part", F.spark_partition_id()), "ranked-parts")
    counts = parts.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(counts), "part").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1)


def validate(conditions: DataFrame) -> DataFrame:
    """(cond_id, issue) of conditions(cond_id, phrase, channel, distance): what a dictionary must not or should not have."""
    t = F.coalesce("phrase", F.lit(""))
    depth = F.aggregate(F.split(t, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, c: F.struct((a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), F.least(a["low"], a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("low")))
    checks = {
        "unknown channel": ~F.col("channel").isin("ANY", "CLIENT", "OPERATOR"),
        "negative distance": F.col("distance") < 0,
        "wide distance": F.col("distance") > 3,
        "odd quotes": F.pmod(X.occurrences(t, F.lit('"')), F.lit(2)) == 1,
        "unbalanced brackets": (depth["d"] != 0) | (depth["low"] < 0),
        "empty phrase": F.trim(t) == "",
    }
    issues = F.array_compact(F.array(*[F.when(test, name) for name, test in checks.items()]))
    return conditions.select("cond_id", F.explode(issues).alias("issue"))


def ancestors(nodes: DataFrame, depth: int = 20) -> DataFrame:
    """Closure (node_id, ancestor_id, distance) of nodes(node_id, parent_id), each node its own at 0."""
    step = nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    out = step
    up = nodes.select(F.col("node_id").alias("ancestor_id"), "parent_id").where("parent_id is not null")
    for d in range(1, depth + 1):
        step = step.join(up, "ancestor_id").select("node_id", F.col("parent_id").alias("ancestor_id"), F.lit(d).alias("distance"))
        if step.isEmpty():
            break
        out = out.union(step)
    return out


def operator_counts(conditions: DataFrame, tokens: DataFrame) -> DataFrame:
    """(kind, n): how many conditions(operator, negated) are joined by AND or OR or negated, and brackets among tokens(text, kind).

    All four kinds have a row, with 0 where there are none.
    """
    op, terminal = F.upper("operator"), (F.col("kind") == "TERMINAL") & F.col("text").isin("(", ")")
    joined = conditions.agg(F.count_if(op == "AND").alias("a"), F.count_if(op == "OR").alias("o"), F.count_if(F.col("negated")).alias("n"))
    each = joined.select(F.explode(F.create_map(F.lit("AND"), "a", F.lit("OR"), "o", F.lit("NOT"), "n")).alias("kind", "n"))
    return each.union(tokens.agg(F.count_if(terminal).alias("n")).select(F.lit("brackets").alias("kind"), "n"))


def warnings(nodes: DataFrame, conditions: DataFrame, tokens: DataFrame) -> DataFrame:
    """(node_id, warning, what, n) of what a node's author should look at.

    nodes(node_id, attributes: how many), conditions(node_id, phrase, exact), tokens(node_id, text,
    is_error). Phrases repeat if they differ in case and blanks around them only; an empty one (or
    null) is a warning and not a repeat. A node without conditions has none that are all exact.
    """
    c = conditions.withColumn("key", F.lower(F.trim(F.coalesce("phrase", F.lit("")))))
    n, none = F.count(F.lit(1)).alias("n"), F.lit(None).cast("string")
    wrong = tokens.where("is_error").groupBy("node_id", F.col("text").alias("what")).agg(n).withColumn("warning", F.lit("error token"))
    keys = c.groupBy("node_id", "key").agg(n, F.bool_and("exact").alias("exact"))
    again = keys.where("key = '' or n > 1").select("node_id", F.when(F.col("key") == "", "empty phrase").otherwise("repeated phrase").alias("warning"), F.col("key").alias("what"), "n")
    quoted = keys.groupBy("node_id").agg(F.bool_and("exact").alias("all"), F.sum("n").alias("n")).where("all").select("node_id", F.lit("all phrases exact").alias("warning"), none.alias("what"), "n")
    bare = nodes.where(F.coalesce("attributes", F.lit(0)) == 0).select("node_id", F.lit("no attribute").alias("warning"), none.alias("what"), F.lit(1).cast("long").alias("n"))
    return wrong.select("node_id", "warning", "what", "n").union(again).union(quoted).union(bare)
