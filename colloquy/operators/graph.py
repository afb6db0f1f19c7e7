"""Groups of a similarity graph and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.kept import written
from colloquy.operators.retrieval import postings, top_k


def groups(edges: DataFrame) -> DataFrame:
    """(node, topic) of every node of edges(src, dst): the least node of its connected group.

    In each round a node takes the least label among its own and its neighbours', then the label of
    that label, so long chains shorten by more than one step. Rounds end in written tables.
    """
    both = written(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct(), "graph-edges")
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("topic")), "graph-labels")
    while True:  # rounds grow with the logarithm of the longest chain
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("topic").alias("other"))
        step = labels.join(near, F.col("node") == F.col("src")).select("node", F.least("topic", "other").alias("topic"), F.col("topic").alias("was"))
        of = step.select(F.col("node").alias("n"), F.col("topic").alias("t"))
        jumped = step.join(of, F.col("topic") == F.col("n"), "left").select("node", F.least("topic", "t").alias("topic"), "was")
        jumped = written(jumped, "graph-labels")
        labels = jumped.select("node", "topic")
        if jumped.where("topic <> was").isEmpty():
            return labels


def communities(edges: DataFrame, most_rounds: int = 12, most_levels: int = 10) -> DataFrame:
    """(node, topic): communities of high modularity in edges(src, dst, weight), each named by its least node.

    Every node begins as its own community and moves where modularity gains most, by the weight that
    joins it to a community and the totals of both; then communities become nodes, and so on, level by
    level. Nodes move at once, which is safe for the totals as in each round, drawn by a hash, one half
    of the communities only gives nodes and the other only takes them; equal gains go to the least
    community. The labels of the round with the highest modularity end a level, so no level loses any.
    A round is one table of a row for each node and one aggregate; the driver holds numbers only. An edge
    counts once however often and in whichever direction it is given, with its highest weight; loops and
    weights that are not above 0 are left out.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    once = edges.where("src <> dst and weight > 0").groupBy(low.alias("a"), high.alias("b")).agg(F.max("weight").cast("double").alias("w"))
    links = written(once.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(once.select("b", "a", "w")), "modular-links")
    nodes = written(links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"), F.lit(0.0).alias("loop")), "modular-nodes")
    members = nodes.select("node", F.col("node").alias("at"))
    both = links.agg(F.sum("w")).first()[0] or 0.0
    for level in range(most_levels):
        labels, best, worse = nodes.select("node", "k", "loop", F.col("node").alias("own")), None, 0
        for turn in range(most_rounds):
            state = written(_moves(links, labels, both, level * most_rounds + turn), "modular-round")
            totals = state.groupBy("own").agg(F.sum("k").alias("total"), F.sum(F.col("inner") + F.col("loop")).alias("inner"))
            found = totals.agg(F.sum(F.col("inner") / both - F.pow(F.col("total") / both, 2)).alias("q"), F.count(F.lit(1)).alias("n")).crossJoin(state.agg(F.count_if("wants").alias("wants"), F.count(F.lit(1)).alias("all"))).first()  # one row each
            if not found["all"]:
                return members.select("node", F.col("at").alias("topic"))
            if best is None or found["q"] > best[0] + 1e-12:
                best, worse = (found["q"], found["n"], state.select("node", "k", "loop", "own")), 0
            else:
                worse += 1
            if not found["wants"] or worse > 2:
                break
            labels = state.select("node", "k", "loop", F.coalesce("goes", "own").alias("own"))
        if best[1] == found["all"]:  # nothing has moved for the better
            break
        labels = best[2].select("node", "own")
        members = written(members.join(labels, F.col("at") == labels["node"]).select(members["node"], F.col("own").alias("at")), "modular-members")
        of = lambda c, name: labels.select(F.col("node").alias(c), F.col("own").alias(name))
        joined = links.join(of("src", "a"), "src").join(of("dst", "b"), "dst").groupBy("a", "b").agg(F.sum("w").alias("w"))
        joined = written(joined, "modular-joined")
        grown = best[2].groupBy("own").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        inner = joined.where("a = b").select(F.col("a").alias("own"), F.col("w").alias("more"))
        nodes = written(grown.join(inner, "own", "left").select(F.col("own").alias("node"), "k", (F.col("loop") + F.coalesce("more", F.lit(0.0))).alias("loop")), "modular-nodes")
        links = joined.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    least = members.groupBy("at").agg(F.min("node").alias("topic"))
    return members.join(least, "at").select("node", "topic")


def _moves(links: DataFrame, labels: DataFrame, both: float, turn: int) -> DataFrame:
    """labels(node, k, loop, own) with inner, the weight to its own community, wants, whether another is better, and goes."""
    totals = labels.groupBy("own").agg(F.sum("k").alias("total"))
    near = links.join(labels.select(F.col("node").alias("dst"), F.col("own").alias("to")), "dst").groupBy("src", "to").agg(F.sum("w").alias("w"))
    at = labels.join(totals, "own")
    seen = at.join(near, at["node"] == near["src"], "left").join(totals.select(F.col("own").alias("to"), F.col("total").alias("there")), "to", "left")
    mine = F.col("to") == F.col("own")
    inner = F.coalesce(F.sum(F.when(mine, F.col("w"))), F.lit(0.0))
    gain = F.struct((F.col("w") - F.col("k") * F.col("there") / both).alias("gain"), (-F.col("to")).alias("to"))
    takes = F.pmod(F.xxhash64("to", F.lit(turn)), F.lit(2)) == 1
    found = seen.groupBy("node", "k", "loop", "own", "total").agg(inner.alias("inner"), F.max(F.when(~mine, gain)).alias("any"), F.max(F.when(~mine & takes, gain)).alias("best"))
    stays = F.col("inner") - F.col("k") * (F.col("total") - F.col("k")) / both + 1e-12
    gives = F.pmod(F.xxhash64("own", F.lit(turn)), F.lit(2)) == 0
    return found.select("node", "k", "loop", "own", "inner", F.coalesce(F.col("any.gain") > stays, F.lit(False)).alias("wants"), F.when(gives & (F.col("best.gain") > stays), -F.col("best.to")).alias("goes"))


def modularity(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: the modularity of topics(node, topic) in edges(src, dst, weight), each edge given once."""
    of = lambda c: topics.select(F.col("node").alias(c), F.col("topic").alias(f"topic_{c}"))
    at = edges.join(of("src"), "src").join(of("dst"), "dst")
    ends = at.select(F.explode(F.array(F.struct(F.col("topic_src").alias("topic"), "weight"), F.struct(F.col("topic_dst").alias("topic"), "weight"))).alias("e")).groupBy("e.topic").agg(F.sum("e.weight").alias("total"))
    inner = at.where("topic_src = topic_dst").groupBy(F.col("topic_src").alias("topic")).agg((2 * F.sum("weight")).alias("inner"))
    both = ends.agg(F.sum("total").alias("both"))
    parts = ends.join(inner, "topic", "left").crossJoin(both)  # one row of both
    return parts.agg(F.round(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("both") - F.pow(F.col("total") / F.col("both"), 2)), 6).alias("modularity"))


def topic_labels(docs: DataFrame, key: str, topics: DataFrame, n: int = 3) -> DataFrame:
    """(topic, term, docs, rank): the terms of lowest IDF within a topic, that is those that most of its documents have; ties by term."""
    terms = postings(docs, key, letters=True).join(topics.withColumnRenamed("node", key), key)
    counted = terms.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("docs"))
    return top_k(counted, "topic", "term", n, "docs").select("topic", "term", "docs", "rank")


def merge_topics(labels: DataFrame, least: float = 0.6) -> DataFrame:
    """(topic, into) of labels(topic, ord, terms): a topic goes into the first kept one before it with like terms.

    Likeness is the Jaccard index of the topics' own terms, not of what they have grown to, so chains
    do not merge. Candidate pairs share a term. A topic is kept once no topic before it that may be
    kept is like it; every round settles the first open topic of each group at least.
    """
    own = labels.select("topic", "ord", F.array_distinct("terms").alias("terms"))
    flat = own.select("topic", "ord", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    a, b = (flat.select(*[F.col(c).alias(f"{c}_{k}") for c in ("topic", "ord", "n")], "term") for k in "ab")
    shared = a.join(b, "term").where("ord_a < ord_b").groupBy("topic_a", "ord_a", "n_a", "topic_b", "n_b").agg(F.count(F.lit(1)).alias("both"))
    pairs = written(shared.where(F.col("both") >= least * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("topic_a", "ord_a", "topic_b"), "topic-pairs")
    state = written(own.select("topic", F.lit(None).cast(own.schema["topic"].dataType).alias("into")), "topic-state")
    while True:
        at = state.select(F.col("topic").alias("topic_a"), F.col("into").alias("into_a"))
        left = pairs.join(at, "topic_a").where("into_a is null or into_a = topic_a")  # those before that are kept or open
        first = left.groupBy("topic_b").agg(F.count_if(F.col("into_a").isNull()).alias("open"), F.min_by(F.when(F.col("into_a").isNotNull(), F.col("topic_a")), F.when(F.col("into_a").isNotNull(), F.col("ord_a"))).alias("kept"))
        new = state.join(first, F.col("topic") == F.col("topic_b"), "left")
        # A kept one before decides only if no open one stands before it; to be safe all before must be settled.
        into = F.coalesce("into", F.when(F.coalesce("open", F.lit(0)) == 0, F.coalesce("kept", "topic")))
        state = written(new.select("topic", into.alias("into")), "topic-state")
        if state.where("into is null").isEmpty():
            return state
