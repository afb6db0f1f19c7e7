"""Queries of search with dictionaries that are tables: one tree for each benchmark item, over the conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import dicttables, search
from colloquy.operators.incremental import KeptSearch
from colloquy.operators.kept import shared_folder
from colloquy.plans.search_queries import TURNS, table, turns

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def limit(event: str, value: Column, direction: str = "") -> Column:
    fields = {"event": F.lit(event), "only": F.lit(True), "value": value, "unit": F.lit("Seconds"), "channel": F.lit("any"), "end": F.lit("First"), "selector": F.lit("Each"), "direction": F.lit(direction), "enabled": F.lit(True)}
    return F.to_json(F.array(F.struct(*[c.alias(k) for k, c in fields.items()])))


def trees(spark, d, shape: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """A tree for each item from its first words: shape has (place, name, conditions), each (number of the word, operator, negated, channel, limits)."""
    items = table(spark, d, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 12, "0").alias("path"), "item_id", X.tokens(F.col("text")).alias("w"))
    none = F.lit(None).cast("string")
    rows = []
    for place, name, conditions in shape:
        head = [F.lit(place).alias("node_id"), F.lit(name).alias("name")]
        for i, (k, operator, negated, channel, limits) in enumerate(conditions):
            rows.append(F.struct(*head, F.lit(i).alias("cond_ord"), F.coalesce(F.get("w", F.lit(k - 1)), F.lit("")).alias("phrase"), F.lit(operator).alias("operator"), F.lit(negated).alias("negated"), F.lit(channel).alias("channel"), (limits if limits is not None else none).alias("limits")))
    found = items.select("path", F.explode(F.array(*rows)).alias("r")).select("path", "r.*", F.lit(False).alias("is_remainder"), F.lit(2).alias("distance"), F.lit(True).alias("exact"))
    return dicttables.labelled(found)


def gated(spark, d):
    c = lambda k, op="", neg=False, channel="ANY": (k, op, neg, channel, None)
    return trees(spark, d, [
        ("0", "root", [c(1), c(2, "ИЛИ"), c(3, "И")]),
        ("0.0", "a", [c(4), c(5, "AND", True)]),
        ("0.0.0", "below a", [c(6), c(7, "OR", False, "client")]),
        ("0.1", "b", [c(8, "", True)]),
        ("0.1.0", "below b", [c(1)]),
    ])


#: e1 .. e8: whether a dialogue has an item's first, second, ... word; h: the turns that have it.
HITS = f"""{TURNS},
w AS (SELECT item_id, (row_number() OVER (ORDER BY item_id))::INT AS tree, regexp_extract_all(lower(text), '[а-яёa-z0-9]+') AS w FROM benchmark),
k AS MATERIALIZED (SELECT tree, k, w[k] AS word FROM w, range(1, 9) r(k)),
f AS MATERIALIZED (SELECT dialogue_id, turn_index, speaker, start_offset, end_offset, unnest(list_distinct(toks)) AS word FROM turns),
h AS MATERIALIZED (SELECT tree, k, word, dialogue_id, turn_index, speaker, start_offset, end_offset FROM f JOIN k USING (word)),
e AS MATERIALIZED (SELECT tree, dialogue_id, {", ".join(f"bool_or(k = {k}) AS e{k}" for k in range(1, 9))} FROM h GROUP BY ALL),
g AS (SELECT tree, dialogue_id, e1 OR (e2 AND e3) AS root, e1 OR e2 OR e3 AS any_root, (e1 OR (e2 AND e3)) AND NOT e5 AS a, (e1 OR (e2 AND e3)) AND e4 AND NOT e5 AS below_a, (e1 OR (e2 AND e3)) AND NOT e8 AS below_b FROM e),
m AS (SELECT tree, dialogue_id, turn_index, word, 'root' AS name, 1 AS level FROM h WHERE k <= 3
  UNION ALL SELECT tree, dialogue_id, turn_index, word, 'a', 2 FROM h JOIN g USING (tree, dialogue_id) WHERE k = 4 AND a
  UNION ALL SELECT tree, dialogue_id, turn_index, word, 'below a', 3 FROM h JOIN g USING (tree, dialogue_id) WHERE (k = 6 OR k = 7 AND speaker = 'Клиент') AND below_a
  UNION ALL SELECT tree, dialogue_id, turn_index, word, 'below b', 3 FROM h JOIN g USING (tree, dialogue_id) WHERE k = 1 AND below_b)"""
CASCADE = """r AS (SELECT DISTINCT dialogue_id, tree FROM m),
p AS (SELECT dialogue_id, tree, row_number() OVER (PARTITION BY dialogue_id ORDER BY tree) AS nth FROM r),
done AS (SELECT dialogue_id, count(*) AS done FROM p WHERE tree = nth GROUP BY dialogue_id)"""
ROWS = "dialogue_id, turn_index, word AS phrase_text, name AS quarter, level AS dict_level, tree AS cascade_order"


def shown(matches: DataFrame) -> DataFrame:
    return matches.select("dialogue_id", "turn_index", "phrase_text", "quarter", "dict_level", "cascade_order")


@query(f"WITH {HITS} SELECT {ROWS} FROM m")
def dictionary_tables_search(spark, d):
    return shown(search.search_tables(turns(spark, d), *gated(spark, d), cascade=False)[0])


@query(f"WITH {HITS}, {CASCADE} SELECT {ROWS} FROM m JOIN done USING (dialogue_id) WHERE tree <= done")
def dictionary_tables_cascade(spark, d):
    return shown(search.search_tables(turns(spark, d), *gated(spark, d))[0])


@query(f"""WITH {HITS},
v AS (SELECT DISTINCT dialogue_id, 1 AS level FROM turns UNION SELECT dialogue_id, 2 FROM g WHERE root UNION SELECT dialogue_id, 3 FROM g WHERE below_a OR below_b)
SELECT dialogue_id, level AS dict_level, count(word) AS matches FROM v LEFT JOIN m USING (dialogue_id, level) GROUP BY ALL""")
def dictionary_tables_levels(spark, d):
    return search.search_tables(turns(spark, d), *gated(spark, d), cascade=False)[1]


@query(f"""WITH {HITS},
x AS (SELECT dialogue_id, arg_min(start_offset, turn_index) AS low FROM turns GROUP BY dialogue_id),
p AS (SELECT h.* FROM h JOIN x USING (dialogue_id) WHERE k = 1 AND start_offset <= low + 20 + 10 * ((tree - 1) % 4) AND end_offset >= low),
c AS (SELECT * FROM h WHERE k = 2 AND EXISTS (SELECT 1 FROM p WHERE p.tree = h.tree AND p.dialogue_id = h.dialogue_id AND h.start_offset <= p.start_offset + 30 AND h.end_offset >= p.start_offset)),
b AS (SELECT * FROM h WHERE k = 3 AND EXISTS (SELECT 1 FROM c WHERE c.tree = h.tree AND c.dialogue_id = h.dialogue_id AND h.start_offset <= c.start_offset AND h.end_offset >= c.start_offset - 15)),
m2 AS (SELECT *, 'root' AS name, 1 AS level FROM p UNION ALL SELECT *, 'after', 2 FROM c UNION ALL SELECT *, 'before', 3 FROM b)
SELECT {ROWS} FROM m2""")
def dictionary_tables_limits(spark, d):
    first = limit("StartEnd", F.lit(20) + 10 * F.pmod("item_id", F.lit(4)).cast("int"))
    after, before = limit("Parent", F.lit(30), "After"), limit("Parent", F.lit(15), "Before")
    shape = [("0", "root", [(1, "", False, "ANY", first)]), ("0.0", "after", [(2, "", False, "ANY", after)]), ("0.0.0", "before", [(3, "", False, "ANY", before)])]
    return shown(search.search_tables(turns(spark, d), *trees(spark, d, shape), cascade=False)[0])


@query(f"WITH {HITS} SELECT {ROWS} FROM m")
def dictionary_tables_kept(spark, d):
    """The same rows by way of kept hits: a first search with other phrases and changed dialogues, then what is asked."""
    said, (nodes, conditions) = turns(spark, d), gated(spark, d)
    kept = KeptSearch(spark, f"{shared_folder(spark)}/kept-search-{uuid.uuid4().hex}")
    other = said.withColumn("text", F.when(F.crc32("dialogue_id") % 10 == 0, F.reverse("text")).otherwise(F.col("text")))
    kept.refresh(other, conditions.where("ord = 0"))
    return shown(kept.search(said, nodes, conditions, cascade=False)[0])
