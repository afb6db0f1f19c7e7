"""Queries of phrase matching and dictionary search over the conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import search
from colloquy.operators.dictionary import Condition, Limit, Node
from colloquy.operators.matcher import match_phrases, phrase_row
from colloquy.sources import turns as T

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer splits than there are cores are dealt out, as work on them is bound by the CPU."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "conversations") and df.rdd.getNumPartitions() < cores else df


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_conversations(table(spark, sf_dir, "conversations"))


TURNS = """turns AS (
  SELECT dialogue_id, turn_index, speaker, text, start_offset,
    coalesce(lead(start_offset) OVER (PARTITION BY dialogue_id ORDER BY turn_index), start_offset) AS end_offset,
    regexp_extract_all(lower(text), '[а-яёa-z0-9]+') AS toks
  FROM (SELECT conv_id::VARCHAR AS dialogue_id, turn::INT AS turn_index, text,
    CASE role WHEN 'user' THEN 'Клиент' WHEN 'assistant' THEN 'Сотрудник' ELSE 'Неизвестный' END AS speaker,
    coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 15.0 AS start_offset
    FROM conversations))"""


def hits(name: str, phrase: str, distance: int = 2, channel: str = "ANY") -> str:
    """SQL of the turns in which the phrase stands, with the tokens of the leftmost window's match."""
    words = phrase.split()
    n = len(words)
    need = {w: words.count(w) for w in words}
    window = f"list_slice(toks, i + 1, i + {n + distance})"
    test = " AND ".join(f"len(list_filter({window}, lambda x: x = '{w}')) >= {m}" for w, m in need.items())
    where = {"CLIENT": "speaker = 'Клиент'", "OPERATOR": "speaker = 'Сотрудник'"}.get(channel, "true")
    nth = lambda w, m: f"list_filter(range(i, least(i + {n + distance}, len(toks))), lambda j: toks[j + 1] = '{w}')[{m}]"
    firsts, lasts = ", ".join(nth(w, 1) for w in need), ", ".join(nth(w, m) for w, m in need.items())
    return f"""{name} AS (SELECT *, least({firsts}) AS a, greatest({lasts}) AS b FROM (
  SELECT dialogue_id, turn_index, speaker, text, start_offset, end_offset, toks, min(i) AS i
  FROM (SELECT *, unnest(range(0, len(toks) - {n - 1})) AS i FROM turns WHERE {where}) WHERE {test}
  GROUP BY dialogue_id, turn_index, speaker, text, start_offset, end_offset, toks))"""


def one(spark, sf_dir, phrase, distance=2, channel="ANY", exact=True):
    return match_phrases(turns(spark, sf_dir), [phrase_row("p", phrase, distance, channel, exact)])


@query(f"WITH {TURNS}, {hits('h', 'the of', 2)} SELECT dialogue_id, turn_index, speaker FROM h")
def phrase_match_exact(spark, sf_dir):
    return one(spark, sf_dir, "the of").select("dialogue_id", "turn_index", "speaker")


@query(f"WITH {TURNS}, {hits('h', 'of and the', 6)} SELECT dialogue_id, turn_index, speaker FROM h")
def phrase_match_canonical(spark, sf_dir):
    return one(spark, sf_dir, "of and the", 6, exact=False).select("dialogue_id", "turn_index", "speaker")


@query(f"""WITH {TURNS}, {hits('h', 'the in', 3)},
g AS (SELECT *, regexp_split_to_array(lower(text), '[а-яёa-z0-9]+') AS gaps FROM h),
s AS (SELECT *, list_sum(list_transform(list_slice(gaps, 1, a + 1), lambda x: length(x)))::INT + coalesce(list_sum(list_transform(list_slice(toks, 1, a), lambda x: length(x))), 0)::INT AS ms,
  list_sum(list_transform(list_slice(gaps, 1, b + 1), lambda x: length(x)))::INT + list_sum(list_transform(list_slice(toks, 1, b + 1), lambda x: length(x)))::INT AS me FROM g)
SELECT dialogue_id, turn_index, ms AS matched_start, me AS matched_end, substr(text, ms + 1, me - ms) AS matched_text FROM s""")
def phrase_match_spans(spark, sf_dir):
    return one(spark, sf_dir, "the in", 3).select("dialogue_id", "turn_index", "matched_start", "matched_end", "matched_text")


@query(f"WITH {TURNS}, {hits('c', 'the and', 4, 'CLIENT')}, {hits('o', 'the and', 4, 'OPERATOR')} SELECT 'CLIENT' AS channel, dialogue_id, turn_index FROM c UNION ALL SELECT 'OPERATOR', dialogue_id, turn_index FROM o")
def channel_filtered_match(spark, sf_dir):
    rows = [phrase_row(c, "the and", 4, c, True) for c in ("CLIENT", "OPERATOR")]
    return match_phrases(turns(spark, sf_dir), rows).select("channel", "dialogue_id", "turn_index")


def shown(spark, sf_dir, roots, **kw):
    return search.search(turns(spark, sf_dir), roots, **kw)[0].select("dialogue_id", "turn_index", "phrase_text", "quarter", "dict_level", "cascade_order")


def sel(src, phrase, quarter, level=1, order=1, where="true"):
    return f"SELECT dialogue_id, turn_index, '{phrase}' AS phrase_text, '{quarter}' AS quarter, {level} AS dict_level, {order} AS cascade_order FROM {src} WHERE {where}"


IN = "dialogue_id IN (SELECT dialogue_id FROM {})".format
OUT = "dialogue_id NOT IN (SELECT dialogue_id FROM {})".format


@query(f"WITH {TURNS}, {hits('p', 'the')}, {hits('n', 'was by', 8)} {sel('p', 'the', 'root', where=OUT('n'))}")
def node_suppression_anti(spark, sf_dir):
    root = Node("root", [Condition("the", exact=True), Condition("was by", 8, negated=True, operator="AND", exact=True)])
    return shown(spark, sf_dir, [root])


def parent_child():
    child = Node("child", [Condition("and", exact=True)])
    return [Node("root", [Condition("of the", 1, "CLIENT", exact=True)], [child])]


@query(f"WITH {TURNS}, {hits('p', 'of the', 1, 'CLIENT')}, {hits('c', 'and')} {sel('p', 'of the', 'root')} UNION ALL {sel('c', 'and', 'child', 2, where=IN('p'))}")
def gate_parent_child_semi(spark, sf_dir):
    return shown(spark, sf_dir, parent_child())


@query(f"WITH {TURNS}, {hits('p', 'of the', 1)}, {hits('c', 'is')} {sel('p', 'of the', 'inner')} UNION ALL {sel('c', 'is', 'leaf', 2, where=IN('p'))}")
def container_level_passthrough(spark, sf_dir):
    leaf = Node("leaf", [Condition("is", exact=True)])
    return shown(spark, sf_dir, [Node("outer", children=[Node("middle", children=[Node("inner", [Condition("of the", 1, exact=True)], [Node("empty", children=[leaf])])])])])


def three_roots():
    return [Node("first", [Condition("the of", 3, exact=True)]), Node("second", [Condition("was", exact=True)]), Node("third", [Condition("by", exact=True)])]


@query(f"WITH {TURNS}, {hits('a', 'the of', 3)}, {hits('b', 'was')}, {hits('c', 'by')} {sel('a', 'the of', 'first')} UNION ALL {sel('b', 'was', 'second', 1, 2, IN('a'))} UNION ALL {sel('c', 'by', 'third', 1, 3, IN('a') + ' AND ' + IN('b'))}")
def cascade_prefix_gate(spark, sf_dir):
    return shown(spark, sf_dir, three_roots())


@query(f"""WITH {TURNS}, {hits('p', 'of the', 1, 'CLIENT')}, {hits('c', 'and')}
SELECT dialogue_id, 1 AS dict_level, (SELECT count(*) FROM p WHERE p.dialogue_id = d.dialogue_id) AS matches FROM (SELECT DISTINCT dialogue_id FROM turns) d
UNION ALL SELECT dialogue_id, 2, (SELECT count(*) FROM c WHERE c.dialogue_id = d.dialogue_id) FROM (SELECT DISTINCT dialogue_id FROM p) d""")
def level_counts(spark, sf_dir):
    return search.search(turns(spark, sf_dir), parent_child())[1]


@query(f"""WITH {TURNS}, {hits('a', 'was')}, {hits('b', 'by')}, {hits('c', 'are')}, {hits('k', 'and')}
{sel('a', 'was', 'root')} UNION ALL {sel('b', 'by', 'root')} UNION ALL {sel('c', 'are', 'root')}
UNION ALL {sel('k', 'and', 'child', 2, where='(' + IN('a') + ' OR (' + IN('b') + ' AND ' + IN('c') + '))')}""")
def logic_tree_gate(spark, sf_dir):
    conds = [Condition("was", exact=True), Condition("by", exact=True, operator="ИЛИ"), Condition("are", exact=True, operator="И")]
    return shown(spark, sf_dir, [Node("root", conds, [Node("child", [Condition("and", exact=True)])])])


@query(f"WITH {TURNS}, {hits('a', 'the')} SELECT dialogue_id, turn_index FROM turns ANTI JOIN a USING (dialogue_id, turn_index)")
def remainder_unmatched(spark, sf_dir):
    t = turns(spark, sf_dir)
    return search.unmatched(t, search.search(t, [Node("all", [Condition("the", exact=True)])])[0]).select("dialogue_id", "turn_index")


def limited(spark, sf_dir, limit, phrase="and"):
    return shown(spark, sf_dir, [Node("root", [Condition(phrase, exact=True, limits=[limit])])])


def window_sql(low: str, high: str, only: bool = True, channel: str = "true") -> str:
    """The window's ends as aggregates over a dialogue's turns."""
    w = f"w AS (SELECT dialogue_id, {low} AS low, {high} AS high FROM turns WHERE {channel} GROUP BY dialogue_id)"
    inside = "start_offset <= high AND end_offset >= low"
    test = f"({inside})" if only else f"NOT ({inside})"
    return f"WITH {TURNS}, {hits('h', 'and')}, {w} {sel('h LEFT JOIN w USING (dialogue_id)', 'and', 'root', where=f'coalesce({test}, true)')}"


@query(window_sql("arg_min(start_offset, turn_index)", "arg_min(start_offset, turn_index) + 20"))
def timegap_first_seconds(spark, sf_dir):
    return limited(spark, sf_dir, Limit(value=20))


@query(window_sql("arg_max(end_offset, turn_index) - 15", "arg_max(end_offset, turn_index)", channel="speaker = 'Клиент'"))
def timegap_last_seconds(spark, sf_dir):
    return limited(spark, sf_dir, Limit(value=15, end="Last", channel="CLIENT"))


@query(window_sql("arg_min(start_offset, turn_index)", "arg_min(start_offset, turn_index) + 20", only=False))
def timegap_exclude(spark, sf_dir):
    return limited(spark, sf_dir, Limit(value=20, only=False))


@query(f"""WITH {TURNS}, {hits('h', 'and')},
r AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM turns),
s AS (SELECT *, sum(w) OVER (PARTITION BY dialogue_id ORDER BY turn_index) AS run FROM r),
w AS (SELECT dialogue_id, arg_min(start_offset, turn_index) FILTER (w > 0) AS low,
  coalesce(arg_min(end_offset, turn_index) FILTER (w > 0 AND run >= 60), arg_max(end_offset, turn_index) FILTER (w > 0)) AS high FROM s GROUP BY dialogue_id)
{sel('h LEFT JOIN w USING (dialogue_id)', 'and', 'root', where='coalesce(start_offset <= high AND end_offset >= low, true)')}""")
def timegap_words_window(spark, sf_dir):
    return limited(spark, sf_dir, Limit(value=60, unit="Words"))


@query(f"""WITH {TURNS}, {hits('h', 'and')},
w AS (SELECT dialogue_id, turn_index, row_number() OVER (PARTITION BY dialogue_id ORDER BY turn_index) AS k FROM turns WHERE speaker = 'Сотрудник')
{sel("h LEFT JOIN w USING (dialogue_id, turn_index)", 'and', 'root', where="coalesce(k <= 1, false) OR dialogue_id NOT IN (SELECT dialogue_id FROM w)")}""")
def timegap_phrases_window(spark, sf_dir):
    return limited(spark, sf_dir, Limit(value=1, unit="Phrases", channel="OPERATOR"))


def around(direction, selector, value, only=True):
    child = Node("child", [Condition("and", exact=True, limits=[Limit("Parent", only, value, selector=selector, direction=direction)])])
    return [Node("root", [Condition("of the", 2, exact=True)], [child])]


def around_sql(times: str, low: str, high: str) -> str:
    child = sel("c", "and", "child", 2, where=f"EXISTS (SELECT 1 FROM ({times}) t WHERE t.dialogue_id = c.dialogue_id AND c.start_offset <= {high} AND c.end_offset >= {low})")
    return f"WITH {TURNS}, {hits('p', 'of the', 2)}, {hits('c', 'and')} {sel('p', 'of the', 'root')} UNION ALL {child}"


@query(around_sql("SELECT dialogue_id, start_offset AS t FROM p", "t - 10", "t"))
def timegap_parent_before_each(spark, sf_dir):
    return shown(spark, sf_dir, around("Before", "Each", 10))


@query(around_sql("SELECT dialogue_id, arg_min(start_offset, turn_index) AS t FROM p GROUP BY dialogue_id", "t", "t + 10"))
def timegap_parent_after_first(spark, sf_dir):
    return shown(spark, sf_dir, around("After", "First", 10))


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index, start_offset, end_offset FROM turns")
def turn_end_offset_lead(spark, sf_dir):
    return turns(spark, sf_dir).select("dialogue_id", "turn_index", "start_offset", "end_offset")


@query(f"""WITH {TURNS} SELECT dialogue_id, count(*) AS turns, count(*) FILTER (speaker = 'Клиент') AS client_turns, count(*) FILTER (speaker = 'Сотрудник') AS operator_turns,
  sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words,
  CASE WHEN count(DISTINCT speaker) > 1 THEN 'ANY' WHEN min(speaker) = 'Клиент' THEN 'CLIENT' WHEN min(speaker) = 'Сотрудник' THEN 'OPERATOR' ELSE 'ANY' END AS channel
FROM turns GROUP BY dialogue_id""")
def channel_turn_counts(spark, sf_dir):
    return T.header(turns(spark, sf_dir))


@query(f"WITH {TURNS} SELECT dialogue_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY turn_index) AS dialogue_text FROM turns GROUP BY dialogue_id")
def dialogue_text(spark, sf_dir):
    return T.dialogue_texts(turns(spark, sf_dir))


@query(f"""WITH {TURNS}, {hits('a', 'the of', 3)}, m AS (SELECT speaker, turn_index % 2 AS parity FROM a)
SELECT speaker, parity, count(*) AS matches FROM m GROUP BY ROLLUP (speaker, parity)""")
def rollup_channel_level(spark, sf_dir):
    return one(spark, sf_dir, "the of", 3).withColumn("parity", F.col("turn_index") % 2).rollup("speaker", "parity").agg(F.count(F.lit(1)).alias("matches"))
