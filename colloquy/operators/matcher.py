"""Windowed bag-of-words phrase matching over tokenised turns."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators.dictionary import channel_of
from colloquy.operators.kept import written
from colloquy.schemas import CHANNELS

#: A task's broadcast of phrases; more phrases are joined by shuffle.
MOST_BROADCAST = 200_000

CONDITION = "cond_id string, phrase string, words array<string>, need array<struct<word:string,m:int>>, n int, distance int, channel string, exact boolean, rarest string"


def tokenised(turns: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Add toks and keys (canonical forms) to turns.

    lemmas(form, lemma) is joined on distinct forms. Without it a form is its own lemma. Aspect
    partners share a key.
    """
    pairs = X.aspect_keys()
    lookup = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    toks = turns.withColumn("toks", X.tokens(F.col("text")))
    if lemmas is None:
        # A look-up in the pairs is only worth while for Cyrillic text.
        keys = F.when(F.regexp_like("text", F.lit("[А-Яа-я]")), F.transform("toks", lambda t: F.coalesce(F.try_element_at(lookup, t), t))).otherwise(F.col("toks"))
        return toks.withColumn("keys", keys)
    key = ["dialogue_id", "turn_index"]
    flat = toks.select(*key, F.posexplode("toks").alias("at", "form"))
    forms = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    named = flat.join(forms, "form", "left").withColumn("lemma", F.coalesce("lemma", "form"))
    named = named.withColumn("key", F.coalesce(F.try_element_at(lookup, F.col("lemma")), F.col("lemma")))
    keys = named.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("keys"))
    return toks.join(keys, key, "left").withColumn("keys", F.coalesce("keys", F.expr("cast(array() as array<string>)")))


def phrase_row(cond_id: str, phrase: str, distance: int = 2, channel: str = "ANY", exact: bool = False, lemma: dict[str, str] | None = None) -> tuple:
    """A condition's row: its words (canonical keys unless exact) and how often each is needed."""
    import re

    words = re.findall(X.TOKEN, phrase.lower())
    if not exact:
        pairs = X.aspect_keys()
        words = [pairs.get(w, w) for w in ((lemma or {}).get(w, w) for w in words)]
    need = sorted(Counter(words).items())
    rarest = max(words, key=lambda w: (len(w), w), default="")  # the longest word is most often the rarest
    return cond_id, phrase, words, [(w, m) for w, m in need], len(words), distance, channel or "ANY", exact, rarest


def phrase_rows(phrases: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """The same rows from a table: phrases(cond_id, phrase, distance, channel, exact), read by Spark."""
    pairs = X.aspect_keys()
    lookup = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    toks = phrases.withColumn("toks", X.tokens(F.col("phrase")))
    keys = F.transform("toks", lambda w: F.coalesce(F.try_element_at(lookup, w), w))
    if lemmas is not None:
        flat = toks.select("cond_id", F.posexplode("toks").alias("at", "form")).join(lemmas.groupBy("form").agg(F.min("lemma").alias("lemma")), "form", "left")
        key = F.coalesce("lemma", "form")
        named = flat.groupBy("cond_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.try_element_at(lookup, key), key).alias("key")))), lambda x: x["key"]).alias("named"))
        toks, keys = toks.join(named, "cond_id", "left"), F.coalesce("named", F.expr("cast(array() as array<string>)"))
    rows = toks.withColumn("words", F.when(F.col("exact"), F.col("toks")).otherwise(keys))
    need = F.transform(F.array_sort(F.array_distinct("words")), lambda w: F.struct(w.alias("word"), F.size(F.filter("words", lambda x: x == w)).alias("m")))
    rarest = F.coalesce(F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"], F.lit(""))
    return rows.select("cond_id", "phrase", "words", need.alias("need"), F.size("words").alias("n"), "distance", "channel", "exact", rarest.alias("rarest"))


def _at(form: Column, first: Column, n: Column, distance: Column, word: Column) -> Column:
    """Positions of a word in the window of n + distance tokens that starts at `first`."""
    return F.filter(F.sequence(first, F.least(first + n + distance, F.size(form)) - 1), lambda j: F.get(form, j) == word)


def first_window(form: Column, need: Column, n: Column, distance: Column, rarest: Column) -> Column:
    """An array of the leftmost window's start, or an empty one.

    A window is n + distance tokens from a start 0 .. len - n. It holds the phrase if every word is
    there as often as needed. Only windows around the rarest word are tried, so a long text costs as
    much as that word is frequent in it.
    """
    fits = lambda i: F.forall(need, lambda k: F.size(_at(form, i, n, distance, k["word"])) >= k["m"])
    places = F.filter(F.sequence(F.lit(0), F.size(form) - 1), lambda j: F.get(form, j) == rarest)
    near = F.transform(places, lambda p: F.sequence(F.greatest(p - n - distance + 1, F.lit(0)), F.least(p, F.size(form) - n)))
    starts = F.filter(F.array_distinct(F.flatten(near)), fits)
    word = F.array_position(form, rarest) - 1
    alone = F.when(word >= 0, F.array(F.greatest(word - distance, F.lit(0)).cast("int")))
    return F.when(n == 1, alone).when((n > 0) & (F.size(form) >= n), F.slice(F.array_sort(starts), 1, 1))


def span_of(form: Column, need: Column, n: Column, distance: Column, first: Column) -> Column:
    """struct(first, last) of token positions: from the first to the last of the earliest words that fit."""
    ends = F.transform(need, lambda k: F.struct(F.get(_at(form, first, n, distance, k["word"]), F.lit(0)).alias("a"), F.get(_at(form, first, n, distance, k["word"]), k["m"] - 1).alias("b")))
    return F.struct(F.array_min(F.transform(ends, lambda e: e["a"])).alias("first"), F.array_max(F.transform(ends, lambda e: e["b"])).alias("last"))


def match_phrases(turns: DataFrame, conditions: list[tuple] | DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Hits of conditions (phrase_row, or a table from phrase_rows) in turns(dialogue_id, turn_index, speaker, text), one a condition and turn.

    Turns meet only the conditions whose rarest word they have: an inverted index join, then the
    window test. Adds cond_id, phrase, matched_text, matched_start and matched_end (in characters).
    """
    spark = turns.sparkSession
    if isinstance(conditions, DataFrame):
        conds = written(conditions.where("n > 0"), "phrase-rows")
        if conds.count() <= MOST_BROADCAST:
            conds = F.broadcast(conds)
        else:
            conds = conds.hint("shuffle_merge")  # the turns' words are more than their table's size tells
    else:
        rows = [c for c in conditions if c[4] > 0]
        conds = spark.createDataFrame(rows, CONDITION)
        if len(rows) <= MOST_BROADCAST:
            conds = F.broadcast(conds)
    conds = conds.withColumn("channel", channel_of(F.col("channel")))
    ready = tokenised(turns, lemmas).withColumn("gaps", X.token_gaps(F.col("text")))
    looked = ready.withColumn("look", F.explode(F.array_distinct(F.array_union("toks", "keys"))))
    joined = looked.join(conds, F.col("look") == F.col("rarest")).drop("look")
    speaker = F.when(F.col("channel") == "CLIENT", CHANNELS["CLIENT"]).when(F.col("channel") == "OPERATOR", CHANNELS["OPERATOR"])
    joined = joined.where(speaker.isNull() | (F.col("speaker") == speaker))
    form = F.when(F.col("exact"), F.col("toks")).otherwise(F.col("keys"))
    c = [F.col(x) for x in ("form", "need", "n", "distance")]
    # A generator, so that the test is evaluated once and not again for a filter.
    hit = joined.withColumn("form", form).where(F.size("form") >= F.col("n")).withColumn("first", F.explode(first_window(*c, F.col("rarest"))))
    # A single word is found where it first stands; what comes before a token is summed up once where it is both ends.
    word = (F.array_position("form", F.col("rarest")) - 1).cast("int")
    hit = hit.withColumn("span", F.when(F.col("n") == 1, F.struct(word.alias("first"), word.alias("last"))).otherwise(span_of(*c, F.col("first")))).drop("first")
    hit = hit.withColumn("matched_start", X.token_start(F.col("gaps"), F.col("span.first")))
    last = F.when(F.col("span.first") == F.col("span.last"), F.col("matched_start")).otherwise(X.token_start(F.col("gaps"), F.col("span.last")))
    hit = hit.withColumn("matched_end", last + F.length(F.get("toks", F.col("span.last"))))
    hit = hit.withColumn("matched_text", F.col("text").substr(F.col("matched_start") + 1, F.col("matched_end") - F.col("matched_start")))
    return hit.drop("toks", "keys", "form", "span", "gaps", "words", "need", "n", "rarest")
