"""Names and addresses found by tables that the caller gives: a join on the rarest word, and a grammar of token classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as X
from colloquy.operators.kept import written
from colloquy.operators.matcher import MOST_BROADCAST
from colloquy.operators.pii import DETECTION

#: Letters of a token's class in an address: markers of towns, streets, houses and flats, numbers, names of places.
TOWN, STREET, HOUSE, FLAT, NUMBER, PLACE, OTHER = "CSHFNPO"
#: An address by its classes: a street's name beside its marker with a house; a town before and a flat behind may come with it.
ADDRESS = r"(?:C?P{1,3}|CO)?(?:SP{1,3}|SO|P{1,3}S)H?N(?:H?N)?(?:FN)?"


def _tokenised(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, "text", X.tokens(F.col("text")).alias("toks"), X.token_gaps(F.col("text")).alias("gaps"))


def _span(first: Column, last: Column) -> list[Column]:
    """Where the tokens first .. last of `toks` begin and end in the text."""
    start = X.token_start(F.col("gaps"), first)
    return [start.cast("int").alias("start"), (X.token_start(F.col("gaps"), last) + F.length(F.get("toks", last))).cast("int").alias("end")]


def find_names(docs: DataFrame, key: str, names: DataFrame, capital: bool = True) -> DataFrame:
    """(key, entity, start, end, first, last, gap) of every place where a name of names(name, entity) stands in docs(key, text).

    A name is a row of words; it is found as these words in this order with nothing but what is between
    words in between, in any case, but with `capital` only where each begins with a capital letter. Each
    name is filed under the word that the fewest names have, so a text meets only names whose rarest word
    it has, and these are compared word by word. The table may have any number of names: it is joined,
    sent to the tasks only up to MOST_BROADCAST names. Overlapping finds are all given; positions are
    those of characters, first and last number the text's words, gap counts the characters before the first.
    """
    words = names.select("entity", X.tokens(F.col("name")).alias("words")).where(F.size("words") > 0).distinct()
    spread = words.select("words", "entity", F.posexplode("words").alias("offset", "word"))
    held = spread.select("word", "words").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    rarest = F.min(F.struct("held", (-F.length("word")).alias("n"), "word", "offset"))
    filed = spread.join(held, "word").groupBy("words", "entity").agg(rarest.alias("r")).select("words", "entity", F.col("r.word").alias("word"), F.col("r.offset").alias("offset"))
    places = _tokenised(docs, key).select("*", F.posexplode("toks").alias("pos", "word"))
    filed = written(filed, "names-filed")
    if filed.count() <= MOST_BROADCAST:
        met = places.join(F.broadcast(filed), "word")
    else:  # the texts' words are more than their tables' sizes tell
        met = places.hint("shuffle_merge").join(filed, "word")
    met = met.withColumn("first", F.col("pos") - F.col("offset")).where("first >= 0")
    met = met.where(F.slice("toks", F.greatest(F.col("first") + 1, F.lit(1)), F.size("words")) == F.col("words"))
    found = met.withColumn("last", F.col("first") + F.size("words") - 1).select(key, "entity", "text", "toks", "gaps", "first", "last")
    if capital:
        found = found.where(F.forall(F.sequence("first", "last"), lambda i: F.regexp_like(F.col("text").substr(X.token_start(F.col("gaps"), i) + 1, F.lit(1)), F.lit(r"\p{Lu}"))))
    return found.select(key, "entity", *_span(F.col("first"), F.col("last")), "first", "last", F.get("gaps", F.col("first"))["gap"].alias("gap"))


def persons(found: DataFrame, key: str, one: float = 0.4, more: float = 0.85) -> DataFrame:
    """(key, entity, start, end, score): name parts with one character between them are one PERSON.

    A run of several words scores `more`, a single word `one`. Parts that overlap are in one run.
    """
    before = F.max("last").over(Window.partitionBy(key).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", ((F.col("first") > F.coalesce(before, F.lit(-2)) + 1) | (F.col("first") == before + 1) & (F.col("gap") > 1)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(Window.partitionBy(key).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first")).alias("n"))
    return out.select(key, F.lit("PERSON").alias("entity"), "start", "end", F.when(F.col("n") > 0, more).otherwise(one).alias("score"))


def addresses(docs: DataFrame, key: str, markers: DataFrame, places: DataFrame, score: float = 0.85, grammar: str = ADDRESS) -> DataFrame:
    """(key, entity, start, end, score) of addresses in docs(key, text).

    markers(token, class) says which words mark towns, streets, houses and flats (`CSHF`), places(name)
    which words names of places consist of; tokens that begin with a digit are numbers. A text becomes
    a string of its tokens' classes, one letter each, and the grammar is a regular expression over that
    string, so a match is a run of tokens. Both tables are joined by token; a text without a street's
    marker is not looked at.
    """
    marks = markers.select(F.lower("token").alias("word"), "class").groupBy("word").agg(F.min("class").alias("mark"))
    named = places.select(F.explode(X.tokens(F.col("name"))).alias("word")).distinct().withColumn("place", F.lit(True))
    streets = marks.where(F.col("mark") == STREET).select("word")
    flat = docs.select(key, "text").withColumn("row", F.xxhash64(key, "text")).withColumn("toks", X.tokens(F.col("text")))
    some = flat.select(key, "row", F.explode("toks").alias("word")).join(streets, "word", "left_semi").select(key, "row").distinct()
    asked = flat.join(some.withColumnsRenamed({key: "_k", "row": "_row"}), F.col(key).eqNullSafe(F.col("_k")) & (F.col("row") == F.col("_row")), "left_semi").dropDuplicates([key, "row"])
    known = asked.select(key, "row", F.posexplode("toks").alias("pos", "word")).join(marks, "word", "left").join(named, "word", "left")
    letter = F.when(F.col("word").rlike("^[0-9]"), NUMBER).when(F.col("mark").isNotNull(), F.col("mark")).when(F.col("place"), PLACE).otherwise(OTHER)
    classes = known.groupBy(key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("c")))), lambda x: x["c"]), "").alias("classes"))
    ready = _tokenised(asked.select(key, "text"), key).withColumn("row", F.xxhash64(key, "text")).join(classes.withColumnsRenamed({key: "_k", "row": "_row"}), F.col(key).eqNullSafe(F.col("_k")) & (F.col("row") == F.col("_row")))
    parts, hits = F.split("classes", grammar, -1), F.regexp_extract_all("classes", F.lit(grammar), F.lit(0))
    lengths = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("n")))
    found = ready.select(key, "text", "toks", "gaps", lengths.alias("lengths")).select("*", F.posexplode("lengths").alias("i", "at"))
    first = F.aggregate(F.slice("lengths", 1, F.col("i")), F.col("at.gap"), lambda a, x: a + x["gap"] + x["n"])
    found = found.withColumn("first", first).withColumn("last", F.col("first") + F.col("at.n") - 1)
    return found.select(key, F.lit("ADDRESS").alias("entity"), *_span(F.col("first"), F.col("last")), F.lit(score).alias("score"))


def with_detections(docs: DataFrame, key: str, *found: DataFrame, name: str = "found") -> DataFrame:
    """docs with an array column of what was found in each, for `pii.mask(..., more=F.col(name))`; rows without finds have null."""
    every = reduce(DataFrame.unionByName, [f.select(key, F.struct("entity", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score")).alias("d")) for f in found])
    by_key = every.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set("d")).cast(DETECTION).alias(name))
    return docs.join(by_key, F.col(key) == F.col("_key"), "left").drop("_key")
