"""Chunks of long turns: packed sentences with overlap, or character windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import text as X


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?…])\s+|\n+"), lambda x: F.trim(x)), lambda s: s != "")


def pack(items: Column, budget: int, overlap: int) -> Column:
    """Arrays of sentences: as many as the token budget holds; each starts with the last of the one before
    that fit the overlap. A sentence over the budget stands alone."""
    sized = F.transform(items, lambda s: F.struct(s.alias("s"), X.word_count(s).alias("n")))
    kind = "array<struct<s:string,n:int>>"
    zero = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("done"), F.expr(f"cast(array() as {kind})").alias("now"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y["n"])

    def tail(a):
        """The longest end of a chunk whose tokens fit the overlap."""
        sizes = F.transform(F.sequence(F.lit(0), F.size(a)), lambda k: F.struct(k.alias("k"), total(F.slice(a, k + 1, F.size(a))).alias("n")))
        first = F.array_min(F.transform(F.filter(sizes, lambda x: x["n"] <= overlap), lambda x: x["k"]))
        return F.slice(a, first + 1, F.size(a))

    def step(acc, x):
        full = (total(acc["now"]) + x["n"] > budget) & (F.size(acc["now"]) > 0)
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(full, F.concat(tail(acc["now"]), F.array(x))).otherwise(F.concat(acc["now"], F.array(x)))
        return F.struct(done.alias("done"), now.alias("now"))

    chunks = F.aggregate(sized, zero, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))
    return F.transform(chunks, lambda c: F.array_join(F.transform(c, lambda x: x["s"]), " "))


def char_windows(text: Column, width: int = 2000, overlap: int = 200) -> Column:
    step = width - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * step + 1, F.lit(width)))


def chunk(turns: DataFrame, max_tokens: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of turns(dialogue_id, turn_index, speaker, text): a short turn is one, a longer one its packed sentences."""
    t = X.sanitize(F.col("text"), 1 << 30)
    parts = F.when(X.word_count(t) <= max_tokens, F.array(t)).otherwise(pack(sentences(t), max_tokens, overlap))
    rows = turns.select("dialogue_id", "turn_index", "speaker", F.posexplode(parts).alias("chunk_index", "text")).where(F.trim("text") != "")
    return rows.select(
        "*",
        F.when(F.col("chunk_index") == 0, "utterance").otherwise("overlap").alias("chunk_type"),
        X.word_count(F.col("text")).alias("token_count"),
        F.length("text").alias("char_count"),
    )


def links(chunks: DataFrame) -> DataFrame:
    """Each chunk's neighbours within its turn."""
    w = Window.partitionBy("dialogue_id", "turn_index").orderBy("chunk_index")
    return chunks.withColumn("overlap_with", F.array_compact(F.array(F.lag("chunk_index").over(w), F.lead("chunk_index").over(w))))


def entities(chunks: DataFrame, recogniser: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """One row for each entity of a chunk; recogniser gives the array of a text's entities (of a pandas UDF or built in)."""
    return chunks.withColumn("entity", F.explode(recogniser(F.col(text)))).drop(text)
