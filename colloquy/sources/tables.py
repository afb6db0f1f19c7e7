"""Single kept tables, lines of feedback, and checks of what a kept index takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.corpus import latest
from colloquy.sources.store import Change, Store, aged


class Table:
    """A store of one table: append, replace by key, delete by key, keep the latest, age out.

    Appends, upserts and deletes write only what is new; several writers lose nothing of each other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.key, self.store = key, Store(spark, path, {"rows": (schema, key)})

    def read(self) -> DataFrame:
        return self.store.read("rows")

    def append(self, rows: DataFrame) -> None:
        self.store.append("rows", rows)

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of the same key; of several new ones of a key any one stays."""
        self.store.upsert("rows", rows)

    def delete(self, keys: DataFrame) -> None:
        self.store.delete("rows", keys)

    def keep_latest(self, order: list[Column]) -> None:
        """One row of each key, the first in the order; done again if the table changes meanwhile."""
        self.store.change(lambda c: c.upsert("rows", latest(c.read("rows"), self.key, order)))

    def age_out(self, column: str, now: Column, ttl_seconds: int) -> None:
        """Keys whose time is too far back go, unless they get a newer row meanwhile."""

        def work(c: Change) -> None:
            c.delete("rows", aged(c.read("rows"), column, now, ttl_seconds).select(*self.key))

        if ttl_seconds > 0:
            self.store.change(work)

    def compact(self) -> None:
        self.store.compact("rows")


def read_feedback(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """Feedback lines of JSONL files: session_id, ts, body (the line); blank and bad lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").where(F.try_parse_json("value").isNotNull())
    rows = lines.select(F.get_json_object("value", "$.session_id").alias("session_id"), F.get_json_object("value", "$.timestamp").alias("ts"), F.col("value").alias("body"))
    return rows.where(F.col("session_id") == session) if session is not None else rows


def load_vocabulary(spark: SparkSession, path: str, dimension: int) -> DataFrame | None:
    """A kept vocabulary(term, idx, df, idf); None if it has another dimension or its places do not run from 0 on."""
    found = spark.read.parquet(path)
    n, least, most = found.agg(F.count(F.lit(1)), F.min("idx"), F.max("idx")).first()
    return found if n <= dimension and (n == 0 or (least == 0 and most == n - 1)) else None


def fitting_vectors(vectors: DataFrame, dimension: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(unit vectors of the dimension, refused rows): what a kept vector index takes; zero vectors stay zero."""
    v = F.col(column)
    fits = F.coalesce(F.size(v) == dimension, F.lit(False))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    return vectors.where(fits).withColumn(column, unit), vectors.where(~fits)
