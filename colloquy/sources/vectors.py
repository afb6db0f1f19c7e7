"""A kept vector index: segments that only grow, deletes by dialogue, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.retrieval import vector_top_k
from colloquy.sources.store import Change, Store
from colloquy.sources.tables import fitting_vectors


class VectorIndex:
    """Unit vectors of one dimension with their key and dialogue: (vec_id, dialogue_id, embedding).

    Added vectors are checked, brought to length one and written as a segment of their own; a vec_id that
    is there already is replaced. Deleted dialogues are a segment of keys. Nothing that was written
    before is read or written again until `compact`. Writers on several machines do not lose each
    other's segments; a search reads one version.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int):
        self.dimension = dimension
        self.store = Store(spark, path, {"vectors": ("vec_id long, dialogue_id string, embedding array<double>", ["vec_id"])})

    def add(self, vectors: DataFrame) -> DataFrame:
        """Add vectors(vec_id, dialogue_id, embedding); the rows of another dimension, which are refused."""
        good, refused = fitting_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("dialogue_id").cast("string").alias("dialogue_id"), "embedding"), self.dimension)
        self.store.upsert("vectors", good)
        return refused

    def delete_dialogues(self, dialogues: DataFrame) -> int:
        """Take away all vectors of dialogues(dialogue_id); the new version."""
        return self.store.delete("vectors", dialogues.select(F.col("dialogue_id").cast("string").alias("dialogue_id")))

    def replace_dialogues(self, vectors: DataFrame) -> int:
        """The dialogues of these vectors have only these from now on, in one commit."""
        good, _ = fitting_vectors(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("dialogue_id").cast("string").alias("dialogue_id"), "embedding"), self.dimension)

        def work(c: Change) -> None:
            c.delete("vectors", good.select("dialogue_id"))
            c.upsert("vectors", good)

        return self.store.change(work)

    def live(self, version: int | None = None) -> DataFrame:
        return self.store.read("vectors", version)

    def ids(self) -> DataFrame:
        """(vec_id, dialogue_id) of what is there."""
        return self.live().select("vec_id", "dialogue_id")

    def stats(self) -> DataFrame:
        """One row: vectors, dialogues, bytes of the vectors as 4-byte numbers."""
        return self.live().agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("dialogue_id").alias("dialogues"), (F.count(F.lit(1)) * self.dimension * 4).alias("bytes"))

    def search(self, queries: DataFrame, k: int = 10, dialogues: DataFrame | None = None) -> DataFrame:
        """(query_id, vec_id, dialogue_id, score, rank) of the k nearest to queries(query_id, query), among some dialogues or all."""
        live = self.live()
        if dialogues is not None:
            live = live.join(dialogues.select("dialogue_id").distinct(), "dialogue_id", "left_semi")
        found = vector_top_k(live, "vec_id", queries, k)
        return found.join(live.select("vec_id", "dialogue_id"), "vec_id").select("query_id", "vec_id", "dialogue_id", "score", "rank")

    def compact(self) -> int:
        """One segment of what is there in place of all segments; the number of segments that were deleted."""
        self.store.compact("vectors")
        return self.store.vacuum()
