"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, mixing, neardup, sharding, toxicity
from colloquy.llm.common import broadcast_if, materialise, table

#: Columns that stages read.
READ = ("doc_id", "text", "source")

#: The mix repeats no document more often, and makes its words whole documents in groups of about so many words.
CAP, GROUP_WORDS = 3, 1 << 17


def apart(docs: DataFrame) -> DataFrame:
    """docs with names of its own for the columns that no stage reads, so that none is mixed up with what a stage adds."""
    return docs.toDF(*[c if c in READ else f"_document_{i}_" for i, c in enumerate(docs.columns)])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, trained on the labelled ones, predicts to be toxic."""
    own = apart(docs)
    model = toxicity.train(own, table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(own, model)
    return scored.where("predicted = 0").select(*own.columns).toDF(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the document with the least doc_id."""
    gone = neardup.near_duplicates(docs.select("doc_id", "text"), threshold=0.8).where("not kept").select(F.col("doc_id").alias("_gone_id_")).distinct()
    gone = materialise(gone, "copies")
    gone = broadcast_if(gone, 32 * gone.count())
    return docs.join(gone, docs["doc_id"] == gone["_gone_id_"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def whole_copies(sizes: np.ndarray, taken: np.ndarray, own: np.ndarray, cap: int = CAP) -> np.ndarray:
    """How often each of a group's documents is repeated so that their words sum up to those taken.

    From the longest on, a document's words are rounded up or down by its own number in [0, 1),
    and what is rounded off is carried to the next one. A choice that the shorter ones could no
    longer balance is not made, so what is left in the end is about half of the shortest.
    """
    out, left, rest, carry = np.zeros(len(sizes), np.int64), float(taken.sum()), int(sizes.sum()), 0.0
    for i in np.lexsort((own, -sizes)):
        size = int(sizes[i])
        if not size:
            break
        rest -= size
        carry += taken[i]
        low, high = max(0, math.ceil((left - cap * rest) / size)), min(cap, max(0, math.floor(left / size)))
        if low <= high:
            times = min(max(math.floor(carry / size + own[i]), low), high)
        else:  # one side or the other is missed: the nearer one
            times = min(low, cap) if low * size - left < left - high * size - cap * rest else high
        out[i] = times
        left -= times * size
        carry -= times * size
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source has the words that the mix takes of it.

    A source's documents are dealt to groups of about GROUP_WORDS words; each keeps its words.
    """
    own, names = apart(docs), docs.columns
    columns = own.columns
    key = F.xxhash64("doc_id", "text", F.lit(23))
    groups = F.greatest(F.lit(1), F.floor(F.col("source_size") / GROUP_WORDS))
    mixed = (
        mixing.mix_sources(own, cap=CAP)
        .where("size > 0")
        .select(*columns, "size", "taken", F.pmod(key, groups).alias("_group"), (F.pmod(F.xxhash64(key), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("_own"))
    )

    def repeat(rows: pa.Table) -> pa.Table:
        sizes, taken, own = (rows[c].to_numpy() for c in ("size", "taken", "_own"))
        times = whole_copies(sizes, taken, own)
        return rows.select(columns).take(pa.array(np.repeat(np.arange(len(times)), times))).rename_columns(names)

    return mixed.groupBy("source", "_group").applyInArrow(repeat, docs.schema)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal what is left to 16 shards of near equal bytes."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", one_of_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: Classifier and sketches are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows, written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
