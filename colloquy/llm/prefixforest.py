"""Approximate nearest neighbours in a forest of sorted hash strings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialise

#: Trees, and bits of each tree's hash strings.
TREES, BITS = 48, 24


def hash_strings(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """(trees, rows) hash strings: signs on random hyperplanes, the first bit the highest."""
    planes = np.random.default_rng(seed).standard_normal((TREES * BITS, x.shape[1])).astype(np.float32)
    bits = (x.astype(np.float32) @ planes.T > 0).reshape(len(x), TREES, BITS)
    out = np.zeros((TREES, len(x)), np.uint64)
    for b in range(BITS):
        out |= bits[:, :, b].T.astype(np.uint64) << np.uint64(BITS - 1 - b)
    return out


def reach(cosine: np.ndarray, miss: float) -> np.ndarray:
    """The longest prefix at which a vector of that cosine is out of the reach of all trees with at most that chance.

    A bit agrees with probability 1 - angle / pi, so a tree's prefix of b bits with the b-th power.
    """
    p = 1 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
    need = 1 - miss ** (1 / TREES)  # of one tree
    with np.errstate(divide="ignore"):
        b = np.log(need) / np.log(np.maximum(p, 1e-12))
    return np.clip(np.where(p >= 1, BITS, b), 0, BITS).astype(np.int64)


class Forest:
    """One sorted array of hash strings for each tree, of vectors lifted to one length.

    A component sqrt(longest^2 - length^2) puts vectors on a sphere, where the largest inner product
    with a query (which gets 0 there) is the smallest angle.
    """

    def __init__(self, x: np.ndarray, longest: float):
        self.x, self.longest = x, longest
        lifted = np.c_[x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))]
        h = hash_strings(lifted)
        self.order = np.argsort(h, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(h, self.order, 1)

    def ranges(self, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) first and last place + 1 of the strings that share so many bits with h."""
        low_bits = np.uint64((1 << (BITS - bits)) - 1)
        low = np.stack([np.searchsorted(s, a & ~low_bits, "left") for s, a in zip(self.sorted, h, strict=True)])
        high = np.stack([np.searchsorted(s, a | low_bits, "right") for s, a in zip(self.sorted, h, strict=True)])
        return low, high

    def _score(self, query: np.ndarray, seen: np.ndarray, scores: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Multiply the query with the rows of these ranges that it has not been multiplied with."""
        new = np.unique(np.concatenate([self.order[t, low[t] : high[t]] for t in range(TREES)]))
        new = new[~seen[new]]
        seen[new] = True
        for a in range(0, len(new), 2048):
            scores[new[a : a + 2048]] = self.x[new[a : a + 2048]] @ query

    def search(self, queries: np.ndarray, floor: np.ndarray, k: int, miss: float):
        """Per query (rows, scores) of its candidates, the rows that it was multiplied with.

        A query with a floor, a score that k others have reached, descends to the prefix at which a
        vector as near as that would be missed with at most the chance `miss`; all that shares it in
        any tree is a candidate. One without starts at the longest prefix at which the trees hold k
        rows, and ascends one bit in all trees at a time until its own k-th best is such a floor. So
        near neighbours end it early, and only data without any make it look at a large share.
        """
        length = np.maximum(np.linalg.norm(queries, axis=1), 1e-300) * self.longest
        h = hash_strings(np.c_[queries, np.zeros(len(queries))])
        seen, scores = np.zeros((len(queries), len(self.x)), bool), np.zeros((len(queries), len(self.x)))
        bounded = np.isfinite(floor)
        level = np.where(bounded, reach(floor / length, miss), -1)
        for bits in np.unique(level[bounded]):
            at = np.flatnonzero(level == bits)
            low, high = self.ranges(h[:, at], int(bits))
            for j, q in enumerate(at):
                self._score(queries[q], seen[q], scores[q], low[:, j], high[:, j])
        open_ = np.flatnonzero(~bounded)
        for bits in range(BITS, -1, -1):
            if not len(open_):
                break
            low, high = self.ranges(h[:, open_], bits)
            keep = np.ones(len(open_), bool)
            for j in np.flatnonzero((high - low).sum(0) >= k) if bits else range(len(open_)):
                q = open_[j]
                self._score(queries[q], seen[q], scores[q], low[:, j], high[:, j])
                some = scores[q][seen[q]]
                if len(some) >= k:
                    keep[j] = bits > reach(np.partition(some, -k)[-k] / length[q], miss)
            open_ = open_[keep]
        for q in range(len(queries)):
            rows = np.flatnonzero(seen[q])
            yield rows, scores[q][rows]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not zero and has only finite components."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def _best(entries, k: int):
    """The k best of an array of struct<score, vec_id>, ties to the smaller vec_id."""
    before = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)
    return F.slice(F.array_sort(entries, before), 1, k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, miss: float = 0.1, rows_per_block: int = 8192, queries_per_task: int = 1024, counts: bool = False) -> DataFrame:
    """For each of queries(vec_id, embedding) its k nearest of vectors by inner product: query_id, rank, vec_id, score.

    Vectors are dealt by hash to blocks that fit a task, each with a forest of its own. A query first
    searches one block. The score that more than its share of the k best reach there is its floor in
    the others, where it only descends to the prefixes at which a vector as near as that is missed with
    a chance of `miss`. So the share of rows it scores falls with the number of blocks, and with the
    nearness of neighbours where each block holds some of them.
    Equal vectors are indexed once with their k + 1 least ids, which is all that can be among the k
    best. Scores are inner products of the original components in double precision, ties go to the
    smaller vec_id, and a row is no candidate of its own. With `counts` the result is query_id and
    scored, the distinct vectors that the query was multiplied with.

    Rows with a null id or a null, empty, zero or non-finite vector take no part; a vector of another
    length than a query's is no candidate of it; repeated ids count once as queries; vectors of any
    length are read whole; empty tables give an empty result. Other columns are not used.
    """
    double = lambda df: usable(df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    index = materialise(_classes(double(vectors), k), "forest-vectors")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = index.agg(F.count(F.lit(1)), F.sqrt(F.max(squares))).first()
    blocks = -(-n // rows_per_block) or 1
    # Of the k best a block holds k / blocks on average; so many, and two deviations more, set a floor.
    near = k + 1 if blocks == 1 else min(k + 1, math.ceil(k / blocks + 2 * math.sqrt(k / blocks)) + 1)
    asked = materialise(double(queries).dropDuplicates(["vec_id"]), "forest-queries")
    slices = -(-asked.count() // queries_per_task) or 1
    left = index.withColumn("block", F.pmod(F.xxhash64("embedding"), F.lit(blocks))).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    mine = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks))
    right = asked.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)))
    schema = "query_id long, best array<struct<score:double,vec_id:bigint>>, scored long"

    def search(data, ask):
        import pandas as pd

        out = []
        for dim, some in ask.groupby(ask["embedding"].map(len)):
            fit = data[data["embedding"].map(len) == dim]
            if not len(fit):
                continue
            x = np.stack(fit["embedding"].to_list())
            ids = fit["ids"].to_list()
            q = np.stack(some["embedding"].to_list())
            own = some["vec_id"].tolist()
            forest = Forest(x, longest)
            for a in range(0, len(q), 256):
                for i, (rows, score) in enumerate(forest.search(q[a : a + 256], some["floor"].to_numpy()[a : a + 256], near, miss), a):
                    scored = len(rows)
                    if len(rows) > 4 * k:
                        rows = rows[score >= np.partition(score, -2 * k)[-2 * k]]
                    # Scores whose sum does not hang on the number of rows scored together.
                    found = [(-float(np.dot(x[r], q[i])), int(v)) for r in rows for v in ids[r] if v != own[i]]
                    found.sort()
                    out.append((own[i], [{"score": -s, "vec_id": v} for s, v in found[:k]], scored))
        return pd.DataFrame(out, columns=["query_id", "best", "scored"])

    def run(ask):
        return left.groupBy("block", "slice").cogroup(ask.groupBy("block", "slice")).applyInPandas(search, schema)

    first = materialise(run(right.withColumn("block", mine).withColumn("floor", F.lit(float("-inf")))), "forest-first")
    found = first
    if blocks > 1:
        at = min(near, k)
        floors = first.where(F.size("best") >= at).select("query_id", F.element_at("best", at)["score"].alias("found_floor"))
        every = right.join(floors, F.col("vec_id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("found_floor", F.lit(float("-inf")))).drop("query_id", "found_floor")
        others = every.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).where(F.col("block") != mine)
        found = found.unionByName(run(others))
    if counts:
        return found.groupBy("query_id").agg(F.sum("scored").alias("scored"))
    # Every 64 blocks' best are merged before the rest, so no task holds k entries of every block.
    salted = found.withColumn("salt", F.pmod(F.xxhash64("best"), F.lit(-(-blocks // 64))))
    part = salted.groupBy("query_id", "salt").agg(_best(F.flatten(F.collect_list("best")), k).alias("best"))
    merged = part.groupBy("query_id").agg(_best(F.flatten(F.collect_list("best")), k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """Equal vectors once, with their k + 1 least ids; no task sees a whole class."""
    name = F.xxhash64("embedding")
    salted = vectors.withColumn("name", name).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(4096)))
    least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    part = salted.groupBy("name", "embedding", "salt").agg(least(F.collect_list("vec_id")).alias("ids"))
    return part.groupBy("name", "embedding").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).drop("name")
