"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from colloquy.llm.common import WORD, broadcast_if, materialise

#: A source and a shard's share of its blocks.
_CELLS = "source string, shard long, blocks long, quota long"


def capped_targets(sizes: list[int], weights: list[float], cap: int = 3, total: int | None = None) -> list[float]:
    """Shares of total by weight; none above cap times its size, the excess shared again by weight."""
    left = float(sum(sizes) if total is None else total)
    out, free = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    while free and left > 0:
        whole = sum(weights[i] for i in sorted(free))
        over = {i for i in sorted(free) if left * weights[i] / whole > cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in sorted(over):
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free -= over
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1); ties to the first.

    The quotas are those of a divisor that leaves fewer seats open than there are parties; the
    open ones then go to the highest quotients one by one, so the work does not grow with seats.
    """
    exact = [Fraction(v) for v in votes]
    whole = sum(exact)
    if not whole or seats <= 0:
        return [0] * len(votes)
    got = [max(0, int(v * seats / whole - Fraction(1, 2))) for v in exact]
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(exact, got, strict=True)) if v]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        q, i = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (-exact[i] / (2 * got[i] + 1), i))
    return got


def capped_seats(blocks: list[int], seats: int, cap: int) -> list[int]:
    """Seats of each cell by its blocks; none has more than cap times them, and what is over goes to the others."""
    got, free = [0] * len(blocks), list(range(len(blocks)))
    while free and seats > 0:
        part = sainte_lague([float(blocks[i]) for i in free], seats)
        full = [i for i, q in zip(free, part, strict=True) if q >= cap * blocks[i]]
        if not full:
            for i, q in zip(free, part, strict=True):
                got[i] = q
            break
        for i in full:
            got[i] = cap * blocks[i]
            seats -= got[i]
        free = [i for i in free if not got[i]]
    return got


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: int = 3,
    block_tokens: int = 64,
    shard_tokens: int = 1 << 16,
    max_shards: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """Add size, source_size, target and taken to docs(doc_id, source, text).

    Sources in code-point order, null last, take the weights in turn. Each source's words form
    equal blocks of about block_tokens within shards (documents dealt by a seeded hash). Blocks
    are apportioned to the sources by highest quotients, each source's quota likewise to its
    shards, and a seeded systematic draw takes exactly a shard's quota of its blocks, none more
    than cap times. `taken` is the words of a document in taken blocks, repeats counted.

    The driver holds one row per source, a task one source's cells (at most max_shards) or one
    cell's documents. Null or empty texts have size 0 and taken 0; repeated rows each take part;
    an empty table gives an empty result; texts of any length count whole; ties in the drawing order
    go by doc_id, then size; other columns stay as they are, but one named like an added column is
    replaced.
    """
    added = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*added)
    spark = docs.sparkSession
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    slim = materialise(sized.select("doc_id", "source", "size"), "mix-sizes")
    sums = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in sums], [r["n"] for r in sums]
    total = sum(sizes)
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
    least = min((t for t in targets if t > 0), default=0)
    block = max(1, min(block_tokens, int(least / 256)))
    shards = max(1, min(max_shards, total // shard_tokens))

    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).alias("shard")
    cells = (
        slim.groupBy("source", shard)
        .agg(F.sum("size").alias("words"))
        .where("words > 0")
        .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long"))
    )
    cells = materialise(cells, "mix-cells")
    in_blocks = {r["source"]: r["b"] for r in cells.groupBy("source").agg(F.sum("blocks").alias("b")).collect()}
    votes = [t * in_blocks.get(s, 0) / n if n else 0.0 for s, n, t in zip(names, sizes, targets, strict=True)]
    quotas = sainte_lague(votes, round(sum(votes)))
    rows = [(s, int(n), float(t), int(q)) for s, n, t, q in zip(names, sizes, targets, quotas, strict=True)]
    schema = T.StructType([T.StructField("source", docs.schema["source"].dataType)] + [T.StructField(n, t) for n, t in (("source_size", T.LongType()), ("target", T.DoubleType()), ("source_quota", T.LongType()))])
    per_source = broadcast_if(spark.createDataFrame(rows, schema), 256 * len(rows))

    def apportion(pdf):
        pdf = pdf.sort_values("shard")
        blocks = [int(b) for b in pdf["blocks"]]
        pdf["quota"] = capped_seats(blocks, int(pdf["source_quota"].iloc[0]), cap)
        return pdf[["source", "shard", "blocks", "quota"]]

    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    shares = (
        cells.alias("c")
        .join(per_source.alias("s"), same)
        .select("c.source", "shard", "blocks", "source_quota")
        .groupBy("source")
        .applyInPandas(apportion, _CELLS)
    )
    shares = materialise(shares, "mix-quotas").select(*[F.col(c).alias(f"_mix_{c}_") for c in ("source", "shard", "blocks", "quota")])

    m = lambda name: F.col(f"_mix_{name}")  # noqa: E731  own columns, apart from any of the caller's
    in_cell = Window.partitionBy("source", "_mix_shard")
    order = [F.xxhash64("doc_id", F.lit(seed + 1)), F.col("doc_id"), F.col("size")]
    placed = (
        sized.withColumn("_mix_shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)))
        .withColumn("_mix_end", F.sum("size").over(in_cell.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_mix_words", F.sum("size").over(in_cell))
        .withColumn("_mix_u", F.pmod(F.xxhash64("source", "_mix_shard", F.lit(seed + 2)), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    )
    dealt = placed.join(shares, F.col("source").eqNullSafe(m("source_")) & (m("shard") == m("shard_")), "left")

    # The draw: block k is taken floor((k + 1) r + u) - floor(k r + u) times, r = quota / blocks and
    # u the cell's start in [0, 1). Word x of a cell is in its block floor(x * blocks / words).
    words, blocks, quota = m("words"), m("blocks_"), m("quota_")
    draws = lambda k: F.floor(k * quota / blocks + m("u"))

    def cumulative(x):
        k = F.least(F.floor(x * blocks / words), blocks - 1)
        return F.round(draws(k) * words / blocks + (draws(k + 1) - draws(k)) * (x - k * words / blocks))

    taken = F.when((F.col("size") > 0) & quota.isNotNull(), cumulative(m("end")) - cumulative(m("end") - F.col("size"))).otherwise(F.lit(0))
    out = [F.col(f"d.`{c}`") for c in docs.columns]
    return (
        dealt.withColumn("taken", F.least(taken.cast("long"), F.lit(cap) * F.col("size")))
        .alias("d")
        .join(per_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left")
        .select(*out, "d.size", "s.source_size", "s.target", "d.taken")
    )
