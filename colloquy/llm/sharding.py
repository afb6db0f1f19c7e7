"""Sharding by histogram sort: exact byte counts below probes, refined until the splitters fit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import broadcast_if, materialise

#: Bits of a key, and those that one round of probes resolves.
_BITS, _STEP = 60, 12


def _prefix(key: Column, bits: int) -> Column:
    """The first bits of a key of _BITS bits, which are not negative, so their order is that of longs."""
    return F.shiftright(key, _BITS - bits) if bits else F.lit(0).cast("long")


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int, int, int]], int]:
    """Splitters of keys(k1, k2, size) as (prefix of k1, its bits, prefix of k2, its bits).

    A row is at or above a splitter if (prefix of k1, prefix of k2) is. Every round sums the exact
    bytes below evenly spaced probes inside the interval that still holds each splitter, one row
    per probe and open interval, until a probe is within the tolerance or the key has no more bits.
    """
    total = keys.agg(F.sum("size").alias("s")).first()["s"] or 0
    targets = [total * i / shards for i in range(1, shards)]
    room = tolerance * total / shards
    found: dict[int, tuple[int, int, int, int]] = {}
    # Open intervals: prefix -> (bytes below it, splitters inside). k2 is used only where one value
    # of k1 holds too many bytes: then the prefix has all bits of k1.
    open_ = {(0, 0): (0, list(range(shards - 1)))}
    bits1 = bits2 = 0
    while open_ and bits1 + bits2 < 2 * _BITS:
        first = bits1 < _BITS
        if first:
            base, probe = _prefix(F.col("k1"), bits1), _prefix(F.col("k1"), bits1 + _STEP)
            inside = base.isin([p for p, _ in open_]) if bits1 else F.lit(True)
            counts = keys.where(inside).groupBy(base.alias("a"), F.lit(0).cast("long").alias("b"), probe.alias("p"))
        else:
            a, b, probe = _prefix(F.col("k1"), _BITS), _prefix(F.col("k2"), bits2), _prefix(F.col("k2"), bits2 + _STEP)
            inside = a.isin([p for p, _ in open_])
            if bits2:
                inside = inside & b.isin([q for _, q in open_])
            counts = keys.where(inside).groupBy(a.alias("a"), b.alias("b"), probe.alias("p"))
        rows = counts.agg(F.sum("size").alias("s")).collect()  # at most 4096 probes for each open interval
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in rows:
            if (r["a"], r["b"]) in open_:
                by.setdefault((r["a"], r["b"]), []).append((r["p"], r["s"]))
        nxt: dict[tuple[int, int], tuple[int, list[int]]] = {}
        last = bits1 + bits2 + _STEP >= 2 * _BITS
        for at, (below, wanted) in open_.items():
            run, edges = below, []
            for p, s in sorted(by.get(at, [])):
                edges.append((p, run, run + s))
                run += s
            for i in wanted:
                t = targets[i]
                p, lo, hi = next((e for e in edges if e[1] <= t <= e[2]), edges[-1] if edges else (0, below, below))
                near_lo = t - lo <= hi - t
                if min(t - lo, hi - t) <= room or last:
                    edge = p if near_lo else p + 1
                    found[i] = (edge, bits1 + _STEP, 0, 0) if first else (at[0], _BITS, edge, bits2 + _STEP)
                else:
                    nxt.setdefault((p, 0) if first else (at[0], p), (lo, []))[1].append(i)
        open_ = nxt
        if first:
            bits1 += _STEP
        else:
            bits2 += _STEP
    for i in range(shards - 1):
        found.setdefault(i, (0, _STEP, 0, 0))
    return [found[i] for i in range(shards - 1)], total


def _shard_of(splitters: list[tuple[int, int, int, int]], k1: Column, k2: Column) -> Column:
    n = F.lit(0)
    for p1, b1, p2, b2 in splitters:
        a = _prefix(k1, b1)
        at = (a > p1) | ((a == p1) & (_prefix(k2, b2) >= p2)) if b2 else a >= p1
        n = n + at.cast("int")
    return n


def _sliced(keys: DataFrame, rows_per_slice: int, n: int):
    """A function that adds the slice of each row, (_sh_a, _sh_b, _sh_c), to rows with _sh_k1 and _sh_k2.

    Slices follow the order of (k1, k2): a range of k1, in it what lies below, at and between its hot
    values (those with more rows than a slice takes), and within a hot value ranges of k2.
    """
    bits = max(0, math.ceil(math.log2(max(1, n / rows_per_slice))))
    hot = keys.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_slice)
    hot = hot.select(_prefix(F.col("k1"), bits).alias("_sh_a_"), "k1", F.ceil(F.log2(F.col("n") / rows_per_slice)).cast("int").alias("bits"))
    hot = materialise(hot.groupBy("_sh_a_").agg(F.array_sort(F.collect_list(F.struct("k1", "bits"))).alias("_sh_hot")), "shard-hot")  # of one range
    size = 64 * (hot.agg(F.sum(F.size("_sh_hot"))).first()[0] or 0)

    def add(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("_sh_a", _prefix(F.col("_sh_k1"), bits)).join(broadcast_if(hot, size), F.col("_sh_a") == F.col("_sh_a_"), "left")
        at = lambda test: F.filter("_sh_hot", lambda x: test(x["k1"], F.col("_sh_k1")))
        mine = F.get(at(lambda a, b: a == b), F.lit(0))
        below = F.coalesce(F.size(at(lambda a, b: a < b)), F.lit(0))
        inner = F.expr(f"shiftright(_sh_k2, {_BITS} - _sh_mine.bits)")
        return (
            placed.withColumn("_sh_mine", mine)
            .withColumn("_sh_b", F.when(F.col("_sh_hot").isNull(), 0).otherwise(2 * below + F.col("_sh_mine").isNotNull().cast("int")))
            .withColumn("_sh_c", F.when(F.col("_sh_mine").isNull(), F.lit(0).cast("long")).otherwise(inner))
            .drop("_sh_a_", "_sh_hot", "_sh_mine")
        )

    return add


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, rows_per_slice: int = 2000, key: str = "text") -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to docs(doc_id, text).

    Law `bytes`: the shards' bytes (UTF-8 bytes of the text plus 1) are near equal. The sort key is
    (hash of the text, hash of the row): shards follow it, and so do the slots within each, so equal
    texts are neighbours and lie in one shard unless a splitter has to cut through their group.
    Within the tolerance a splitter is put between groups. One exchange brings each slice of a shard
    together, a range of keys of about rows_per_slice rows, and slots run on over the slices; a text
    with more rows is a number of slices, so that none grows with its copies.

    A null text has size 1 and the crc32 of no bytes; texts of any length count whole; rows alike in
    doc_id and text are told apart by nothing, and each gets a slot; ties of the first hash are
    broken by the second; an empty table gives an empty result. Other columns stay, and added ones
    replace those of the same name.
    """
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    k1, k2 = (F.shiftrightunsigned(h, 64 - _BITS) for h in (F.xxhash64(F.lit("k1"), text), F.xxhash64(F.lit("k2"), F.col("doc_id"), text)))
    keyed = (
        docs.withColumn("size", (F.octet_length(text) + 1).cast("long"))
        .withColumn("text_crc32", F.crc32(text.cast("binary")))
        .withColumn("_sh_k1", k1)
        .withColumn("_sh_k2", k2)
    )
    keys = materialise(keyed.select(F.col("_sh_k1").alias("k1"), F.col("_sh_k2").alias("k2"), "size"), "shard-keys")
    splitters, _ = find_splitters(keys, shards, tolerance)
    sliced = _sliced(keys, rows_per_slice, keys.count())
    parts = ["_sh_shard", "_sh_a", "_sh_b", "_sh_c"]
    slim = keys.withColumnsRenamed({"k1": "_sh_k1", "k2": "_sh_k2"}).withColumn("_sh_shard", _shard_of(splitters, F.col("_sh_k1"), F.col("_sh_k2")))
    counts = sliced(slim).groupBy(*parts).agg(F.count(F.lit(1)).alias("_sh_n"))
    before = Window.partitionBy("_sh_shard").orderBy(*parts[1:]).rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    starts = counts.withColumn("_sh_start", F.coalesce(F.sum("_sh_n").over(before), F.lit(0))).drop("_sh_n")
    starts = materialise(starts.withColumnsRenamed({p: f"{p}_" for p in parts}), "shard-slices")
    in_slice = Window.partitionBy(*parts).orderBy("_sh_k1", "_sh_k2")
    placed = (
        sliced(keyed.withColumn("_sh_shard", _shard_of(splitters, F.col("_sh_k1"), F.col("_sh_k2"))))
        .withColumn("_sh_row", F.row_number().over(in_slice))
        .join(starts, [F.col(p) == F.col(f"{p}_") for p in parts])
    )
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_sh_shard").alias("shard"),
        (F.col("_sh_start") + F.col("_sh_row") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
