"""Exact repeated passages by bucket-pointer refinement of suffix buckets.

Suffixes are put into buckets by their first Q bytes, and buckets are refined by the identifiers of
what stands at other offsets, round after round, until `length` bytes are settled:

1. Of the suffixes that start in one window of length - Q + 1 positions only the least by a hash of
   its Q bytes is bucketed, so about one of 70; equal passages pick it at the same place. It stands
   for the windows (strings of `length` bytes) in which it is the least.
2. A node is a suffix with a range of its windows. Its core is what all of them have in common, its
   hull what they reach together. At first the core is the Q bytes, the range all windows. A node
   alone with its core has no window in common with any other and is dropped; nodes with one hull
   have all windows in common and are settled. The others are open.
3. Every round splits the ranges of the open nodes. The part of a range has a longer core: its bucket
   is the one of the last round, refined by the identifiers of the pieces that the core gains at an
   earlier and a later offset. In the last round a range is one window: core and hull are its bytes.

Every round is one sort by bucket. Only equality counts, so an identifier is a name by content (a
64-bit polynomial) and no ranks are sent back to the texts. A hull settles its windows by two such
names of different bases, 128 bits, and its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import Rolling, materialise, mix64, pieces, text_bytes

#: Bytes of the first buckets, and into how many parts at most a round splits a range.
Q, PARTS = 64, 12
#: Low bits of a key that hold the position; the hash takes the rest.
_POS = 31
#: Bytes that one pass over a text works on; longer texts are read in several.
_SEGMENT = 1 << 22

#: (start of the first window << 32) | (suffix - that start) << 16 | (last window - first window).
_NODE = "core long, hull long, proof long, rid long, at long, settled boolean, wide boolean"
_M = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def anchors(names: np.ndarray, ends: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of each least suffix.

    names: of the q bytes at each position; ends: where the text of each position ends.
    """
    width, n = length - q + 1, len(names)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none
    keys = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    keys[:n] = (names >> np.uint64(_POS)) << np.uint64(_POS) | np.arange(n, dtype=np.uint64)
    rows = keys.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    start = np.flatnonzero(ends[:m] - np.arange(m) >= length)
    if not len(start):
        return none, none, none
    least = (np.minimum(tail[start], head[start + width - 1]) & np.uint64((1 << _POS) - 1)).astype(np.int64)
    first = np.ones(len(start), bool)
    first[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    a = np.flatnonzero(first)
    b = np.append(a[1:], len(start)) - 1
    return least[a], start[a], start[b]


def segments(off: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, first byte, last byte + 1); a long row comes in parts that share no window."""
    for i, j in pieces(off):
        if off[j] - off[i] <= _SEGMENT:
            yield i, j, int(off[i]), int(off[j])
        else:
            for a in range(int(off[i]), int(off[j]) - length + 1, _SEGMENT):
                yield i, j, a, min(int(off[j]), a + _SEGMENT + length - 1)


def _batch(core, hull, proof, rid, at):
    """An Arrow batch of nodes.

    Of more than two nodes alike in it the others are settled here and meet no bucket. A bucket with
    more than two nodes left is wide: it needs no other batch to be kept, so its nodes are dealt by
    their hulls, and one row stands for it among the nodes of other batches.
    """
    import pyarrow as pa

    order = np.lexsort((core, hull, proof))
    same = np.zeros(len(order), bool)
    same[2:] = (hull[order][2:] == hull[order][:-2]) & (core[order][2:] == core[order][:-2]) & (proof[order][2:] == proof[order][:-2])
    settled = np.zeros(len(order), bool)
    settled[order] = same
    order = np.lexsort((settled, core))
    c, new = core[order], np.ones(len(order), bool)
    new[1:] = c[1:] != c[:-1]
    run = np.flatnonzero(new)
    left = np.add.reduceat((~settled[order]).astype(np.int64), run) if len(run) else run
    many = left > 2
    wide = np.zeros(len(order), bool)
    wide[order] = np.repeat(many, np.diff(np.append(run, len(order))))
    stand = order[run[many]]
    # A settled node stands alone.
    alone = rid.view(np.uint64) ^ at.view(np.uint64) * _M[0]
    core = np.concatenate([np.where(settled, alone, core), core[stand]])
    hull = np.concatenate([hull, mix64(hull[stand] ^ rid[stand].view(np.uint64) ^ _M[1])])
    proof = np.concatenate([proof, proof[stand]])
    rid, at = np.concatenate([rid, rid[stand]]), np.concatenate([at, np.full(len(stand), -1)])
    no = np.zeros(len(stand), bool)
    columns = [core.view(np.int64), hull.view(np.int64), proof.view(np.int64), rid, at, np.concatenate([settled, no]), np.concatenate([wide & ~settled, no])]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["core", "hull", "proof", "rid", "at", "settled", "wide"])


def _first_nodes(length: int, q: int):
    """rid, text -> nodes of the first round."""

    def run(batches):
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = text_bytes(batch.column(1))
            out: list[tuple[np.ndarray, ...]] = []
            for i, j, a, b in segments(off, length):
                part, po = data[a:b], np.clip(off[i : j + 1], a, b) - a
                if len(part) < length:
                    continue
                roll = Rolling(part)
                at = np.arange(len(part) - q + 1)
                names = roll.of(at, at + q)
                ends = np.repeat(po[1:], np.diff(po))[: len(at)]
                pos, lo, hi = anchors(names, ends, length, q)
                if not len(pos):
                    continue
                d = np.searchsorted(po, lo, "right") - 1
                where = ((lo + a - off[i + d]) << 32) | ((pos - lo) << 16) | (hi - lo)
                out.append((names[pos], roll.of(lo, hi + length), Rolling(part, 1).of(lo, hi + length), rid[i + d], where))
            if out:
                yield _batch(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return run


def _contexts(length: int):
    """rid, text, nodes -> rid, pos, low, context, nodes: the bytes that the nodes of a suffix reach."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            nodes = batch.column(2)
            counts = np.diff(np.asarray(nodes.offsets))
            flat = nodes.flatten()
            at, core = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            d = np.repeat(np.arange(len(counts)), counts)
            low = at >> 32
            rid = batch.column(0).to_numpy(zero_copy_only=False)[d]
            raw = memoryview(np.ascontiguousarray(data))
            a = low + off[d]
            b = a + (at & 0xFFFF) + length
            for k in range(0, len(at), 1 << 14):
                e = k + (1 << 14)
                context = [raw[x:y].tobytes() for x, y in zip(a[k:e].tolist(), b[k:e].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rid[k:e]), pa.array((low + (at >> 16 & 0xFFFF))[k:e]), pa.array(low[k:e]), pa.array(context, pa.binary()), pa.array(at[k:e]), pa.array(core[k:e])], ["rid", "pos", "low", "context", "at", "core"])

    return run


def _next_nodes(length: int, q: int, before: int, width: int):
    """rid, low, context, nodes -> the nodes' parts: ranges of `width` windows of those of `before` windows."""
    last = length - q  # the farthest that a window starts before its suffix

    def run(batches):
        for batch in batches:
            rid, low = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, off = _binary(batch.column(2))
            nodes = batch.column(3)
            counts = np.diff(np.asarray(nodes.offsets))
            flat = nodes.flatten()
            at, core = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            row = np.repeat(np.arange(len(counts)), counts)
            edge = np.append(0, np.cumsum(counts))
            out: list[tuple[np.ndarray, ...]] = []
            for i, j in pieces(off):
                x, y = edge[i], edge[j]
                if x == y:
                    continue
                part, r = data[off[i] : off[j]], row[x:y]
                base = off[r] - off[i] - low[r]  # from a text's bytes to those of the piece
                lo, pos, hi = at[x:y] >> 32, (at[x:y] >> 32) + (at[x:y] >> 16 & 0xFFFF), (at[x:y] >> 32) + (at[x:y] & 0xFFFF)
                one, two = Rolling(part), Rolling(part, 1)
                # A window is known by how far it starts before its suffix.
                j0, j1 = (pos - hi) // width, (pos - lo) // width
                n = j1 - j0 + 1
                k = np.repeat(np.arange(len(n)), n)
                child = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + j0[k]
                p, to = pos[k], base[k]
                a1 = child * width
                a2 = np.minimum(a1 + width - 1, last)
                b1 = (a1 // before) * before
                b2 = np.minimum(b1 + before - 1, last)
                near, far = np.maximum(a1, p - hi[k]), np.minimum(a2, p - lo[k])
                left, right = one.of(to + p - a1, to + p - b1), one.of(to + p - b2 + length, to + p - a2 + length)
                refined = mix64(core[x:y].view(np.uint64)[k] * _M[0] + left * _M[1] + right * _M[2] + child.astype(np.uint64) * _M[3])
                u, v = to + p - far, to + p - near + length
                where = ((p - far) << 32) | (far << 16) | (far - near)
                out.append((refined, one.of(u, v), two.of(u, v), rid[r][k], where))
            if out:
                yield _batch(*(np.concatenate(z) for z in zip(*out, strict=True)))

    return run


def _refined(nodes: DataFrame, last: bool, name: str) -> DataFrame:
    """(rid, at, core, state) of the nodes that are not alone: 0 open; 1 settled; 2 settled, and met by the
    open ones of its bucket for all of its kind."""
    gate = F.when(F.col("wide"), F.xxhash64("core", "hull")).otherwise(F.col("core"))
    in_bucket, alike = Window.partitionBy("gate"), Window.partitionBy("gate", "hull", "proof")
    counted = (
        nodes.withColumn("gate", gate)
        .withColumn("n", F.count(F.lit(1)).over(in_bucket))
        .where("n > 1 or settled or wide")
        .withColumn("c", F.count(F.lit(1)).over(alike))
        .withColumn("k", F.row_number().over(alike.orderBy("rid", "at")))
        .withColumn("open", F.col("wide") | F.max((F.col("c") == 1) & ~F.col("settled")).over(in_bucket))
    )
    state = F.when(F.col("settled"), 1).when(F.col("c") == 1, 0).when((F.col("k") == 1) & F.col("open"), 2).otherwise(1)
    found = counted.where("at >= 0").select("rid", "at", "core", state.cast("byte").alias("state"))
    return materialise(found.where("state > 0").drop("core") if last else found, name)


def _binary(array) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    wide = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if offsets is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    off = np.frombuffer(offsets, wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def _cut(length: int):
    """text, settled nodes of the first round, those of the others -> spans, kept."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            lists = [(np.asarray(c.offsets), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column(2), batch.column(3))]
            spans, kept = [], []
            for i in range(len(off) - 1):
                at = np.concatenate([v[o[i] : o[i + 1]] for o, v in lists])
                a, b = at >> 32, (at >> 32) + (at & 0xFFFF) + length
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > b[:-1]
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(a)) - 1 if len(a) else first
                text = data[off[i] : off[i + 1]]
                keep = np.ones(len(text), bool)
                pairs = [{"start": int(x), "end": int(y)} for x, y in zip(a[first], b[last], strict=True)]
                for p in pairs:
                    keep[p["start"] : p["end"]] = False
                spans.append(pairs)
                kept.append(text[keep].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"])

    return run


def widths(length: int, q: int) -> list[int]:
    """Windows of a range, round by round: powers of PARTS below all of them, down to one."""
    out = [1]
    while out[-1] * PARTS < length - q + 1:
        out.append(out[-1] * PARTS)
    return [length - q + 1, *reversed(out)]


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """For docs(doc_id, text): doc_id, spans array<struct<start, end>> in UTF-8 bytes, kept binary.

    Each byte is removed that lies in a string of `length` bytes which starts anywhere else too, in
    the same text or another; matches never cross texts and are judged on the input. A null text
    is empty; texts under the length stay whole, longer ones are read in parts that share no window,
    so of any length. Rows alike in doc_id and text are two texts, so each repeats the other; all
    copies of a passage go, there is no first one; an empty table gives an empty result. Other
    columns are not used.
    """
    q = min(Q, max(1, length // 3))
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = F.expr("cast(array() as array<bigint>)")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    steps = widths(length, q)

    first = keyed.where(F.octet_length("text") >= length).select("rid", "text").mapInArrow(_first_nodes(length, q), _NODE)
    nodes = _refined(first, False, "repeat-nodes-0")
    settled = F.collect_list(F.when(F.col("state") > 0, F.col("at"))).alias("settled")
    open_ = F.collect_list(F.when(F.col("state") != 1, F.struct("at", "core"))).alias("open")
    by_row = nodes.distinct().groupBy("rid").agg(settled, open_).withColumnRenamed("rid", "mark_rid")  # of one text
    placed = keyed.join(by_row, F.col("rid") == F.col("mark_rid"), "left").drop("mark_rid")
    placed = materialise(placed, "repeat-texts", "zstd")
    touched = placed.where("settled is not null")
    flat = "rid long, pos long, low long, context binary, at long, core long"
    reach = materialise(touched.where(F.size("open") > 0).select("rid", "text", "open").mapInArrow(_contexts(length), flat), "repeat-contexts", "zstd")

    found = []
    todo = reach.select("rid", "low", "context", F.array(F.struct("at", "core")).alias("nodes"))
    for k in range(1, len(steps)):
        parts = todo.mapInArrow(_next_nodes(length, q, steps[k - 1], steps[k]), _NODE)
        nodes = _refined(parts, k == len(steps) - 1, f"repeat-nodes-{k}")
        found.append(nodes.where("state > 0").select("rid", "at"))
        if k < len(steps) - 1:
            pos = F.shiftright("at", 32) + F.shiftright("at", 16).bitwiseAND(0xFFFF)
            live = nodes.where("state <> 1").distinct().groupBy(F.col("rid").alias("n_rid"), pos.alias("n_pos")).agg(F.collect_list(F.struct("at", "core")).alias("nodes"))  # at most one for each window
            inside = lambda x: (F.shiftright(x["at"], 32) >= F.col("low")) & (F.shiftright(x["at"], 32) + x["at"].bitwiseAND(0xFFFF) + length <= F.col("low") + F.octet_length("context"))
            todo = reach.join(live, (F.col("rid") == F.col("n_rid")) & (F.col("pos") == F.col("n_pos"))).select("rid", "low", "context", F.filter("nodes", inside).alias("nodes"))
    rest = found[0]
    for f in found[1:]:
        rest = rest.union(f)
    rest = rest.distinct().groupBy(F.col("rid").alias("found_rid")).agg(F.collect_list("at").alias("found"))
    joined = touched.join(rest, F.col("rid") == F.col("found_rid"), "left").withColumn("found", F.coalesce("found", none))
    cut = joined.select("doc_id", "text", "settled", "found").mapInArrow(_cut(length), f"doc_id {kind}, spans array<struct<start:bigint,end:bigint>>, kept binary")
    whole = placed.where("settled is null").select("doc_id", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.coalesce("text", F.lit("")).cast("binary").alias("kept"))
    return cut.unionByName(whole)
