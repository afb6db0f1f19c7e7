"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of characters that are neither a space nor one of tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder, or where none is set one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_colloquy"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


def broadcast_if(df: DataFrame, size: int, limit: int = 1 << 25) -> DataFrame:
    """Ask for a broadcast only where the measured bytes are within the limit; a shuffle join beyond."""
    return F.broadcast(df) if size <= limit else df


def crc_mod(c: str, n: int) -> Column:
    """crc32 of a column's text form, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(n))


# ---------------------------------------------------------------- Arrow batches as bytes


def text_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string array's bytes and offsets; null rows are empty."""
    import pyarrow as pa

    if not (pa.types.is_large_string(array.type) or pa.types.is_string(array.type)):
        array = array.cast(pa.string())
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about limit bytes each; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, at) of the maximal runs of bytes of a class, none across texts; at: where each text's runs begin."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    mine = inside[data]
    filled = off[:-1] < off[1:]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    np.logical_not(mine[:-1], out=first[1:])
    np.logical_not(mine[1:], out=last[:-1])
    first[off[:-1][filled]] = last[off[1:][filled] - 1] = True
    start = np.flatnonzero(mine & first)
    return start, np.flatnonzero(mine & last) + 1, np.searchsorted(start, off)


def chopped(data: np.ndarray, off: np.ndarray, inside: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows) of about limit bytes each; a longer text is cut where a byte is not of the class."""
    for a, b in pieces(off, limit):
        cut, row = off[a : b + 1], np.arange(a, b)
        if cut[-1] - cut[0] > 2 * limit:
            gaps = np.flatnonzero(~inside[data[cut[0] : cut[-1]]]) + cut[0]
            want = np.searchsorted(gaps, np.arange(cut[0] + limit, cut[-1], limit))
            ends = np.unique(np.concatenate([cut, gaps[want[want < len(gaps)]]]))
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                yield data[x:y], np.array([0, y - x]), np.full(1, np.searchsorted(cut, x, "right") - 1 + a)
        else:
            yield data[cut[0] : cut[-1]], cut - cut[0], row


# ---------------------------------------------------------------- rolling hashes

#: Odd bases of two independent families of names.
_BASES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a family's base and of its inverse, modulo 2^64."""
    if family not in _POWERS or len(_POWERS[family][0]) < n:
        out = []
        for base in (_BASES[family], pow(_BASES[family], -1, 1 << 64)):
            x = np.full(max(n, 1 << 20), base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[family] = (out[0], out[1])
    return _POWERS[family]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """64-bit names of any substrings of a byte array, of one of two families."""

    def __init__(self, data: np.ndarray, family: int = 0):
        pw, self.ip = _powers(len(data) + 1, family)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.ip[start] + (end - start).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit names of its word shingles.

    Words are runs of non-space bytes with A-Z lower-cased. With fewer words than the width the
    whole sequence is the only shingle; without words the set is empty.
    """
    n = len(off) - 1
    empty = np.zeros(0, np.uint64)
    if not len(data):
        return [empty] * n
    gap = _SPACE[data]
    filled = off[:-1] < off[1:]
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    before[off[:-1][filled]] = True
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    after[off[1:][filled] - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    words = Rolling(_LOWER[data]).of(start, end)
    at = np.searchsorted(start, off)
    k = len(words) - width + 1
    if k > 0:
        names = words[:k] * _C[0]
        for j in range(1, width):
            names += words[j : j + k] * (_C[j % 5] + np.uint64(2 * (j // 5)))
        names = mix64(names)
    out = []
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            x = np.sort(names[a : b - width + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for j in range(a, b):
                whole = whole * _C[1] + words[j]
            out.append(mix64(whole))
        else:
            out.append(empty)
    return out
