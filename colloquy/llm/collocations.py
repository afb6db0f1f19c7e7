"""Phrase collocations: n-grams are counted inside the distinct chunks of a prefix-free parse."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import _C, Rolling, broadcast_if, materialise, mix64, pieces, spans, text_bytes

#: Bytes that end a piece, and blanks between words; what else there is belongs to words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_WORD = np.ones(256, bool)
_WORD[list(ENDS + BLANKS)] = False
_END = np.zeros(256, bool)
_END[list(ENDS)] = True
_SOLID = np.arange(256) != 0x20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: One window of words in so many ends a chunk; so many names of frequent phrases go to every task.
TRIGGER, MOST_NAMES = 16, 1 << 21


def _joined(names: np.ndarray, width: int) -> np.ndarray:
    """64-bit names of the runs of so many words, at each word where one begins."""
    k = max(0, len(names) - width + 1)
    out = names[:k] * _C[0]
    for j in range(1, width):
        out += names[j : j + k] * (_C[j % 5] + np.uint64(2 * (j // 5)))
    return mix64(out)


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The byte ranges, which may overlap, as an Arrow array of strings."""
    import pyarrow as pa

    off = np.append(0, np.cumsum(end - start))
    at = np.repeat(start - off[:-1], end - start) + np.arange(off[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[at]))


def chunks_of(data: np.ndarray, off: np.ndarray, longest: int, trigger: int = TRIGGER):
    """(chunks, row of each, whether it ends its piece) of lower-cased texts.

    A chunk begins at a piece's first word, and wherever the next longest - 1 words are a trigger: their
    name, which only depends on them, is 0 modulo `trigger`. It runs to the end of the next chunk's
    trigger, so neighbours share just those words, or to the piece's end.
    """
    w = longest - 1
    start, end, at = spans(data, off, _WORD)
    count, seps = len(start), np.flatnonzero(_END[data])
    seg, row = np.searchsorted(seps, start), np.repeat(np.arange(len(off) - 1), np.diff(at))
    new = np.ones(count, bool)
    new[1:] = (seg[1:] != seg[:-1]) | (row[1:] != row[:-1])
    piece = np.cumsum(new)
    names = Rolling(data).of(start, end) if count else np.zeros(0, np.uint64)
    fires = np.zeros(count, bool)
    windows = _joined(names, w)
    k = len(windows)
    fires[:k] = (windows % np.uint64(trigger) == 0) & (piece[:k] == piece[w - 1 : w - 1 + k])
    first = np.flatnonzero(new | fires)
    then = np.append(first[1:], count)
    last = np.append(piece[first[1:]] != piece[first[:-1]], True)[: len(first)]
    stop = np.where(last, then, then + w)  # past the chunk's last word
    size = end - start
    place = np.cumsum(size + 1) - size - 1
    text = np.full(int(size.sum()) + count, 0x20, np.uint8)
    solid = np.ones(len(text), bool)
    solid[place + size] = False
    text[solid] = data[_WORD[data]]
    return _slices(text, place[first], place[stop - 1] + size[stop - 1]), row[first], last


def parse(docs: DataFrame, longest: int) -> DataFrame:
    """The dictionary: (lang, chunk, last, freq) of distinct chunks with their number of places."""
    import pyarrow as pa

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            for a, b in pieces(off, 1 << 22):
                text, row, last = chunks_of(_LOWER[data[off[a] : off[b]]], off[a : b + 1] - off[a], longest)
                found = pa.table({"lang": batch.column("lang").take(pa.array(row + a)), "chunk": text, "last": last})
                counted = found.group_by(["lang", "chunk", "last"]).aggregate([([], "count_all")])
                yield from counted.rename_columns(["lang", "chunk", "last", "freq"]).cast(schema).to_batches()

    schema = pa.schema([("lang", pa.string()), ("chunk", pa.large_string()), ("last", pa.bool_()), ("freq", pa.int64())])
    found = docs.mapInArrow(chunks, "lang string, chunk string, last boolean, freq long")
    return found.groupBy("lang", "chunk", "last").agg(F.sum("freq").alias("freq"))


class Chunks:
    """A batch of distinct chunks: its words' names within their language, and where n-grams may begin."""

    def __init__(self, batch, longest: int):
        data, off = text_bytes(batch.column("chunk"))
        self.data = data
        self.start, self.end, self.at = spans(data, off, _SOLID)
        self.rows = batch.column("freq").to_numpy()
        lang_bytes, lang_off = text_bytes(batch.column("lang"))
        lang = Rolling(lang_bytes).of(lang_off[:-1], lang_off[1:])
        size = np.diff(self.at)
        self.row = np.repeat(np.arange(len(size)), size)
        names = Rolling(data).of(self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        self.names = np.maximum(mix64(names * _C[1] + lang[self.row]), np.uint64(1))  # 0 stands for no word
        own = size - np.where(batch.column("last").to_numpy(zero_copy_only=False), 0, longest - 1)
        self.mine = np.arange(len(self.row)) - self.at[self.row] < own[self.row]
        self.left = self.at[self.row + 1] - np.arange(len(self.row))  # words from here to the chunk's end

    def grams(self, n: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(where, freq) of n-grams that begin in what is the chunk's own; both their parts of n - 1 words are among the known."""
        good = self.mine & (self.left >= n)
        if known is not None:
            parts = _joined(self.names, n - 1) if n > 2 else self.names
            there = np.zeros(len(good) + 1, bool)
            if len(known) and len(parts):
                at = np.minimum(np.searchsorted(known, parts), len(known) - 1)
                there[: len(parts)] = known[at] == parts
            good &= there[:-1] & there[1:]
        where = np.flatnonzero(good)
        return where, self.rows[self.row[where]]


def _summed(keys: np.ndarray, freq: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each group of equal neighbours by key, the groups' sums)."""
    order = np.argsort(keys, kind="stable")
    if not len(order):
        return order, freq
    first = np.flatnonzero(np.append(True, ~same(order[1:], order[:-1])))
    return order[first], np.add.reduceat(freq[order], first)


def count_words(dictionary: DataFrame, longest: int) -> DataFrame:
    """(lang, word, name, f) of all words."""
    import pyarrow as pa

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Chunks(batch, longest)
            where, freq = c.grams(1, None)
            name = c.names[where]
            at, f = _summed(name, freq, lambda x, y: name[x] == name[y])
            at, lang = where[at], batch.column("lang").take(pa.array(c.row[where[at]]))
            yield pa.RecordBatch.from_arrays([lang, _slices(c.data, c.start[at], c.end[at]).cast(pa.string()), pa.array(c.names[at].view(np.int64)), pa.array(f)], ["lang", "word", "name", "f"])

    found = dictionary.mapInArrow(words, "lang string, word string, name long, f long")
    return found.groupBy("lang", "word", "name").agg(F.sum("f").alias("f"))


def count_grams(dictionary: DataFrame, n: int, longest: int, known: np.ndarray | None) -> DataFrame:
    """(w0, w1, ..., f): the n-grams' word names, 0 beyond the n-th, and how often they stand in all texts."""
    import pyarrow as pa

    columns = [f"w{i}" for i in range(longest)]
    shared = dictionary.sparkSession.sparkContext.broadcast(known)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Chunks(batch, longest)
            where, freq = c.grams(n, shared.value)
            words = [c.names[where + i] for i in range(n)]
            key = _joined(c.names, n)[where]
            at, f = _summed(key, freq, lambda x, y: reduce(np.logical_and, [w[x] == w[y] for w in words]))
            out = [pa.array(w[at].view(np.int64)) for w in words] + [pa.array(np.zeros(len(at), np.int64))] * (longest - n)
            yield pa.RecordBatch.from_arrays([*out, pa.array(f)], [*columns, "f"])

    found = dictionary.mapInArrow(grams, ", ".join(f"{c} long" for c in [*columns, "f"]))
    return found.groupBy(*columns).agg(F.sum("f").alias("f"))


def _names(frequent: DataFrame, n: int) -> np.ndarray | None:
    """The sorted names of frequent n-grams, or None where there are more than MOST_NAMES of them."""
    if frequent.count() > MOST_NAMES:
        return None
    rows = frequent.select(*[f"w{i}" for i in range(n)]).toPandas()
    words = [rows[c].to_numpy(np.int64).view(np.uint64) for c in rows.columns]
    if n == 1:
        return np.sort(words[0])
    flat = np.stack(words, axis=1).ravel() if len(rows) else np.zeros(0, np.uint64)
    return np.sort(_joined(flat, n)[::n])


def _contained(words: list[Column], n: int) -> list[tuple[Column, list[Column]]]:
    """The shorter phrases, of two words or more, inside phrases of n words: (whether it is that long, padded words)."""
    size = reduce(lambda a, b: a + b, [F.when(w != 0, 1).otherwise(0) for w in words])
    out = []
    for width in range(2, n):
        out += [(size == n, [*words[i : i + width], *[F.lit(0).cast("long")] * (len(words) - width)]) for i in range(n - width + 1)]
    return out


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z), and cut at .,;:!? and line ends into pieces, these at blanks into words;
    f counts a phrase's contiguous occurrences in pieces, and candidates have f = a >= least. Of the
    cuts of a candidate into two parts with l and r occurrences the one of the lowest score
    2,000,000 a div (l + r) counts, the first one in ties. A candidate inside a longer candidate, which
    need not stay itself, that has at least `share` percent of its occurrences goes.

    Texts are parsed prefix-free: a few words whose hash says so end a chunk and begin the next one, so
    equal passages give equal chunks wherever they stand. Distinct chunks and their frequencies are the
    dictionary, written once; phrases are counted inside it, times the chunk's frequency, each where it
    begins and not in the words that the next chunk has as well. Counting goes from short to long, and
    where the frequent phrases of the length before are at most MOST_NAMES only what is made of them is
    counted, as nothing else can reach `least`; beyond that all is. Tasks sum up before any exchange.
    Words are known by 64-bit names within their language. Two frequent words of one name would be one;
    at 10^8 frequent words of a language that has a chance of 3 in 10,000.

    Null texts are empty, a null lang is `und`, repeated rows count again, texts of any length are parsed
    whole (a chunk is at most a piece). Empty tables give an empty result; other columns, whatever their
    names, are not used.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    dictionary = materialise(parse(docs, longest), "phrase-chunks")
    columns = [f"w{i}" for i in range(longest)]
    counted = materialise(count_words(dictionary, longest), "phrase-words")
    totals = materialise(counted.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    words = materialise(counted.where(F.col("f") >= least), "phrase-frequent")
    zero = F.lit(0).cast("long")
    levels = [words.select(F.col("name").alias("w0"), *[zero.alias(c) for c in columns[1:]], "f")]
    for n in range(2, longest + 1):
        levels.append(materialise(count_grams(dictionary, n, longest, _names(levels[-1], n - 1)).where(F.col("f") >= least), f"phrase-{n}"))
    counts = reduce(DataFrame.unionByName, levels[:-1])
    candidates = reduce(DataFrame.unionByName, levels[1:])
    counts = broadcast_if(counts, counts.count() * 8 * (longest + 6))

    w = [F.col(c) for c in columns]
    inside = [F.when(long, F.struct(*[x.alias(c) for x, c in zip(part, columns, strict=True)])) for n in range(3, longest + 1) for long, part in _contained(w, n)]
    if inside:
        parts = candidates.where(F.col("w2") != 0).select(F.col("f").alias("above"), F.explode(F.array_compact(F.array(*inside))).alias("p")).groupBy("p").agg(F.max("above").alias("above"))
        covers = materialise(parts.select("p.*", "above"), "phrase-covers")
        covers = broadcast_if(covers, covers.count() * 8 * (longest + 6))
        candidates = candidates.join(covers, columns, "left").where("above is null or 100 * cast(above as decimal(20, 0)) < " + f"{share} * cast(f as decimal(20, 0))").drop("above")

    cuts = []
    for k in range(1, longest):
        left, right = [*w[:k], *[zero] * (longest - k)], [*w[k:], *[zero] * k]
        named = [x.alias(f"{side}{i}") for side, part in (("l", left), ("r", right)) for i, x in enumerate(part)]
        cuts.append(F.when(w[k] != 0, F.struct(F.lit(k).alias("k"), *named)))
    cut = candidates.select(*columns, F.col("f").alias("a"), F.explode(F.array_compact(F.array(*cuts))).alias("c")).select(*columns, "a", "c.*")
    for side in ("l", "r"):
        part = counts.select(*[F.col(c).alias(f"{side}{i}") for i, c in enumerate(columns)], F.col("f").alias(side))
        cut = cut.join(part, [f"{side}{i}" for i in range(longest)])
    score = F.expr("cast((2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)")
    low = cut.groupBy(*columns, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")).select(*columns, "a", "m.l", "m.r", "m.score")

    measured = words.agg(F.sum(F.octet_length("word") + F.octet_length("lang") + 64)).first()[0] or 0
    spelled = broadcast_if(words.select("name", "lang", "word"), measured)
    for i, c in enumerate(columns):
        one = spelled.select(F.col("name").alias(c), F.col("word").alias(f"s{i}"), *([F.col("lang")] if i == 0 else []))
        low = low.join(one, c, "inner" if i < 2 else "left")
    low = low.select("lang", F.concat_ws(" ", *[f"s{i}" for i in range(longest)]).alias("phrase"), "a", "l", "r", "score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = low.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    totals = broadcast_if(totals, 64 * totals.count())
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 30, top: int = 2000, share: int = 80) -> str:
    """DuckDB SQL of op12 over documents."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, w[i:i + {k - 1}] AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})" for k in range(1, 5))
    return f"""
WITH p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
u AS (SELECT lang, g[i:i + m - 1] AS g, max(f) AS above FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
c AS (SELECT f.lang, f.g, f.f AS a, f.k FROM f LEFT JOIN u USING (lang, g) WHERE f.k > 1 AND (above IS NULL OR 100::HUGEINT * above < {share}::HUGEINT * f.f)),
x AS (SELECT c.lang, c.g, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:cut] JOIN f r ON r.lang = c.lang AND r.g = c.g[cut + 1:]),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS best FROM x),
z AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM y WHERE best = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) QUALIFY rank <= {top}"""
