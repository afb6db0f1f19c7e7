"""Ranked lexical search: documents are grouped by the mask of an item's terms that they hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import Rolling, chopped, lower_ascii, materialise, spans, text_bytes

#: Terms are runs of letters and digits of ASCII and of everything beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Documents of a block; items that one pass over the documents asks for, in bytes of their terms.
BLOCK, SLICE_BYTES = 8192, 1 << 24


def term_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    return Rolling(data, family).of(start, end)


class Vocabulary:
    """The terms that are asked for, by two 64-bit names each; 128 bits tell a term from others."""

    def __init__(self, terms: list[str]):
        import pyarrow as pa

        data, off = text_bytes(pa.array(terms, pa.large_string()))
        name = term_names(data, off[:-1], off[1:])
        self.order = np.argsort(name, kind="stable")
        self.first = name[self.order]
        self.second = term_names(data, off[:-1], off[1:], 1)[self.order]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which spans are terms of the vocabulary, their numbers)."""
        if not len(self.first) or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        name = term_names(data, start, end)
        at = np.minimum(np.searchsorted(self.first, name), len(self.first) - 1)
        hit = np.flatnonzero(self.first[at] == name)
        hit = hit[term_names(data, start[hit], end[hit], 1) == self.second[at[hit]]]
        return hit, self.order[at[hit]]


def postings_of(text, vocabulary: Vocabulary, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, off, terms, tfs): a document's terms, and what it holds of the vocabulary, row by row."""
    data, off = text_bytes(text)
    n, codes = np.zeros(len(off) - 1, np.int64), []
    for part, cut, row in chopped(_LOWER[data], off, INSIDE):
        start, end, at = spans(part, cut, INSIDE)
        np.add.at(n, row, np.diff(at))
        hit, term = vocabulary.find(part, start, end)
        codes.append(np.repeat(row, np.diff(at))[hit] * size + term)
    code, tf = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
    at = np.searchsorted(code, np.arange(len(n) + 1) * size)
    return n, at, code % max(size, 1), tf


class Block:
    """Documents with what each of their terms adds to a score, by document and by term."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, off: np.ndarray, terms: np.ndarray, adds: np.ndarray):
        self.ids, self.known, self.off, self.terms, self.adds = ids, known, off, terms, adds
        order = np.argsort(terms, kind="stable")
        self.holders = np.repeat(np.arange(len(ids)), np.diff(off))[order]
        self.present, first = np.unique(terms[order], return_index=True)
        self.bounds = np.append(first, len(terms))
        self.most = np.maximum.reduceat(adds[order], first) if len(first) else np.zeros(0, np.int64)

    def masks(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents by mask, where each mask's documents begin, the highest score that each mask allows), highest first.

        A document's mask has a bit for each of the item's terms that it holds, set from the terms' lists.
        """
        at = np.searchsorted(self.present, terms)
        have = np.flatnonzero(at < len(self.present))
        have = have[self.present[at[have]] == terms[have]]
        best = times[have] * self.most[at[have]]
        bits = np.zeros((max(1, -(-len(have) // 64)), len(self.ids)), np.uint64)
        for k, j in enumerate(at[have]):
            bits[k >> 6, self.holders[self.bounds[j] : self.bounds[j + 1]]] |= np.uint64(1 << (k & 63))
        docs = np.flatnonzero(bits.any(axis=0))
        if not len(docs):
            return docs, np.zeros(1, np.int64), np.zeros(0, np.int64)
        bits = bits[:, docs]
        order = np.lexsort(bits)
        bits, docs = bits[:, order], docs[order]
        new = np.flatnonzero(np.append(True, (bits[:, 1:] != bits[:, :-1]).any(axis=0)))
        distinct, bound = bits[:, new], np.zeros(len(new), np.int64)
        for k, b in enumerate(best):
            bound += b * ((distinct[k >> 6] >> np.uint64(k & 63)) & np.uint64(1)).astype(np.int64)
        size, rank = np.diff(np.append(new, len(docs))), np.argsort(-bound, kind="stable")
        off = np.append(0, np.cumsum(size[rank]))
        return docs[np.repeat(new[rank] - off[:-1], size[rank]) + np.arange(len(docs))], off, bound[rank]

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Exact scores of documents that hold some term; times: how often the item has each term."""
        size = self.off[docs + 1] - self.off[docs]
        first = np.cumsum(size) - size
        at = np.repeat(self.off[docs] - first, size) + np.arange(size.sum())
        return np.add.reduceat(self.adds[at] * times[self.terms[at]], first)


class Best:
    """The k best so far of one item: highest score first, ties to the smaller id, a null id last."""

    def __init__(self, k: int):
        self.k, self.evaluated = k, 0
        self.score, self.id, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        self.evaluated += len(score)
        good = score >= self.floor()
        score, ids, known = np.append(self.score, score[good]), np.append(self.id, ids[good]), np.append(self.known, known[good])
        order = np.lexsort((ids, ~known, -score))[: self.k]
        self.score, self.id, self.known = score[order], ids[order], known[order]

    def search(self, block: Block, terms: np.ndarray, times: np.ndarray, every: np.ndarray) -> None:
        """Evaluate masks from the highest bound on, until the next one is below the k-th best."""
        docs, off, bound = block.masks(terms, times)
        every[terms] = times
        a, step = 0, 2 * self.k
        while a < len(bound) and bound[a] >= self.floor():
            b = max(a + 1, int(np.searchsorted(off, off[a] + step, "right")) - 1)
            b = a + int((bound[a:b] >= self.floor()).sum())
            found = docs[off[a] : off[b]]
            self.add(block.scores(found, every), block.ids[found], block.known[found])
            a, step = b, 2 * step
        every[terms] = 0


def _blocks(batches: Iterator, weight: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Block]:
    import pyarrow as pa
    import pyarrow.compute as pc

    held, rows = [], 0

    def block() -> Block:
        t = pa.Table.from_batches(held).combine_chunks()
        flat = lambda c: pc.list_flatten(t[c]).to_numpy().astype(np.int64)
        size = pc.list_value_length(t["terms"]).to_numpy().astype(np.int64)
        m = 75 + 25 * t["n"].to_numpy() * n_docs // n_terms
        terms, tf, per = flat("terms"), flat("tfs"), np.repeat(m, size)
        adds = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * per))
        ids = t["doc_id"]
        return Block(pc.fill_null(ids, 0).to_numpy().astype(np.int64), pc.is_valid(ids).to_numpy(), np.append(0, np.cumsum(size)), terms, adds)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield block()
            held, rows = [], 0
    if rows:
        yield block()


def _slice(docs: DataFrame, asked: list, k: int, item_type) -> DataFrame:
    """Each partition's k best documents of every asked item: (item_id, doc_id, score)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    words = sorted({r["term"] for r in asked})
    number = {w: i for i, w in enumerate(words)}
    items: dict = {}
    for r in asked:
        items.setdefault(r["item_id"], {})[number[r["term"]]] = r["times"]
    queries = [(i, np.array(list(t), np.int64), np.array(list(t.values()), np.int64)) for i, t in items.items()]
    vocabulary, size = Vocabulary(words), len(words)
    shared = spark.sparkContext.broadcast((vocabulary, queries))

    def count(batches):
        vocabulary, _ = shared.value
        for batch in batches:
            n, at, terms, tfs = postings_of(batch.column("text"), vocabulary, size)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    held = docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")
    held = materialise(held, "rank-postings")
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the slice's terms
        df[r["term"]] = r["count"]
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    kind = to_arrow_type(item_type)

    def rank(batches):
        _, queries = shared.value
        best, every = [Best(k) for _ in queries], np.zeros(size, np.int64)
        for block in _blocks(batches, weight, n_docs, n_terms):
            for b, (_, terms, times) in zip(best, queries, strict=True):
                b.search(block, terms, times, every)
        for b, (item, _, _) in zip(best, queries, strict=True):
            ids = pa.array(b.id, pa.int64(), mask=~b.known)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), kind), ids, pa.array(b.score)], ["item_id", "doc_id", "score"])

    return held.mapInArrow(rank, f"item_id {item_type.simpleString()}, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of docs(doc_id, text) for each of items(item_id, text).

    Scores are a saturated term frequency times the term's weight, in integers: with N documents of L
    terms in all, and n in one, m = 75 + 25 n N div L, a term of tf occurrences in the document and
    df documents adds floor(1000 ln((2N + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 12 m)) each time
    the item has it; documents of score 0 are not returned.

    The items are a stated query set: their terms go to every task, in slices of SLICE_BYTES measured
    bytes, each a pass of its own, so more items mean more passes and not larger ones. A pass keeps of
    each document its length and what it holds of the slice's terms, in one row. Tasks then take these
    rows in blocks; an item's term lists set the bits of a presence mask in each document, documents of
    one mask are a group, and groups are scored from the highest possible score on (each term's most in
    the block) until the next group's is below the k-th best so far, which may still be a tie. Nothing
    is shuffled by term, so a term that all documents hold is no hot key; only k rows an item and task
    are left for the last cut.

    A null text has no terms and is no document in N; repeated rows are documents of their own; a null
    doc_id comes last in ties. Equal items count once, different texts of one item_id are one item, a
    null item_id is an id like others, an item without terms has no rows. Texts of any length are
    counted whole. Empty tables give an empty result; other columns, whatever their names, are not used.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms = items.select("item_id", "text").distinct().select("item_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
    terms = materialise(terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "rank-items")
    measured = terms.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    slices = -(-measured // SLICE_BYTES)
    found = spark.createDataFrame([], f"item_id {kind.simpleString()}, doc_id long, score long")
    for s in range(slices):
        asked = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).collect()  # about SLICE_BYTES
        if asked:
            found = found.unionByName(_slice(docs, asked, k, kind))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle(k: int = 20) -> str:
    """DuckDB SQL of op11 over documents and benchmark."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
i AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
c AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM p JOIN w USING (term) JOIN i USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= {k}"""
