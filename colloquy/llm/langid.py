"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import pieces, text_bytes

#: Buckets of hashed n-grams.
BUCKETS = 4096

# Byte -> 6-bit class: 0 for ASCII non-letters, 1-26 for letters in either case, more for other bytes.
_CLASS = np.zeros(256, np.uint32)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of hashed n-gram counts (n = 3), one row a text."""
    out = np.zeros((len(off) - 1, BUCKETS), np.float32)
    if len(data) < 3:
        return out
    c = _CLASS[data]
    t = (c[:-2] << np.uint32(12)) | (c[1:-1] << np.uint32(6)) | c[2:]
    t *= np.uint32(2654435761)
    t >>= np.uint32(20)
    grams = t.astype(np.int64)
    for i in range(len(off) - 1):
        if off[i + 1] - off[i] >= 3:
            out[i] = np.bincount(grams[off[i] : off[i + 1] - 2], minlength=BUCKETS)
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +-1, one row a language: all splits in two for up to 7, else the best random code."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, least = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - (code @ code.T)[np.triu_indices(n, 1)].max()) / 2
        if apart > least:
            best, least = code, apart
    return best


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    code: np.ndarray | None = None
    weights: np.ndarray | None = None  # buckets x bits
    bias: np.ndarray | None = None
    trust: np.ndarray | None = None  # of each bit's classifier

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by trust-weighted logistic loss, its share, and the runner-up's share."""
        margin = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.trust).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, top, p.max(1) if p.shape[1] else top


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150, decay: float = 1e-5) -> Model:
    """A logistic classifier for every bit of the codewords, by accelerated gradient steps."""
    code = codewords(len(languages))
    target = code[y].astype(np.float32)
    share = np.bincount(y, minlength=len(languages)).astype(np.float32)
    weight = (1 / np.maximum(share, 1))[y][:, None] / len(languages)  # languages count alike
    w = v = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = vb = np.zeros(code.shape[1], np.float32)
    rate, t = np.float32(6.0), 1.0
    for _ in range(steps):
        g = -target / (1 + np.exp(target * (x @ v + vb))) * weight
        w2, b2 = v - rate * (x.T @ g + decay * v), vb - rate * 0.1 * g.sum(0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2.astype(np.float32), b2.astype(np.float32), t2
        v, vb = v.astype(np.float32), vb.astype(np.float32)
    right = (((x @ w + b) * target > 0) * weight).sum(0)
    right = np.clip(right, 0.5, 0.999)
    return Model(languages, code, w, b, np.log(right / (1 - right)) + 0.05)


def train(docs: DataFrame, sample: int = 4000, seed: int = 3) -> Model:
    """Fit on a seeded sample of docs(doc_id, text, lang) with a lang: about sample / languages rows of each.

    Only text and lang of these rows are learned from; the sample's expected size, at least 20 rows a
    language, is the bound on what the driver holds (8 KB a row), and n-grams of each sampled text are counted in full.
    """
    known = docs.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(counts)
    if not languages:
        return Model()
    each = max(20, sample // len(languages))
    rate = F.lit(0.0)
    for lang in languages:
        rate = F.when(F.col("lang") == lang, min(1.0, each / counts[lang])).otherwise(rate)
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 20)) < rate * (1 << 20)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in pieces(off):
                for a in range(i, j, 256):
                    b = min(j, a + 256)
                    x = features(data[off[a] : off[b]], off[a : b + 1] - off[a]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    rows = known.where(drawn).select("lang", "text").mapInArrow(run, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not rows:
        return Model()
    languages = sorted({r["lang"] for r in rows})
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float16).reshape(len(rows), BUCKETS).astype(np.float32)
    return fit(x, np.array([languages.index(r["lang"]) for r in rows]), languages)


def identify(docs: DataFrame, model: Model, clear: float = 0.2) -> DataFrame:
    """Add lang_pred, score, runner_up_score and ambiguous to docs(text); only the text is looked at.

    `und` and score 0 where the text is null or has no letter, or nothing was learned; ambiguous
    where the nearest codewords' scores differ by less than `clear`. Whole texts are counted, of
    any length. Of languages that score alike the first by name is predicted. Repeated rows each get their
    row, with the same result. Added columns replace those of the same name, other columns stay; an empty
    table gives an empty result.
    """
    added = ["lang_pred", "score", "runner_up_score", "ambiguous"]
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers
    at = docs.columns.index("text")
    docs = docs.withColumn("_lang_letters", F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, top, second = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            if m.languages:
                data, off = text_bytes(batch.column(at))
                for i, j in pieces(off):
                    for a in range(i, j, 512):
                        b = min(j, a + 512)
                        best, p, q = m.decode(features(data[off[a] : off[b]], off[a : b + 1] - off[a]))
                        lang[a:b], top[a:b], second[a:b] = np.array(m.languages, object)[best], p, q
                none = ~batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                lang[none], top[none], second[none] = "und", 0, 0
            found = [pa.array(lang, pa.string()), pa.array(top), pa.array(second), pa.array(top - second < clear)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*batch.schema.names[:-1], *added])

    schema = docs.drop("_lang_letters").schema
    for name, kind in zip(added, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
