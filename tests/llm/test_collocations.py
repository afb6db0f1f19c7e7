"""Collocations from a prefix-free parse against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import collocations as C
from colloquy.llm.common import text_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, least, longest=4, top=2000, share=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for p in pieces(text):
            n[lang or "und"] += len(p)
            f.update((lang or "und", *p[i : i + k]) for k in range(1, longest + 1) for i in range(len(p) - k + 1))
    cands = {g: a for g, a in f.items() if a >= least and len(g) > 2}
    covered = {}
    for (lang, *g), a in cands.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                key = (lang, *g[i : i + k])
                covered[key] = max(covered.get(key, 0), a)
    by: dict = {}
    for (lang, *g), a in cands.items():
        if 100 * covered.get((lang, *g), 0) >= share * a:
            continue
        score, _, left, r = min((2_000_000 * a // (f[lang, *g[:k]] + f[lang, *g[k:]]), k, f[lang, *g[:k]], f[lang, *g[k:]]) for k in range(1, len(g)))
        by.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, r))
    return sorted((lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for lang, found in by.items() for i, (s, a, p, left, r) in enumerate(sorted(found)[:top]))


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)] + ["Été", "日本語", "it's", "a-b", "\x01"]
    p = 1 / np.arange(1, len(words) + 1)
    passage = "this long passage stands in very many texts without any change at all and so it is one chunk"
    rows = []
    for i in range(300):
        text = "".join(str(w) + str(rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b"])) for w in rng.choice(words, rng.integers(0, 80), p=p / p.sum()))
        rows.append((["en", "de", None][i % 3], text + (passage if i % 2 else "")))
    rows += [("en", None), ("fr", ""), ("fr", " .,; "), (None, "only"), ("en", "the " * 50_000), ("de", "a b " * 500 + "\x0c" + "A B C D E " * 70), ("de", "a b " * 500)]
    return rows


@pytest.mark.parametrize(("least", "longest", "trigger", "most"), [(30, 4, 16, 1 << 21), (5, 4, 2, 1 << 21), (30, 4, 16, 0), (10, 3, 3, 1 << 21), (10, 2, 1, 1 << 21)])
def test_phrases_like_brute_force(spark, monkeypatch, least, longest, trigger, most):
    monkeypatch.setattr(C, "MOST_NAMES", most)
    monkeypatch.setattr(C.chunks_of, "__defaults__", (trigger,))
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"w0": F.lit(1), "f": F.lit(2), "chunk": F.lit("x"), "n": F.lit(0)}).repartition(6)
    got = C.collocations(docs, least=least, longest=longest)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest)


def test_top_of_each_language(spark):
    rows = corpus()
    got = C.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5, top=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, top=7)


def test_chunks_overlap_and_repeat():
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(200))
    texts = [" ".join(f"x{i}" for i in rng.integers(0, 50, 40)) + " " + passage + " " + " ".join(f"y{i}" for i in rng.integers(0, 50, 40)) for _ in range(5)]
    data, off = text_bytes(pa.array(texts))
    chunks, row, last = C.chunks_of(data, off, 4)
    chunks = chunks.to_pylist()
    for i, text in enumerate(texts):
        mine = [(c.split(), z) for c, r, z in zip(chunks, row, last, strict=True) if r == i]
        assert [z for _, z in mine] == [False] * (len(mine) - 1) + [True]
        assert [w for c, z in mine for w in (c if z else c[:-3])] == text.split()
        assert all(c[-3:] == d[:3] for (c, _), (d, _) in zip(mine, mine[1:]))
    inside = [{c for c, r in zip(chunks, row, strict=True) if r == i and c in passage} for i in range(5)]
    assert inside[0] and all(x == inside[0] for x in inside)  # the passage is parsed alike in every text


def test_no_documents(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
