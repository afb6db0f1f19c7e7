import random
import re

import numpy as np

from colloquy.llm import neardup
from colloquy.llm.neardup import components, likely, near_duplicates, registers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    ids = sorted({d for d, _ in rows})
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = root(a), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d), d == root(d)) for (d, _), s in zip(rows, sets, strict=True))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "x y"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, base = [], text(200)
    for _ in range(60):  # near copies of near copies
        w = base.split(" ")
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
        if rng.random() < 0.2:
            base = rows[-1]
    rows += [text(rng.randrange(1, 80)) for _ in range(60)]
    rows += [r.upper() for r in rows[::9]] + [rows[0] + "\n\ttail"] + ["a b", "A\tb", "a", None, "", " \n", "a b c d e", "a b c d e f"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, rid string, n int").repartition(4)
    for percent in (80, 85):
        got = sorted(tuple(r) for r in near_duplicates(df, percent / 100).collect())
        assert got == brute(rows, percent)


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id int, text string")
    got = sorted(map(repr, (tuple(r) for r in near_duplicates(df).collect())))
    assert got == sorted(map(repr, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 0, 2, True)]))
    assert near_duplicates(df.limit(0)).count() == 0


def test_boilerplate_makes_no_groups(spark):
    """Texts that share a third of their shingles fall into common buckets and into no group."""
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(100_000)
    same = " ".join(word() for _ in range(120))
    docs = [(i, same + " " + " ".join(word() for _ in range(140))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sketch = registers([np.array([hash(x) & (1 << 64) - 1 for x in shingles(t)], np.uint64) for _, t in docs])
    n = np.full(len(docs), 256.0)
    assert not any(likely(sketch[:i], n[:i], sketch[i], 256.0, 0.8).any() for i in range(1, 100))
    assert all(r["component_id"] == r["doc_id"] for r in near_duplicates(df).collect())


def test_one_id_with_several_texts(spark):
    a, b, c = ("%s1 %s2 %s3 %s4 %s5 %s6 %s7" % ((x,) * 7) for x in "abc")
    df = spark.createDataFrame([(5, a), (3, a), (5, b), (7, b), (9, c), (9, c), (9, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect())
    assert got == [(3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 3, 3), (9, 0, 9), (9, 3, 9), (9, 3, 9)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, 4000).astype(np.uint64) for _ in range(2))
    whole, x, y = registers([np.concatenate([a, b]), a, b])
    assert (np.maximum(x, y) == whole).all()
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    kept = []
    for share, want in ((0.95, True), (0.4, False)):
        other = np.concatenate([base[: int(1000 * share)], rng.integers(0, 1 << 63, 1000 - int(1000 * share)).astype(np.uint64)])
        k = registers([base, other])
        kept.append(bool(likely(k[:1], np.array([1000.0]), k[1], 1000.0, 0.8)[0]) == want)
    assert all(kept)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (500, 499)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (200, 100), (300, 100), (499, 499), (500, 499)}
