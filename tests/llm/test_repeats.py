import hashlib
import random
from collections import Counter

import numpy as np

from colloquy.llm import repeats
from colloquy.llm.queries import op9_repeats
from colloquy.llm.repeats import remove_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((sum(gone), bytes(c for c, g in zip(t, gone) if not g), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))))
    return out


def check(spark, texts, length):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in remove_repeats(df, length).collect()}
    assert len(got) == len(texts)
    for i, (removed, kept, spans) in enumerate(brute(texts, length)):
        r = got[i]
        assert bytes(r["kept"]) == kept, (i, texts[i], r["spans"])
        assert len(r["spans"]) == spans and sum(x["end"] - x["start"] for x in r["spans"]) == removed


def test_random_small_alphabet(spark):
    rng = random.Random(1)
    check(spark, ["".join(rng.choice("abé") for _ in range(rng.randrange(40))) for _ in range(120)] + [None, "", "a" * 300], 9)


def test_shared_passages(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ü\n") for _ in range(n))
    line, long = word(70), word(500)
    texts = []
    for i in range(200):
        t = word(rng.randrange(400))
        if i % 3 == 0:
            t += line + word(50)
        if i % 5 == 0:
            a = rng.randrange(300)
            t += long[a : a + rng.randrange(30, 420)] + word(20)
        if i % 7 == 0 and texts:
            s = rng.choice(texts)
            k = rng.randrange(len(s) + 1)
            t += s[:k] + "!" + s[k:]
        texts.append(t)
    texts += [texts[0]] * 40 + [long + long, "x" * 2000]
    check(spark, texts, 60)
    check(spark, texts, 200)


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_SEGMENT", 64)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shared = text(300)
    df = [text(rng.randrange(500)) + shared[rng.randrange(100) : rng.randrange(150, 300)] + text(40) for _ in range(30)]
    raw = ["".join(df), *df, "x" * 3000]
    whole = [(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in raw]
    for data, off in whole:  # every window stands in one part
        starts = [s for _, _, a, b in repeats.segments(off, 20) for s in range(a, b - 19)]
        assert sorted(starts) == list(range(max(0, len(data) - 19)))
    check(spark, raw, 20)


def test_one_line_in_every_text(spark):
    """A wide bucket: a common line with other surroundings each time, ends that some share."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    line, heads, tails = word(210), [word(90) for _ in range(4)], [word(90) for _ in range(4)]
    texts = [word(rng.randrange(150)) + rng.choice([*heads, ""]) + line[rng.randrange(3) :] + rng.choice([*tails, word(30)]) + word(rng.randrange(150)) for _ in range(300)]
    check(spark, texts, 200)


def test_repeated_rows_and_query(spark, tmp_path):
    rows = [(1, "r" * 150 + "s" * 150, "x"), (1, "r" * 150 + "s" * 150, "x"), (2, None, None), (3, "y" * 199, "x"), (4, "z" * 201, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, marks string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op9_repeats(spark, str(tmp_path)).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert got == [(1, 300, 300, 1, empty)] * 2 + [(2, 0, 0, 0, empty), (3, 199, 0, 0, hashlib.sha256(b"y" * 199).hexdigest()), (4, 201, 201, 1, empty)]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
