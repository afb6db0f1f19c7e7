"""Line deduplication against brute force."""

import pytest
from pyspark.sql import functions as F

from colloquy.llm.linededup import BLANK, dedup_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=10, min_docs=2):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    held: dict = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(doc_id)
    order = lambda d: (d is None, d if d is not None else 0)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        drop = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and doc_id != min(held[key(x)], key=order) for x in lines]
        out.append((doc_id, len(lines), sum(drop), "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)))
    return sorted(out, key=repr)


COMMON = "the same line in all of them"
ROWS = [
    (1, f"{COMMON}\nown line number one\n{COMMON}\n"),
    (2, f"  \t{COMMON.upper()}\r\nshort\nshort\n\n{COMMON}"),
    (3, "short\nÉcole Élève Straße"),
    (4, "école Élève straße\nÉCOLE Élève straße\n École Élève Straße\x0b"),
    (4, "École Élève Straße\nanother row of document four"),
    (4, "École Élève Straße\nanother row of document four"),
    (5, None),
    (6, ""),
    (7, "\n\n\n"),
    (None, f"{COMMON}\nonly without an id it is"),
    (None, "only without an id it is\nand a second one here"),
    (8, "and a second one here\n" + "\n".join(f"{COMMON}\nline {i % 7} of a very long text" for i in range(20_000))),
    (9, "0123456789\n012345678"),
    (10, "0123456789\n012345678"),
    (11, "éééééééééé\nééééééééé"),
    (12, "éééééééééé\nééééééééé"),
]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_of_many_documents(spark, min_docs):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"kept": F.lit("x"), "a": F.lit(1), "gone": F.lit(2), "key": F.lit("k"), "lines": F.lit("l")})
    got = dedup_lines(docs.repartition(5), min_docs=min_docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS, min_docs=min_docs)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    from colloquy.llm import linededup

    monkeypatch.setattr(linededup, "broadcast_if", lambda df, size: df)
    got = dedup_lines(spark.createDataFrame(ROWS, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)


def test_no_documents(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
