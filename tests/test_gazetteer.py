"""Names and addresses from tables against brute force, and their masking."""

import random
import re

from pyspark.sql import functions as F

from colloquy.operators import gazetteer as G
from colloquy.operators import pii

TOKEN = re.compile("[а-яёa-z0-9]+")


def brute(docs, names, capital):
    out = set()
    for key, text in docs:
        toks = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer((text or "").lower())]
        for name, entity in names:
            words = TOKEN.findall((name or "").lower())
            for i in range(len(toks) - len(words) + 1):
                if words and [t[0] for t in toks[i : i + len(words)]] == words and not (capital and any(not text[s].isupper() for _, s, _ in toks[i : i + len(words)])):
                    out.add((key, entity, toks[i][1], toks[i + len(words) - 1][2]))
    return sorted(out)


def test_names_like_brute_force(spark):
    r = random.Random(3)
    words = ["Анна", "Мария", "Иванова", "de", "la", "Cruz", "John", "O'Neil", "Smith", "и", "x", "де", "Санкт", "Петербург"]
    names = [(" ".join(r.choice(words) for _ in range(r.randint(1, 3))), r.choice(["FIRST", "LAST"])) for _ in range(40)] + [("", "FIRST"), (None, "LAST"), ("--", "LAST"), ("de la Cruz", "LAST"), ("de la Cruz", "LAST")]
    docs = [(i, "".join(r.choice([w, w.lower(), w.upper()]) + r.choice([" ", ", ", "-", ". "]) for w in r.choices(words, k=r.randint(0, 15)))) for i in range(120)] + [(900, None), (901, ""), (902, "x " * 5000 + "John Smith")]
    d, n = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(names, "name string, entity string")
    for capital in (True, False):
        got = G.find_names(d, "doc_id", n, capital).select("doc_id", "entity", "start", "end").collect()
        assert sorted(map(tuple, got)) == brute(docs, names, capital)
    assert G.find_names(d, "doc_id", n.limit(0)).collect() == []


MARKERS = [("ул", "S"), ("улица", "S"), ("street", "S"), ("г", "C"), ("город", "C"), ("д", "H"), ("дом", "H"), ("кв", "F"), ("apt", "F")]
PLACES = [("Москва",), ("Ленина",), ("Большая Садовая",), ("Baker",)]


def test_addresses_and_masks(spark):
    docs = [
        (1, "Живу: г. Москва, ул. Ленина, д. 5, кв. 12. Звоните"),
        (2, "221 Baker Street, 221b apt 3; Baker street is nice"),
        (3, "улица Большая Садовая дом 10 и ул. Ленина 7"),
        (4, "ул. Неведомая, дом 3"),
        (5, "Ленина 5, дом 7, кв 2"),
        (6, None),
        (7, "Анна Иванова, ул. Ленина, 9, mail a@b.ru; анна"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = G.addresses(d, "doc_id", spark.createDataFrame(MARKERS, "token string, class string"), spark.createDataFrame(PLACES, "name string"))
    text = dict(docs)
    got = sorted((r["doc_id"], text[r["doc_id"]][r["start"] : r["end"]]) for r in found.collect())
    assert got == [(1, "г. Москва, ул. Ленина, д. 5, кв. 12"), (2, "Baker Street, 221b apt 3"), (3, "ул. Ленина 7"), (3, "улица Большая Садовая дом 10"), (4, "ул. Неведомая, дом 3"), (7, "ул. Ленина, 9")]
    names = spark.createDataFrame([("Анна", "FIRST"), ("Иванова", "LAST")], "name string, entity string")
    people = G.persons(G.find_names(d, "doc_id", names), "doc_id")
    masked = pii.mask(G.with_detections(d, "doc_id", people, found), more=F.col("found"))
    assert {r["doc_id"]: r["masked"] for r in masked.collect()}[7] == "<PERSON>, <ADDRESS>, mail <EMAIL>; анна"
    assert {r["doc_id"]: r["masked"] for r in masked.collect()}[6] == ""


def test_runs_of_name_parts_are_one_person(spark):
    docs = [(1, "Пришла Анна Мария Иванова. Анна ушла, John, Smith"), (2, "John x Smith")]
    names = [("Анна", "FIRST"), ("Анна Мария", "FIRST"), ("Иванова", "LAST"), ("John", "FIRST"), ("Smith", "LAST")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = G.persons(G.find_names(d, "doc_id", spark.createDataFrame(names, "name string, entity string")), "doc_id").collect()
    text = dict(docs)
    assert sorted((r["doc_id"], text[r["doc_id"]][r["start"] : r["end"]], r["score"]) for r in got) == [(1, "John", 0.4), (1, "Smith", 0.4), (1, "Анна", 0.4), (1, "Анна Мария Иванова", 0.85), (2, "John", 0.4), (2, "Smith", 0.4)]
