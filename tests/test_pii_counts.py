import re
from collections import Counter

import duckdb

from __spark_entry__ import queries
from colloquy.operators import pii
from colloquy.operators.pii import RECOGNIZERS

SF = "/root/testdata/sf0.01"
TEXTS = [
    "тел 89161234567, ещё +7(916)123-45-67 и 8(916)123-45-67",
    "паспорт 45 10 789012, не 00 10 789012; карта 4111 1111 1111 1111, 4111111111111111, не 4111111111111112",
    "снилс 112-233-445 95, не 112-233-445 00; инн 7707083893 и 500100732259, не 7707083890",
    "договор № 12, Д-17/4, К-9, № 345; ЛС 12345 и лицевой счёт 98765; a.b@c.io, x@y.example.org",
    "a.b@c.io and 89161234567, 4111111111111111",
    None,
    "",
]


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def weighted(d, weights):
    return sum(w * x for w, x in zip(weights, d, strict=False)) % 11 % 10


def inn(s):
    d = digits(s)
    if len(d) == 10:
        return weighted(d, [2, 4, 10, 3, 5, 9, 4, 6, 8]) == d[9]
    return len(d) == 12 and weighted(d, [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) == d[10] and weighted(d, [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]) == d[11]


def snils(s):
    d = digits(s)
    t = sum((9 - i) * x for i, x in enumerate(d[:9]))
    t = t % 101 if t > 101 else t
    return len(d) == 11 and (0 if t == 100 else t) == d[9] * 10 + d[10]


def luhn(s):
    return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(digits(s)[::-1])) % 10 == 0


VALID = {"": None, "phone": lambda s: len(digits(s)) == 11, "passport": lambda s: digits(s)[:2] != [0, 0], "snils": snils, "inn": inn, "luhn": luhn}


def brute(docs):
    times, where = Counter(), {}
    for doc, text in docs:
        found = set()
        for entity, _, check, patterns in RECOGNIZERS:
            for pattern, score in patterns:
                for m in re.finditer(pattern.replace(r"\d", "[0-9]"), text or ""):
                    if VALID[check](m[0]) if check else score >= 0.5:
                        found.add((-1.0 if check else -score, m.start() - m.end(), m.start(), entity))
        kept = []
        for _, minus, start, entity in sorted(found):
            if all(start - minus <= a or b <= start for a, b in kept):
                kept.append((start, start - minus))
                times[entity] += 1
                where.setdefault(entity, set()).add(doc)
    return sorted((e, n, len(where[e])) for e, n in times.items())


def counted(spark, path):
    return sorted(tuple(r) for r in queries()["pii_counts_all"](spark, path).collect())


def test_every_entity_is_counted(spark, tmp_path):
    docs = list(enumerate(TEXTS))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = counted(spark, str(tmp_path))
    assert got == brute(docs) and {e for e, *_ in got} == {e for e, *_ in RECOGNIZERS}


def test_counts_of_the_given_documents(spark):
    got = counted(spark, SF)
    print(got)
    assert got == brute(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    assert {"CREDIT_CARD", "PHONE_NUMBER", "EMAIL_ADDRESS"} <= {e for e, *_ in got}


def test_detections_are_found_once_and_from_their_first_characters(spark):
    plan = queries()["pii_counts_all"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1 and plan.count(f"(?={pii.STARTS})") == 1
    for text in TEXTS:
        for entity, _, _, patterns in RECOGNIZERS:
            assert entity in pii.HINTS or all(re.match(pii.STARTS, m[0]) for p, _ in patterns for m in re.finditer(p, text or ""))
    added = (("CODE", "<CODE>", "", ((r"zz\d+", 0.9),)),)
    found = spark.createDataFrame([(1, "a zz12 b"), (2, "К-9"), (3, "b 9")], "doc_id long, text string").select("doc_id", pii.detections(pii.F.col("text"), recognizers=RECOGNIZERS + added).alias("x"))
    assert {r["doc_id"]: [d["entity"] for d in r["x"]] for r in found.collect()} == {1: ["CODE"], 2: ["CONTRACT_NUMBER"], 3: []}
