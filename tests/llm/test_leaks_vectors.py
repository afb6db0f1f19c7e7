import random
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from colloquy.llm.decontaminate import find_leaks, without_leaks
from colloquy.llm.prefixforest import nearest
from colloquy.llm.queries import op3_decontamination, op6_prefix_forest, oracle_sql


def test_leaks_against_sql(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(3, 60)), "x") for i in range(40)] + [(50, None, "x"), (51, "", "x"), (52, "a a a a a a a", "x"), (53, "Paris", "x"), (54, "deux mots", "x"), (55, "w1 w2 w3 w4", "x"), (56, "A\ta", "x")]
    docs = [(i, text(rng.randrange(0, 300)), "d") for i in range(80)] + [(90, None, "d"), (91, "", "d"), (92, "A A A A A A", "d"), (93, "in paris", "d"), (94, "mots deux", "d"), (95, "deux  MOTS", "d"), (96, "x " * 2_000 + "w1 W2 w3\nw4", "d")]
    for i in range(60):
        w = rng.choice(items[:40])[1].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "zz"
        docs.append((100 + i, text(rng.randrange(50)) + "\n " + " ".join(w).upper() + "\t" + text(rng.randrange(50)), "d"))
    docs.append(docs[-1])
    spark.createDataFrame(items, "item_id long, text string, words string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string, item string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(oracle_sql()["op3_decontamination"]).fetchall())
    got = sorted(tuple(r) for r in op3_decontamination(spark, str(tmp_path)).collect())
    assert got == want and len(got) > 20 and {(93, 53), (95, 54), (96, 55), (92, 56)} <= {g[:2] for g in got} and not any(g[0] == 94 for g in got)
    d, b = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    left = sorted(r["doc_id"] for r in without_leaks(d, b).collect())
    assert left == sorted(x[0] for x in docs if x[0] not in {g[0] for g in got})
    clash = d.withColumnRenamed("item", "leak_id").withColumn("rid", F.lit(1)).withColumn("words", F.lit("w"))
    assert without_leaks(clash, b).count() == len(left)
    assert find_leaks(d.limit(0), b).count() == 0 and find_leaks(d, b.limit(0)).count() == 0


def test_leaks_in_very_long_texts(spark):
    docs = spark.createDataFrame([(i, "x " * 300_000 + ("a b c d e f g" if i else "a b c d") + " y" * 1000) for i in range(2)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert [tuple(r) for r in find_leaks(docs, items).collect()] == [(1, 1, 3, 3, 1.0)]


def exact(x, ids, k):
    out = {}
    for q in [i for i in ids if i % 20 == 0]:
        s = sorted((-float(np.dot(x[i], x[q])), i) for i in ids if i != q)
        out[q] = [(i, -v) for v, i in s[:k]]
    return out


def recall(got, want):
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    return hit / sum(len(w) for w in want.values())


def results(df):
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_on_table(spark):
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    got, want = results(op6_prefix_forest(spark, "/root/testdata/sf0.1")), exact(e, list(e), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values()) and recall(got, want) > 0.93
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall(results(nearest(v, v.where("vec_id % 20 = 0"), rows_per_block=300, queries_per_task=40)), want) > 0.93


def test_unequal_lengths_and_near_neighbours(spark):
    """The nearest by inner product of vectors of any length; in clusters a query looks at few rows, the fewer the more there are."""
    rng = np.random.default_rng(2)
    shares = []
    for n in (1500, 6000):
        centre = rng.standard_normal((n // 150, 32))
        x = np.repeat(centre, 150, axis=0) + 0.05 * rng.standard_normal((n, 32))
        x *= rng.uniform(0.9, 1.1, (n, 1))
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        asked = df.where("vec_id % 20 = 0")
        assert recall(results(nearest(df, asked, rows_per_block=1000)), exact(dict(enumerate(x)), range(n), 20)) > 0.9
        shares.append(nearest(df, asked, rows_per_block=1000, counts=True).agg(F.avg("scored")).first()[0] / n)
    assert shares[1] < shares[0] < 0.5, shares


def test_ties_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(200, [0.5, 1.0]), (220, None), (240, [0.0, 0.0]), (260, [float("nan"), 1.0]), (280, [None, 1.0]), (None, [1.0, 1.0]), (300, []), (320, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, ids string")
    got = results(nearest(df, df.where("vec_id % 20 = 0")))
    assert set(got) == {0, 20, 40, 60, 80, 200}
    assert [v for v, _ in got[20]] == list(range(20)) and [v for v, _ in got[0]] == list(range(1, 21)) and got[200][0] == (0, 0.5)
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


class Gathered:
    """Vectors that can only be taken row by row, and are counted."""

    def __init__(self, x):
        self.x, self.n = x, 0

    def __len__(self):
        return len(self.x)

    def __getitem__(self, rows):
        self.n += len(rows)
        return self.x[rows]


def test_a_forest_multiplies_only_what_it_finds():
    from colloquy.llm.prefixforest import Forest

    rng, shares = np.random.default_rng(5), []
    for n in (2000, 8000):
        centre = rng.standard_normal((n // 100, 32))
        x = np.repeat(centre, 100, axis=0) + 0.05 * rng.standard_normal((n, 32))
        forest = Forest(x, np.linalg.norm(x, axis=1).max())
        forest.x = Gathered(x)
        asked = x[::50]
        found = list(forest.search(asked, np.full(len(asked), -np.inf), 20, 0.1))
        assert forest.x.n == sum(len(rows) for rows, _ in found)
        shares.append(forest.x.n / (n * len(asked)))
        near = [set(np.argsort(-(x @ q))[:20]) for q in asked]
        assert np.mean([len(w & set(rows.tolist())) / 20 for w, (rows, _) in zip(near, found, strict=True)]) > 0.9
    assert shares[1] < shares[0] < 0.1, shares
    isotropic = rng.standard_normal((2000, 32))
    forest = Forest(isotropic, np.linalg.norm(isotropic, axis=1).max())
    forest.x = Gathered(isotropic)
    found = list(forest.search(isotropic[:20], np.full(20, -np.inf), 20, 0.1))
    assert forest.x.n == sum(len(rows) for rows, _ in found)  # most of the rows, as nothing is near
