"""Cycles in trees: without broadcasts, and with what cannot be on one left out."""

from colloquy.operators import mutate


def test_cycles_of_all_lengths_and_no_broadcast(spark, monkeypatch):
    ring = lambda a, n: [(a + i, a + (i + 1) % n) for i in range(n)]
    rows = [(1, 1), *ring(100, 2), *ring(200, 20), *ring(300, 21), *[(400 + i, 401 + i) for i in range(30)], (500, 100), (501, 500), (502, None), (503, 999), (101, 504), (504, 101)]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long")
    seen = []
    kept = mutate.written
    monkeypatch.setattr(mutate, "written", lambda df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    got = sorted(r[0] for r in mutate.cycles(nodes).collect())
    assert got == sorted({1, 100, 101, 504, *range(200, 220)})
    assert len(seen) > 3 and not any("Broadcast" in p for p in seen)
    assert mutate.cycles(nodes.where("node_id >= 400 and node_id < 500")).count() == 0
