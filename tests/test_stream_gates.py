"""Gates and cascade on a stream against the batch search: any order, a restart, late and repeated turns."""

import random

from pyspark.sql import functions as F

from colloquy.operators.dictionary import Condition, Limit, Node
from colloquy.operators.search import search
from colloquy.streaming.gates import decide, gated_matches, state_store
from colloquy.schemas import CLIENT, OPERATOR

SCHEMA = "dialogue_id string, turn_index int, speaker string, text string, ts timestamp"
ROOTS = [
    Node("A", [Condition("a"), Condition("b", operator="OR"), Condition("x", negated=True)], [Node("A1", [Condition("c", channel="CLIENT"), Condition("d", operator="AND")], [Node("A2", [Condition("e")])])]),
    Node("B", [Condition("c"), Condition("d", operator="OR")]),
    Node("C", [Condition("f", negated=True)], [Node("C1", [Condition("a")])]),
]


def turns_of(r, n, start):
    out = []
    for d in range(n):
        for i in range(r.randint(1, 6)):
            text = " ".join(r.choice("abcdefyz" + ("x" if r.random() < 0.1 else "")) for _ in range(r.randint(0, 3)))
            out.append((f"{start}-{d}", i, r.choice([CLIENT, OPERATOR]), text, (start + 1) * 3600 + d * 5 + i * 60))
    return out


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    r = random.Random(7)
    first, second = turns_of(r, 30, 0), turns_of(r, 10, 2)
    early, rest = first[::2], first[1::2]
    far = [("end", 0, CLIENT, "a", 90_000)]
    source, base = str(tmp_path / "in"), str(tmp_path / "run")
    frame = lambda rows: spark.createDataFrame([x[:4] + (float(x[4]),) for x in rows], "dialogue_id string, turn_index int, speaker string, text string, s double").select("*", F.timestamp_seconds("s").alias("ts")).drop("s")

    def run(rows):
        r.shuffle(rows)
        frame(rows).coalesce(1).write.mode("append").parquet(source)
        with state_store(spark):
            found = gated_matches(spark.readStream.schema(SCHEMA).parquet(source), ROOTS)
            found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{base}/out").collect()))

    assert run(early + early[:5]) == []  # all are open yet; some turns come twice
    run(rest)  # a new query goes on with the state
    run(second)
    late = [(d, 99, s, "a b c d e", t) for d, _, s, _, t in first[:20]]
    run(late + [("now", 0, CLIENT, "y", 12_000)])
    got = run(far)
    timed = frame(first + second).withColumns({"timestamp": F.lit(None).cast("string"), "start_offset": F.unix_seconds("ts").cast("double"), "end_offset": F.unix_seconds("ts").cast("double")})
    matches, _ = search(timed, ROOTS)
    want = sorted(map(tuple, matches.select("dialogue_id", "turn_index", "phrase_text", "matched_text", "quarter", "dict_level", "cascade_order").collect()))
    assert want and got == want


def test_limits_are_refused(spark):
    rows = spark.createDataFrame([], SCHEMA)
    try:
        gated_matches(rows, [Node("n", [Condition("a", limits=[Limit(value=3)])])])
    except ValueError:
        return
    raise AssertionError("limits were taken")


def test_deciding_nothing():
    from colloquy.operators.dictionary import flatten

    assert decide(flatten(ROOTS), []) == []
