import zlib
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st

from colloquy.llm.mixing import capped_targets, mix_sources, sainte_lague
from colloquy.llm.sharding import shard_documents

SCHEMA = "doc_id long, source string, text string, shard string, _x int"


def brute_sainte_lague(votes, seats):
    got = [0] * len(votes)
    from fractions import Fraction as Fr

    for _ in range(seats if sum(votes) else 0):
        i = max(range(len(votes)), key=lambda i: (Fr(votes[i]) / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 40))
def test_highest_quotients(votes, seats):
    assert sainte_lague(votes, seats) == brute_sainte_lague(votes, seats)


def test_targets_are_capped_and_shared_again():
    t = capped_targets([10, 1000, 1000], [5, 2, 1])
    assert t[0] == 30 and abs(sum(t) - 2010) < 1e-9 and abs(t[1] / t[2] - 2) < 1e-9
    assert capped_targets([], []) == [] and capped_targets([0, 0], [1, 2]) == [0, 0]


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_mix(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "w " * (i % 50), "mine", 1) for i in range(600)]
    rows += [(1, "s0", None, None, None), (None, "s1", "a b c", "", 2), (None, "s1", "a b c", "", 2), (700, "big", "x " * 30000, "s", 1), (701, "nil", "", "s", 1)]
    out = mix_sources(docs(spark, rows)).collect()
    assert len(out) == len(rows) and out[0]["shard"] in ("mine", None, "", "s")
    taken, target, size = Counter(), {}, Counter()
    for r in out:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(3, 0.02 * t), (s, taken[s], t)
    again = mix_sources(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_mix_empty(spark):
    assert mix_sources(docs(spark, [])).count() == 0
    assert mix_sources(docs(spark, [(1, None, None, None, None)])).first()["taken"] == 0


def check_shards(out, n):
    slots = defaultdict(list)
    size = Counter()
    for r in out:
        text = (r["text"] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert set(slots) <= set(range(n))
    return [size[i] for i in range(n)]


def test_shards(spark):
    rows = [(i, "s", "t" * (i % 97) + str(i), "own", 1) for i in range(3000)] + [(5000 + i, "s", "the same text", "own", 1) for i in range(1500)]
    rows += [(None, None, None, None, None), (1, "s", "", None, None), (1, "s", "", None, None)]
    out = shard_documents(docs(spark, rows)).collect()
    assert len(out) == len(rows) and "source" in out[0]
    sizes = check_shards(out, 16)
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 16 + 400
    copies = {r["shard"] for r in out if r["text"] == "the same text"}
    assert len(copies) <= 1 + 16 * 1500 * 14 / sum(sizes) + 1
    assert sorted(map(repr, out)) == sorted(map(repr, shard_documents(docs(spark, rows).repartition(3)).collect()))


def test_shards_small(spark):
    assert shard_documents(docs(spark, [])).count() == 0
    check_shards(shard_documents(docs(spark, [(1, None, None, None, None)])).collect(), 16)
    check_shards(shard_documents(docs(spark, [(1, None, "a" * 100000, None, None)] * 3)).collect(), 16)


def test_slots_follow_the_key_at_every_size(spark):
    rows = [(i, "s", f"text {i % 62}" if i % 4 else "hot", "own", 1) for i in range(1200)]
    orders = []
    for per_slice in (5, 10, 100, 10_000):
        out = shard_documents(docs(spark, rows), shards=4, rows_per_slice=per_slice).collect()
        check_shards(out, 4)
        by_slot = [(r["shard"], r["slot"], r["doc_id"], r["text"]) for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
        orders.append(by_slot)
        for shard in range(4):
            texts = [t for s, _, _, t in by_slot if s == shard]
            assert sum(a != b for a, b in zip(texts, texts[1:])) + 1 == len(set(texts)), per_slice
    assert all(o == orders[0] for o in orders)


def test_splitters_against_sorted_bytes(spark):
    """No shard is farther from its share than the tolerance and one document: the splitters of a full sort."""
    rows = [(i, "s", "t" * (i * 7919 % 301) + str(i), "own", 1) for i in range(4000)]
    for shards, tolerance in ((16, 0.002), (7, 0.01), (3, 0.0)):
        sizes = check_shards(shard_documents(docs(spark, rows), shards=shards, tolerance=tolerance).collect(), shards)
        total, run = sum(sizes), 0
        for i, n in enumerate(sizes[:-1]):
            run += n
            assert abs(run - total * (i + 1) / shards) <= tolerance * total / shards + 306


def test_shards_of_long_texts(spark):
    rows = [(i, "s", "é" * 500_000 if i < 3 else "b" * i, "own", 1) for i in range(40)]
    sizes = check_shards(shard_documents(docs(spark, rows), shards=4).collect(), 4)
    assert sum(sizes) == 3 * 1_000_001 + sum(i + 1 for i in range(3, 40))
