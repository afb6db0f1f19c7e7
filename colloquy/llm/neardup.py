"""Near-duplicate documents by SetSketch registers, banded, estimated by likelihood, then verified."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import broadcast_if, materialise, mix64, pieces, shingle_sets, text_bytes

#: Registers: floor(1 - log_b(min h)), h exponential with rate A, cut off to 0 .. LIMIT.
BASE, A, LIMIT = 1.001, 20.0, (1 << 16) - 1
#: Bands of registers. A pair at similarity 0.85 shares none of 32 bands of 6 in 3 of 10 million cases, one at
#: 0.8 in 6 of 100,000; one at 0.3 meets in a given band in 7 of 10,000.
BANDS, ROWS = 32, 6
#: Documents of a bucket or a group that one task holds from each of two blocks.
BLOCK = 1024

_SEEDS = mix64(np.arange(1, 3 * BANDS * ROWS + 1, dtype=np.uint64))


def registers(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """SetSketch registers (uint16) of non-empty sets of 64-bit names, one row a set.

    Register i is a monotone function of the least 32-bit hash h_i over the set, so sketches of
    parts merge by maximum. -log(1 - u) makes the least hash exponential.
    """
    if not sets:
        return np.zeros((0, m), np.uint16)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), m), np.uint32)
    x = np.empty_like(flat)
    t = np.empty_like(flat)
    for i in range(m):
        a, b, c = (np.uint32(int(_SEEDS[3 * i + k]) & 0xFFFFFFFF) for k in range(3))
        np.bitwise_xor(flat, a, out=x)
        x *= b | np.uint32(1)
        np.right_shift(x, np.uint32(15), out=t)
        x ^= t
        x *= c | np.uint32(1)
        least[:, i] = np.minimum.reduceat(x, at)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / A
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def likely(k: np.ndarray, n: np.ndarray, k0: np.ndarray, n0: np.ndarray | float, threshold: float, slack: float = 4.0) -> np.ndarray:
    """Whether the joint maximum-likelihood similarity of row pairs (or with one row k0) may reach the threshold.

    With u, v the sets' shares of n + n0 and p(x) = -log_b(1 - x (b - 1) / b), registers are above,
    below or equal with probabilities p(u - v J), p(v - u J) and the rest. The log-likelihood is
    concave in J, so its slope at `threshold` less `slack` standard errors tells on which side the
    maximum lies.
    """
    m = k.shape[1]
    tau = max(0.0, threshold - slack * np.sqrt(threshold * (1 - threshold) / m))
    up, down = (k > k0).sum(1), (k < k0).sum(1)
    same = m - up - down
    u, v = n / (n + n0), n0 / (n + n0)
    tau = np.minimum(tau, 0.999 * np.minimum(u / v, v / u))
    q, log_b = (BASE - 1) / BASE, np.log(BASE)
    xu, xv = np.maximum(u - v * tau, 1e-12), np.maximum(v - u * tau, 1e-12)
    pu, pv = -np.log1p(-xu * q) / log_b, -np.log1p(-xv * q) / log_b
    du, dv = -v * q / ((1 - xu * q) * log_b), -u * q / ((1 - xv * q) * log_b)
    slope = up * du / pu + down * dv / pv - same * (du + dv) / np.maximum(1 - pu - pv, 1e-12)
    return slope >= 0


def _sketched(width: int):
    """rid, text -> rid, n, set_a, set_b, sketch (registers as bytes)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            n, a, b, sketch = [], [], [], []
            for i, j in pieces(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                full = [s for s in sets if len(s)]
                rows = iter(registers(full))
                for s in sets:
                    n.append(len(s))
                    a.append(int(np.bitwise_xor.reduce(mix64(s))) - (1 << 63) if len(s) else 0)
                    b.append(int(np.add.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)) - (1 << 63) if len(s) else 0)
                    sketch.append(next(rows).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sketch, pa.binary())], ["rid", "n", "set_a", "set_b", "sketch"])

    return run


def _shingled(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in pieces(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                name = [int(np.bitwise_xor.reduce(mix64(s))) - (1 << 63) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(name, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["member", "name", "names"])

    return run


def _forest(threshold: float):
    """Whole buckets (or two blocks of one), in order -> likely links, a spanning forest of those of each."""
    percent = round(threshold * 100)

    def linked(rows):
        """Every row is compared with those that no link has reached yet, so copies of one text cost one pass."""
        rid, name, n, k = rows
        todo, queue = np.arange(1, len(rid)), [0]
        while len(todo):
            if not queue:
                queue, todo = [int(todo[0])], todo[1:]
                continue
            u = queue.pop()
            near = np.minimum(n[todo], n[u]) * 100 >= percent * np.maximum(n[todo], n[u])
            at = np.flatnonzero(near)
            near[at] = likely(k[todo[at]], n[todo[at]], k[u], n[u], threshold) if len(at) else False
            reached = todo[near]
            yield from ((rid[u], name[u], rid[v], name[v]) for v in reached)
            queue += reached.tolist()
            todo = todo[~near]

    def work(table):
        import pyarrow as pa

        rid, name, n = (table[c].to_numpy() for c in ("rid", "name", "n"))
        bucket, low, high = (table[c].to_numpy() for c in ("bucket", "low", "high"))
        k = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(len(rid), -1)
        n = n.astype(np.float64)
        new = np.ones(len(rid), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(rid)))
        two = start[size == 2]
        two = two[np.minimum(n[two], n[two + 1]) * 100 >= percent * np.maximum(n[two], n[two + 1])]
        two = two[likely(k[two], n[two], k[two + 1], n[two + 1], threshold)] if len(two) else two
        out = [np.stack([rid[two], name[two], rid[two + 1], name[two + 1]])]
        for s, c in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            e = s + c
            found = list(linked((rid[s:e], name[s:e], n[s:e], k[s:e])))
            if found:
                out.append(np.array(found, np.int64).T)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], ["rid_a", "name_a", "rid_b", "name_b"])

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            b, x, y = (table[c].to_numpy() for c in ("bucket", "low", "high"))
            other = np.flatnonzero((b != b[-1]) | (x != x[-1]) | (y != y[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            held = table.slice(cut)
            if cut:
                yield work(table.slice(0, cut))
        if held is not None and held.num_rows:
            yield work(held)

    return run


def _verified(threshold: float):
    """Members of one candidate group, or of two of its blocks -> verified links, a spanning forest of them."""
    percent = round(threshold * 100)

    def run(key, pdf):
        import pandas as pd

        group, low, high = key
        pdf = pdf.sort_values(["block", "member", "name"], kind="stable")
        member, name = pdf["member"].to_numpy(), pdf["name"].to_numpy()
        own = pdf["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["names"]]
        n = np.array([len(s) for s in sets], np.float64)
        k = np.stack([np.frombuffer(x, np.uint16) for x in pdf["sketch"]])
        label = np.arange(len(member))
        links = []
        for i in range(1, len(member)):
            near = np.minimum(n[:i], n[i]) * 100 >= percent * np.maximum(n[:i], n[i])
            if low != high:
                near &= own[:i] != own[i]
            near = np.flatnonzero(near)
            if not len(near):
                continue
            near = near[likely(k[near], n[near], k[i], n[i], threshold)]
            if not len(near):
                continue
            near = near[np.argsort(-(k[near] == k[i]).sum(1), kind="stable")]
            mine = {int(label[i])}
            for j in near:
                if int(label[j]) in mine:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    links.append((member[i], name[i], member[j], name[j]))
                    mine.add(int(label[j]))
            if len(mine) > 1:
                label[np.isin(label, list(mine))] = min(mine)
        return pd.DataFrame(links, columns=["rid_a", "name_a", "rid_b", "name_b"]).astype("int64")

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of edges(a, b): the least node it is linked with, by large and small stars.

    Every round sends a node's larger neighbours, then its smaller ones, to the least it knows, so
    paths halve. Rounds end in written tables; sums over them tell when nothing changes. A node's
    least neighbour is written too, so that the join with a hot node's edges is one of plain tables,
    which adaptive execution splits.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")

    def state(df):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()  # of numbers or structs of them
        return r[0], r[1]

    seen = state(edges)
    if seen[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    k = 0
    while True:  # until nothing changes: rounds grow with the logarithm of the longest path
        k += 1
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-{k}-large")
        large = materialise(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{name}-{k}-moved")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{k}-small")
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialise(small, f"{name}-{k}")
        now = state(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select("b", "b").distinct())


def _in_blocks(rows: DataFrame, group: str, sizes: DataFrame, node: str) -> DataFrame:
    """Add block, low and high: every row goes to each pair of blocks that has its own; sizes(group, size).

    What comes of it is broadcast where the sizes say that it is small.
    """
    blocks = sizes.select(F.col(group).alias("_group"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    n, total = sizes.agg(F.count(F.lit(1)), F.sum(F.col("size") * F.ceil(F.col("size") / BLOCK))).first()
    placed = rows.join(broadcast_if(blocks, 24 * n), F.col(group) == F.col("_group")).withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("_group", "blocks", "other")
    return broadcast_if(placed, 56 * (total or 0))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """For docs(doc_id integer, text): doc_id, n_shingles, component_id, kept, one row for each input row.

    Documents are linked if the Jaccard similarity of their sets of word shingles is at least the
    threshold (in whole hundredths); component_id is the least doc_id reachable. Rows with equal
    sets form a class, and only one of it is banded. Within each bucket of a band the registers are
    compared, and pairs that the joint likelihood lets reach the threshold are links; only these are
    joined to groups. Within a group every such pair is verified on the full sets unless both are
    already linked. Large buckets and groups are worked on in pairs of blocks.

    Null texts and those without words have an empty set and are linked with nothing; texts of any
    length count whole; rows with one doc_id count as one document, and each row is returned, with its
    own n_shingles. Null doc_ids are never linked; doc_ids that are no integers count as null. Ties
    do not arise, as the least doc_id names a component. An empty table gives an empty result. Other
    columns are not used.
    """
    slim = docs.select(F.col("doc_id").try_cast("long").alias("rid"), "text")
    sketched = materialise(slim.mapInArrow(_sketched(width), "rid long, n long, set_a long, set_b long, sketch binary"), "neardup-sketches", "zstd")
    linkable = sketched.where("n > 0 and rid is not null")
    same = ["n", "set_a", "set_b"]
    # Classes of one row need no join. A class is known by its least doc_id and a name of its set.
    classes = materialise(linkable.groupBy(*same).agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select(*same, "rep"), "neardup-classes")
    classes = broadcast_if(classes, 48 * classes.count())
    rows = linkable.join(classes, same, "left")
    node = lambda rid, name: F.struct(F.col(rid).alias("rid"), F.col(name).alias("name"))
    first = materialise(rows.where("rep is null or rid = rep").select("rid", F.col("set_a").alias("name"), "n", "sketch", F.col("rep").isNotNull().alias("shared")), "neardup-first", "zstd")
    # Only a class's rows of its least doc_id may be there more than once.
    reps = first.where("not shared").unionByName(first.where("shared").dropDuplicates(["rid", "name"])).drop("shared")

    size = 2 * ROWS
    part = F.array(*[F.xxhash64(F.lit(j), F.substring(F.col("sketch"), j * size + 1, size)) for j in range(BANDS)])
    keyed = reps.select("rid", "name", F.explode(part).alias("bucket"))
    buckets = materialise(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "neardup-buckets")
    members = materialise(keyed.join(broadcast_if(buckets.select("bucket"), 16 * buckets.count()), "bucket"), "neardup-members")
    # Near copies meet in many bands, mostly in buckets of the same documents: one of these says it all.
    sets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rid", "name")).alias("x"), F.bit_xor(F.xxhash64("name", "rid", F.lit(7))).alias("y"))
    sets = materialise(sets.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "neardup-sets")
    met = reps.join(_in_blocks(members, "bucket", sets, "rid"), ["rid", "name"])
    met = met.select("bucket", "low", "high", "rid", "name", "n", "sketch").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    four = "rid_a long, name_a long, rid_b long, name_b long"
    edges = lambda df: df.select(node("rid_a", "name_a").alias("a"), node("rid_b", "name_b").alias("b"))
    groups = components(edges(met.mapInArrow(_forest(threshold), four)), "neardup-candidates")
    groups = materialise(groups.select("node.rid", "node.name", F.xxhash64("component").alias("group")), "neardup-groups")

    sizes = materialise(groups.groupBy("group").agg(F.count(F.lit(1)).alias("size")), "neardup-sizes")
    placed = _in_blocks(groups, "group", sizes, "rid")
    wanted = groups.select("rid").distinct()
    wanted = broadcast_if(wanted, 32 * wanted.count())
    names = slim.join(wanted, "rid", "left_semi").mapInArrow(_shingled(width), "member long, name long, names binary").dropDuplicates(["member", "name"])
    full = reps.select("rid", "name", "sketch").join(placed, ["rid", "name"]).withColumnRenamed("rid", "member").join(names, ["member", "name"])
    links = full.select("group", "low", "high", "block", "member", "name", "names", "sketch").groupBy("group", "low", "high").applyInPandas(_verified(threshold), four)
    links = edges(links)

    # Documents of several texts join the classes of all of them.
    own = rows.select("rid", F.struct(F.coalesce("rep", "rid").alias("rid"), F.col("set_a").alias("name")).alias("class"))
    several = own.groupBy("rid").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select(F.col("rid").alias("s_rid"), "least")
    several = materialise(several, "neardup-several")
    if several.take(1):
        links = links.union(own.join(several, F.col("rid") == F.col("s_rid")).where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct())
    linked = materialise(components(links, "neardup-links").select(F.col("node").alias("class"), F.col("component.rid").alias("component_id")), "neardup-components")

    of_class = sketched.join(classes, same, "left").withColumn("class", F.struct(F.coalesce("rep", "rid").alias("rid"), F.col("set_a").alias("name")))
    return (
        of_class.select("rid", "n", F.when((F.col("n") > 0) & F.col("rid").isNotNull(), F.col("class")).alias("class"))
        .join(linked, "class", "left")
        .select(
            F.col("rid").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("class").isNull(), F.col("rid")).otherwise(F.coalesce("component_id", "class.rid")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def oracle(percent: int = 85) -> str:
    """DuckDB SQL of near_duplicates over documents, by pairs that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, w, least(5, len(w)) AS k FROM (SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents) WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, hash(list_slice(w, j, j + k - 1)) AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM w))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= {percent} * (a.n + b.n - i)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS top FROM documents UNION SELECT e.y, r.top FROM r JOIN e ON e.x = r.node),
c AS (SELECT node, min(top) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.node = doc_id"""
