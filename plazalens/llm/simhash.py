"""SimHash near-duplicates with vantage-point trees.

1. Fingerprints: 64 majority bits over the hashes of all 3-word shingles of a whole text.
2. Equal fingerprints become one node, so copies never form pairs.
3. A vantage-point tree over a bounded sample of fingerprints gives the shards: an inner node
   has a vantage point and a radius, near fingerprints go left and far ones right. Every node
   lives in one shard and also visits each shard that the triangle bound leaves within reach of
   RADIUS; the tree deepens with the number of nodes, so a shard keeps its size.
4. Inside a shard a dual search takes a vantage point of the shard at a time, splits both sides
   into rings of equal distance and follows only ring pairs at most RADIUS apart. What is left is
   compared exactly. A shard sends one link for each node it joins to an earlier one (a spanning
   forest), so a group of n copies gives at most n - 1 links and never all pairs.
5. Components come from star contraction over the links, with written tables between rounds.

The sample only decides where shards end; every fingerprint is placed and searched, whatever the
sample held.

Defined results: null and empty texts have fingerprint zero, linked like any other; a text of one
or two words has one shingle; repeated rows are copies; a null doc_id never is a component id
unless its whole group has none; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plazalens.llm.common import buffer, few, slices, written

WORDS = 3
RADIUS = 2
SEED = 42
#: Distinct fingerprints that choose vantage points and radii.
SAMPLE = 8192
#: Nodes that a shard should hold before visitors.
SHARD_NODES = 4096
#: Ring pairs with fewer comparisons than this are compared directly.
DIRECT = 1 << 18


def _fingerprints(others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in slices(batches, most=2 << 20):
            data, places = buffer(batch.column("text"))
            raw = data.tobytes().lower()  # bytes.lower changes A-Z only
            out = np.zeros(batch.num_rows, np.uint64)
            for i in range(batch.num_rows):
                tokens = raw[places[i] : places[i + 1]].split()  # at 0x09 to 0x0D and 0x20
                if tokens:
                    out[i] = majority(tokens, digest)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(out.view(np.int64))], [*others, "fp"])

    return run


def majority(tokens: list[bytes], digest) -> np.uint64:
    """The fingerprint of a text with at least one word."""
    n = max(1, len(tokens) - WORDS + 1)
    line = b" ".join(tokens)
    stops = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])[:n].tolist()
    stops = stops[min(WORDS, len(tokens)) - 1 :].tolist()
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        part = hashes[k : k + 4096].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, others: list[str]) -> DataFrame:
    """The columns ``others`` and ``fp``, the fingerprint as a signed 64-bit number, of every row."""
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.select("text", *others).mapInArrow(_fingerprints(others), f"{kinds}, fp bigint")


class Tree:
    """Top of the vantage-point tree: arrays in heap order, leaves are the shards.

    Fingerprints are numbers, or rows of several numbers for more than 64 bits; ``reach`` is how far links go."""

    def __init__(self, sample: np.ndarray, depth: int, reach: int = RADIUS):
        self.depth, self.reach = depth, reach
        self.points = np.zeros((1 << depth, *sample.shape[1:]), np.uint64)
        self.radii = np.full(1 << depth, 8 * sample[:1].nbytes or 64, np.int64)
        self._build(1, sample)

    def _away(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bits = np.bitwise_count(x ^ y).astype(np.int64)
        return bits.sum(-1) if self.points.ndim > 1 else bits

    def _build(self, node: int, sample: np.ndarray) -> None:
        if node >= 1 << self.depth or len(sample) < 2:
            return
        # Of a few candidates, the vantage point whose distances spread most prunes best.
        tries = sample[:: max(1, len(sample) // 8)][:8]
        away = self._away(sample[None, :], tries[:, None])
        best = int(np.argmax(away.std(1)))
        self.points[node] = tries[best]
        self.radii[node] = radius = int(np.median(away[best]))
        self._build(2 * node, sample[away[best] <= radius])
        self._build(2 * node + 1, sample[away[best] > radius])

    def shards(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, shard and whether it is the row's own, for all shards each fingerprint visits."""
        rows, nodes, own = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(self.depth):
            away = self._away(fps[rows], self.points[nodes])
            radius = self.radii[nodes]
            left, right = away - self.reach <= radius, away + self.reach > radius
            inner = away <= radius
            rows = np.concatenate([rows[left], rows[right]])
            own = np.concatenate([own[left] & inner[left], own[right] & ~inner[right]])
            nodes = np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
        return rows, nodes - (1 << self.depth), own


def _place(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                fps = np.array(batch.column("fp").slice(start, 2000), np.int64).view(np.uint64)
                rows, shard, own = tree.value.shards(fps)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[rows].view(np.int64)), pa.array(own)], ["shard", "fp", "own"])

    return run


class Forest:
    """Union-find over the nodes of a shard, in arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
        """The pairs that join two groups, one after another; pairs inside a group go first, all at once."""
        apart = self.parent[x] != self.parent[y]
        out: tuple[list[int], list[int]] = ([], [])
        parent = self.parent
        for i, j in zip(x[apart].tolist(), y[apart].tolist()):
            a, b = i, j
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                out[0].append(i)
                out[1].append(j)
        if out[0]:
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.parent = parent
        return out


def near(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of index pairs within RADIUS, from ``left`` and ``right`` by a dual search."""
    work = [(left, right, 0)]
    while work:
        a, b, level = work.pop()
        if len(a) == 0 or len(b) == 0:
            continue
        if len(a) * len(b) > DIRECT and level < 24:
            point = fps[a[(level * 7919) % len(a)]]
            da, db = (np.bitwise_count(fps[x] ^ point) for x in (a, b))
            if da.min() != da.max() or db.min() != db.max():
                a, b = a[np.argsort(da, kind="stable")], b[np.argsort(db, kind="stable")]
                ca, cb = (np.concatenate([[0], np.cumsum(np.bincount(d, minlength=65))]) for d in (da, db))
                for ring in range(65):
                    if ca[ring] < ca[ring + 1]:
                        for other in range(max(0, ring - RADIUS), min(64, ring + RADIUS) + 1):
                            if cb[other] < cb[other + 1]:
                                work.append((a[ca[ring] : ca[ring + 1]], b[cb[other] : cb[other + 1]], level + 1))
                continue
            level = 24 if len(set(fps[a[:64]].tolist())) == 1 else level
            if level < 23:
                work.append((a, b, level + 1))
                continue
        step = max(1, DIRECT // len(b))
        for k in range(0, len(a), step):
            x, y = np.nonzero(np.bitwise_count(fps[a[k : k + step], None] ^ fps[None, b]) <= RADIUS)
            if len(x):
                yield a[k + x], b[y]


def _links(group: pa.Table) -> pa.Table:
    """Links of one shard: its own nodes among themselves and with the visitors."""
    fps = np.array(group.column("fp").combine_chunks(), np.int64).view(np.uint64)
    own = np.array(group.column("own").combine_chunks())
    order = np.argsort(fps, kind="stable")
    fps, own = fps[order], own[order]
    home, forest = np.flatnonzero(own), Forest(len(fps))
    out: tuple[list[int], list[int]] = ([], [])
    for x, y in near(fps, home, np.arange(len(fps))):
        for kept, new in zip(out, forest.join(x, y)):
            kept += new
    a, b = (fps[np.array(k, np.int64)].view(np.int64) for k in out)
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that span every group of distinct fingerprints within RADIUS of another."""
    spark = nodes.sparkSession
    total = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total) / SHARD_NODES))))
    sample = nodes.select("fp").where(few(F.col("fp"), SAMPLE, F.lit(total))).orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()
    tree = spark.sparkContext.broadcast(Tree(sample["fp"].to_numpy(np.int64).view(np.uint64), depth))
    placed = nodes.select("fp").mapInArrow(_place(tree), "shard bigint, fp bigint, own boolean")
    return placed.groupBy("shard").applyInArrow(_links, "a bigint, b bigint")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of every component that has a link.

    Each node learns the smallest node among its neighbours and itself; links are then drawn to
    that minimum (large star and small star in turn). The largest node degree is summed map side.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.unionByName(low.where("low < a").select("a", F.col("low").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(prints: DataFrame) -> DataFrame:
    """(fp, component_id, root) of every distinct fingerprint: the smallest doc_id of its component,
    and a fingerprint that names the component."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes))
    linked = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    lows = linked.join(nodes, "fp").groupBy("root").agg(F.min("low").alias("lowest"))
    named = linked.join(lows, "root").select("fp", "root", "lowest")
    found = nodes.join(named, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    # Written, so that both sides of the next join are dealt anew and a hot fingerprint can be split.
    return written(found, "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id for every row of ``docs``."""
    prints = written(fingerprints(docs, ["doc_id"]), "fingerprints")
    found = prints.join(groups(prints), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of every component with the smallest doc_id; of repeated rows one. Texts are
    shuffled once."""
    rows = docs.withColumns({"_k1": F.xxhash64("doc_id", "text"), "_k2": F.hash("text")})
    prints = written(fingerprints(rows, ["doc_id", "_k1", "_k2"]), "fingerprints")
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    first = prints.join(groups(prints), "fp").groupBy("root").agg(F.min(member).alias("m")).select("m._k1", "m._k2")
    place = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1"))
    return rows.join(first, ["_k1", "_k2"]).withColumn("_place", place).where("_place = 1").select(*docs.columns)
