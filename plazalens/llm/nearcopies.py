"""Near copies: SimHash over 5-word shingles and a vantage-point tree (``simhash``), then exact Jaccard similarity.

1. Each row gets a key of its word sequence and a fingerprint: BITS majority bits over its distinct 5-word shingles; equal
   sequences are one node, so copies never form pairs.
2. A vantage-point tree deals the nodes into shards. The first vantage point is the empty text, from which a text is as far as
   it has shingles; near copies lie in one ring or in two neighbours, as the rings grow by 1 / SIMILARITY. A ring of over
   SHARD nodes is dealt on by ``simhash.Tree`` over a bounded sample. Every node lives in one shard and visits each
   shard that its ring and the triangle bound leave within REACH; the sample decides only where shards end.
3. In a shard, nodes of such sizes that SIMILARITY is possible are compared, visitors as they come past, so a task holds one shard
   and a batch. Fingerprints at most REACH bits apart are linked, by a spanning forest: at most n - 1 links for n nodes. Texts that
   share SIMILARITY of their shingles are further apart with a probability of 2e-06 at most (4 shingles of 5, where a bit differs with
   3/16), 2e-09 in long texts, where it differs with 0.152.
4. The components of these links (``simhash.components``) hold every near copy of a node. The whole shingle sets of
   a component meet once in one task, many small components together, and are linked again where their exact
   Jaccard similarity reaches SIMILARITY; again by n - 1 rows. A component over PACK shingles or BUCKET nodes is dealt into blocks and every
   two blocks meet.
5. Components of the exact links are the groups. What is read again by its text is found by a key of doc_id and text.

The comparisons of step 3 grow with the square of the nodes of a size: near copies of 0.8 are too far apart for the triangle bound to
leave out much of a ring. A task's memory is bounded by SHARD; the visitors that pass it grow with their rings.

Defined results: words end at ASCII white space, A-Z are folded; a text of one to four words has one
shingle; null texts and texts without words are copies of each other; texts are taken whole, however long; of repeated rows one stays; a
row without doc_id goes before no other; an empty table gives no rows; other columns pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazalens.llm.common import Rolling, buffer, few, fresh, mixed, slices, spans, words, written
from plazalens.llm.simhash import Forest, Tree, components

WORDS = 5
SIMILARITY = 0.8
SEED = 42
#: Bits of a fingerprint, and of those that are compared first.
BITS, FIRST = 256, 128
#: Different bits up to which fingerprints are linked, and so many of the first bits.
REACH, FIRST_REACH = 80, 46
#: Nodes that a shard should hold before visitors, and fingerprints of a ring that place the shards' borders.
SHARD, SAMPLE = 1 << 16, 1024
#: Nodes of a block.
BUCKET = 2048
#: Shingles that meet in a task.
PACK = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def shingles(data: np.ndarray, places: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, where those of each text begin, and a key of each word sequence."""
    data = np.frombuffer(data.tobytes().lower(), np.uint8)  # bytes.lower changes A-Z only
    starts, stops, first = words(data, places)
    each = rolling.pieces(data, starts, stops) if len(starts) else np.zeros(0, np.uint64)
    sizes = np.diff(first)
    counts = np.where(sizes > 0, np.maximum(1, sizes - WORDS + 1), 0)
    heads = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(heads[-1]) + np.repeat(first[:-1] - heads[:-1], counts)
    end = np.repeat(first[1:], counts)
    padded = np.concatenate([each, np.zeros(WORDS, np.uint64)])
    out = np.zeros(heads[-1], np.uint64)
    for k in range(WORDS):
        out += np.where(at + k < end, padded[at + k] * _PLACES[k], np.uint64(0))
    keys, some = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(some):
        place = (np.arange(len(each)) - np.repeat(first[:-1], sizes)).astype(np.uint64)
        keys[some] = mixed(np.add.reduceat(each * (mixed((place + np.uint64(1)) * _STEP) | np.uint64(1)), first[some]))
    return mixed(out), heads, keys


PRINTS = "doc_id bigint, k1 bigint, k2 int, fp bigint, size bigint, sketch binary"


def sketches(hashes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text and its BITS majority bits over them, packed; sorts ``hashes`` within the texts."""
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
        hashes[a:b].sort()
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
    new[heads[:-1][np.diff(heads) > 0]] = True
    bounds = np.concatenate([[0], np.cumsum(new)])[heads]
    hashes, sizes = hashes[new], np.diff(bounds)
    # Votes are added in pieces of 255 shingles, eight one-byte sums in a number.
    pieces = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(pieces)])
    starts = np.repeat(bounds[:-1], pieces) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], pieces))
    stops = np.concatenate([starts[1:], [len(hashes)]])
    sums = np.zeros((len(starts), BITS), np.uint8)
    for k in range(0, len(starts), 256):
        at = starts[k : k + 256]
        part = hashes[at[0] : stops[k : k + 256][-1]]
        voters = np.stack([mixed(part + _STEP * np.uint64(i)) for i in range(1, BITS // 64 + 1)], axis=1)
        votes = np.unpackbits(voters.view(np.uint8), axis=1).view(np.uint64)
        sums[k : k + 256] = np.add.reduceat(votes, at - at[0], axis=0).view(np.uint8)
    some = sizes > 0
    out = np.zeros((len(sizes), BITS // 8), np.uint8)
    if some.any():
        out[some] = np.packbits(2 * np.add.reduceat(sums, first[:-1][some], axis=0, dtype=np.int64) > sizes[some, None], axis=1)
    return sizes, out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(SEED)
    for batch in slices(batches, most=1 << 20):
        hashes, heads, keys = shingles(*buffer(batch.column("text")), rolling)
        sizes, marks = sketches(hashes, heads)
        columns = [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(keys.view(np.int64)), pa.array(sizes), pa.array([m.tobytes() for m in marks], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "fp", "size", "sketch"])


def unpacked(sketches: pa.Array) -> np.ndarray:
    """The fingerprints, a row of 64-bit numbers each."""
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(-1, BITS // 64)


SHARDS = "shard bigint, own boolean, fp bigint, size bigint, sketch binary"


def _place(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, ring = unpacked(batch.column("sketch")), np.array(batch.column("ring"), np.int64)
            for r in np.unique(ring).tolist():
                at = np.flatnonzero(ring == r)
                for target in (r, r + 1):
                    if target not in trees.value:
                        continue
                    rows, leaf, own = trees.value[target].shards(marks[at])
                    own &= target == r
                    if target == r:  # of two shards of a ring, the nodes of the first visit the second
                        home = np.zeros(len(at), np.int64)
                        home[rows[own]] = leaf[own]
                        rows, leaf, own = (x[own | (leaf > home[rows])] for x in (rows, leaf, own))
                    taken = batch.select(["fp", "size", "sketch"]).take(pa.array(at[rows]))
                    yield pa.RecordBatch.from_arrays([pa.array((target << 32) + leaf), pa.array(own), *taken.columns], ["shard", "own", "fp", "size", "sketch"])

    return run


class Shard:
    """The nodes of a shard by size, and the groups that its links make."""

    def __init__(self, fp: np.ndarray, size: np.ndarray, marks: np.ndarray):
        order = np.argsort(size, kind="stable")
        self.fp, self.size, self.marks = fp[order], size[order], marks[order]
        self.words = [np.ascontiguousarray(self.marks[:, i]) for i in range(FIRST // 64)]
        self.forest = Forest(len(fp))

    def near(self, size: np.ndarray, marks: np.ndarray, among: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs within REACH of the given nodes, by size, and the shard's; ``among`` itself, each pair once."""
        for k in range(0, len(size), 64):
            held_sizes, some = size[k : k + 64], marks[k : k + 64]
            low = k if among else int(np.searchsorted(self.size, SIMILARITY * held_sizes[0] - 1e-9))
            high = int(np.searchsorted(self.size, held_sizes[-1] / SIMILARITY + 1e-9, "right"))
            for j in range(low, high, 4096):
                stop = min(high, j + 4096)
                away = np.zeros((len(held_sizes), stop - j), np.uint8)
                for i, word in enumerate(self.words):
                    away += np.bitwise_count(some[:, i, None] ^ word[None, j:stop])
                x, y = np.divmod(np.flatnonzero(away <= FIRST_REACH), stop - j)
                y += j
                held = np.minimum(held_sizes[x], self.size[y]) >= SIMILARITY * np.maximum(held_sizes[x], self.size[y]) - 1e-9
                held &= np.bitwise_count(some[x] ^ self.marks[y]).sum(1, dtype=np.int64) <= REACH
                held &= (y > k + x) if among else True
                if held.any():
                    yield k + x[held], y[held]

    def among(self) -> Iterator[pa.RecordBatch]:
        for x, y in self.near(self.size, self.marks, True):
            a, b = self.forest.join(x, y)
            yield _edges(self.fp[a], self.fp[b])

    def visited(self, fp: np.ndarray, size: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, n = np.argsort(size, kind="stable"), len(self.fp)
        both = Forest(n + len(fp))
        both.parent[:n] = self.forest.parent
        for x, y in self.near(size[order], marks[order], False):
            a, b = both.join(n + x, y)
            yield _edges(fp[order][np.array(a, np.int64) - n], self.fp[b])
        self.forest.parent = both.parent[:n]  # the smaller number is a root, so none leads to a visitor


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each shard; rows come by shard, its own nodes before visitors."""
    number, shard, own = None, None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        kinds = np.array(batch.column("shard"), np.int64) * 2 + ~np.array(batch.column("own"))
        heads = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
        marks = unpacked(batch.column("sketch"))
        fp, size = (np.array(batch.column(c), np.int64) for c in ("fp", "size"))
        for a, b in zip(heads[:-1], heads[1:]):
            at, visit = divmod(int(kinds[a]), 2)
            if own and (at != number or visit):
                shard = Shard(*(np.concatenate(x) for x in zip(*own)))
                own = []
                yield from shard.among()
            part = (fp[a:b], size[a:b], marks[a:b])
            if not visit:
                number, shard = at, None
                own.append(part)
            elif at == number and shard is not None:
                yield from shard.visited(*part)
    if own:
        yield from Shard(*(np.concatenate(x) for x in zip(*own))).among()


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) by fingerprints; their components hold all near copies."""
    ring = F.floor(F.log("size") / float(np.log(1 / SIMILARITY))).cast("int")
    ringed = nodes.where("size > 0").select("fp", "size", "sketch", ring.alias("ring"))
    counts = {r.ring: r.n for r in ringed.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).collect()}  # some dozens
    depths = {r: max(0, int(np.ceil(np.log2(n / SHARD)))) for r, n in counts.items()}
    deep = {r: counts[r] for r, depth in depths.items() if depth}
    sample: dict[int, list] = {r: [] for r in counts}
    if deep:
        of = F.create_map(*[F.lit(x) for item in deep.items() for x in item])
        taken = ringed.where(F.col("ring").isin(list(deep))).where(few(F.col("fp"), SAMPLE, F.element_at(of, F.col("ring"))))
        for r in taken.select("ring", "sketch").orderBy(F.xxhash64("fp")).collect():
            sample[r.ring] += [r.sketch][: SAMPLE - len(sample[r.ring])]
    trees = {r: Tree(unpacked(pa.array(sample[r], pa.binary())), depth, REACH) for r, depth in depths.items()}
    placed = ringed.mapInArrow(_place(nodes.sparkSession.sparkContext.broadcast(trees)), SHARDS)
    met = placed.repartition("shard").sortWithinPartitions("shard", F.desc("own"))
    return written(met.mapInArrow(_near, "a bigint, b bigint").distinct(), "near")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = Rolling(SEED)
    for batch in slices(batches, most=1 << 20):
        hashes, heads, _ = shingles(*buffer(batch.column("text")), rolling)
        parts = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(heads[:-1], heads[1:])]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts)))], ["fp", "grams"])


def _exact(group: pa.Table) -> pa.Table:
    """Links of the sets of a group to the smallest node from which similar sets lead to them."""
    fps = np.array(group.column("fp").combine_chunks(), np.int64)
    _, kept = np.unique(fps, return_index=True)  # rising, and repeated rows once
    grams = group.column("grams").combine_chunks()
    grams = (grams.combine_chunks() if isinstance(grams, pa.ChunkedArray) else grams).take(pa.array(kept))
    fps, sizes = fps[kept], np.array(grams.value_lengths(), np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, gram = np.unique(np.array(grams.flatten(), np.int64), return_inverse=True)
    holder = np.repeat(np.arange(len(fps)), sizes)[np.argsort(gram, kind="stable")]
    heads = np.concatenate([[0], np.cumsum(np.bincount(gram))]).astype(np.int64)
    first = np.full(len(fps), -1)
    for start in range(len(fps)):
        if first[start] >= 0:
            continue
        first[start], queue = start, [start]
        while queue:
            u = queue.pop()
            flat, _ = spans(heads, gram[bounds[u] : bounds[u + 1]])
            both = np.bincount(holder[flat], minlength=len(fps))
            near = np.flatnonzero((first < 0) & (both >= SIMILARITY * (sizes[u] + sizes - both) - 1e-9))
            first[near] = start
            queue += near.tolist()
    linked = np.flatnonzero(first != np.arange(len(fps)))
    return pa.table({"a": pa.array(fps[linked]), "b": pa.array(fps[first[linked]])})


def exact(found: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of the nodes of each component (fp, root) whose whole shingle sets are similar."""
    members = written(found.join(nodes.select("fp", "k1", "k2", "size"), "fp"), "members")
    sums = members.groupBy("root").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.greatest(F.col("total") / PACK, F.col("n") / BUCKET)).cast("int")
    sums = written(sums.select("root", "total", blocks.alias("blocks")), "sums")
    packs = max(1, (sums.where("blocks = 1").agg(F.sum("total")).first()[0] or 0) // PACK)
    dealt = members.join(sums, "root").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # A block meets every other block of its component, itself included, once; small components share a pack.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("fp", "k1", "k2", "root", "blocks", "block", other.alias("other"))
    large = F.col("blocks") > 1
    dealt = dealt.select(
        "fp",
        "k1",
        "k2",
        F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(packs))).alias("pack"),
        F.when(large, F.least("block", "other")).otherwise(F.lit(-1)).alias("one"),
        F.when(large, F.greatest("block", "other")).otherwise(F.lit(-1)).alias("two"),
    )
    dealt = written(dealt, "dealt")
    asked = written(dealt.select("k1", "k2", "fp").distinct(), "asked")
    # The hint keeps the plan one and the same at every size, and what it needs of disk in proportion.
    sets = written(docs.select("k1", "k2", "text").join(asked.hint("merge"), ["k1", "k2"]).select("fp", "text").mapInArrow(_sets, "fp bigint, grams array<bigint>"), "sets")
    meeting = dealt.select("fp", "pack", "one", "two").join(sets, "fp")
    return written(meeting.groupBy("pack", "one", "two").applyInArrow(_exact, "a bigint, b bigint").distinct(), "exact")


def named(links: DataFrame) -> DataFrame:
    """(fp, root) of all members of the links' components, the root itself among them."""
    roots = components(links)
    own = roots.select(F.col("root").alias("fp"), "root").distinct()
    return written(roots.select(F.col("node").alias("fp"), "root").unionByName(own).distinct(), "named")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of every group of near copies with the smallest doc_id; of repeated rows one."""
    keys = fresh(docs, "k1", "k2", "goes")
    keyed = docs.withColumns({keys[0]: F.xxhash64("doc_id", "text"), keys[1]: F.hash("text")})
    texts = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(keys[0]).alias("k1"), F.col(keys[1]).alias("k2"), "text")
    prints = written(texts.mapInArrow(_sketches, PRINTS), "prints")
    narrow = prints.select("fp", "doc_id", "k1", "k2")
    same = [F.first(c).alias(c) for c in ("size", "sketch")]  # equal for all rows of a node
    nodes = prints.groupBy("fp").agg(F.min(F.struct("k1", "k2")).alias("m"), *same)
    nodes = written(nodes.select("fp", "m.*", "size", "sketch"), "nodes")
    found = named(exact(named(candidates(nodes)), nodes, texts))
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    # Copies first, so that no hot key is joined.
    lowest = narrow.groupBy("fp").agg(F.min(member).alias("m"))
    lowest = lowest.join(found, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("m").alias("m"))
    kept = written(lowest.select("m.k1", "m.k2"), "kept")
    rows = narrow.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    goes = rows.join(kept.withColumn("stays", F.lit(True)), ["k1", "k2"], "left").where("stays is null or n > 1")
    goes = written(goes.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), F.col("stays").isNull().alias(keys[2])), "goes")
    marked = keyed.join(goes.hint("merge"), keys[:2], "left")
    once = marked.where(F.col(keys[2]).isNull()).select(*docs.columns)
    again = goes.where(~F.col(keys[2]))
    if again.isEmpty():
        return once
    repeated = marked.where(~F.col(keys[2])).dropDuplicates(keys[:2]).select(*docs.columns)
    return once.unionByName(repeated)
