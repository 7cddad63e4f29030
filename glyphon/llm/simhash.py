"""SimHash near-duplicates by vantage-point trees.

Shells around one vantage point can't shard 64-bit fingerprints: distances of unlike texts
gather around 32, so most points lie within the radius of a shell's edge and would go to
both sides (figures in the README). So the fingerprints are dealt out by Hamming distance
zero in parts of their bits: with the bits in ``m`` blocks, two fingerprints that differ
in at most r bits agree in some m - r blocks, so for every choice of m - r blocks there
are shards of fingerprints at distance zero in those blocks, and every close pair meets
in one. Blocks are as few as leave shards of about ``MEET`` unlike fingerprints, and each
shard is searched by a vantage-point tree, whose leaves hold up to ``LEAF``; a shard too
large for a task is cut into blocks of which every pair is searched. All close pairs are
found.

Distinct fingerprints are compared, not documents; each search hands on a spanning
forest of its links, which has the same components as all its links.

Cases: a null or empty text has fingerprint zero and links like any other; null ids
take part, and a group of nothing but null ids has a null component; repeated rows give
repeated rows; an empty table gives an empty one; further input columns are not read.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, stash

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one shard that one task searches; larger shards are cut.
SHARD = 20_000
#: Unlike fingerprints that meet in a shard, about; more copies of each fingerprint would be dealt out for fewer.
MEET = 512
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit set: set in over half of the hashes of the word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))), ">u8").astype(np.uint64)
    n = len(h)
    # eight counters of a byte in each word, summed before they can overflow
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = h
    padded = padded.reshape(-1, 255)
    out = 0
    for k in range(8):
        sums = ((padded >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
        lanes = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for lane in np.flatnonzero(2 * lanes > n).tolist():
            out |= 1 << (8 * lane + k)
    return out


class VantageTree:
    """Exact search within a Hamming radius. Children are the near and the far half around
    the median distance from a vantage point; the triangle bound says which to enter."""

    LEAF = 16

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray) -> int:
        stack, self.nodes = [(at, None, None)], []
        while stack:
            at, parent, side = stack.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = me
            if len(at) <= self.LEAF:
                self.nodes.append(["leaf", at])
                continue
            vantage = self.points[at[0]]
            d = np.bitwise_count(self.points[at] ^ vantage)
            mu = int(np.median(d))
            near, far = at[d <= mu], at[d > mu]
            if not len(far):  # many at the median and none beyond: cut below it
                mu = int(d.max()) - 1
                near, far = at[d <= mu], at[d > mu]
            if not len(near) or not len(far):
                self.nodes.append(["leaf", at])
                continue
            self.nodes.append([vantage, mu, None, None])
            stack += [(near, me, 2), (far, me, 3)]
        return 0

    def within(self, queries: np.ndarray, radius: int):
        """Yields index arrays (of queries, of points) of all pairs within the radius."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            k, q = stack.pop()
            if not len(q):
                continue
            node = self.nodes[k]
            if node[0] is not None and isinstance(node[0], str):
                for a in range(0, len(q), 4096):
                    part = q[a : a + 4096]
                    x, y = np.nonzero(np.bitwise_count(queries[part][:, None] ^ self.points[node[1]][None, :]) <= radius)
                    yield part[x], node[1][y]
            else:
                vantage, mu, near, far = node
                d = np.bitwise_count(queries[q] ^ vantage).astype(np.int64)
                stack += [(near, q[d - radius <= mu]), (far, q[d + radius > mu])]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (smallest index reachable) after joining a with b; whole arrays at a time."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def spanning_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, first point) by index, which join what the pairs of distinct points within the radius join."""
    label = np.arange(len(points))
    for x, y in VantageTree(points).within(points, radius):
        label = _joined(label, x, y)
    at = np.flatnonzero(label != np.arange(len(points)))
    return at, label[at]


def block_masks(n: int, radius: int, slack: int = 0) -> list[int]:
    """Bit masks of the choices of blocks: as many bits as it takes to tell n fingerprints
    apart, and ``slack`` more, so that few of them meet by chance."""
    for m in range(radius + 1, 65):
        widths = [64 * (k + 1) // m - 64 * k // m for k in range(m)]
        if sum(sorted(widths)[: m - radius]) >= min(n.bit_length() + slack, 40 + slack) or m == radius + 6:
            break
    edges = np.concatenate([[0], np.cumsum(widths)]).tolist()
    blocks = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(m)]
    return [sum(c) for c in combinations(blocks, m - radius)]


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp``: their components are those of all pairs within the radius."""
    n = prints.count()
    masks = block_masks(max(1, n // MEET), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(signed)]))
    dealt = prints.select("fp", keys.alias("key")).select("key.choice", "key.value", "fp")
    # shards too large for a task: rare, and found by a count that is aggregated before the shuffle
    large = stash(dealt.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard), "large-shards")
    dealt = dealt.withColumn("part", F.lit(0)).withColumn("other", F.lit(0))
    if not large.isEmpty():
        cuts = F.ceil(F.col("n") / (shard // 2)).cast("int")
        cut = dealt.drop("part", "other").join(large, ["choice", "value"]).withColumn("cuts", cuts).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
        pairs = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
        cut = cut.withColumn("k", pairs).select("choice", "value", "fp", (F.least("mine", "k") + 1).alias("part"), (F.greatest("mine", "k") + 1).alias("other"))
        dealt = dealt.join(large, ["choice", "value"], "left_anti").unionByName(cut)
    key = ["choice", "value", "part", "other"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "fp")

    def search(batches):
        carry: pa.RecordBatch | None = None

        def links(cols: list[np.ndarray]):
            fp = cols[4].view(np.uint64)
            same = np.ones(len(fp) - 1, bool)
            for c in cols[:4]:
                same &= c[1:] == c[:-1]
            edges = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(fp)]])
            sizes = np.diff(edges)
            out_a, out_b = [], []
            # small shards: every point against its d-th next, for all shards at once
            small = np.repeat(sizes <= VantageTree.LEAF, sizes)
            group = np.repeat(np.arange(len(sizes)), sizes)
            for d in range(1, int(sizes[sizes <= VantageTree.LEAF].max(initial=0))):
                near = np.flatnonzero((group[d:] == group[:-d]) & small[d:] & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius))
                out_a.append(cols[4][near])
                out_b.append(cols[4][near + d])
            for k in np.flatnonzero(sizes > VantageTree.LEAF).tolist():
                points = np.unique(fp[edges[k] : edges[k + 1]])
                x, y = spanning_links(points, radius)
                out_a.append(points[x].view(np.int64))
                out_b.append(points[y].view(np.int64))
            a, b = np.concatenate(out_a or [np.zeros(0, np.int64)]), np.concatenate(out_b or [np.zeros(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        for batch in batches:
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            # the last shard may go on in the next batch
            last = np.ones(len(cols[0]), bool)
            for c in cols[:4]:
                last &= c == c[-1]
            begin = len(last) - int(last.sum())
            carry = batch.slice(begin)
            if begin:
                yield links([c[:begin] for c in cols])
        if carry is not None:
            yield links([c.to_numpy(zero_copy_only=False) for c in carry.columns])

    return arrow_map(dealt.select(*key, "fp"), search, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable), a row for each of ``docs``.

    The texts go no further than the fingerprints; join them again by id where needed.
    """

    def sign(batches):
        for batch in batches:
            fp = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = stash(arrow_map(docs.select(F.col(id_col).cast("long"), text_col), sign, "doc_id long, fp long"), "fingerprints")
    prints = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    links = stash(fingerprint_links(prints.select("fp"), radius).distinct(), "fingerprint-links")
    roots = connected_components(links)
    classes = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = stash(classes.join(lows, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_query(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
