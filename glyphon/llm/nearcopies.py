"""Near copies by exact shingle Jaccard similarity.

Texts are compared by the sets of their word shingles. Candidates are the links of the
SimHash search and all that meet in a MinHash band: 64 bits can't tell a similarity of
0.8 (some ten differing bits) from unlike texts, but of 40 bands of five minima a pair
of similarity 0.8 misses all with a chance of 1.3e-7, and a closer pair more rarely
still. Every candidate is verified by the Jaccard similarity of the two sets before it
is a link, and links make the components.

A band's bucket doesn't give all its pairs: each text is held against the bucket's
first. What those links join is known then, and only texts apart from the first are held
against the rest. This leaves the same components.

Cases: texts of one shingle set are one node; a null or empty text has the empty set,
which equals itself only; texts of fewer words than a shingle are one shingle; repeated
rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, connected_components, stash
from .simhash import RADIUS, SEED, fingerprint, fingerprint_links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
#: Shingles whose minima are taken at once.
_CHUNK = 512
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the words are those of ``fingerprint``."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))), ">u8").astype(np.uint64))


def band_values(hashes: np.ndarray) -> np.ndarray:
    """One value for each band, of the minima of its rows; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(hashes), _CHUNK):
        np.minimum(least, (_FACTORS[:, None] * low[None, a : a + _CHUNK] + high[None, a : a + _CHUNK]).min(axis=1), out=least)
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th (hash of the text), node (hash of the set), n (its size), fp, bands."""

    def sign(batches):
        for batch in batches:
            nodes, sizes, prints, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text or "", shingle)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                prints.append(fingerprint(text or "", shingle))
                bands.append(band_values(s))
            unsigned = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            arrays = [batch.column(0), batch.column(1), unsigned[0], pa.array(sizes, pa.int64()), unsigned[1], pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "node", "n", "fp", "bands"])

    return arrow_map(docs, sign, "doc_id long, th long, node long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, hashes of the ``wanted`` nodes (node, th), from one text of each."""
    texts = docs.join(wanted, "th").dropDuplicates(["node"]).select("node", "text")

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t or "", shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"])

    return arrow_map(texts, sets, "node long, hashes array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    pairs = stash(pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-candidates")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stash(_sets(docs, nodes.join(wanted, "node").select("node", "th"), shingle), f"{name}-sets")
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "hashes": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "hashes": "y"}), "b")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    return stash(both.where(F.col("common") + 1e-9 >= similarity * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b"), f"{name}-links")


def near_copy_components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (smallest id reachable over pairs of the similarity), a row for each of ``docs``."""
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = stash(_signed(docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), text_col), shingle), "near-rows")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("th").alias("th"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = stash(nodes, "near-nodes")
    # SimHash: nodes of one fingerprint, and one of each for a link
    prints = stash(nodes.groupBy("fp").agg(F.min("node").alias("head")), "near-prints")
    links = fingerprint_links(prints.select("fp"), radius).distinct()
    far = links.join(prints.select(F.col("fp").alias("a"), F.col("head").alias("p")), "a").join(prints.select(F.col("fp").alias("b"), F.col("head").alias("q")), "b")
    hashed = nodes.join(prints, "fp").select(F.col("head").alias("a"), F.col("node").alias("b")).union(far.select("p", "q"))

    dealt = nodes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    heads = dealt.groupBy("band", "value").agg(F.min(F.struct("node", "n")).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = stash(dealt.join(heads, ["band", "value"]).select("band", "value", "node", "n", F.col("h.node").alias("head"), F.col("h.n").alias("head_n"), "size"), "near-buckets")

    def fits(a: Column, b: Column) -> Column:
        return F.least(a, b) + 1e-9 >= similarity * F.greatest(a, b)

    first = dealt.where((F.col("node") != F.col("head")) & fits(F.col("n"), F.col("head_n"))).select(F.col("head").alias("a"), F.col("node").alias("b"))
    first = _verified(hashed.union(first), texts, nodes, shingle, similarity, "near-heads")
    known = stash(connected_components(first, "near-known"), "near-known-roots")
    tagged = dealt.where("size > 2").join(known, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
    of_head = tagged.where("node = head").select("band", "value", F.col("group").alias("head_group"))
    tagged = stash(tagged.join(of_head, ["band", "value"]).select("band", "value", "node", "n", "head", "group", (F.col("group") != F.col("head_group")).alias("apart")), "near-tagged")
    x, y = tagged.where("apart AND node != head").alias("x"), tagged.where("node != head").alias("y")
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.group") != F.col("y.group"))
    more = x.join(y, meet & fits(F.col("x.n"), F.col("y.n"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = _verified(more, texts, nodes, shingle, similarity, "near-others")

    roots = connected_components(first.union(more), "near-groups")
    classes = nodes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = stash(classes.join(lows, "root").select("node", "component_id"), "near-classes")
    return rows.join(classes, "node").select("doc_id", "component_id")
