"""Benchmark decontamination by q-gram lemma filtering.

Items are cut into pieces of ``PIECE`` characters, begun ``STRIDE`` characters apart, so
that every passage of ``PIECE + STRIDE - 1`` characters of an item holds a whole piece;
an item of up to ``PIECE`` characters is one piece. A piece of n characters and a
stretch of text within k edits of it share at least n - q + 1 - q * k of their q-grams,
on diagonals that lie within k of each other. Shared q-grams are counted in diagonal
bands that overlap by half, bands that reach the bound are kept, and a banded alignment
of the piece with the text there decides.

Texts are compared by letters and digits, lower-cased, with anything else as one space.
The benchmark is taken to the executors in blocks of a bounded number of characters, and
one pass over the texts compares stretches of them with all blocks.

Cases: a null or empty text or item matches nothing; items of fewer than ``Q`` characters
hold no q-gram, and are looked up as they are, between spaces or ends; null ids are carried as they are; repeated
rows give repeated rows; empty tables give an empty result; ``drop_leaks`` carries all
input columns.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_map, pack, unpack

Q, PIECE, STRIDE = 12, 60, 30
#: Edits allowed for each character of a piece.
EDIT_RATE = 0.05
#: Characters of benchmark that go to the executors at once, and of text looked at together.
BLOCK, STRIP = 8_000_000, 1_000_000
#: Bytes of texts that are held while they are compared with one block after the other.
STRETCH = 64 << 20
_TOP = 0x3000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Folded code point and 5-bit code of each code point below _TOP."""
    fold, code = np.full(_TOP, 32, np.uint32), np.zeros(_TOP, np.uint64)
    for c in range(_TOP):
        if chr(c).isalnum():
            low = chr(c).lower()
            fold[c] = f = ord(low) if len(low) == 1 and ord(low) < _TOP else c
            code[c] = f - 96 if 97 <= f <= 122 else 27 if 48 <= f <= 57 else 28 + f % 4
    return fold, code


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with runs of other characters as one space, and their places in ``text``."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    fold = _tables()[0]
    out = np.where(raw < _TOP, fold[np.minimum(raw, _TOP - 1)], raw)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    at = np.flatnonzero(keep)
    return out[at], at


def qgrams(folded: np.ndarray) -> np.ndarray:
    """Twelve 5-bit codes from each place on."""
    if len(folded) < Q:
        return np.zeros(0, np.uint64)
    x = np.where(folded < _TOP, _tables()[1][np.minimum(folded, _TOP - 1)], 28 + folded % 4).astype(np.uint64)
    x1 = (x[:-1] << np.uint64(5)) | x[1:]
    x2 = (x1[:-2] << np.uint64(10)) | x1[2:]
    x4 = (x2[:-4] << np.uint64(20)) | x2[4:]
    return (x4[:-4] << np.uint64(20)) | x2[8 : len(x4) + 4]


def band_distance(piece: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, end) of the stretch of ``text`` closest to ``piece``; the shortest such end.

    Rows of the alignment are kept by diagonal, and the diagonals are those of ``text``
    against the start of ``piece``: a band of len(text) - len(piece) + 1 and its margins.
    """
    n, width = len(piece), len(text) + 1
    row = np.zeros(width, np.int64)  # a stretch may begin anywhere
    places = np.arange(width)
    for i in range(n):
        step = np.empty(width, np.int64)
        step[0] = i + 1
        np.minimum(row[:-1] + (text != piece[i]), row[1:] + 1, out=step[1:])
        row = np.minimum.accumulate(step - places) + places
    end = int(row.argmin())
    return int(row[end]), end


def _index(text: np.ndarray, piece: np.ndarray) -> int:
    """Where ``piece`` stands in ``text`` as it is, or -1."""
    data, part = text.tobytes(), piece.tobytes()
    at = data.find(part)
    while at > 0 and at % 4:
        at = data.find(part, at + 1)
    return at // 4 if at >= 0 else -1


class LeakFinder:
    """The pieces of a block of items and the index of their q-grams."""

    def __init__(self, items: list[tuple[object, str]]):
        self.pieces: list[np.ndarray] = []
        self.item: list[tuple[object, int]] = []
        self.short: list[tuple[object, str]] = []
        grams, piece_of, place = [], [], []
        for item, text in items:
            folded, _ = normalised((text or "").strip())
            if len(folded) < Q:
                if (folded != 32).any():
                    self.short.append((item, f" {''.join(map(chr, folded)).strip()} "))
                continue
            starts = [*range(0, max(1, len(folded) - PIECE), STRIDE), max(0, len(folded) - PIECE)]
            cuts = sorted({(a, min(a + PIECE, len(folded))) for a in starts})
            for k, (a, b) in enumerate(cuts):
                g = qgrams(folded[a:b])
                grams.append(g)
                piece_of.append(np.full(len(g), len(self.pieces)))
                place.append(np.arange(len(g)))
                self.pieces.append(folded[a:b])
                self.item.append((item, k))
        lengths = np.array([len(p) for p in self.pieces], np.int64)
        # no more edits than the lemma bears, which matters for items shorter than a piece
        self.budget = np.minimum((lengths * EDIT_RATE).astype(np.int64), (lengths - Q) // Q)
        self.bound = np.maximum(1, lengths - Q + 1 - Q * self.budget)
        g = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(g, kind="stable")
        self.grams, self.first = np.unique(g[order], return_index=True)
        self.count = np.diff(np.concatenate([self.first, [len(g)]]))
        self.piece_of = np.concatenate([*piece_of, np.zeros(0, np.int64)])[order]
        self.place = np.concatenate([*place, np.zeros(0, np.int64)])[order]
        self.known = np.zeros(1 << _BITS, bool)
        self.known[(self.grams * _MIX) >> np.uint64(64 - _BITS)] = True

    def find(self, texts: list[str | None]) -> list[tuple[int, object, int, int, int, int]]:
        """(row, item, piece, start, end, edits), offsets in code points of the row's text."""
        out, begin, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= STRIP:
                out += self._strip(texts[begin : k + 1], begin)
                begin, size = k + 1, 0
        return out + self._strip(texts[begin:], begin)

    def _short(self, parts, base):
        """Items without a q-gram, where they stand as they are."""
        out = []
        for row, (folded, places) in enumerate(parts):
            text = f" {folded.astype('<u4').tobytes().decode('utf-32-le', 'surrogatepass')} "
            for item, part in self.short:
                at = text.find(part)
                while at >= 0:
                    out.append((base + row, item, 0, int(places[at]), int(places[at + len(part) - 3]) + 1, 0))
                    at = text.find(part, at + 1)
        return out

    def _strip(self, texts, base):
        if not texts or not (len(self.grams) or self.short):
            return []
        parts = [normalised(t or "") for t in texts]
        if self.short:
            return self._short(parts, base) + self._long(texts, parts, base)
        return self._long(texts, parts, base)

    def _long(self, texts, parts, base):
        if not len(self.grams):
            return []
        ends = np.cumsum([len(f) for f, _ in parts])
        whole = np.concatenate([f for f, _ in parts])
        g = qgrams(whole)
        at = np.flatnonzero(self.known[(g * _MIX) >> np.uint64(64 - _BITS)])
        where = np.searchsorted(self.grams, g[at])
        where[where == len(self.grams)] = 0
        true = self.grams[where] == g[at]
        at, where = at[true], where[true]
        many = self.count[where]
        post = np.repeat(self.first[where] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        piece = self.piece_of[post]
        diagonal = np.repeat(at, many) - self.place[post]
        step = self.budget[piece] + 1
        band = np.floor_divide(diagonal, step)
        # bands of two steps, each begun one step after the last
        key = np.concatenate([piece << 40 | (band + 1), piece << 40 | band + 2]) if len(piece) else np.zeros(0, np.int64)
        keys, hits = np.unique(key, return_counts=True)
        enough = hits >= self.bound[keys >> 40] if len(keys) else np.zeros(0, bool)
        out, done, limits = [], {}, ends.tolist()
        for k in keys[enough].tolist():
            p, b = k >> 40, (k & ((1 << 40) - 1)) - 2
            step, n, budget = int(self.budget[p]) + 1, len(self.pieces[p]), int(self.budget[p])
            low, high = b * step - budget, (b + 2) * step + n + budget
            # the text in which most of the stretch lies
            row = min(bisect_right(limits, max(0, b * step + step + n // 2)), len(texts) - 1)
            begin, end = int(ends[row]) - len(parts[row][0]), int(ends[row])
            low, high = max(low, begin), min(high, end)
            # the band before may have found it: its start is on a diagonal of this one
            if any(b * step - budget <= a <= (b + 2) * step + budget for a in done.get((p, row), ())):
                continue
            window, piece = whole[low:high], self.pieces[p]
            exact = _index(window, piece)
            if exact >= 0:
                edits, back, stop = 0, n, exact + n
            else:
                edits, stop = band_distance(piece, window)
                if edits > budget:
                    continue
                _, back = band_distance(piece[::-1], window[:stop][::-1])
            places = parts[row][1]
            a, z = low + stop - back - begin, low + stop - begin
            out.append((base + row, *self.item[p], int(places[a]), int(places[z - 1]) + 1, edits))
            done.setdefault((p, row), []).append(low + stop - back)
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list:
    """(name, items) broadcasts, each of a bounded part of the benchmark; the name is random, so
    that a worker never takes one block's index for another's."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n, out = max(1, -(-chars // BLOCK)), []
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        rows = sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        out.append(spark.sparkContext.broadcast((uuid.uuid4().hex, rows)))
    return out


_FINDERS: dict[str, LeakFinder] = {}


def _finder(block) -> LeakFinder:
    """The index of a broadcast block. A worker holds one at a time, however many blocks there are."""
    name, items = block.value
    if name not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[name] = LeakFinder(items)
    return _FINDERS[name]


def _found(blocks: list, batches, column: str):
    """(batch, leaks) for each batch, over all blocks: an index is made once for a stretch of texts, not once a text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if len(blocks) == 1 or size >= STRETCH:
            yield from _over_blocks(blocks, held, column)
            held, size = [], 0
    yield from _over_blocks(blocks, held, column)


def _over_blocks(blocks: list, held: list, column: str):
    leaks = [[] for _ in held]
    if held:
        for block in blocks:
            for batch, out in zip(held, leaks, strict=True):
                out += _finder(block).find(batch.column(column).to_pylist())
    return zip(held, leaks, strict=True)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, piece, start, end, edits: each piece of an item found in each text; one pass over the texts."""
    blocks = _blocks(benchmark, "item_id", "text")

    def look(batches):
        for batch, leaks in _found(blocks, batches, "_text"):
            ids = batch.column(0).to_pylist()
            rows = [(ids[r], *rest) for r, *rest in leaks]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "piece", "start", "end", "edits"])

    return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col).alias("_text")), look, "doc_id long, item_id long, piece int, start long, end long, edits int")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a piece of an item is found; one pass, no shuffle."""
    blocks = _blocks(benchmark, "item_id", "text")
    rows = pack(docs).withColumn("_text", F.col("_row")[text_col])

    def keep(batches):
        for batch, leaks in _found(blocks, batches, "_text"):
            bad = {r for r, *_ in leaks}
            yield batch.select(["_row"]).filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

    return unpack(arrow_map(rows, keep, StructType([rows.schema["_row"]])), docs.columns, [])


def op5_query(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
