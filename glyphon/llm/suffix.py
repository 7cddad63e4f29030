"""Exact substring dedup with a logarithmic family of sparse suffix arrays.

The rule: a byte goes if a string of ``length`` bytes covers it that also starts in a
document of a smaller id. An array of all suffixes would be many times the corpus, so
the arrays are sparse. Each window of ``length`` bytes is represented by the smallest
hash of the ``k``-byte strings in it, which depends on the window's content alone: equal
windows have equal representatives, and consecutive windows that share one form a
block. Only blocks whose representative several documents have enter the arrays.

1. Texts are gathered into chunks, each a row with an id of its own.
2. Each chunk hands on the sorted array of its distinct representatives, cut by ranges
   of value. Each range tells which of them more than one document has
   (``RepresentativeLevels``): a filter that loses nothing.
3. Only blocks of these are sent on, each content once for each chunk. Blocks of one
   representative that are all alike are a match as a whole. The others are taken in
   parts of whole representatives, since windows of unlike ones are unlike, and a part
   is cut into batches of an index family (``SuffixFamily``): a batch gets a suffix
   array, levels of like size are merge-scanned for long matches and become one, and in
   the end every window knows the smallest id that has it. So a task holds the arrays of
   one part, not of its whole range.
4. Chunks take these answers and remove what they cover.

A representative that very many documents share costs a row a chunk, not a row a
document, because chunks gather first. Windows are judged on the input, so the order of
removal doesn't matter.

Cases: a null or empty text has no bytes and nothing removed; a null id counts as larger
than any; rows that share an id don't remove each other's bytes; repeated rows give
repeated rows; an empty table gives an empty one; further input columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stash, trim

LENGTH, K = 50, 24
#: Bytes of text in a chunk.
CHUNK = 2 << 20
#: Representatives that one range of values holds, about; a chunk has some 150,000.
PER_RANGE = 1_000_000
#: Windows in a batch of the index family, about, and in all batches of a family, if no one representative has more.
BATCH, PART = 1 << 18, 1 << 20
#: Windows whose representatives are computed at once.
PIECE = 1 << 17
_NULL_ID = (1 << 63) - 1


class RepresentativeLevels:
    """Sorted arrays of representatives, each level at least twice the one below it. They tell
    which representatives several batches have, so that only those blocks enter suffix arrays."""

    def __init__(self):
        self.levels: list[np.ndarray] = []
        self.hits: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> None:
        """``batch``: a sorted array of distinct values. What is known already is a hit."""
        for level in self.levels:
            at = np.searchsorted(level, batch)
            at[at == len(level)] = 0
            if len(level):
                found = batch[level[at] == batch]
                if len(found):
                    self.hits.append(found)
        self.levels.append(batch)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            merged = np.sort(np.concatenate(self.levels[-2:]), kind="stable")  # merges two sorted runs
            self.levels[-2:] = [merged[np.concatenate([[True], merged[1:] != merged[:-1]])]]

    def shared(self) -> np.ndarray:
        return np.unique(np.concatenate(self.hits)) if self.hits else np.zeros(0, np.uint64)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that orders like them; zeros follow the text."""
    x = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        x = (x[:-step] << np.uint64(shift)) | x[step:]
    return x[: len(text)]


class SuffixArray:
    """The places of a text in the order of their suffixes, by their first ``length`` bytes; of
    places that agree in all of these one stays, with the smallest id of all."""

    def __init__(self, words: np.ndarray, places: np.ndarray, low: np.ndarray):
        self.words, self.places, self.low = words, places, low

    @classmethod
    def of(cls, text: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[SuffixArray, np.ndarray]:
        """The array of the suffixes that begin at ``at``, and the entry of each. Built by prefix
        doubling: the rank of 2n bytes is that of the pair of ranks of n bytes."""
        words = _words(np.concatenate([text, np.zeros(length, np.uint8)]))
        rank, size = np.unique(words, return_inverse=True)[1].astype(np.int64), 8
        while 2 * size <= length:
            rank = np.unique(rank[:-size] * (int(rank.max()) + 1) + rank[size:], return_inverse=True)[1].astype(np.int64)
            size *= 2
        pair = rank[at] * (int(rank.max()) + 1) + rank[at + length - size]
        distinct, entry = np.unique(pair, return_inverse=True)
        places, low = np.empty(len(distinct), np.int64), np.full(len(distinct), _NULL_ID)
        places[entry] = at  # any one of those alike
        np.minimum.at(low, entry, ids)
        return cls(words, places, low), entry

    def __len__(self) -> int:
        return len(self.places)

    def lower_bound(self, other: SuffixArray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of ``other``: the first entry here that isn't smaller, and whether it has the same ``length`` bytes."""
        first, wanted = self.words[self.places], other.words[other.places]
        lo, hi = np.searchsorted(first, wanted, side="left"), np.searchsorted(first, wanted, side="right")
        same = np.zeros(len(other), bool)
        steps = [*range(8, length - 8, 8), length - 8]
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            mine, theirs = self.places[mid], other.places[open_]
            less, tied = np.zeros(len(open_), bool), np.arange(len(open_))
            for step in steps:  # by common prefixes: the next eight bytes of those that agree so far
                x, y = self.words[mine[tied] + step], other.words[theirs[tied] + step]
                less[tied] = x < y
                tied = tied[x == y]
                if not len(tied):
                    break
            same[open_[tied]] = True
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo, same

    def merged(self, other: SuffixArray) -> tuple[SuffixArray, np.ndarray, np.ndarray]:
        """Both arrays as one, and the new entries of this one's and the other's entries. Suffixes
        in both are the long matches; they become one entry of the smaller id."""
        at, same = self.lower_bound(other)
        before = at[~same]
        to_mine = np.arange(len(self)) + np.searchsorted(before, np.arange(len(self)), side="right")
        to_other = np.empty(len(other), np.int64)
        to_other[~same] = before + np.arange(len(before))
        to_other[same] = to_mine[at[same]]
        n = len(self) + len(before)
        places, low = np.empty(n, np.int64), np.full(n, _NULL_ID)
        places[to_other] = other.places + len(self.words)
        places[to_mine] = self.places
        low[to_mine] = self.low
        low[to_other] = np.minimum(low[to_other], other.low)
        return SuffixArray(np.concatenate([self.words, other.words]), places, low), to_mine, to_other


class SuffixFamily:
    """Suffix arrays in levels, each at least twice the one after it: a new batch gets an
    array of its own, and while the last level isn't smaller than half of the one before,
    the two are merge-scanned for long matches and become one."""

    def __init__(self):
        self.levels: list[SuffixArray] = []
        #: For each level, the batches in it: (number, entry of each of the batch's windows).
        self.members: list[list[tuple[int, np.ndarray]]] = []
        self.count = 0

    def add(self, contents: list[bytes], ids: np.ndarray) -> None:
        """A batch: every window of ``LENGTH`` bytes of the contents, each of them in the document ``ids``."""
        sizes = np.array([len(c) for c in contents], np.int64)
        ends = np.cumsum(sizes)
        windows = sizes - LENGTH + 1
        at = np.arange(windows.sum()) + np.repeat(ends - sizes - (np.cumsum(windows) - windows), windows)
        array, entry = SuffixArray.of(np.frombuffer(b"".join(contents), np.uint8), at, np.repeat(ids, windows))
        self.levels.append(array)
        self.members.append([(self.count, entry)])
        self.count += 1
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            self._merge()

    def _merge(self) -> None:
        array, to_mine, to_other = self.levels[-2].merged(self.levels[-1])
        members = [(k, to[entry]) for part, to in ((self.members[-2], to_mine), (self.members[-1], to_other)) for k, entry in part]
        self.levels[-2:], self.members[-2:] = [array], [members]

    def lowest(self) -> np.ndarray:
        """For each window of all batches, in order: the smallest id that has it."""
        while len(self.levels) > 1:
            self._merge()
        return np.concatenate([self.levels[0].low[entry] for _, entry in sorted(self.members[0], key=lambda m: m[0])]) if self.levels else np.zeros(0, np.int64)


def representatives(buf: np.ndarray, length: int = LENGTH, k: int = K) -> np.ndarray:
    """The smallest hash of the k-byte strings in each window of ``length`` bytes."""
    n = len(buf) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    if n > PIECE:  # piece by piece, so that what stands between doesn't add up
        return np.concatenate([representatives(buf[a : a + PIECE + length - 1], length, k) for a in range(0, n, PIECE)])
    x = buf.astype(np.uint64)
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        x = x[:-step] | (x[step:] << np.uint64(shift))
    # x: the eight bytes from each place on; k is 24, three such words
    h = x[: len(buf) - k + 1] * np.uint64(0x9E3779B97F4A7C15)
    h += x[8 : len(buf) - k + 9] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h += x[16 : len(buf) - k + 17] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    size, width = 1, length - k + 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def blocks(data: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(representative, first window, windows, document) of each block of the texts that end at ``ends``."""
    buf = np.frombuffer(data, np.uint8)
    rep = representatives(buf, length)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ends)), ends - starts)[: len(rep)]
    inside = np.arange(len(rep)) + length <= ends[doc]
    at = np.flatnonzero(inside)
    if not len(at):
        return rep[:0], at, at, doc[:0]
    r, d = rep[at], doc[at]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (d[1:] != d[:-1])]))
    return r[new], at[new], np.diff(np.concatenate([new, [len(at)]])), d[new]


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """chunk, ids (packed), ends (packed), data (compressed)."""

    def gather(batches):
        import uuid

        ids, ends, parts, size = [], [], [], 0

        def row():
            arrays = [pa.array([uuid.uuid4().hex]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(ends, "<i8").tobytes()], pa.binary()), pa.array([zstandard.compress(b"".join(parts), 3)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", "ids", "ends", "data"])

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = (text or "").encode()
                ids.append(_NULL_ID if d is None else d)
                parts.append(x)
                size += len(x)
                ends.append(size)
                if size >= CHUNK:
                    yield row()
                    ids, ends, parts, size = [], [], [], 0
        if ids:
            yield row()

    # written once, so the random names stay what they are
    return stash(arrow_map(docs.select(F.col(id_col).cast("long"), text_col), gather, "chunk string, ids binary, ends binary, data binary"), "chunks")


def _text(data: bytes) -> bytes:
    """A chunk's text; compressed in its row, which is shuffled twice."""
    return zstandard.decompress(data)


def _range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _split(values: np.ndarray, ranges: int):
    """(range, slice) of a sorted array."""
    if not len(values):
        return
    r = _range_of(values, ranges)
    cuts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(r)], strict=True):
        yield int(r[a]), slice(a, b)


def _candidates(chunks: DataFrame, ranges: int) -> DataFrame:
    """chunk, shared: the representatives in it that more than one document has."""

    def arrays(batches):
        for batch in batches:
            for chunk, ids, ends, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rep, _, _, doc = blocks(_text(data), np.frombuffer(ends, "<i8"))
                owner = np.frombuffer(ids, "<i8")[doc]
                order = np.lexsort((owner, rep))
                rep, owner = rep[order], owner[order]
                twice = rep[1:][(rep[1:] == rep[:-1]) & (owner[1:] != owner[:-1])]
                rep = np.unique(rep)
                many = np.isin(rep, twice)
                out = list(_split(rep, ranges))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([chunk] * len(out), pa.string()), pa.array([rep[s].tobytes() for _, s in out], pa.binary()), pa.array([np.packbits(many[s]).tobytes() for _, s in out], pa.binary())], ["range", "chunk", "rep", "many"])

    def scan(key, batches):
        rows = [r for b in batches for r in zip(b.column("chunk").to_pylist(), b.column("rep").to_pylist(), b.column("many").to_pylist(), strict=True)]
        levels, local = RepresentativeLevels(), []
        for _, rep, many in sorted(rows):
            rep = np.frombuffer(rep, np.uint64)
            levels.add(rep)
            local.append(rep[np.unpackbits(np.frombuffer(many, np.uint8))[: len(rep)].astype(bool)])
        shared = np.union1d(levels.shared(), np.concatenate(local))
        for chunk, rep, _ in rows:
            rep = np.frombuffer(rep, np.uint64)
            at = np.minimum(np.searchsorted(shared, rep), max(0, len(shared) - 1))
            mine = rep[shared[at] == rep] if len(shared) else rep[:0]
            if len(mine):
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([mine.tobytes()], pa.binary())], ["chunk", "shared"])

    sorted_arrays = arrow_map(chunks, arrays, "range long, chunk string, rep binary, many binary")
    return sorted_arrays.groupBy("range").applyInArrow(_streamed(scan), "chunk string, shared binary")


def _streamed(fn):
    """For applyInArrow: the group's batches in, batches out."""

    def call(key, table):
        out = list(fn(key, table.to_batches()))
        trim()
        return pa.Table.from_batches(out) if out else _EMPTY[fn.__name__].slice(0, 0)

    return call


_EMPTY = {
    "scan": pa.table({"chunk": pa.array([], pa.string()), "shared": pa.array([], pa.binary())}),
    "compare": pa.table({"chunk": pa.array([], pa.string()), "answer": pa.array([], pa.binary())}),
}


def _shared_blocks(data: bytes, ends: bytes, ids: bytes, shared: list[bytes]):
    """The blocks of candidates, and the number of each one's content: (representative,
    first window, windows, owner, number), contents by number."""
    rep, at, n, doc = blocks(data, np.frombuffer(ends, "<i8"))
    wanted = np.frombuffer(b"".join(shared), np.uint64)
    keep = np.isin(rep, wanted)
    rep, at, n, owner = rep[keep], at[keep], n[keep], np.frombuffer(ids, "<i8")[doc[keep]]
    numbers: dict[bytes, int] = {}
    number = np.array([numbers.setdefault(data[a : a + m + LENGTH - 1], len(numbers)) for a, m in zip(at.tolist(), n.tolist(), strict=True)], np.int64)
    return rep, at, n, owner, number, list(numbers)


def _parts(rep: np.ndarray, windows: np.ndarray):
    """For each part of about ``PART`` windows: the edges of its representatives in the sorted ``rep``."""
    edges = np.concatenate([np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]])), [len(rep)]])
    before = np.concatenate([[0], np.cumsum(windows, dtype=np.int64)])[edges[:-1]] // PART
    first = [*np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])).tolist(), len(edges) - 1]
    for a, b in zip(first, first[1:]):
        yield edges[a : b + 1].tolist()


def _part_answers(order: np.ndarray, edges: list[int], text: bytes, cuts: np.ndarray, number: np.ndarray, low: np.ndarray, high: np.ndarray, where: np.ndarray):
    """(number of the chunk, runs) for the blocks ``order`` of the representatives between the ``edges``."""
    out, distinct, lowest, blocks_of, content_of = defaultdict(list), [], [], [], []
    for a, b in zip(edges, edges[1:]):
        group = order[a:b].tolist()
        first: dict[bytes, list[int]] = {}
        for i, x, y in zip(group, cuts[group].tolist(), cuts[order[a:b] + 1].tolist(), strict=True):
            first.setdefault(text[x:y], []).append(i)
        if len(first) == 1:  # one content: the match is the whole block
            d, c = int(low[group].min()), next(iter(first))
            for i in group:
                if d < high[i]:
                    out[int(where[i])].append((int(number[i]), len(c) - LENGTH + 1, d))
            continue
        for c, same in first.items():
            blocks_of += same
            content_of += [len(distinct)] * len(same)
            distinct.append(c)
            lowest.append(int(low[same].min()))
    for w, flat in out.items():
        yield w, np.array(flat, "<i8")
    if not distinct:
        return
    windows = np.array([len(c) - LENGTH + 1 for c in distinct], np.int64)
    batch = (np.cumsum(windows) - windows) // BATCH
    ends = [*np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]])).tolist(), len(distinct)]
    family, ids = SuffixFamily(), np.array(lowest, np.int64)
    for a, b in zip(ends, ends[1:]):
        family.add(distinct[a:b], ids[a:b])
    d = family.lowest()
    # runs of windows of one answer, each within a content
    begins = np.zeros(len(d), bool)
    begins[np.cumsum(windows) - windows] = True
    begins[1:] |= d[1:] != d[:-1]
    run = np.flatnonzero(begins)
    size, d = np.diff(np.concatenate([run, [len(d)]])), d[run]
    start = np.searchsorted(run, np.cumsum(windows) - windows)
    count = np.diff(np.concatenate([start, [len(run)]]))
    block, content = np.array(blocks_of, np.int64), np.array(content_of, np.int64)
    kept = np.minimum.reduceat(d, start)[content] < high[block]
    block, content = block[kept], content[kept]
    by = np.argsort(where[block], kind="stable")
    block, content = block[by], content[by]
    n = count[content]
    rows = np.repeat(start[content] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    flat = np.stack([np.repeat(number[block].astype(np.int64), n), size[rows], d[rows]], axis=1)
    of = np.repeat(where[block], n)
    new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(of)]):
        yield int(of[a]), flat[a:b]


def _answers(joined: DataFrame, ranges: int) -> DataFrame:
    """chunk, answer: packed (block number, windows, smallest id) runs where some id is smaller."""

    def send(batches):
        for batch in batches:
            for chunk, ids, ends, data, shared in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rep, _, _, owner, number, contents = _shared_blocks(_text(data), ends, ids, shared)
                low, high = np.full(len(contents), _NULL_ID), np.full(len(contents), -(1 << 63))
                np.minimum.at(low, number, owner)
                np.maximum.at(high, number, owner)
                of = np.zeros(len(contents), np.uint64)
                of[number] = rep
                order = np.argsort(of, kind="stable")
                sizes = np.array([len(c) for c in contents], np.int64)
                out = [[] for _ in range(7)]
                for r, s in _split(of[order], ranges):
                    o = order[s]
                    for column, v in zip(out, (r, chunk, of[o].tobytes(), zstandard.compress(o.astype(np.int32).tobytes()), zstandard.compress(np.concatenate([low[o], high[o] - low[o]]).tobytes()), zstandard.compress(sizes[o].astype(np.int32).tobytes()), zstandard.compress(b"".join([contents[i] for i in o.tolist()]), 1)), strict=True):
                        column.append(v)
                kinds = [pa.int64(), pa.string(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["range", "chunk", "rep", "number", "ids", "sizes", "contents"])

    def compare(key, batches):
        chunks, where, reps, numbers, lows, highs, sizes, texts = ([] for _ in range(8))
        for b in batches:
            for chunk, rep, number, ids, size, data in zip(*[b.column(c).to_pylist() for c in ("chunk", "rep", "number", "ids", "sizes", "contents")], strict=True):
                n = len(rep) // 8
                where.append(np.full(n, len(chunks), np.int32))
                chunks.append(chunk)
                reps.append(np.frombuffer(rep, np.uint64))
                numbers.append(np.frombuffer(zstandard.decompress(number), np.int32))
                both = np.frombuffer(zstandard.decompress(ids), np.int64)
                lows.append(both[:n])
                highs.append(both[n:] + both[:n])
                sizes.append(np.frombuffer(zstandard.decompress(size), np.int32))
                texts.append(zstandard.decompress(data))
        rep, number, low, high, where, sizes = map(np.concatenate, (reps, numbers, lows, highs, where, sizes))
        text = b"".join(texts)
        del reps, numbers, lows, highs, texts
        cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        order = np.argsort(rep, kind="stable")
        answers: dict[int, list[np.ndarray]] = {}
        for edges in _parts(rep[order], sizes[order] - LENGTH + 1):
            for w, flat in _part_answers(order, edges, text, cuts, number, low, high, where):
                answers.setdefault(w, []).append(flat)
        for w, parts in answers.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunks[w]]), pa.array([np.concatenate(parts).astype("<i8").tobytes()], pa.binary())], ["chunk", "answer"])

    sent = arrow_map(joined, send, "range long, chunk string, rep binary, number binary, ids binary, sizes binary, contents binary")
    return sent.groupBy("range").applyInArrow(_streamed(compare), "chunk string, answer binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans (removed [start, end)).

    ``ranges``: tasks of the index and of the comparison; by default as many as give each
    about ``PER_RANGE`` representatives.
    """
    chunks = _chunks(docs, id_col, text_col)
    if ranges is None:
        ranges = max(12, chunks.count() * 150_000 // PER_RANGE)
    shared = stash(_candidates(chunks, ranges).groupBy("chunk").agg(F.collect_list("shared").alias("shared")), "candidates")
    joined = chunks.join(shared, "chunk").select("chunk", "ids", "ends", "data", "shared")
    answers = stash(_answers(joined, 4 * ranges).groupBy("chunk").agg(F.collect_list("answer").alias("answers")), "answers")

    def cut(batches):
        for batch in batches:
            for _, ids, ends, data, shared, answers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = _text(data)
                edges = np.zeros(len(data) + 1, np.int64)
                if answers:
                    _, at, n, owner, number, contents = _shared_blocks(data, ends, ids, shared)
                    rows = np.frombuffer(b"".join(answers), "<i8").reshape(-1, 3)
                    # a content's runs stand together and in order
                    first = np.full(len(contents), -1)
                    new = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
                    first[rows[new, 0]] = new
                    count = np.zeros(len(contents), np.int64)
                    count[rows[new, 0]] = np.diff(np.concatenate([new, [len(rows)]]))
                    begun = np.cumsum(rows[:, 1]) - rows[:, 1]
                    has = np.flatnonzero(first[number] >= 0)
                    per = count[number[has]]
                    block = np.repeat(has, per)
                    run = np.repeat(first[number[has]] - (np.cumsum(per) - per), per) + np.arange(per.sum())
                    gone = rows[run, 2] < owner[block]
                    block, run = block[gone], run[gone]
                    start = at[block] + begun[run] - begun[first[number[block]]]
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + rows[run, 1] - 1 + LENGTH, -1)
                covered = np.cumsum(edges[:-1]) > 0
                out = [[] for _ in range(6)]
                begin = 0
                for d, end in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(ends, "<i8").tolist(), strict=True):
                    x, c = data[begin:end], covered[begin:end]
                    removed = int(c.sum())
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]]))).tolist()
                    kept = np.frombuffer(x, np.uint8)[~c].tobytes() if removed else x
                    for column, v in zip(out, (None if d == _NULL_ID else d, len(x), removed, len(turns) // 2, kept, turns), strict=True):
                        column.append(v)
                    begin = end
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    done = chunks.join(shared, "chunk", "left").join(answers, "chunk", "left").select("chunk", "ids", "ends", "data", "shared", "answers")
    return arrow_map(done, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")


def op6_query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
