"""Best-fit packing by linear grouping.

Lengths are counted, and a table of at most ``capacity`` counts is all that the plan is
made from, however many documents there are. Large lengths are sorted into groups of
equal cardinality and rounded up to the largest of their group; packings of these few
sizes are optimised by column generation; actual lengths then take the places of the
rounded ones, and the rest goes to the sequences it fits best. The plan is a list of
patterns with multiplicities, so a length's pieces are dealt out by their rank.

Cases: a null text is empty and still has its end id; ties are dealt out by rank, and
repeated rows are pieces of their own; an empty table gives an empty one; a text of
more than ``capacity`` ids is cut into full pieces and a rest; input columns are carried,
and those named like an output column give way to it.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bucket_count, dense_rank_in_groups, pack, row_schema, stash, unpack
from .tokenbin import vocabulary
from .tokens import packer

CAPACITY = 4096
#: Groups of equal cardinality; lengths of more than capacity / 2, then capacity / 3, are large.
GROUPS, LARGE = 48, (2, 3)


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The set of sizes of most value within the capacity (an unbounded knapsack)."""
    rounds = capacity // int(sizes.min())
    best = np.zeros(capacity + 1)
    took = []
    for _ in range(rounds):
        now, pick = best.copy(), np.full(capacity + 1, -1)
        for g, (s, v) in enumerate(zip(sizes.tolist(), value.tolist(), strict=True)):
            if v > 1e-12:
                with_g = best[: capacity + 1 - s] + v
                better = with_g > now[s:] + 1e-12
                now[s:][better] = with_g[better]
                pick[s:][better] = g
        took.append(pick)
        if (pick < 0).all():
            break
        best = now
    pattern, left = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(took):
        if (g := int(pick[left])) >= 0:
            pattern[g] += 1
            left -= int(sizes[g])
    return float(value @ pattern), pattern


def optimise_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their (fractional) numbers that cover ``demand`` with the fewest sequences."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(most):
        inverse = np.linalg.inv(basis)
        x = inverse @ demand
        dual = inverse.sum(axis=0)
        gain, pattern = _best_pattern(sizes, np.maximum(dual, 0), capacity)
        if gain <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, np.maximum(x, 0) / direction, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
    x = np.linalg.solve(basis, demand)
    return [(basis[:, i].astype(np.int64), float(x[i])) for i in range(k) if x[i] > 1e-9]


class _Queue:
    """Lengths with counts, taken from the front."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.runs, self.at, self.used = runs, 0, 0

    def take(self, n: int) -> list[tuple[int, int]]:
        """Runs of n items in all; length 0 stands for a place that stays empty."""
        out = []
        while n and self.at < len(self.runs):
            length, count = self.runs[self.at]
            k = min(n, count - self.used)
            out.append((length, k))
            n, self.used = n - k, self.used + k
            if self.used == count:
                self.at, self.used = self.at + 1, 0
        return [*out, (0, n)] if n else out

    def rest(self) -> list[tuple[int, int]]:
        return self.take(sum(c for _, c in self.runs[self.at :]) - self.used)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(sequences, ((length, how many in each), ...)), ...] for a table of length counts.

    Rounding up may leave room that a sequence of actual lengths could have used, the more
    the more lengths count as large. So plans are made by linear grouping of the lengths
    over a half and over a third of a sequence, and each again with its worst-filled
    sequences repacked; the first of the fewest sequences is taken. Grouping no length at
    all, which is best fit in falling order, is held against them, so that it's never beaten.
    """
    plans = [_grouped_plan(counts, capacity, groups, large) for large in LARGE]
    plans += [_refilled(p, capacity) for p in plans]
    return min([*plans, _grouped_plan(counts, capacity, 1, 1)], key=lambda p: sum(n for n, _ in p))


def _refilled(plan, capacity: int):
    """The plan with the sequences that are less than full by a 64th and more packed again by best fit."""
    keep = [(n, held) for n, held in plan if sum(a * k for a, k in held) * 64 >= capacity * 63]
    again: dict[int, int] = {}
    for n, held in plan:
        if sum(a * k for a, k in held) * 64 < capacity * 63:
            for a, k in held:
                again[a] = again.get(a, 0) + n * k
    return keep + _grouped_plan(again, capacity, 1, 1)


def _grouped_plan(counts: dict[int, int], capacity: int, groups: int, large: int):
    """Linear grouping of lengths over capacity / large, then best fit of the rest."""
    patterns: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    if counts.get(capacity):
        patterns.append((counts[capacity], ((capacity, 1),)))
    items = sorted(((length, n) for length, n in counts.items() if 0 < length < capacity and n), reverse=True)
    bins: dict[int, list[list]] = {}  # free space -> [number of sequences, what each holds]
    rest = [x for x in items if x[0] * large <= capacity]
    if big := [x for x in items if x[0] * large > capacity]:
        queue, per = _Queue(big), -(-sum(n for _, n in big) // groups)
        queues: dict[int, _Queue] = {}
        for _ in range(groups):
            if runs := [x for x in queue.take(per) if x[0]]:
                size = runs[0][0]  # groups of one rounded size are one
                queues[size] = _Queue([*queues[size].runs, *runs] if size in queues else runs)
        sizes = np.array(sorted(queues, reverse=True))
        demand = np.array([sum(n for _, n in queues[s].runs) for s in sizes.tolist()], float)
        for pattern, x in sorted(optimise_configurations(sizes, demand, capacity), key=lambda p: tuple(-p[0])):
            if times := int(x + 1e-6):
                slots = [queues[s].take(times) for s, a in zip(sizes.tolist(), pattern.tolist(), strict=True) for _ in range(a)]
                cuts = sorted({c for runs in slots for c in np.cumsum([n for _, n in runs]).tolist()})
                begun = 0
                places = [(np.cumsum([n for _, n in runs]), runs) for runs in slots]
                for cut in cuts:
                    held = sorted((runs[int(np.searchsorted(ends, begun, side="right"))][0] for ends, runs in places), reverse=True)
                    held = [h for h in held if h]
                    if held:
                        bins.setdefault(capacity - sum(held), []).append([cut - begun, tuple((h, held.count(h)) for h in dict.fromkeys(held))])
                    begun = cut
        rest = sorted([x for q in queues.values() for x in q.rest()] + rest, reverse=True)
    free = sorted(bins)

    def put(space: int, n: int, held: tuple) -> None:
        if space not in bins:
            bins[space] = []
            bisect.insort(free, space)
        bins[space].append([n, held])

    for length, n in rest:
        while n:
            k = bisect.bisect_left(free, length)
            if k == len(free):
                each = min(capacity // length, n)
                many = max(1, n // each)
                put(capacity - each * length, many, ((length, each),))
                n -= many * each
                continue
            space = free[k]
            have, held = bins[space].pop()
            if not bins[space]:
                del bins[space], free[k]
            each = min(space // length, n)
            many = min(have, n // each)
            put(space - each * length, many, (*held, (length, each)))
            if have > many:
                put(space, have - many, held)
            n -= many * each
    return patterns + [(n, held) for space in sorted(bins) for n, held in bins[space]]


def _slots(patterns) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, each, first sequence, offset), sorted."""
    out, ranks, sequence = [], {}, 0
    for n, held in patterns:
        offset = 0
        for length, each in held:
            begin = ranks.get(length, 0)
            ranks[length] = begin + n * each
            out.append((length, begin, begin + n * each, each, sequence, offset))
            offset += length * each
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def pack_pieces(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, order: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (the place there, gapless from 0).

    Ranks within a length come from hash buckets, so a length that most pieces have is no
    large task. The plan that every task gets has at most a few entries for each of the
    ``capacity`` lengths; its size doesn't depend on the number of pieces.
    """
    columns = pieces.columns
    n = pieces.count()
    rows = pack(pieces).withColumn("_len", F.col("_row")[length_col].cast("long"))
    key = F.xxhash64(*[F.col("_row")[c] for c in order or columns])
    rows = stash(rows.withColumn("_key", key).withColumn("_b", F.pmod("_key", F.lit(bucket_count(n)))), "pack-rows")
    counts = {r["_len"]: r["n"] for r in rows.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan_packing(counts, capacity)))
    ranked = dense_rank_in_groups(rows, rows, ["_len"], "_b", ["_key"], "_rank")

    def place(batches):
        s = slots.value
        keys = s[:, 0] * (1 << 44) + s[:, 1]
        for batch in batches:
            length, rank = batch.column("_len").to_numpy(), batch.column("_rank").to_numpy()
            m = s[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1]
            at = rank - m[:, 1]
            arrays = [batch.column("_row"), pa.array(m[:, 4] + at // m[:, 3]), pa.array(m[:, 5] + at % m[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(arrays, ["_row", "sequence_id", "offset"])

    placed = arrow_map(ranked.select("_row", "_len", "_rank"), place, row_schema(rows, "sequence_id long, offset long"))
    return unpack(placed, columns, ["sequence_id", "offset"])


def token_pieces(docs: DataFrame, tokenizer: str, byte_level: bool, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the packed ids) of each piece of each text."""

    def cut(batches):
        p, end = packer(tokenizer, byte_level), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out = [[] for _ in range(6)]
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = p.packed(text) + end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    x = ids[a : a + 4 * capacity]
                    for column, v in zip(out, (d, k, a // 4, len(x) // 4, zlib.crc32(x), x), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)][: 5 + with_ids], names)

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return arrow_map(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def packed_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    pieces = token_pieces(docs, vocabulary("word_bpe_49k.json"), False, end_id=1, with_ids=with_ids)
    return pack_pieces(stash(pieces, "pieces"), order=("doc_id", "piece", "ids_crc32"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
