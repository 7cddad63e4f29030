"""Token ids of a corpus as binary files with Elias-Fano document boundaries.

A file is one segment: a header, the ids of its documents one after the other (2 bytes
an id if the vocabulary allows, else 4), and two Elias-Fano sequences with samples for
select: the documents' ends, and the document ids less the smallest. A document's offsets
come from select alone; no table of 64-bit offsets is written or made on reading. Spark's
own writer commits the files, so they can lie in any store, and a lost task leaves nothing
behind. A manifest beside the files counts segments, documents and tokens, and a reader
that finds others raises, as it does for a file that is cut off.

Cases: a null text is an empty one (its end id only); null document ids come first;
rows that share a document id are ordered by a hash of their text; further columns are
not read; an empty table leaves no segment and gives no rows.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir, stash
from .tokens import packer

MAGIC = b"GLYTOK02"
_HEAD, _EF = "<8sIIQQBQQq", "<QBQQ"
HEAD_SIZE = struct.calcsize(_HEAD)
#: Bytes of ids after which a segment is closed.
SEGMENT = 4 << 20


class EliasFano:
    """A non-decreasing sequence in about 2.5 + log2(universe / n) bits a value: the low bits as
    they are, the high ones in unary, and where each ``SAMPLE``-th one bit is, from which select looks on."""

    SAMPLE = 64

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = b""
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        spots = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(spots[-1]) + 1 if n else 0, np.uint8)
        flags[spots] = 1
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little").tobytes(), spots[:: cls.SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it over a few bytes, and its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        s, left = divmod(i, self.SAMPLE)
        at = int(self.samples[s])
        byte = at >> 3
        bits = self.high[byte] >> (at & 7) << (at & 7)
        while left >= (ones := bits.bit_count()):
            left -= ones
            byte += 1
            bits = self.high[byte]
        for _ in range(left):
            bits &= bits - 1
        value = byte * 8 + (bits & -bits).bit_length() - 1 - i
        if not self.low_bits:
            return value
        first = i * self.low_bits
        part = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little")
        return value << self.low_bits | part >> (first & 7) & ((1 << self.low_bits) - 1)

    def pack(self) -> bytes:
        return struct.pack(_EF, self.n, self.low_bits, len(self.low), len(self.high)) + self.samples.tobytes() + self.low + self.high

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """The sequence that begins at a place in ``data``, and where it ends."""
        n, low_bits, n_low, n_high = struct.unpack_from(_EF, data, at)
        at += struct.calcsize(_EF)
        n_samples = -(-n // cls.SAMPLE)
        samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        end = at + n_low + n_high
        if end > len(data):
            raise ValueError("a token file is cut off")
        return cls(n, low_bits, data[at : at + n_low], data[at + n_low : end], samples), end


def segment_bytes(part: int, seq: int, width: int, ids: list[bytes], doc_ids: list[int | None]) -> bytes:
    """``ids``: each document's ids, packed in ``width`` bytes; ``doc_ids`` ascending, nulls first."""
    ends = np.cumsum([len(x) // width for x in ids])
    named = [d for d in doc_ids if d is not None]
    least = named[0] if named else 0
    body = b"".join(ids)
    head = struct.pack(_HEAD, MAGIC, part, seq, len(ids), int(ends[-1]), width, len(body), len(ids) - len(named), least)
    return b"".join([head, body, EliasFano.of(ends).pack(), EliasFano.of(np.array([d - least for d in named], np.uint64)).pack()])


class Segment:
    """A segment read back; ``ids(i)`` are a document's ids, found by ``ends.select``."""

    def __init__(self, data: bytes):
        if len(data) < HEAD_SIZE:
            raise ValueError("a token file is cut off")
        magic, self.part, self.seq, self.n, self.n_tokens, self.width, n_ids, self.n_null, self.least = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        if len(data) < HEAD_SIZE + n_ids:
            raise ValueError("a token file is cut off")
        self.body = np.frombuffer(data, f"<u{self.width}", n_ids // self.width, HEAD_SIZE)
        try:
            self.ends, at = EliasFano.unpack(data, HEAD_SIZE + n_ids)
            self.named, _ = EliasFano.unpack(data, at)
        except (struct.error, ValueError) as e:
            raise ValueError("a token file is cut off") from e

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.least + self.named.select(i - self.n_null)

    def span(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.body[a:b]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, byte_level: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write them to ``path`` in ascending order of ``id_col``, and the manifest beside it.

    The texts are dealt out by ranges of (id, hash of the text), so one id on many rows
    doesn't make one large task; each task sorts its range and writes it in segments.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches):
        from pyspark import TaskContext

        part, seq, size, ids, doc_ids = TaskContext.get().partitionId(), 0, 0, [], []
        p = packer(tokenizer, byte_level)
        width = 2 if max(p.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = p.packed(text) + end
                ids.append(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes())
                doc_ids.append(d)
                size += len(ids[-1])
                if size >= SEGMENT:
                    yield closed(part, seq, width, ids, doc_ids)
                    seq, size, ids, doc_ids = seq + 1, 0, [], []
        if ids:
            yield closed(part, seq, width, ids, doc_ids)

    def closed(part, seq, width, ids, doc_ids):
        arrays = [pa.array([segment_bytes(part, seq, width, ids, doc_ids)], pa.binary()), pa.array([len(ids)], pa.int64()), pa.array([sum(map(len, ids)) // width], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["segment", "docs", "tokens"])

    made = arrow_map(rows.select("doc_id", "text"), write, "segment binary, docs long, tokens long")
    seen = Observation()
    made = made.observe(seen, F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    # the text writer puts a value's bytes down as they are, and a line end that readers of a segment don't reach
    made.select(F.col("segment").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    docs.sparkSession.createDataFrame([(json.dumps(seen.get),)], "value string").coalesce(1).write.text(_manifest(path))


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}.manifest"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row a document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                if not data:  # a task without documents leaves an empty file
                    continue
                s = Segment(data)
                ends = [s.ends.select(i) for i in range(s.n)]
                spans = list(zip([0, *ends], ends))
                packed = s.body.astype("<u4").tobytes()
                crc = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in spans]
                starts, sizes = [a for a, _ in spans], [b - a for a, b in spans]
                arrays = [[s.part] * s.n, [s.seq] * s.n, [s.doc_id(i) for i in range(s.n)], starts, sizes, crc]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = stash(arrow_map(files, read, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-rows")
    segments = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    wanted = json.loads(spark.read.text(_manifest(path)).first()[0])
    found = segments.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if tuple(found) != (wanted["segments"], wanted["docs"], wanted["tokens"]):
        raise ValueError(f"the token files hold {tuple(found)} segments, documents and tokens; the manifest says {wanted}")
    parts = segments.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_base"))
    segments = segments.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("seq_base"))
    return rows.join(segments, ["part", "seq"]).join(parts, "part").select("doc_id", (F.col("part_base") + F.col("seq_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_query(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary("byte_bpe_50k.json"), True, end_id=2)
    return read_token_files(spark, path)
