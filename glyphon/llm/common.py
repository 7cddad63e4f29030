"""What the operators share: shared storage, packed rows, ranks, and components."""

from __future__ import annotations

import ctypes
import math
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphon.shipping import ship

#: Name under which a caller's own columns travel while an operator adds others.
ROW = "_row"
#: Rows and bytes that an Arrow function takes at once, about.
MOST_ROWS, MOST_BYTES = 4_000, 16 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, the place that all executors see.

    Only in local mode a missing setting (as in tests) is filled with a local folder; on a
    cluster each executor would write to its own disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "glyphon-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting to delete a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), dictionary: bool = True) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read and not a recomputation.
    The step's own shuffle files are deleted as it ends, so disk use doesn't add up.
    Without a ``dictionary``, hashes and texts that hardly repeat take less time to write.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower())
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stash`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def pack(df: DataFrame) -> DataFrame:
    """All columns as one struct, so that names an operator adds can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def unpack(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The packed columns again, then ``added``; a packed column of an added name gives way."""
    names = {a.casefold() for a in added}  # Spark tells names apart without regard to case
    kept = [F.col(ROW)[c].alias(c) for c in columns if c.casefold() not in names]
    return df.select(*kept, *added)


def key_of(c: Column) -> Column:
    """A string key that joins and groups like the value and has no nulls."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def unit_hash(*parts: Column) -> Column:
    """32 bits of a seeded md5 as a long; plain SQL can compute the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def bucket_count(n: int) -> int:
    """Buckets by the square root of the rows: no window group and no table of counts exceeds it much."""
    return max(1, math.isqrt(max(n, 1)))


def dense_rank_in_groups(rows: DataFrame, counted: DataFrame, group: list[str], bucket: str, order: list[Column], rank: str) -> DataFrame:
    """Gapless ranks from 0 within ``group``, however large a group is.

    ``bucket`` splits a group into ranges that agree with the order. Their counts are
    summed first (``counted`` has the group and bucket columns, of fewer or cheaper
    columns than ``rows``), and each row is then ranked in its own small bucket.
    ``{rank}_of`` gets the size of the group.
    """
    per = counted.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, bucket, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias(f"{rank}_of"))
    place = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    return rows.join(per, [*group, bucket]).withColumn(rank, F.col("_before") + place - 1).drop("_before")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps, all of them DataFrame joins and
    aggregates. No group's neighbours are gathered: each step carries the group's
    minimum, which is aggregated before the shuffle. Every round is written to the
    shared folder; the driver sees one count and one checksum a round.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stash(pairs, f"{name}-0")
    seen = None
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for step in range(1, 64):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # a node that is its neighbourhood's minimum keeps its links; others hand them on
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stash(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))


def row_schema(rows: DataFrame, added: str) -> StructType:
    """The packed rows' type and the ``added`` columns (name type, ...), whatever the packed names are."""
    return StructType([rows.schema[ROW], *StructType.fromDDL(added).fields])


def trim() -> None:
    """Hand freed memory back to the system: a worker lives on after its task, and what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def arrow_map(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches cut to a bounded number of bytes, so long texts don't add up in ``fn``."""
    ship(df.sparkSession)

    def bounded(batches):
        for batch in batches:
            n = batch.num_rows
            step = max(1, min(n, MOST_ROWS, n * MOST_BYTES // max(1, batch.nbytes)))
            for a in range(0, n, step):
                yield batch.slice(a, step)

    def whole(batches):
        yield from fn(bounded(batches))
        trim()

    return df.mapInArrow(whole, schema)
