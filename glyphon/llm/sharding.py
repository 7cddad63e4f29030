"""Sharding by proportional stratified interleaving. DataFrame functions only.

Rows of a source are shuffled by a seeded hash and ranked; rank over source size,
shifted by a phase of the source's own, is the row's place between 0 and 1. All rows
in the order of these places form one sequence in which each stretch holds the
sources in their overall shares. It is cut into equal runs: law ``rows``.

Cases: a null source is a source of its own; a null id takes part like any other;
rows that tie in source and hash are ordered by id and then by the ``ties`` columns,
so only rows that agree in all of these may change places; an empty table gives an
empty one; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, dense_rank_in_groups, key_of, pack, stash, unit_hash, unpack

SEED = "mix-1"


def interleave_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", source_col: str = "source", seed: str = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    No group is ranked whole: a source is cut into about sqrt(n) hash ranges, and so is
    the final sequence, so a source with most of the rows is spread like any other.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    columns = df.columns
    n = df.count()
    buckets = bucket_count(n)

    def keyed(rows: DataFrame) -> DataFrame:
        row = F.col("_row")
        rows = rows.withColumn("_src", key_of(row[source_col])).withColumn("_id", key_of(row[id_col]))
        rows = rows.withColumn("_h", unit_hash(F.lit(seed), F.col("_id")))
        return rows.withColumn("_b", F.floor(F.col("_h") * F.lit(buckets) / F.lit(float(2**32))))

    def tie(c: str) -> F.Column:
        return F.col("_row")[c]

    counted = keyed(pack(df.select(*dict.fromkeys([id_col, source_col])))).select("_src", "_b")
    ranked = dense_rank_in_groups(keyed(pack(df)), counted, ["_src"], "_b", ["_h", "_id", *map(tie, ties)], "_r")
    phase = unit_hash(F.lit(seed), F.lit("phase"), F.col("_src")) / F.lit(float(2**32))
    ranked = ranked.withColumn("_at", (F.col("_r") + phase) / F.col("_r_of"))
    ranked = ranked.select("_row", "_src", "_r", "_at", F.least(F.floor(F.col("_at") * buckets), F.lit(buckets - 1)).alias("_j"), F.lit(0).alias("_all"))
    ranked = stash(ranked, "shard-ranks")
    placed = dense_rank_in_groups(ranked, ranked, ["_all"], "_j", ["_at", "_src", "_r"], "_p")
    shard = F.expr(f"(_p * {n_shards}) div {max(n, 1)}").cast("int")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.expr(f"_p - (shard * {n}L + {n_shards - 1}) div {n_shards}"))
    return unpack(placed, columns, ["shard", "slot"])


N_SHARDS = 40


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select("doc_id", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = interleave_shards(rows, N_SHARDS, ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS tbl FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS v
    FROM range(256) r(i))
), digests AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS src, coalesce('=' || doc_id::VARCHAR, 'null') AS id,
         coalesce(octet_length(encode(text)), 0)::BIGINT + 16 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ',')[:-2], lambda x: ('0x' || x)::BIGINT)),
             lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc_table
), hashed AS (
  SELECT *, ('0x' || substr(md5('{SEED}|' || id), 1, 8))::BIGINT AS h, ('0x' || substr(md5('{SEED}|phase|' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS phase FROM digests
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, id, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY src) AS n_src FROM hashed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (r + phase) / n_src, src, r) - 1 AS p, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * {N_SHARDS} // n)::INTEGER AS shard,
       (p - ((p * {N_SHARDS} // n) * n + {N_SHARDS - 1}) // {N_SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
