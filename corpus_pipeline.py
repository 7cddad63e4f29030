"""The corpus pipeline: stages in order, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes each stage's rows to the shared folder and
reads them back, so a lost executor costs at most one stage's work.

Rows without an id are told apart by a hash of their text; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphon.llm.common import pack, stash, unpack
from glyphon.llm.decontam import drop_leaks
from glyphon.llm.lines import fuzzy_line_dedup
from glyphon.llm.nearcopies import near_copy_components
from glyphon.llm.packing import packed_documents
from glyphon.llm.quality import quality_verdicts

#: Words in a shingle of the near-copy stage, and the Jaccard similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule, not the likelihood ratio and no toxic words reject. Null and empty texts go."""
    judged = quality_verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; documents of which nothing is left go. Null texts stay as they are."""
    out = fuzzy_line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.where("n_removed = 0 OR trim(text) != ''").select(*docs.columns)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more): the one of the smallest id."""
    unnamed = F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    keyed = docs.select(F.coalesce(F.col("doc_id"), unnamed).alias("doc_id"), "text")
    kept = near_copy_components(keyed, SHINGLE, SIMILARITY).where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    rows = pack(docs).withColumn("_th", F.xxhash64(F.col("_row")["text"]))
    rows = rows.withColumn("_key", F.coalesce(F.col("_row")["doc_id"], F.col("_th").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)))
    rows = rows.join(kept, "_key", "left_semi")
    rows = rows.withColumn("_no", F.row_number().over(Window.partitionBy("_key", "_th").orderBy("_th"))).where("_no = 1")
    return unpack(rows, docs.columns, [])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts and ids stay."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, and their places in the training sequences."""
    return packed_documents(docs, with_ids=True)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", dedup_lines),
    ("near-copy dedup", dedup_near_copies),
    ("decontamination", decontaminate),
    ("best-fit packing", pack_sequences),
]
#: SQL can't express the tokenizer, the edit alignment or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stash(stage(spark, out, sf_dir), f"stage-{name.replace(' ', '-')}")
    return out
