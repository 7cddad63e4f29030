"""Quality rules with a hashed n-gram likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of bins. Two multinomials over
the bins are estimated: one from trusted documents, one from the raw corpus, all of it.
A document's score is the mean log ratio of the two over its n-grams, so its length
doesn't matter; it is kept if no base rule fails and the score reaches the threshold.
A few toxic words don't move a mean, so the same kind of ratio, of hashed words' document
frequencies between toxic and clean labelled documents, picks out the words that tell,
and a document with ``TOXIC_WORDS`` distinct ones of them isn't kept.

Parameters with a bound: the trusted side (quality 1, not toxic) and the toxic side take
at most ``trusted_limit`` labelled documents each (those of the smallest hashes).
Everything else covers all rows. With few labels the prior outweighs the trusted side, so
less is rejected, and no word counts as toxic on the word of fewer than three documents.

Cases: a null or empty text has no words, fails the base rules, and is rejected; a null
id is never trusted; an id on many labels has the best quality and the worst toxicity of them; repeated rows
count as often as they are there; without trusted rows the score is zero for every
document; an empty table gives an empty one; input columns are carried, those named
like an output column give way to it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pack, row_schema, unpack

BINS = 1 << 16
TRUSTED_LIMIT = 20_000
#: Log ratio of document frequencies from which a word counts as toxic, and the distinct ones that reject a document.
TOXIC_RATIO, TOXIC_WORDS = 4.0, 2
#: Mean log ratio below which a document is unlike the trusted ones.
THRESHOLD = -0.35
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # equal mixes are looked at word by word, so a chance collision doesn't count
    groups = defaultdict(list)
    for i in np.flatnonzero(np.isin(mixed, twice)).tolist():
        groups[ids[i : i + window].tobytes()].append(i)
    starts = np.array([i for g in groups.values() if len(g) > 1 for i in g], np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def hash_bins(h: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The bins of all unigrams and bigrams of the words with the hashes ``h``."""
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.concatenate([(h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40), two]).astype(np.int64) % bins


def ngram_bins(words: list[bytes], bins: int = BINS) -> np.ndarray:
    return hash_bins(word_hashes(words), bins)


def _sample(labels: DataFrame, where: str, limit: int) -> list[int]:
    """The ids of at most ``limit`` labelled documents, those of the smallest hashes."""
    ids = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("quality", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("bad"))
    return [r[0] for r in ids.where(where).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]


def fit_log_ratio(docs: DataFrame, ids: list[int], bins: int = BINS) -> np.ndarray:
    """The log ratio of each bin, of the documents ``ids`` to all. What comes to the driver is the bins' counts: a fixed size."""
    trusted = docs.sparkSession.sparkContext.broadcast(frozenset(ids))

    def count(batches):
        raw, target = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = ngram_bins((text or "").encode().lower().split(), bins)
                raw += np.bincount(found, minlength=bins)
                if d in trusted.value:
                    target += np.bincount(found, minlength=bins)
        at = np.flatnonzero(raw)
        for a in range(0, len(at), 8192):
            x = at[a : a + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(raw[x]), pa.array(target[x])], ["bin", "raw", "target"])

    counts = arrow_map(docs.select("doc_id", "text"), count, "bin long, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(bins), np.zeros(bins)
    for r in counts.collect():
        raw[r["bin"]], target[r["bin"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(bins)
    # the raw corpus is the trusted side's prior, with the weight of one n-gram a bin
    base = (raw + 1) / (raw.sum() + bins)
    return np.log((target + bins * base) / (target.sum() + bins)) - np.log(base)


def fit_toxic_words(docs: DataFrame, toxic: list[int], clean: list[int], ratio: float = TOXIC_RATIO) -> np.ndarray:
    """Hashes of the words whose log ratio of document frequencies, toxic to clean, is at least ``ratio``.

    A word must be in three and in a fiftieth of the toxic documents, so there are at most
    fifty times as many as a document has words.
    """
    if not toxic:
        return np.zeros(0, np.uint32)
    spark = docs.sparkSession
    sides = spark.createDataFrame([(d, 1) for d in toxic] + [(d, 0) for d in clean], "_id long, toxic int")

    def words(batches):
        for batch in batches:
            found = [word_hashes((t or "").encode().lower().split()) for t in batch.column(0).to_pylist()]
            per = [np.unique(h) for h in found]
            side = np.repeat(batch.column(1).to_numpy(), [len(h) for h in per])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*per, np.zeros(0, np.uint64)]).astype(np.int64)), pa.array(side, pa.int32())], ["word", "toxic"])

    held = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(sides), "_id").select("text", "toxic")
    per = arrow_map(held, words, "word long, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (len(toxic) + 1)) - F.log((F.col("c") + 0.5) / (len(clean) + 1))
    strong = per.where((F.col("t") >= max(3, len(toxic) / 50)) & (odds >= ratio)).select("word")
    return np.sort(np.array([r[0] for r in strong.collect()], np.uint32))


def quality_verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bins: int = BINS, trusted_limit: int = TRUSTED_LIMIT) -> DataFrame:
    """``docs`` with the base counts, ``score``, ``n_toxic_words``, ``base_failed`` and ``kept``, for every document."""
    clean, toxic = _sample(labels, "good = 1 AND bad = 0", trusted_limit), _sample(labels, "bad = 1", trusted_limit)
    sent = docs.sparkSession.sparkContext.broadcast((fit_log_ratio(docs, clean, bins), fit_toxic_words(docs, toxic, clean)))
    columns = docs.columns

    def judge(batches):
        ratio, strong = sent.value
        for batch in batches:
            counts, scores, toxic = [], [], []
            for text in batch.column("_text").to_pylist():
                words = (text or "").encode().split()
                counts.append(base_counts(text or "", words))
                hashes = word_hashes([w.lower() for w in words])
                found = hash_bins(hashes, bins)
                scores.append(float(ratio[found].mean()) if len(found) else 0.0)
                toxic.append(len(np.unique(hashes[np.isin(hashes, strong)])) if len(strong) else 0)
            c = np.array(counts, np.int64).reshape(-1, 5)
            failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])
            score, n_toxic = np.array(scores, float), np.array(toxic, np.int64)
            kept = ~failed & (score >= threshold) & (n_toxic < TOXIC_WORDS)
            arrays = [batch.column("_row"), *[pa.array(c[:, k]) for k in range(5)], pa.array(score), pa.array(n_toxic), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, ["_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "n_toxic_words", "base_failed", "kept"])

    rows = pack(docs).withColumn("_text", F.col("_row")["text"])
    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, n_toxic_words long, base_failed boolean, kept boolean"
    return unpack(arrow_map(rows, judge, row_schema(rows, added)), columns, [x.split()[0] for x in added.split(", ")])


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
