"""Substring dedup by hashing lines.

A line's words, lower-cased and joined by one space, are hashed to 128 bits, and so are
the sentences of ``MIN_WORDS`` words or more within lines of several sentences, for the
passages that are set inside a line of other text. With ``unit="paragraph"`` the units
are the stretches between blank lines. Digests are grouped globally, the earliest
occurrence by document rank (the id) and place stays, and every other one is reported
with its offsets in the original text. Of a line that goes, the sentences aren't
reported again. ``remove_repeated_units`` returns the remaining texts with the offsets.

Cases: a null or empty text has no units, and a null text stays null; a unit without
words is none; a null id ranks last; rows that agree in id and text are one document,
which keeps a unit it has first, in each of the rows; rows that share an id only are parts of one
document, each of which keeps a unit it has first; an empty table gives an empty one;
``repeated_units`` reads no further columns, ``remove_repeated_units`` carries them, and
those named like an output column give way to it.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, key_of, pack, row_schema, stash, unpack

#: What a unit is, and the finer units within it.
UNITS = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"[^\n]+(?:\n[^\n]+)*")}
SENTENCE = re.compile(r"[^\n.!?]+")
#: Shorter sentences repeat by chance and stay, if their line does.
MIN_WORDS = 6
_NULL_ID = (1 << 63) - 1


def units_of(text: str, unit: str = "line", min_words: int | None = MIN_WORDS):
    """(digest, start, end, start of the outer unit) of each unit, offsets in code points; no
    sentences if ``min_words`` is None."""
    for m in UNITS[unit].finditer(text):
        words = m[0].lower().split()
        if not words:
            continue
        yield xxhash.xxh3_128_digest(" ".join(words).encode()), m.start(), m.end(), m.start()
        if min_words is not None and len(words) > min_words:
            for s in SENTENCE.finditer(text, m.start(), m.end()):
                part = s[0].lower().split()
                if min_words <= len(part) and s.span() != m.span():
                    yield xxhash.xxh3_128_digest(" ".join(part).encode()), s.start(), s.end(), m.start()


def _gone(docs: DataFrame, unit: str, min_words: int | None, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), start, end, first (id of the occurrence that stays) of each unit that goes.

    One digest's count and smallest id are aggregated before the shuffle, so a unit that
    very many documents share is no large group; in the join that follows, the digests
    are unique on one side and the runtime splits a hot one on the other.
    """

    def digest(batches):
        for batch in batches:
            high, low, ids, texts, starts, ends, outer, again = [], [], [], [], [], [], [], []
            for d, th, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                seen = set()
                for h, a, b, o in units_of(text or "", unit, min_words):
                    high.append(int.from_bytes(h[:8], "little", signed=True))
                    low.append(int.from_bytes(h[8:], "little", signed=True))
                    ids.append(_NULL_ID if d is None else d)
                    texts.append(th)
                    starts.append(a)
                    ends.append(b)
                    outer.append(o)
                    again.append(h in seen)
                    seen.add(h)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_()]
            columns = (high, low, ids, texts, starts, ends, outer, again)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["high", "low", "id", "th", "start", "end", "outer", "again"])

    rows = docs.select(F.col(id_col).cast("long"), F.xxhash64(text_col), text_col)
    found = stash(arrow_map(rows, digest, "high long, low long, id long, th long, start int, end int, outer int, again boolean"), "units")
    keys = found.groupBy("high", "low").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    gone = found.join(keys, ["high", "low"]).where("again OR id > first")
    # of an outer unit that goes, the sentences go with it
    whole = F.col("start") == F.col("outer")
    least = gone.groupBy("id", "th", "outer").agg(F.max(F.when(whole, F.col("end"))).alias("to"))
    return gone.join(least, ["id", "th", "outer"]).where("to IS NULL OR start >= to OR (start = outer AND end = to)").select("id", "th", "start", "end", "first").distinct()


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int | None = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, kept_doc_id of each unit that goes."""
    null = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return _gone(docs, unit, min_words, id_col, text_col).select(null("id").alias("doc_id"), "start", "end", null("first").alias("kept_doc_id"))


def remove_repeated_units(docs: DataFrame, unit: str = "line", min_words: int | None = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` without the units that go, and ``kept_spans``: the [start, end) of what
    remains, in the original text, so every character can be traced back."""
    gone = _gone(docs, unit, min_words, id_col, text_col)
    null = F.when(F.col("id") != _NULL_ID, F.col("id"))
    spans = gone.select(key_of(null).alias("_k"), F.col("th").alias("_th"), F.struct("start", "end").alias("s")).groupBy("_k", "_th").agg(F.sort_array(F.collect_set("s")).alias("_gone"))
    rows = pack(docs).withColumn("_k", key_of(F.col("_row")[id_col].cast("long"))).withColumn("_th", F.xxhash64(F.col("_row")[text_col]))
    rows = rows.join(spans.hint("shuffle_hash"), ["_k", "_th"], "left").select("_row", F.col("_row")[text_col].alias("_text"), "_gone")

    def cut(batches):
        for batch in batches:
            texts, kept = [], []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
                edges = [0, *[x for s in spans or [] for x in (s["start"], s["end"])], len(text or "")]
                keep = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
                texts.append(None if text is None else "".join([text[a:b] for a, b in keep]))
                kept.append([{"start": a, "end": b} for a, b in keep])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array(kept, kind)], ["_row", "_kept", "_spans"])

    out = arrow_map(rows, cut, row_schema(rows, "_kept string, _spans array<struct<start:int,end:int>>"))
    return unpack(out.withColumnsRenamed({"_kept": text_col, "_spans": "kept_spans"}), docs.columns, [text_col, "kept_spans"])


def op3_query(spark, sf_dir: str) -> DataFrame:
    return repeated_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The words of the test tables stand between ASCII white space only.
_SQL_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
OP3_SQL = rf"""
WITH line_parts AS (
  SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')
), lines AS (
  SELECT *, (sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(part) - 1)::INTEGER AS outer_start, {_SQL_NORM.format('part')} AS norm FROM line_parts
), sentence_parts AS (
  SELECT doc_id, outer_start, line_length, unnest(s) AS part, generate_subscripts(s, 1) AS k
  FROM (SELECT doc_id, outer_start, length(part) AS line_length, string_split_regex(part, '[.!?]') AS s FROM lines WHERE norm <> '' AND len(string_split(norm, ' ')) > {MIN_WORDS})
), sentences AS (
  SELECT *, (outer_start + sum(length(part) + 1) OVER (PARTITION BY doc_id, outer_start ORDER BY k) - length(part) - 1)::INTEGER AS start, {_SQL_NORM.format('part')} AS norm FROM sentence_parts
), units AS (
  SELECT doc_id, outer_start, outer_start AS start, (outer_start + length(part))::INTEGER AS end_at, 0 AS level, norm FROM lines WHERE norm <> ''
  UNION ALL
  SELECT doc_id, outer_start, start, (start + length(part))::INTEGER, 1, norm FROM sentences WHERE norm <> '' AND len(string_split(norm, ' ')) >= {MIN_WORDS} AND length(part) < line_length
), ranked AS (
  SELECT *, min(doc_id) OVER (PARTITION BY norm) AS first_id, row_number() OVER (PARTITION BY norm, doc_id ORDER BY outer_start, level, start) AS nth FROM units
), gone AS (SELECT *, max(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, outer_start) AS whole FROM ranked WHERE nth > 1 OR doc_id > first_id)
SELECT doc_id, start, end_at AS "end", first_id AS kept_doc_id FROM gone WHERE level = 0 OR whole = 0
"""
