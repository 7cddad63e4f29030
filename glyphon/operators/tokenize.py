"""Tokenizing a column: over distinct words with joins (A), or row by row (B).

A works on each distinct unit once and joins the ids back; it is the batch path. B has
no shuffle and no state, so it also serves streams; both give the same ids.
"""

from __future__ import annotations

import re
import uuid
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from glyphon.functions.charsmap import decode_charsmap, normalizer
from glyphon.functions.chars import WHITE_SPACE, python_class
from glyphon.functions.text import SPLITS_ELSEWHERE, pretokenize, python_pretokenize
from glyphon.shipping import ship
from glyphon.sources.model import Model, Tokenizer

#: Vocabulary entries up to which the table is sent to every executor.
BROADCAST_TOKENS = 600_000


def small(vocab: DataFrame, tokens: int) -> DataFrame:
    """A broadcast hint behind a check of the size; larger tables are joined by shuffle."""
    return F.broadcast(vocab) if tokens <= BROADCAST_TOKENS else vocab


def wordpiece_words(words: DataFrame, vocab: DataFrame, tokens: int, longest: int, max_chars: int = 100, unk_id: int = 0) -> DataFrame:
    """(word, ids) for distinct ``words`` (word): greedy, longest match first.

    Every (start, end) up to the longest entry is a candidate, the vocabulary is joined by
    equality, and a fold walks from match to match. A word with a gap gets no ids, or is
    an error where the vocabulary has no unknown token.
    """
    fit = words.select("word", F.length("word").alias("n")).where(f"n BETWEEN 1 AND {max_chars}")
    starts = fit.select("word", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("start"))
    spans = starts.select("word", "n", "start", F.explode(F.sequence(F.col("start"), F.least(F.col("n"), F.col("start") + longest - 1))).alias("end"))
    piece = F.substring(F.col("word"), F.col("start"), F.col("end") - F.col("start") + 1)
    spans = spans.withColumn("token", F.when(F.col("start") > 1, F.concat(F.lit("##"), piece)).otherwise(piece))
    hits = spans.join(small(vocab.select("token", "token_id"), tokens), "token")
    best = hits.groupBy("word", "n", "start").agg(F.max(F.struct("end", "token_id")).alias("m"))
    walked = best.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("start", F.col("m.end").alias("end"), F.col("m.token_id").alias("id")))).alias("steps"))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("ids"))
    step = lambda a, s: F.when(s["start"] == a["next"], F.struct((s["end"] + 1).alias("next"), F.concat(a["ids"], F.array(s["id"])).alias("ids"))).otherwise(a)
    walked = walked.withColumn("w", F.aggregate("steps", start, step)).select("word", F.when(F.col("w.next") == F.col("n") + 1, F.col("w.ids")).alias("ids"))
    none = F.array().cast("array<int>") if unk_id >= 0 else F.raise_error(F.concat(F.lit("cannot tokenize word "), F.col("word"))).cast("array<int>")
    return words.join(walked, "word", "left").select("word", F.coalesce("ids", none).alias("ids"))


def _join_back(units: DataFrame, ids: DataFrame, unit: str) -> DataFrame:
    """(key, tokens) of ``units`` (key, pos, unit) and the ids of each distinct unit."""
    parts = units.join(ids, unit).where(F.size("ids") > 0)
    lists = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("p"))
    return lists.select("key", F.flatten(F.transform("p", lambda x: x["ids"])).alias("tokens"))


def tokenize(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): strategy A. Null texts give null, texts without tokens an empty list."""
    t = model.tokenizer
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if t.family == "WordPiece":
        norm = t.normalizer.apply(rows, "text", "norm")
        units = norm.select("key", F.posexplode(pretokenize(F.col("norm"))).alias("pos", "word"))
        longest = max((len(x.removeprefix("##")) for x in t.vocab), default=1)
        ids = wordpiece_words(units.select("word").distinct(), model.vocab, len(t.vocab), longest, t.max_chars, t.unk_id)
        found = _join_back(units, ids, "word")
    else:
        ship(df.sparkSession)
        local = RowTokenizer(t)
        if not local.segmentable:
            return tokenize_rows(df, model, key, text)

        def prepare(batches):
            local = RowTokenizer(t)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else local.prepared(x) for x in b.column(1).to_pylist()], pa.string())], ["key", "norm"])

        norm = rows.mapInArrow(prepare, StructType([rows.schema["key"], StructField("norm", StringType())]))
        cut = F.regexp_extract_all(F.col("norm"), F.lit(f"{t.mark}?[^{t.mark}]*"), F.lit(0))
        units = norm.select("key", F.posexplode(F.filter(cut, lambda x: x != "")).alias("pos", "segment"))

        def encode(batches):
            local = RowTokenizer(t)
            for b in batches:
                segments = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(segments, pa.string()), pa.array([local.ids(x) for x in segments], pa.list_(pa.int32()))], ["segment", "ids"])

        ids = units.select("segment").distinct().mapInArrow(encode, "segment string, ids array<int>")
        found = _join_back(units, ids, "segment")
    out = rows.select("key", F.col("text").isNull().alias("none")).join(found, "key", "left")
    return out.select(F.col("key").alias(key), F.when(~F.col("none"), F.coalesce("tokens", F.array().cast("array<int>"))).alias("tokens"))


class RowTokenizer:
    """Strategy B: one text at a time, in Python."""

    def __init__(self, t: Tokenizer):
        self.t, self.memo = t, _Memo(self._chunk)
        self.longest = max(map(len, t.vocab), default=1)
        if t.family == "Unigram":
            self.low = min(t.scores)
            self.steps = [self._step(s) for s in t.normalizer or []]

    @property
    def segmentable(self) -> bool:
        """Segments at the mark are independent: no entry has it inside, and it is an entry."""
        return self.t.mark in self.t.vocab and not any(self.t.mark in x[1:] for x in self.t.vocab)

    def _step(self, s: dict):
        ws = f"[{python_class(WHITE_SPACE)}]"
        if s["type"] == "Replace":
            if "String" in s["pattern"]:
                if not s["pattern"]["String"]:
                    raise ValueError("an empty literal can't be replaced")
                return lambda x: x.replace(s["pattern"]["String"], s["content"])
            pattern = re.compile(s["pattern"]["Regex"].replace(r"\s", ws))
            content = re.sub(r"\$(\d+)", r"\\g<\1>", s["content"].replace("\\", "\\\\"))
            return lambda x: pattern.sub(content, x)
        if s["type"] == "Strip":
            sides = [rf"\A{ws}+"] * bool(s.get("strip_left")) + [rf"{ws}+\Z"] * bool(s.get("strip_right"))
            pattern = re.compile("|".join(sides)) if sides else None
            return lambda x: pattern.sub("", x) if pattern else x
        return normalizer(decode_charsmap(s["precompiled_charsmap"]))

    def prepared(self, text: str) -> str:
        for step in self.steps:
            text = step(text)
        if not text:
            return ""
        text = text.replace(" ", self.t.mark)
        return text if not self.t.prepend or text.startswith(self.t.mark) else self.t.mark + text

    def pieces(self, text: str) -> list[str]:
        """Best segmentation: for each end the best edge, of equal ones the earliest start."""
        n, vocab, scores = len(text), self.t.vocab, self.t.scores
        best, back = [0.0] + [float("-inf")] * n, [(0, False)] * (n + 1)
        for start in range(n):
            if best[start] == float("-inf"):
                continue
            single = False
            for end in range(start + 1, min(n, start + self.longest) + 1):
                i = vocab.get(text[start:end])
                if i is not None:
                    single |= end == start + 1
                    if best[start] + scores[i] > best[end]:
                        best[end], back[end] = best[start] + scores[i], (start, False)
            if not single:
                if self.t.unk_id < 0:
                    raise ValueError(f"cannot tokenize {text[start]!r}")
                if best[start] + self.low - 10 > best[start + 1]:
                    best[start + 1], back[start + 1] = best[start] + self.low - 10, (start, True)
        out, end, fused = [], n, False
        while end:
            start, unknown = back[end]
            if unknown and fused:
                out[-1] = text[start:end] + out[-1]
            else:
                out.append(text[start:end])
            end, fused = start, unknown
        return out[::-1]

    def ids(self, prepared: str) -> list[int]:
        out = []
        for p in self.pieces(prepared):
            if p in self.t.vocab:
                out.append(self.t.vocab[p])
                continue
            tokens = [self.t.vocab.get(f"<0x{b:02X}>") for b in p.encode()] if self.t.byte_fallback else [None]
            if None not in tokens:
                out += tokens
            elif self.t.unk_id >= 0:
                out.append(self.t.unk_id)
            else:
                raise ValueError(f"cannot tokenize {p!r}")
        return out

    def _word(self, word: str) -> list[int]:
        ids, start = [], 0
        while start < len(word) <= self.t.max_chars:
            for end in range(min(len(word), start + self.longest), start, -1):
                i = self.t.vocab.get(("##" if start else "") + word[start:end])
                if i is not None:
                    ids.append(i)
                    start = end
                    break
            else:
                break
        if start < len(word):
            if self.t.unk_id < 0:
                raise ValueError(f"cannot tokenize word {word}")
            return []
        return ids

    def tokens(self, text: str) -> list[int]:
        if self.t.family == "Unigram":
            return self.ids(self.prepared(text))
        if SPLITS_ELSEWHERE.search(text):
            return self._chunk(text)
        return list(chain.from_iterable(map(self.memo.__getitem__, text.split())))

    def _chunk(self, text: str) -> list[int]:
        """Ids of a stretch of text between white space, which no step looks beyond, or of a whole text."""
        return [i for w in python_pretokenize(self.t.normalizer.python(text)) for i in self._word(w)]


class _Memo(dict):
    """Ids of the raw chunks met so far, bounded in number; long ones aren't kept, so it is bounded in bytes too."""

    MOST, LONGEST = 400_000, 32

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, word: str) -> list[int]:
        ids = self.ids_of(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = ids
        return ids


_LOCAL: dict[str, object] = {}


def in_worker(name: str, make):
    """``make()`` once in each worker process for ``name``, a random name that travels with a broadcast."""
    if name not in _LOCAL:
        if len(_LOCAL) >= 8:
            _LOCAL.clear()
        _LOCAL[name] = make()
    return _LOCAL[name]


def named(what, key):
    """What ``what()`` returns; its errors say which document they are about."""
    try:
        return what()
    except ValueError as e:
        raise ValueError(f"document {key!r}: {e}") from e


def tokenize_rows(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): strategy B, for batches and streams alike."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.tokenizer))

    def encode(batches):
        name, t = sent.value
        local = in_worker(name, lambda: RowTokenizer(t))
        for b in batches:
            keys = b.column(0).to_pylist()
            ids = [None if x is None else named(lambda: local.tokens(x), k) for k, x in zip(keys, b.column(1).to_pylist(), strict=True)]  # noqa: B023
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "tokens"])

    return df.select(key, text).mapInArrow(encode, StructType([df.schema[key], StructField("tokens", ArrayType(IntegerType()))]))
