"""Text steps as Column functions: cleaning, padding, accents, case, splitting, prefixes."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphon.shipping import ship

from . import chars

_WS = chars.JAVA_SPACE
_PLAIN_SPACES = "\t\n\r"
_PLAIN_CONTROL = "".join(chr(x) for x in (*range(32), 127) if chr(x) not in _PLAIN_SPACES)


def clean_text(c: Column) -> Column:
    """Drop control characters first, then make any white space a plain space.

    ASCII texts take one pass over a table; only the others meet the Unicode classes.
    """
    # NUL can't stand in translate's table, which ends there
    plain = F.translate(F.replace(c, F.lit("\0"), F.lit("")), _PLAIN_SPACES + _PLAIN_CONTROL[1:], " " * len(_PLAIN_SPACES))
    dropped = F.regexp_replace(F.make_valid_utf8(c), f"[{chars.JAVA_CONTROL}]", "")
    return F.when(is_ascii(c) & F.is_valid_utf8(c), plain).otherwise(F.regexp_replace(dropped, f"[{_WS}]", " "))


def pad_cjk(c: Column) -> Column:
    return F.when(is_ascii(c), c).otherwise(F.regexp_replace(c, f"([{chars.java_class(chars.CJK)}])", " $1 "))


def trim_unicode(c: Column, left: bool = True, right: bool = True) -> Column:
    sides = [f"^[{_WS}]+"] * left + [f"[{_WS}]+$"] * right
    return F.regexp_replace(c, "|".join(sides), "") if sides else c


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def lower_codepoint(c: Column) -> Column:
    """Each code point by itself: no final sigma, and a dotted capital I becomes i."""
    plain = F.replace(c, F.lit("\u0130"), F.lit("i"))
    return F.when(is_ascii(c), F.lower(c)).otherwise(F.array_join(F.transform(F.split(plain, ""), lambda x: F.lower(x)), ""))


def python_lower(text: str) -> str:
    return "".join([low if len(low := ch.lower()) == 1 else "i" if ch == "\u0130" else ch for ch in text])


class _PerPoint(dict):
    """A translate table that fills itself: code point -> what ``fn`` makes of its character."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, point: int) -> str:
        self[point] = out = self.fn(chr(point))
        return out


def _bare(ch: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFD", ch))


_MARKS = re.compile(f"[{chars.python_class(chars.marks())}]")
_BARE = _PerPoint(_bare)
#: Characters that decomposition may put in another order and that aren't dropped; texts with one are decomposed whole.
_MOVED = re.compile(f"[{chars.python_class(chars.moved())}]")


def python_strip_accents(text: str) -> str:
    if text.isascii():
        return text
    return _bare(text) if _MOVED.search(text) else text.translate(_BARE)


def _strip_accents(texts: pd.Series) -> pd.Series:
    return texts.map(python_strip_accents, na_action="ignore")


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without the nonspacing marks, over Arrow batches; Spark has no such function."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
    return F.pandas_udf(_strip_accents, "string")(c)


@dataclass(frozen=True)
class BertNormalizer:
    clean: bool = True
    cjk: bool = True
    strip_accents: bool | None = None
    lowercase: bool = True

    @property
    def strips(self) -> bool:
        """Unset, accents follow the case flag."""
        return self.lowercase if self.strip_accents is None else self.strip_accents

    def apply(self, df: DataFrame, source: str, target: str) -> DataFrame:
        """``df`` with ``target``. Only rows that aren't ASCII go through Python, and they
        are split off first, since a condition wouldn't shield the others from it."""
        c = F.col(source)
        if self.clean:
            c = clean_text(c)
        if self.cjk:
            c = pad_cjk(c)
        out = df.withColumn(target, c)
        last = lambda d: trim_unicode(lower_codepoint(d) if self.lowercase else d)
        if not self.strips:
            return out.withColumn(target, last(F.col(target)))
        plain = F.coalesce(is_ascii(F.col(target)), F.lit(True))
        easy = out.where(plain).withColumn(target, last(F.col(target)))
        return easy.unionByName(out.where(~plain).withColumn(target, last(strip_accents(F.col(target)))))

    def python(self, text: str) -> str:
        if text.isascii():
            text = text.translate(_ASCII_CLEAN) if self.clean else text
            return (text.lower() if self.lowercase else text).strip(_SPACES)
        if self.strips and _MOVED.search(text):
            text = _bare(self._clean(text))
            return (python_lower(text) if self.lowercase else text).strip(_SPACES)
        return text.translate(self._table).strip(_SPACES)

    def _clean(self, text: str) -> str:
        if self.clean:
            text = _SPACE.sub(" ", _CONTROL.sub("", text.replace("\ufffd", "")))
        return _IDEOGRAPH.sub(r" \g<0> ", text) if self.cjk else text

    @cached_property
    def _table(self) -> _PerPoint:
        """All steps of one code point: none but the order of marks looks further."""

        def one(ch: str) -> str:
            ch = self._clean(ch)
            ch = _bare(ch) if self.strips else ch
            return python_lower(ch) if self.lowercase else ch

        return _PerPoint(one)


_ASCII_CLEAN = {**dict.fromkeys(map(ord, _PLAIN_CONTROL)), **dict.fromkeys(map(ord, _PLAIN_SPACES), " ")}
_PWS = chars.python_class(chars.WHITE_SPACE)
_CONTROL = re.compile(f"[{chars.python_class(chars.control())}]")
_SPACE = re.compile(f"[{_PWS}]")
_IDEOGRAPH = re.compile(f"[{chars.python_class(chars.CJK)}]")
_SPACES = "".join(chr(c) for a, b in chars.WHITE_SPACE for c in range(a, b + 1))
#: What cleaning drops, or leaves in a word, but str.split would split at.
SPLITS_ELSEWHERE = re.compile("[\x0b\x0c\x1c-\x1f\x85]")


def pretokenize(c: Column) -> Column:
    """Words; each punctuation character is a word of its own.

    ASCII texts are cut by the ASCII classes. In the others, runs of ASCII letters and
    digits are taken first, so few characters meet the Unicode classes.
    """
    a, p = chars.java_class(chars.ASCII_PUNCTUATION), chars.JAVA_PUNCTUATION
    plain = F.regexp_extract_all(c, F.lit(rf"[^\x{{9}}-\x{{D}} {a}]++|[{a}]"), F.lit(0))
    other = F.regexp_extract_all(c, F.lit(rf"(?:[a-zA-Z0-9]++|[^{_WS}{p}]++)++|[{p}]"), F.lit(0))
    return F.when(is_ascii(c), plain).otherwise(other)


_WORDS = re.compile(f"[{chars.python_class(chars.punctuation())}]|[^{_PWS}{chars.python_class(chars.punctuation())}]+")
_ASCII_WORDS = re.compile(f"[{chars.python_class(chars.ASCII_PUNCTUATION)}]|[^\t-\r {chars.python_class(chars.ASCII_PUNCTUATION)}]+")


def python_pretokenize(text: str) -> list[str]:
    return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text)


def replace_literal(c: Column, old: str, new: str) -> Column:
    if not old:
        raise ValueError("an empty literal can't be replaced")
    return F.replace(c, F.lit(old), F.lit(new))


def replace_regex(c: Column, pattern: str, new: str) -> Column:
    """``\\s`` means Unicode white space, and ``$1`` in ``new`` a group."""
    return F.regexp_replace(c, pattern.replace(r"\s", f"[{_WS}]"), new)


def metaspace(c: Column, mark: str = "\u2581", prepend: bool = True) -> Column:
    """Plain spaces become ``mark``; one is put first unless it is there. Empty stays empty."""
    out = F.replace(c, F.lit(" "), F.lit(mark))
    return F.when(c == "", c).when(F.lit(prepend) & ~F.startswith(out, F.lit(mark)), F.concat(F.lit(mark), out)).otherwise(out)


def chunk_words(df: DataFrame, id_col: str, text_col: str, size: int = 256) -> DataFrame:
    """id, chunk, text: chunks of ``size`` white-space words, the last one shorter."""
    words = F.filter(F.split(F.col(text_col), f"[{_WS}]+"), lambda w: w != "")
    cut = df.select(id_col, words.alias("w")).where(F.size("w") > 0)
    cut = cut.select(id_col, "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int"))).alias("chunk"))
    return cut.select(id_col, "chunk", F.array_join(F.slice("w", F.col("chunk") * size + 1, F.lit(size)), " ").alias("text"))
