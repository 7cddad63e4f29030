"""Code-point classes, from one source, as regex classes for both Spark and Python.

Spark's and Python's own classes follow different Unicode versions, so Python uses these
explicit ranges, and Spark the categories with what later versions have added.
"""

from __future__ import annotations

import unicodedata
from functools import cache

# The Unicode White_Space property.
WHITE_SPACE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
# The ideograph ranges that get padded. The sixth begins at 2B920.
CJK = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
# ASCII characters that count as punctuation whatever their category.
ASCII_PUNCTUATION = [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)]
# Punctuation and format characters of Unicode 14 and 15, which older Java classes lack.
LATER_PUNCTUATION = [(0x61D, 0x61D), (0x1B7D, 0x1B7E), (0x2E53, 0x2E5D), (0x10F86, 0x10F89), (0x116B9, 0x116B9), (0x11B00, 0x11B09), (0x11F43, 0x11F4F), (0x12FF1, 0x12FF2)]
LATER_CONTROL = [(0x890, 0x891), (0x13439, 0x1343F)]

Ranges = list[tuple[int, int]]


def _ranges(accept) -> Ranges:
    out: Ranges = []
    for c in range(0x110000):
        if not 0xD800 <= c <= 0xDFFF and accept(c):
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
    return out


def _in(c: int, ranges: Ranges) -> bool:
    return any(a <= c <= b for a, b in ranges)


@cache
def control() -> tuple[tuple[int, int], ...]:
    """Characters that cleaning drops: NUL, U+FFFD, and Cc, Cf, Co but tab and line ends."""
    return tuple(_ranges(lambda c: c in (0, 0xFFFD) or (c not in (9, 10, 13) and unicodedata.category(chr(c)) in ("Cc", "Cf", "Co"))))


@cache
def marks() -> tuple[tuple[int, int], ...]:
    return tuple(_ranges(lambda c: unicodedata.category(chr(c)) == "Mn"))


@cache
def moved() -> tuple[tuple[int, int], ...]:
    """Characters with a combining class that aren't nonspacing marks, or decompose to one."""
    return tuple(_ranges(lambda c: any(unicodedata.combining(x) and unicodedata.category(x) != "Mn" for x in unicodedata.normalize("NFD", chr(c)))))


@cache
def punctuation() -> tuple[tuple[int, int], ...]:
    return tuple(_ranges(lambda c: _in(c, ASCII_PUNCTUATION) or unicodedata.category(chr(c))[0] == "P"))


def java_class(ranges) -> str:
    """The inside of a character class for Spark's regex functions."""
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


#: The insides of Java classes that equal the lists above: one category costs one test a
#: character, where a list of ranges costs one for each range.
JAVA_SPACE = r"\p{IsWhite_Space}"
JAVA_PUNCTUATION = r"\p{P}$+<=>^`|~" + java_class(LATER_PUNCTUATION)
JAVA_CONTROL = r"\p{Cc}\p{Cf}\p{Co}\x{FFFD}" + java_class(LATER_CONTROL) + r"&&[^\t\n\r]"


def python_class(ranges) -> str:
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
