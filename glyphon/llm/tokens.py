"""Token ids of whole texts, fast: the tokenizer runs once per distinct word and worker.

Both vocabularies cut a text before merging, and no cut-out piece reaches over the
places split at here, so ids of the words in order are the ids of the text. Where
white space makes that untrue, the whole text goes through the tokenizer.
"""

from __future__ import annotations

import re

import numpy as np

#: Words that a worker remembers in each of two generations; bounds memory, not results.
MEMO = 600_000
#: Characters of the longest word remembered, so that the memory is bounded in bytes too.
LONGEST = 32
_RUN = re.compile(r"\s\s(?:\s|\Z)")


def _byte_chars() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: 33-126, 161-172
    and 174-255 as themselves, the others in order from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class _Memo(dict):
    """Packed little-endian unsigned 32-bit ids of prefix + word."""

    def __init__(self, packer: "Packer", prefix: str):
        super().__init__()
        self.packer, self.prefix, self.old = packer, prefix, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha() and max(word) <= "\xff":
                ids = self.packer.letters(self.prefix + word)
            elif word[-1:] in self.packer.marks and word[-2:-1].isalpha() and word[-2] <= "\xff":
                # letters end where such a mark begins, in either vocabulary
                ids = self[word[:-1]] + self.packer.marks[word[-1]]
            else:
                ids = self.packer.encoded(self.prefix + word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class Packer:
    """``packed(text)``: the text's ids as packed bytes, equal to the tokenizer's own."""

    def __init__(self, path: str, byte_level: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = byte_level
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chars = _byte_chars()
        self.model = self.tokenizer.model
        self.ids_packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.marks = {m: self.encoded(m) for m in ".,;:"}
        self.first, self.later = _Memo(self, ""), _Memo(self, " ")
        self.newline = self.encoded("\n")

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def letters(self, text: str) -> bytes:
        """One word of letters up to U+00FF is one piece, so it can go to the merges directly."""
        if not self.byte_level:
            text = text.lower()
        if text.isascii():
            text = text.replace(" ", self.chars[32])
        else:
            text = "".join([self.chars[b] for b in text.encode()])
        packed = self.ids_packed
        return b"".join([packed[t.id] for t in self.model.tokenize(text)])

    def packed(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.encoded(text)
        if not self.byte_level:
            # white space is dropped, so words stand alone
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        if ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\t" in text or "\r" in text or not text.isascii()) and _RUN.search(text):
            return self.encoded(text)
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
            head, *rest = line.split(" ")
            out.append(self.first[head])
            out.extend(map(self.later.__getitem__, rest))
        return b"".join(out)


_PACKERS: dict[tuple[str, bool], Packer] = {}


def packer(path: str, byte_level: bool) -> Packer:
    """One for each worker process and vocabulary."""
    if (path, byte_level) not in _PACKERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _PACKERS[path, byte_level] = Packer(path, byte_level)
    return _PACKERS[path, byte_level]
