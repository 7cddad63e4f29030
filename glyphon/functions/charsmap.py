"""The compiled character map: decoded once, listed as a table of key and replacement."""

from __future__ import annotations

import base64
import struct

import regex


def decode_charsmap(encoded: str) -> dict[bytes, bytes]:
    """{key: replacement} of all keys that a lookup can reach, as bytes.

    The blob: the trie's size, its 32-bit units, and a pool of NUL-ended replacements. A
    lookup stops at the first key it meets, so keys behind a shorter key are left out,
    whether or not that key is whole UTF-8. A value at the pool's end is a deletion.
    """
    blob = base64.b64decode(encoded)
    if len(blob) < 4:
        raise ValueError("charsmap too short")
    size = struct.unpack_from("<I", blob)[0]
    if 4 + size > len(blob):
        raise ValueError("charsmap trie larger than the data")
    units, pool = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    out: dict[bytes, bytes] = {}
    stack = [(offset(units[0]), b"")] if units else []
    while stack:
        base, key = stack.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte:
                continue
            below, now = at ^ offset(units[at]), key + bytes([byte])
            if not units[at] & 0x100:
                stack.append((below, now))
            elif below < len(units) and (value := units[below] & 0x7FFFFFFF) <= len(pool):
                out[now] = pool[value:].partition(b"\0")[0]
    return out


def lookup(keys: dict[bytes, bytes], longest: int, text: bytes) -> bytes | None:
    """The replacement of the shortest key that ``text`` begins with."""
    for n in range(1, min(longest, len(text)) + 1):
        if text[n - 1] == 0:
            return None
        if (found := keys.get(text[:n])) is not None:
            return found
    return None


def normalizer(keys: dict[bytes, bytes]):
    """text -> text by grapheme cluster: one of under six bytes that begins with a key is
    replaced as a whole; in any other, each code point that begins with one."""
    longest = max(map(len, keys), default=0)

    def cluster(part: str) -> bytes:
        data = part.encode()
        found = lookup(keys, longest, data) if len(data) < 6 else None
        if found is not None:
            return found
        ones = [ch.encode() for ch in part]
        return b"".join([x if (one := lookup(keys, longest, x)) is None else one for x in ones])

    return lambda text: b"".join(map(cluster, regex.findall(r"\X", text))).decode("utf-8", "replace")
