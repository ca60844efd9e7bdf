"""Words of many texts at once, as byte ranges and 64-bit hashes, by array operations on their UTF-8 bytes.

Every code point from U+0080 on is made of bytes from 0x80 on, so both word rules used here can be read off bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BYTES = np.arange(256)
#: a-z after lower-casing, 0-9 and all that is not ASCII
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: all but space and tab to carriage return
SOLID = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of texts joined into ``data``: word i is data[start[i]:end[i]]; text k has words first[k]:first[k + 1]."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def words(texts: list[str | None], rule: np.ndarray, seed: int = 0) -> Words:
    """Splits lower-cased (A-Z only) texts into the longest runs of bytes for which ``rule`` holds; None has none.

    Words are hashed with the seed; the hash of a word is never 0.
    """
    raw = [(t or "").encode() for t in texts]
    data = b"\n".join(raw).translate(_LOWER)
    buf = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = rule[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    return Words(data, start, end, np.searchsorted(start, at), _hashes(data, start, end, seed))


def lanes(data: bytes) -> np.ndarray:
    """At each place, the next eight bytes as an integer; zeros follow the end."""
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=data + bytes(8), strides=(1,))


def lane(of: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of words that have more than 8k bytes, as an integer; zeros follow the word's end."""
    x = of[start + 8 * k]
    rest = size - 8 * k
    cut = np.flatnonzero(rest < 8)
    x[cut] &= (np.uint64(1) << (8 * rest[cut]).astype(np.uint64)) - np.uint64(1)
    return x


def _hashes(data: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Eight bytes at a time, each step through a bijection; long words by a keyed digest."""
    of, size = lanes(data), end - start
    out = mix(size.astype(np.uint64) * _BASE + np.uint64(seed))
    todo, k = np.flatnonzero(size <= _LONG), 0
    while len(todo):
        out[todo] = mix((out[todo] ^ lane(of, start[todo], size[todo], k)) * _BASE + np.uint64(k + 1))
        k += 1
        todo = todo[size[todo] > 8 * k]
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=key).digest(), "little")
    out[out == 0] = 1
    return out


def same(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words i of a and words j of b, pair by pair, have the same bytes."""
    size = a.end[i] - a.start[i]
    out = size == b.end[j] - b.start[j]
    left, right, k = lanes(a.data), lanes(b.data), 0
    todo = np.flatnonzero(out & (size <= _LONG))
    while len(todo):
        out[todo] = lane(left, a.start[i[todo]], size[todo], k) == lane(right, b.start[j[todo]], size[todo], k)
        k += 1
        todo = todo[out[todo] & (size[todo] > 8 * k)]
    for n in np.flatnonzero(out & (size > _LONG)).tolist():
        out[n] = a.word(i[n]) == b.word(j[n])
    return out


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cuts a list into ranges of whole items with at most ``most`` together, or a single item."""
    i = total = 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)
