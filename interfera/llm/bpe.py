"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding by offsets.

Boundaries are found without a regular expression. Each code point has a class; with its neighbours' classes it gives
a symbol, and each symbol is a function on the few states of the tokeniser. Composing these functions is associative,
so the state before every code point comes from a doubling scan over them. The functions that can arise form a small
monoid: its multiplication table is computed once, and a step of the scan is one lookup. A function that sends all
states to one needs no further steps, so only stretches without such a symbol are scanned on.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from interfera.llm.store import small_batches, table, tidy
from interfera.llm.words import runs

LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE = range(6)
#: The code points that Unicode calls white space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: What may follow a quote to form a piece of its own.
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]

# States: what the piece that holds the code point before is made of. SUFFIX_2 and SUFFIX_1: so many letters of a
# contraction are still to come. ENDED: a contraction has just ended. ATTACH: a space that the next run joins.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, ATTACH, SUFFIX_2, SUFFIX_1, ENDED = range(9)
_STATES = 9
# Symbols: the class; for white space, whether it is the last before something else and a space, or last and not a
# space; for quotes, how many letters a contraction would take. S_NEAR: a letter with a quote close before it; no other
# letter can belong to a contraction.
S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_LAST_SPACE, S_LAST_BLANK, S_QUOTE_1, S_QUOTE_2, S_NEAR, S_FIRST = range(10)
_CHUNK = 1 << 18


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this code point."""
    if symbol == S_LETTER:
        return IN_LETTERS, state not in (IN_LETTERS, ATTACH)
    if symbol == S_NEAR:
        if state == SUFFIX_2:
            return SUFFIX_1, False
        if state == SUFFIX_1:
            return ENDED, False
        return IN_LETTERS, state not in (IN_LETTERS, ATTACH)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, ATTACH)
    if symbol == S_OTHER:
        return IN_OTHERS, state not in (IN_OTHERS, ATTACH)
    if symbol in (S_QUOTE_1, S_QUOTE_2):
        if state in (IN_OTHERS, ATTACH):
            return IN_OTHERS, False
        return (SUFFIX_1 if symbol == S_QUOTE_1 else SUFFIX_2), True
    if symbol == S_BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (ATTACH if symbol == S_LAST_SPACE else START), True


@cache
def _monoid() -> tuple[np.ndarray, ...]:
    """Each of 256 bytes long but for the second: the function of each symbol; products; whether a function is
    constant; its value at START; whether a piece starts, by state * S_FIRST + symbol."""
    index: dict[tuple[int, ...], int] = {}

    def of(f: tuple[int, ...]) -> int:
        return index.setdefault(f, len(index))

    symbols = [of(tuple(_step(s, q)[0] for q in range(_STATES))) for s in range(S_FIRST)]
    symbols.append(of((START,) * _STATES))  # S_FIRST: what comes before a text
    products, n = {}, 0
    while n < len(index):  # till products give nothing new
        n = len(index)
        for f in list(index):
            for g in list(index):
                products[index[f], index[g]] = of(tuple(g[x] for x in f))
    mult = np.zeros((n, n), dtype=np.uint8)
    for (f, g), h in products.items():
        mult[f, g] = h
    full = lambda x: np.array([*x, *[0] * 256][:256], dtype=np.uint8)
    starts = [_step(s, q)[1] for q in range(_STATES) for s in range(S_FIRST)]
    return full(symbols), mult, full([len(set(f)) == 1 for f in index]), full([f[START] for f in index]), full(starts)


@cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "\x00" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[WHITE_SPACE] = BLANK
    out[32] = SPACE
    out[39] = QUOTE
    return out


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the code points at which pieces start. first: marks the first code point of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=bool)
    kind = _classes()[points]
    white = (kind == SPACE) | (kind == BLANK)
    ends = np.append(first[1:], True)  # the last code point of its text
    after_white = np.append(white[1:], False)
    symbol = np.full(n, S_OTHER, dtype=np.uint8)
    symbol[kind == LETTER] = S_LETTER
    symbol[kind == NUMBER] = S_NUMBER
    last = white & ~ends & ~after_white
    symbol[white] = S_BLANK
    symbol[last & (kind == SPACE)] = S_LAST_SPACE
    symbol[last & (kind != SPACE)] = S_LAST_BLANK
    quotes = np.flatnonzero(kind == QUOTE)
    if len(quotes):
        for k in (1, 2, 3):
            near = quotes[quotes < n - k] + k
            symbol[near[kind[near] == LETTER]] = S_NEAR
        one, two = np.append(points[1:], 0)[quotes], np.append(points[2:], [0, 0])[quotes]
        has1 = ~ends[quotes]
        has2 = has1 & ~np.append(ends[1:], True)[quotes]
        symbol[quotes[has2 & np.logical_or.reduce([(one == ord(s[0])) & (two == ord(s[1])) for s in SUFFIXES if len(s) == 2])]] = S_QUOTE_2
        symbol[quotes[has1 & np.isin(one, [ord(s) for s in SUFFIXES if len(s) == 1])]] = S_QUOTE_1
    of_symbol, mult, constant, at_start, starts = _monoid()

    # f[i]: from the state before code point i - d, or from anywhere if it's constant, to the state before i
    f = np.empty(n, dtype=np.uint8)
    f[1:] = _through(of_symbol, symbol[:-1])
    f[first] = of_symbol[S_FIRST]
    open_, d = np.flatnonzero(_through(constant, f) == 0), 1
    while len(open_):
        f[open_] = mult[f[open_ - d], f[open_]]  # the right side is read before anything is written
        open_ = open_[constant[f[open_]] == 0]
        d *= 2
    return _through(starts, _through(at_start, f) * np.uint8(S_FIRST) + symbol) != 0


def _through(of: np.ndarray, x: np.ndarray) -> np.ndarray:
    """of[x] for bytes."""
    return np.frombuffer(x.tobytes().translate(of.tobytes()), dtype=np.uint8)


class Merges:
    """Which two tokens make which; a token's id is its rank, and the lowest rank is joined first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.none = max(ranks.values()) + 1

    def __call__(self, piece: bytes) -> list[int]:
        """Joins the neighbours of lowest rank, leftmost first, till none can be joined."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        none, get = self.none, self.ranks.get
        if len(piece) > 64:
            return self._long(piece)
        at = list(range(len(piece) + 1))  # where tokens begin
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            del at[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(piece[at[i - 1] : at[i + 1]], none)
            if i < len(pairs):
                pairs[i] = get(piece[at[i] : at[i + 2]], none)
        return [get(piece[a:b]) for a, b in zip(at, at[1:])]

    def _long(self, piece: bytes) -> list[int]:
        """The same in O(n log n): a heap of pairs over a linked list, whose stale entries are passed over."""
        n, get = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that begins here; end 0: none does
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != to:
                continue
            end[i], end[j] = to, 0
            if to < n:
                before[to] = i
                if (r := get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (p := before[i]) >= 0 and (r := get(piece[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        return [get(piece[i : end[i]]) for i in range(n) if end[i]]


class _Pieces(dict):
    """The ids of each piece met of late, as little-endian 32-bit integers. With ``most`` pieces it begins anew and takes
    over those of the last time that are met again; so it holds twice as many at most, about 20 MB."""

    def __init__(self, ranks: dict[bytes, int], most: int = 50_000):
        super().__init__()
        self.merge, self.most, self.last = Merges(ranks), most, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.last.get(piece)) is None:
            tokens = self.merge(piece.encode())
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.last = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """Encodes and decodes with the ranks of a vocabulary file (base64 of the bytes, and the rank, on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.length = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.pieces = _Pieces(self.ranks)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out, get = [], self.pieces.__getitem__
        for i, j in runs([len(t) for t in texts], _CHUNK):
            joined = "".join(texts[i:j])
            points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
            size = np.array([len(t) for t in texts[i:j]])
            at = np.cumsum(size) - size
            first = np.zeros(len(points), dtype=bool)
            first[at[size > 0]] = True
            cuts = np.flatnonzero(boundaries(points, first) | first)
            edges = np.append(cuts, len(points)).tolist()
            ids = list(map(get, [joined[a:b] for a, b in zip(edges, edges[1:])]))
            where = np.searchsorted(cuts, np.append(at, len(points))).tolist()
            out += [b"".join(ids[a:b]) for a, b in zip(where, where[1:])]
        return out

    def decode(self, ids: bytes) -> tuple[bytes, np.ndarray]:
        """The bytes of the text, and where each token's bytes begin, with the whole length at the end."""
        tokens = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        length = self.length[tokens]
        offset = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.cumsum(length, out=offset[1:])
        if len(tokens) < 4096:
            return b"".join([self.bytes[t] for t in tokens.tolist()]), offset
        shift = np.repeat(self.offset[tokens] - offset[:-1], length)
        return self.flat[shift + np.arange(offset[-1])].tobytes(), offset


@cache
def _encoder(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Returns key, n_tokens, ids_sha256 and decoded_sha256 for each row; with ``ids``, the ids and offsets too.

    ``path`` names the vocabulary on every executor. A null text is as an empty one (no tokens); null keys and
    repeated rows stay as they are, an empty table gives an empty one, and other columns are ignored. Texts of any
    length are encoded whole; memory follows the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in runs([len(t) for t in texts], 2 * _CHUNK):
                coded = bpe.encode(texts[i:j])
                decoded = [bpe.decode(c) for c in coded]
                columns = [
                    batch.column(0).slice(i, j - i), pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([hashlib.sha256(d).hexdigest() for d, _ in decoded]),
                ]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in coded], pa.list_(pa.int32())), pa.array([o for _, o in decoded], pa.list_(pa.int64()))]
                    names += ["ids", "offsets"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    kind = docs.select(key).dtypes[0][1]
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, offsets array<bigint>" * ids
    return docs.select(key, docs[text].cast("string").alias("text_")).mapInArrow(tidy(run), schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
