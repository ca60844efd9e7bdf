"""FITS headers and binary tables, by the published standard: what a UVFITS file needs and no more."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

BLOCK, CARD = 2880, 80


@dataclass(frozen=True)
class Card:
    key: str
    value: object = None
    comment: str = ""


def parse_card(text: str) -> Card:
    """A card of 80 characters; one without a value has its text as a comment."""
    key = text[:8].rstrip()
    if text[8:10] != "= ":
        return Card(key, None, text[8:].rstrip())
    rest = text[10:]
    if m := re.match(r"\s*'((?:[^']|'')*)'\s*(?:/\s?(.*))?$", rest):
        return Card(key, m[1].replace("''", "'").rstrip(), (m[2] or "").rstrip())
    raw, _, comment = rest.partition("/")
    return Card(key, number(raw.strip()), comment.strip())


def number(raw: str) -> object:
    """T and F, else a whole number, a real one (D for E too), or the text as it is."""
    if raw in ("T", "F"):
        return raw == "T"
    for kind, text in ((int, raw), (float, raw), (float, re.sub("[dD]", "E", raw))):
        try:
            return kind(text)
        except ValueError:
            pass
    return raw or None


def format_card(card: Card) -> str:
    v = card.value
    if v is None:
        return f"{card.key:<8}{card.comment}"[:CARD].ljust(CARD)
    if isinstance(v, (bool, np.bool_)):
        shown = ("T" if v else "F").rjust(20)
    elif isinstance(v, (int, np.integer)):
        shown = str(int(v)).rjust(20)
    elif isinstance(v, (float, np.floating)):
        shown = repr(float(v)).upper().rjust(20)
    else:
        shown = "'" + str(v).replace("'", "''").ljust(8) + "'"
    return (f"{card.key:<8}= {shown}" + (f" / {card.comment}" if card.comment else ""))[:CARD].ljust(CARD)


def value(cards: list[Card] | tuple[Card, ...], key: str, default: object = None) -> object:
    """The first card's value of that key, trimmed."""
    for c in cards:
        if c.key == key.rstrip() and c.value is not None:
            return c.value.strip() if isinstance(c.value, str) else c.value
    return default


@dataclass(frozen=True)
class Hdu:
    cards: tuple[Card, ...]
    offset: int
    size: int

    @property
    def name(self) -> str:
        return str(value(self.cards, "EXTNAME", ""))


def shape(cards: tuple[Card, ...]) -> list[int]:
    """NAXIS1 and on; of random groups without the 0."""
    n = [int(value(cards, f"NAXIS{i + 1}", 0)) for i in range(int(value(cards, "NAXIS", 0)))]
    return n[1:] if n and n[0] == 0 and value(cards, "GROUPS") is True else n


def hdus(f: BinaryIO) -> list[Hdu]:
    """Where each header's data lie; the data aren't read."""
    out = []
    f.seek(0, 2)
    end = f.tell()
    at = 0
    while at < end:
        cards, done = [], False
        f.seek(at)
        while not done:
            block = f.read(BLOCK)
            if len(block) < BLOCK:
                raise ValueError("a header without its end")
            at += BLOCK
            for i in range(0, BLOCK, CARD):
                text = block[i : i + CARD].decode("ascii", "replace")
                if text[:8].rstrip() == "END":
                    done = True
                    break
                if text.strip():
                    cards.append(parse_card(text))
        dims = shape(tuple(cards))
        items = int(np.prod(dims)) if dims else 0
        groups = int(value(cards, "GCOUNT", 1)) * (items + int(value(cards, "PCOUNT", 0))) if dims else 0
        size = abs(int(value(cards, "BITPIX", 8))) // 8 * groups
        out.append(Hdu(tuple(cards), at, size))
        at += -(-size // BLOCK) * BLOCK
    return out


_CODES = {"A": "S", "E": ">f4", "D": ">f8", "J": ">i4", "I": ">i2", "B": "u1", "K": ">i8", "L": "S1"}


def read_table(f: BinaryIO, hdu: Hdu) -> dict[str, np.ndarray]:
    """A binary table's columns: text, numbers, or matrices of a row each."""
    fields = []
    for i in range(1, int(value(hdu.cards, "TFIELDS", 0)) + 1):
        n, code = re.match(r"(\d*)([A-Z])", str(value(hdu.cards, f"TFORM{i}"))).groups()
        n = int(n) if n else 1
        name = str(value(hdu.cards, f"TTYPE{i}", f"COL{i}"))
        fields.append((f"{i}:{name}", f"S{n}" if code == "A" and n else _CODES[code], () if code == "A" and n else (n,) if n != 1 else ()))
    rows = int(value(hdu.cards, "NAXIS2", 0))
    f.seek(hdu.offset)
    table = np.frombuffer(f.read(int(value(hdu.cards, "NAXIS1", 0)) * rows), dtype=np.dtype(fields), count=rows)
    out = {}
    for name, kind, _ in fields:
        column = table[name]
        out[name.split(":", 1)[1]] = np.char.decode(column, "ascii", "replace") if kind.startswith("S") else column.astype(column.dtype.newbyteorder("="))
    return out


def table_bytes(name: str, columns: dict[str, list | np.ndarray], cards: list[Card]) -> bytes:
    """A binary table of columns of text, numbers or rows of numbers."""
    fields, arrays, forms = [], [], []
    for key, c in columns.items():
        a = np.asarray(c)
        if a.dtype.kind in "US":
            width = max(1, max((len(x) for x in a.tolist()), default=1))
            a = np.array([x.ljust(width) for x in a.tolist()], dtype=f"S{width}")
            fields.append((key, f"S{width}"))
            forms.append(f"{width}A")
        else:
            code, kind = ("J", ">i4") if a.dtype.kind in "iu" else ("E", ">f4") if a.dtype == np.float32 else ("D", ">f8")
            n = a.shape[1] if a.ndim == 2 else 1
            fields.append((key, kind, (n,)) if a.ndim == 2 else (key, kind))
            forms.append(f"{n}{code}")
        arrays.append(a)
    rows = len(arrays[0])
    table = np.zeros(rows, dtype=np.dtype(fields))
    for (key, *_), a in zip(fields, arrays):
        table[key] = a
    head = [Card("XTENSION", "BINTABLE"), Card("BITPIX", 8), Card("NAXIS", 2), Card("NAXIS1", table.dtype.itemsize), Card("NAXIS2", rows), Card("PCOUNT", 0), Card("GCOUNT", 1), Card("TFIELDS", len(fields))]
    for i, ((key, *_), form) in enumerate(zip(fields, forms), 1):
        head += [Card(f"TTYPE{i}", key), Card(f"TFORM{i}", form)]
    return header_bytes([*head, Card("EXTNAME", name), *cards]) + padded(table.tobytes())


def header_bytes(cards: list[Card]) -> bytes:
    text = "".join(map(format_card, cards)) + "END".ljust(CARD)
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("ascii")


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK)
