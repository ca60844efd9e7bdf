"""Language identification by hyperdimensional profiles.

Each letter has a random vector of signs; an n-gram's vector binds (multiplies) its letters' vectors, each permuted
(rotated) by its place; a text bundles (adds) the vectors of its n-grams, a language those of its texts. A text gets
the language whose bundle has the largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interfera.llm.store import small_batches, table, tidy
from interfera.llm.words import mix

DIMENSIONS = 512
GRAM = 3
_CHUNK = 1 << 18
#: Numbers that a table may have in memory.
_TABLE = 1 << 18


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signs that depend on the code point alone; 0 stands for all that is no letter."""
    seed = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dimensions // 64 + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    bits = np.unpackbits(mix(mix(seed)).view(np.uint8), axis=1)
    return (bits.astype(np.float32) * 2 - 1).reshape(len(points), dimensions)


def bundles(texts: list[str | None], group: np.ndarray, groups: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundle of each group of texts; group: of each text. Texts are lower-cased, other runs than letters are one."""
    out = np.zeros((groups, dimensions))
    held, owner, size = [], [], 0
    for t, g in zip(texts, group.tolist()):
        t = f" {(t or '').lower()} "
        for i in range(0, len(t), _CHUNK):  # long texts in pieces that share an n-gram's worth of code points
            piece = t[max(0, i - GRAM + 1) : i + _CHUNK]
            if held and size + len(piece) > _CHUNK:
                _add(out, held, owner, dimensions)
                held, owner, size = [], [], 0
            held.append(piece)
            owner.append(g)
            size += len(piece)
    if held:
        _add(out, held, owner, dimensions)
    return out


def _add(out: np.ndarray, texts: list[str], group: list[int], dimensions: int) -> None:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size) - size
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run without letters, the first
    keep[first] = True
    present = np.flatnonzero(np.bincount(points[keep & letter], minlength=1))
    names = np.append(0, present)
    code = np.zeros(max(int(points.max(initial=0)), 0) + 1, dtype=np.int32)
    code[present] = np.arange(1, len(names))
    at = np.flatnonzero(keep)
    symbol = code[points[at]]
    m, n = len(names), len(at) - GRAM + 1
    if n < 1:
        return
    first = np.searchsorted(at, first)
    gram = symbol[:n].astype(np.int64)
    for k in range(1, GRAM):
        gram = gram * m + symbol[k : k + n]
    owner = np.repeat(np.asarray(group), np.diff(np.append(first, len(at))))[:n]
    inside = np.ones(len(at), dtype=bool)
    for k in range(1, GRAM):
        inside[np.maximum(first[1:] - k, 0)] = False
    gram, owner = gram[inside[:n]], owner[inside[:n]]
    if m**GRAM <= _TABLE:
        seen = np.flatnonzero(np.bincount(gram, minlength=m**GRAM))
        index = np.zeros(m**GRAM, dtype=np.int64)
        index[seen] = np.arange(len(seen))
        gram = index[gram]
    else:
        seen, gram = np.unique(gram, return_inverse=True)
    groups, owner = np.unique(owner, return_inverse=True)
    base = letter_vectors(names, dimensions)
    rolled = [np.roll(base, GRAM - 1 - k, axis=1) for k in range(GRAM)]
    step = max(1, 2 * _TABLE // max(len(groups), dimensions))
    # of each n-gram in order, the texts with it and how often
    pair, times = np.unique(gram * len(groups) + owner, return_counts=True)
    cut = np.searchsorted(pair, np.arange(0, len(seen) + step, step) * len(groups))
    for k, i in enumerate(range(0, len(seen), step)):
        part, vectors = seen[i : i + step], None
        counts = np.zeros((len(part), len(groups)), dtype=np.float32)
        counts.reshape(-1)[pair[cut[k] : cut[k + 1]] - i * len(groups)] = times[cut[k] : cut[k + 1]]
        for g in range(GRAM):
            v = rolled[g][part // m ** (GRAM - 1 - g) % m]
            vectors = v if vectors is None else vectors * v
        out[groups] += counts.T @ vectors


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """The bundle of each language (rows without one are left out): lang, and ``v``, an array of doubles.

    Each task adds up its own rows; the sums of tasks are added natively, in two steps, so no task gets more than a
    short row from each of many.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t")).filter("l IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names, group = np.unique(np.array(batch.column(0).to_pylist(), dtype=object), return_inverse=True)
            for name, v in zip(names, bundles(batch.column(1).to_pylist(), group, len(names), dimensions)):
                total[name] = total.get(name, 0) + v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["l", "v"])

    sums = [F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(dimensions)]
    parts = rows.mapInArrow(tidy(run), "l string, v array<double>").withColumn("salt", F.spark_partition_id() % 64)
    half = parts.groupBy("l", "salt").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dimensions)]).alias("v"))
    return half.groupBy("l").agg(F.array(*sums).alias("v")).select(F.col("l").alias("lang"), "v")


def identify(docs: DataFrame, languages: DataFrame, key: str = "doc_id", text: str = "text", most_languages: int = 10_000) -> DataFrame:
    """Returns key, lang_pred and score (the cosine, 0 at least) for each row.

    ``languages``: from ``profiles``; read by the driver, so at most ``most_languages`` rows, else an error. A text
    that is null or has no letter, or any text when no language is known, gets ``und`` and 0. Ties go to the first
    language by name. Keys may repeat or be null; other columns are ignored, whatever their names; an empty table
    gives none. Whole texts are read, in pieces.
    """
    found = languages.orderBy("lang").limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names = [r["lang"] for r in found]
    dimensions = len(found[0]["v"]) if found else DIMENSIONS
    matrix = np.array([r["v"] for r in found], dtype=np.float64).reshape(len(names), dimensions)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts = part.column(1).to_pylist()
                v = bundles(texts, np.arange(len(texts)), len(texts), dimensions)
                cosine = (v @ matrix.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                has = np.array([t is not None and any(map(str.isalpha, t)) for t in texts]) & (len(names) > 0)
                best = cosine.argmax(axis=1) if names else np.zeros(len(texts), int)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([names[b] if h else "und" for b, h in zip(best, has)], pa.string()), pa.array([min(1.0, max(0.0, float(cosine[k, b]))) if h else 0.0 for k, (b, h) in enumerate(zip(best, has))], pa.float64())],
                    names=[key, "lang_pred", "score"],
                )

    rows = docs.select(key, docs[text].cast("string").alias("text_"))
    return rows.mapInArrow(tidy(run), f"`{key}` {rows.dtypes[0][1]}, lang_pred string, score double")


def remainder(key: str, n: int):
    """The checksum of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def op9_hyperdimensional_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = profiles(docs.filter(remainder("doc_id", 3) != 1))
    out = identify(docs, known)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
