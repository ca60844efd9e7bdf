"""Document quality by Bradley-Terry pairwise ranking.

Scores are linear in features of the text. They are learned from preference pairs (a document of label 1 over one of
label 0) by logistic loss on the difference of their features, which is the Bradley-Terry model. The cut is where it
parts the labelled documents best; as a quantile of the scores of all documents it becomes the score 0.3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interfera.llm.langid import remainder
from interfera.llm.store import checkpoint, small_batches, table, tidy

#: Labelled documents to learn from, at most; the first by a digest of their ids.
SAMPLE = 20_000
#: Preference pairs drawn from them.
PAIRS = 100_000
#: The score at the cut.
CUT = 0.3
QUANTILES = 1000

_KIND = np.full(256, 5)
_KIND[[*range(97, 123)]] = 0
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[32, *range(9, 14)]] = 3
_KIND[[ord(c) for c in ".,;:'\"?()-"]] = 4
_KIND[128:] = 6
FEATURES = 16


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, lengths of words and lines, and how much repeats; an empty text has zeros."""
    raw = (text or "").encode()
    out = np.zeros(FEATURES)
    if not raw:
        return out
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    out[:7] = np.bincount(_KIND, weights=count, minlength=7) / len(raw)
    words = raw.split()
    if not words:
        return out
    n = len(words)
    lower = out[0] + out[6]
    lines = raw.split(b"\n")
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    out[7] = len(set(words)) / n
    out[8] = pairs / max(1, n - 1)
    out[9] = min(1.0, len(raw) / n / 20)
    out[10] = len(set(lines)) / len(lines)
    out[11] = out[1] / (out[1] + lower) if out[1] + lower else 0
    out[12] = sum(w[-1] in b"*#$%&!|~^_+=" for w in words) / n
    out[13] = min(1.0, np.log1p(n) / 10)
    out[14] = count[ord("|")] / n
    out[15] = count[ord("!")] / n
    return out


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights for the features, and the raw score that parts the two labels best (balanced accuracy).

    Without both labels there is nothing to prefer: zero weights, and a cut that keeps all (or, if all are bad, none).
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), -1.0 if len(good) or not len(bad) else 1.0
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0)
    scale[scale < 1e-9] = np.inf
    z = (x - x.mean(axis=0)) / scale
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton, with a ridge
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (p - 1) / pairs + 1e-3 * w
        h = (d * (p * (1 - p))[:, None]).T @ d / pairs + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    s = x @ w
    order = np.argsort(s, kind="stable")
    below_bad = np.concatenate([[0], np.cumsum(y[order] == 0)]) / len(bad)
    above_good = 1 - np.concatenate([[0], np.cumsum(y[order] == 1)]) / len(good)
    edges = np.concatenate([[s[order[0]] - 1], (s[order][1:] + s[order][:-1]) / 2, [s[order[-1]] + 1]])
    ok = np.concatenate([[True], s[order][1:] > s[order][:-1], [True]])
    balance = np.where(ok, below_bad + above_good, -1)
    best = np.flatnonzero(balance >= balance.max() - 1e-12)
    return w, float(edges[best[len(best) // 2]])


def _apply(docs: DataFrame, key: str, text: str, value, schema: str, names: list[str], kinds: list) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = np.array([features(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, k) for v, k in zip(value(x, part), kinds)]], names=["k", *names])

    return docs.mapInArrow(tidy(run), f"k {docs.dtypes[0][1]}, {schema}")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fits on at most ``sample`` labelled keys, the first by a digest of the key; null keys and labels are left out.

    Of a key's labels the smallest counts, of its documents the one whose text has the smallest digest (null last), so
    the model doesn't depend on chance. Without documents or labels of both kinds nothing is learned: see ``fit``.
    """
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    chosen = chosen.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    # bounded by ``sample`` rows
    some = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "k")
    some = some.groupBy("k", "y").agg(F.min_by("t", F.struct(F.col("t").isNull(), F.sha2("t", 256))).alias("t")).select("k", "t", "y")
    found = _apply(some, "k", "t", lambda x, part: [x.tolist(), part.column(2)], "x array<double>, y int", ["x", "y"], [pa.list_(pa.float64()), pa.int32()])
    rows = sorted(found.collect(), key=lambda r: r["k"])  # ``sample`` rows at most
    x = np.array([r["x"] for r in rows]).reshape(len(rows), FEATURES)
    return fit(x, np.array([r["y"] for r in rows], dtype=int))


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key and score for each row: its raw score's quantile among all rows, stretched so that the model's cut
    lies at CUT.

    Null and empty texts have zero features and are scored as any others. Equal raw scores get equal scores. Keys may
    repeat or be null; other columns are ignored, whatever their names; an empty table gives none.
    """
    weights, cut = model
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    raw = checkpoint(_apply(rows, "k", "t", lambda x, part: [x @ weights], "raw double", ["raw"], [pa.float64()]))
    stats = raw.agg(F.percentile_approx("raw", [i / QUANTILES for i in range(QUANTILES + 1)], 10 * QUANTILES).alias("q"), F.avg((F.col("raw") < cut).cast("double")).alias("below")).first()
    q = np.array(stats["q"] if stats["q"] else [cut])
    below = min(max(stats["below"] or 0.0, 1e-6), 1 - 1e-6)
    share = np.linspace(0, 1, len(q)) if len(q) > 1 else np.zeros(1)
    knots, first = np.unique(q, return_index=True)
    last = len(q) - 1 - np.unique(q[::-1], return_index=True)[1]
    share = (share[first] + share[last]) / 2
    left, right = knots < cut, knots > cut
    xs = np.concatenate([knots[left], [cut], knots[right]])
    ys = np.concatenate([CUT * np.minimum(share[left] / below, 1 - 1e-9), [CUT], CUT + (1 - CUT) * np.clip((share[right] - below) / (1 - below), 0, 1)])
    xs, ys = xs.tolist(), np.maximum.accumulate(ys).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column(1).to_numpy(zero_copy_only=False)
            s = np.interp(r, xs, ys)
            s = np.where(r < cut, np.minimum(s, CUT * (1 - 1e-9)), np.maximum(s, CUT))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=[key, "score"])

    return raw.mapInArrow(tidy(run), f"`{key}` {raw.dtypes[0][1]}, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """The rows at or over the cut, all columns as they were; the cut is the same as that of ``score``.

    Null and empty texts have zero features and are judged as any others. Keys aren't read, so repeated rows stay or go
    alike; of an empty table nothing is left.
    """
    weights, cut = model
    at = docs.columns.index(text)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(at).to_pylist()]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(x @ weights >= cut, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_bradley_terry_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, learn(docs, labels.filter(remainder("doc_id", 5) != 0)))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
