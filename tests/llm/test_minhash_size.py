"""op4: what it writes for a document, chunks of a task, repeated rows and keys, more rows than may be broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from interfera.llm import minhash, store


def near(n, groups, words=60, seed=3):
    """Texts of a few groups, each a text of its group with up to two words changed."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t = [f"g{i % groups}w{k}" for k in range(words)]
        for k in rng.choice(words, size=rng.integers(0, 3), replace=False):
            t[k] = f"n{i}"
        out.append(" ".join(t))
    return out


def smallest(rows):
    """Of each row of keys and texts, the smallest key reachable over links, by brute force."""
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    low = [k for k, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while True:
        before = list(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def test_shuffle_of_a_document(spark):
    """A document's bands are dealt once, and the sets of near copies once: under 1,600 bytes for texts of 2 kB."""
    n = 3000
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.hex(F.xxhash64("id", i)).substr(1, 9), F.when((i == 7) & (F.col("doc_id") % 10 == 0), F.lit("x")).otherwise(F.lit("")))))
    docs = store.checkpoint(spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("id")).select("doc_id", text.alias("text")))
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    got = minhash.near_duplicates(docs).collect()
    assert (written() - before) / n < 1600
    assert all(r.component_id == r.doc_id - (r.doc_id % 10 == 1) for r in got) and len(got) == n


@pytest.mark.parametrize("chunk, ids, block", [(1 << 19, 2_000_000, 1 << 19), (100, 0, 400)])
def test_chunks_and_repeated_rows(spark, monkeypatch, chunk, ids, block):
    """Near copies in one chunk and in many; rows repeated, keys of several texts."""
    monkeypatch.setattr(minhash, "_CHUNK", chunk)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(store, "BROADCAST_IDS", ids)
    texts = near(60, 4)
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(3, texts[6])] * 20 + [(0, texts[59]), (29, texts[0])]
    want = sorted((k, len(set(zip(*[t.split()[j:] for j in range(5)]))), low) for (k, t), low in zip(rows, smallest(rows)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()) == want


def test_keys_that_are_all_null(spark):
    got = minhash.near_duplicates(spark.createDataFrame([(None, t) for t in near(60, 4)], "doc_id long, text string")).collect()
    assert len(got) == 60 and all(r.component_id is None and r.kept for r in got)
