"""Benchmark decontamination by suffix arrays of the training text.

Documents are gathered into shards of up to SHARD words, whole documents always. Each shard gets the suffix array of
its words (to a depth of DEPTH words, or the window if that's more), and every suffix of the benchmark is looked up in
it by binary search. That gives all places of each window and, by extending them, the longest verbatim matches. Words
are numbered by the benchmark's vocabulary: found by a hash, then compared byte by byte, so matches are exact. All
words that the benchmark lacks share one number.

Nothing is shuffled. The benchmark is read by the driver and sent to the tasks in blocks of up to BENCHMARK_BLOCK
bytes of text, one at a time; a larger benchmark takes a pass over the documents, written between, for each block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interfera.llm.store import checkpoint, small_batches, table, tidy
from interfera.llm.words import ALNUM, runs, same, words

WINDOW = 10
SHARD = 1 << 19
DEPTH = 16
BENCHMARK_BLOCK = 8 << 20


def suffix_array(rank: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The positions of ``rank`` (ranks of words, 0: between texts) by the words from there on, to ``depth`` words.

    Prefix doubling. Two ranks and the position share an integer where they fit, so that sorting needs no indirection.
    """
    n = len(rank)
    r = rank.astype(np.uint64)
    bits = max(1, int(n).bit_length())
    step, order = 1, np.argsort(r, kind="stable")
    at = np.arange(n, dtype=np.uint64)
    while step < min(depth, n):
        after = np.zeros(n, dtype=np.uint64)
        after[: n - step] = r[step:]
        width = max(1, int(r.max(initial=0)).bit_length())
        if 2 * width + bits <= 64:
            key = (r << np.uint64(width + bits)) | (after << np.uint64(bits)) | at
            key.sort()
            order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            key >>= np.uint64(bits)
        else:
            order = np.lexsort((after, r))
            key = None
        new = np.empty(n, dtype=bool)
        new[:1] = False
        if key is not None:
            np.not_equal(key[1:], key[:-1], out=new[1:])
        else:
            new[1:] = (r[order][1:] != r[order][:-1]) | (after[order][1:] != after[order][:-1])
        r = np.empty(n, dtype=np.uint64)
        r[order] = np.cumsum(new)
        step *= 2
    return order


class Benchmark:
    """The suffixes of the items: word numbers laid out with one 0 after each item, and each item's windows. Words are
    numbered from 1 in the order of ``known``, their hashes; ``first`` holds a place of each in ``words``."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        for self.seed in itertools.count():  # with a seed that tells all its words apart
            self.words = w = words([t for _, t in items], ALNUM, self.seed)
            self.known, self.first, number = np.unique(w.hash, return_index=True, return_inverse=True)
            if same(w, np.arange(len(w.hash)), w, self.first[number]).all():
                break
        self.names = [str(i) for i, _ in items]
        ranks, start, length, item, at = [], [], [], [], 0
        for k in range(len(items)):
            h = number[w.first[k] : w.first[k + 1]] + 1
            n = len(h)
            ranks += [h, np.zeros(1, np.int64)]
            if n:
                size = min(n, window)
                start.append(at + np.arange(n - size + 1))
                length.append(np.full(n - size + 1, size))
                item.append(np.full(n - size + 1, k))
            at += n + 1
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.rank = join(ranks, np.uint64)
        self.start, self.length, self.item = join(start, np.int64), join(length, np.int64), join(item, np.int64)


def _search(rank: np.ndarray, sa: np.ndarray, query: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the range of the suffix array whose suffixes begin with it."""
    most = int(length.max(initial=0))
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(sa), np.int64)
        while len(todo := np.flatnonzero(lo < hi)):
            mid = (lo[todo] + hi[todo]) // 2
            p, q, n = sa[mid], start[todo], length[todo]
            less, open_ = np.zeros(len(todo), bool), np.ones(len(todo), bool)  # suffix < query; still equal
            for k in range(most):
                open_ &= k < n
                if not open_.any():
                    break
                i = np.flatnonzero(open_)
                a, b = rank[np.minimum(p[i] + k, len(rank) - 1)], query[q[i] + k]
                a = np.where(p[i] + k < len(rank), a, 0)
                less[i] = a < b
                open_[i] = a == b
            if upper:
                less |= _equal(rank, p, query, q, n)
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
        out.append(lo)
    return out[0], out[1]


def _equal(rank: np.ndarray, p: np.ndarray, query: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    same = p + n <= len(rank)
    for k in range(int(n.max(initial=0))):
        i = np.flatnonzero(same & (k < n))
        same[i] = rank[p[i] + k] == query[q[i] + k]
    return same


def match_shard(texts: list[str | None], bench: Benchmark) -> list[tuple[int, list[int], list[str], int, int]]:
    """For each text: its words, the ranges of words hit (start, end, start, end ...), the items with a window in it,
    and the longest match's words and first word."""
    w = words(texts, ALNUM, bench.seed)
    count = np.diff(w.first)
    first = w.first[:-1] + np.arange(len(texts))  # places when a 0 follows each text
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(w.hash)) + doc
    known = bench.known
    found = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
    some = np.flatnonzero(known[found] == w.hash) if len(known) else np.zeros(0, np.int64)
    some = some[same(w, some, bench.words, bench.first[found[some]])]
    rank = np.zeros(len(w.hash) + len(texts), dtype=np.uint64)
    rank[place] = len(known) + 1
    rank[place[some]] = found[some] + 1
    present = np.zeros(len(known) + 2, dtype=bool)
    present[rank.astype(np.int64)] = True
    query = np.where(present[bench.rank.astype(np.int64)], bench.rank, 0)
    # a suffix with an unknown word before its window ends is in no text
    unknown = np.concatenate([[0], np.cumsum(query == 0)])
    todo = np.flatnonzero(unknown[bench.start + bench.length] == unknown[bench.start])
    none = [(int(n), [], [], 0, -1) for n in count]
    if not len(todo) or not len(some):
        return none
    start, length, item = bench.start[todo], bench.length[todo], bench.item[todo]
    sa = suffix_array(rank, max(DEPTH, int(length.max())))
    lo, hi = _search(rank, sa, query, start, length)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return none
    start, length, item, lo, hi = start[some], length[some], item[some], lo[some], hi[some]
    # windows of equal words have the same range: each range is opened once, for its longest window's first suffix
    _, one, which = np.unique(np.stack([lo, hi, length]), axis=1, return_index=True, return_inverse=True)
    which = which.reshape(-1)
    size = hi[one] - lo[one]
    owner = np.repeat(np.arange(len(one)), size)
    p = sa[np.arange(len(owner)) + np.repeat(lo[one] - (np.cumsum(size) - size), size)]
    span, q = length[one][owner], start[one][owner]
    cover = np.zeros(len(rank) + 1, dtype=np.int64)
    np.add.at(cover, p, 1)
    np.add.at(cover, p + span, -1)
    hit = np.zeros(len(rank) + 2, dtype=bool)
    hit[1:-1] = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
    in_doc = np.searchsorted(first, edge[:, 0], side="right") - 1
    edge = edge - first[in_doc, None]
    cut = np.searchsorted(in_doc, np.arange(len(texts) + 1))
    # the longest verbatim match from each place
    long, open_ = span.copy(), np.arange(len(p))
    while len(open_):
        a, b = p[open_] + long[open_], q[open_] + long[open_]
        ok = (a < len(rank)) & (b < len(query))
        ok[ok] = (rank[a[ok]] == query[b[ok]]) & (query[b[ok]] != 0)
        open_ = open_[ok]
        long[open_] += 1
    at_doc = np.searchsorted(first, p, side="right") - 1
    best: dict[int, tuple[int, int]] = {}
    for k in np.lexsort((-p, long)).tolist():
        best[int(at_doc[k])] = (int(long[k]), int(p[k] - first[at_doc[k]]))
    # each document's items: the range's documents, then all items of windows in the range
    pairs = np.unique(np.stack([owner, at_doc]), axis=1) if len(owner) else np.zeros((2, 0), int)
    items: dict[int, list[str]] = {}
    by_range: dict[int, set[str]] = {}
    for g, k in zip(which.tolist(), item.tolist()):
        by_range.setdefault(g, set()).add(bench.names[k])
    for g, d in pairs.T.tolist():
        items.setdefault(d, []).append(g)
    return [(int(n), edge[cut[d] : cut[d + 1]].reshape(-1).tolist(), sorted(set().union(*[by_range[g] for g in items[d]])) if d in items else [], *best.get(d, (0, -1))) for d, n in enumerate(count)]


def _blocks(benchmark: DataFrame, window: int) -> Iterator[tuple]:
    """Broadcasts of the benchmark, each of at most about BENCHMARK_BLOCK bytes of text and made when it's asked for,
    and whether it is the last."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BENCHMARK_BLOCK))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    small_batches(benchmark.sparkSession)
    sc = benchmark.sparkSession.sparkContext
    for b in range(n):
        yield sc.broadcast(Benchmark([tuple(r) for r in rows.filter(part == b).collect()], window)), b + 1 == n


def _shards(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows of several batches together, so that a suffix array is worth its while; bounded by bytes of text."""
    held, size = [], 0
    for batch in batches:
        sizes = [len(t) if t else 1 for t in batch.column(text).to_pylist()]
        for i, j in runs(sizes, 2 * SHARD):
            piece, n = batch.slice(i, j - i), sum(sizes[i:j])
            if held and size + n > 2 * SHARD:
                yield from _one(held, text)
                held, size = [], 0
            held.append(piece)
            size += n
    if held:
        yield from _one(held, text)


def _one(held: list[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    joined = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)
    for batch in joined:
        yield batch, batch.column(text).to_pylist()


def _united(a: list[int], b: list[int]) -> list[int]:
    """The union of two sorted lists of ranges."""
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns for each document key, n_words, n_hit, items (sorted ids), longest_match and longest_at (its words and
    its first word from 0; 0 and -1 without one).

    Null or wordless texts and items have no words and no windows. Items with equal texts are all named; items with
    the same id count as one; an item without id is named "None". Keys may repeat or be null: each row is looked at
    by itself. Empty tables give no rows, or no hits; other columns are ignored, whatever their names. A text of any
    length is one whole; memory follows the longest.
    """
    rows = docs.select(F.col(key).alias("k"), docs[text].cast("string").alias("t"))
    state = "n bigint, ranges array<bigint>, items array<string>, longest bigint, at bigint"
    kind = rows.dtypes[0][1]
    for b, (block, last) in enumerate(_blocks(benchmark, window)):

        def step(batches: Iterator[pa.RecordBatch], block=block, first=b == 0) -> Iterator[pa.RecordBatch]:
            for batch, texts in _shards(batches, 1):
                found = match_shard(texts, block.value)
                if not first:
                    old = [batch.column(c).to_pylist() for c in range(2, 7)]
                    found = [(n, _united(r, x[1]), sorted({*i, *x[2]}), *max((g, a), (x[3], x[4]))) for n, r, i, g, a, x in zip(*old, found)]
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["k", "t", "n", "ranges", "items", "longest", "at"])

        rows = rows.mapInArrow(tidy(step), f"k {kind}, t string, {state}")
        if not last:
            rows = checkpoint(rows)
            block.unpersist()
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, x: x - a)  # ends less starts, for an even number
    return rows.select(F.col("k").alias(key), F.col("n").alias("n_words"), n_hit.alias("n_hit"), "items", F.col("longest").alias("longest_match"), F.col("at").alias("longest_at"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents without any window of the benchmark, all columns as they were.

    Null, empty and wordless texts hold none and stay. Keys aren't read: each row is judged by its own text, so repeated
    rows stay or go alike. Of an empty table nothing is left, of an empty benchmark nothing removes.
    """
    at = docs.columns.index(text)
    for block, last in _blocks(benchmark, window):

        def step(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch, texts in _shards(batches, at):
                yield batch.filter(pa.array([not f[1] for f in match_shard(texts, block.value)], pa.bool_()))

        docs = docs.mapInArrow(tidy(step), docs.schema)
        if not last:
            docs = checkpoint(docs)
            block.unpersist()
    return docs


def op2_suffix_decontam(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = """
w_{t} AS (SELECT {id}, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: true) AS w FROM {t})"""

OP2_SQL = f"""
WITH {_WORDS.format(t="documents", id="doc_id")}, {_WORDS.format(t="benchmark", id="item_id")},
items AS (SELECT CAST(item_id AS VARCHAR) AS item, least(len(w), {WINDOW}) AS size, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' '))) AS win FROM w_benchmark WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM items),
places AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS p, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS win FROM w_documents, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, p, places.size AS size, item FROM places JOIN items USING (win, size)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w_documents d LEFT JOIN hit_words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
