"""Near duplicates by circulant MinHash.

A document's set of 5-word shingles is hashed to places on a circle of 2^32 (the first permutation); coordinate k of
its signature is the least value that the second permutation, a bijection of these places shifted circularly by k,
gives any of them. The coordinates are cut into bands, and documents that agree on a band are candidates, confirmed on
their full sets of 64-bit shingle hashes.

Documents with the same set (by a digest of 128 bits) are one class from the start; of each class one is compared, so
exact copies cost nothing more. Classes that share bands, directly or not, are a family. A family of up to BLOCK
shingles is one task, which confirms the pairs that share a band and aren't known to be connected, and returns a
spanning forest of the links. No pairs are written.

Of a larger family each class is first compared with the first one of each of its bands, which connects most of a large
group of near copies. What is then not yet one component in some band is compared in blocks of about BLOCK shingles,
two to a task, where large components have blocks of their own that aren't compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interfera.llm.components import components, forest
from interfera.llm.store import checkpoint, small, small_batches, table, tidy
from interfera.llm.words import SOLID, mix, runs, words

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 50 bands of 5: two sets of similarity 0.75 share no band with a chance of 1.3e-6.
BANDS, ROWS = 50, 5
#: Shingles of a block.
BLOCK = 1 << 19
_BYTES = 1 << 20
#: Bands that a task holds at once.
_CHUNK = 1 << 19


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles: five words, or all of them where there are fewer."""
    w = words(texts, SOLID)
    out = []
    n = len(w.hash)
    every = np.zeros(max(0, n - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        every += mix(w.hash[k : k + len(every)] + np.uint64(k + 1)) if len(every) else 0
        every *= np.uint64(0x9E3779B97F4A7C15)
    every = mix(every)
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        if b - a >= SHINGLE:
            s = np.sort(every[a : b - SHINGLE + 1])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            whole = np.uint64(b - a)
            for h in w.hash[a:b]:
                whole = mix(np.array([whole], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + h)[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _second(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingle: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    place = (mix(shingle ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)
    out = np.full(coordinates, (1 << 32) - 1, dtype=np.uint32)
    for i in range(0, len(place), 128):
        np.minimum(out, _second(place[i : i + 128, None] + shift).min(axis=0), out=out)
    return out


def bands(shingle: np.ndarray) -> np.ndarray:
    """A hash of each band of the signature, with the band's number in it."""
    s = signature(shingle).reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
    return out


def _sets(rows: DataFrame, whole: bool = False) -> DataFrame:
    """rows: k, t. Returns k, f (the set's digest; null for an empty set), n and bands; with ``whole`` also set, and
    then rows of a key and a set that a task has seen may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in runs([len(t) if t else 0 for t in texts], _BYTES):
                keys, sets = batch.column(0).slice(i, j - i), shingles(texts[i:j])
                digests = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                if whole:
                    seen = seen if len(seen) < 1 << 16 else set()
                    new = []
                    for at, pair in enumerate(zip(keys.to_pylist(), digests)):
                        if pair not in seen:
                            seen.add(pair)
                            new.append(at)
                    keys, sets, digests = keys.take(pa.array(new, pa.int64())), [sets[at] for at in new], [digests[at] for at in new]
                columns = {
                    "k": keys, "f": pa.array(digests, pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "bands": pa.array([bands(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                }
                if whole:
                    columns["set"] = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(tidy(run), "k bigint, f binary, n bigint, bands array<bigint>" + (", set array<bigint>" if whole else ""))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, n_shingles, component_id (the smallest key reachable over links) and kept (whether that's its own).

    Links have a Jaccard similarity of 0.75 or more. Texts that are null or have no words are linked with nothing.
    Rows of one key and the same text are equal copies: each is returned, and kept if one is; rows of one key with
    unlike texts are compared each by its own. A null key takes part through its
    text but can't represent it: it is compared as the largest integer of 64 bits, and that is what it is reachable
    as; an otherwise unlinked null key has a null component and is kept. Keys are integers. An empty table gives
    none; other columns are ignored, whatever their names. Memory follows the longest text.
    """
    top = (1 << 63) - 1
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(top)).alias("k"), F.col(text).cast("string").alias("t"))
    every = checkpoint(_sets(rows))
    # a class is named by its row's number, as keys may repeat; a row of its smallest key stands for it
    classes = checkpoint(every.filter("n > 0").groupBy("f").agg(F.min("k").alias("k"), F.max("n").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    found = components(_links(classes, _families(every.filter("n > 0")), rows))
    joined = classes.join(found.select(F.col("node").alias("id"), F.col("component").alias("root")), "id")
    least = joined.groupBy("root").agg(F.min("k").alias("component"))
    reached = classes.join(joined.select("id", "root").join(least, "root"), "id", "left").select("f", F.coalesce("component", "k").alias("component"))
    out = every.select("k", "f", "n").join(reached, "f", "left").withColumn("component", F.coalesce("component", "k"))
    shown = lambda c: F.when(F.col(c) != top, F.col(c))
    return out.select(shown("k").alias(key), F.col("n").alias("n_shingles"), shown("component").alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))


def _links(classes: DataFrame, families: DataFrame, rows: DataFrame) -> DataFrame:
    """Confirmed links u, v between classes that connect all that is connected. classes: id, k (a key with that set),
    f (the set's digest) and n of each."""
    named = classes.withColumn("node", F.xxhash64("f"))
    family = checkpoint(named.join(small(families, families.count()), "node"))
    large = checkpoint(family.groupBy("component").agg(F.sum("n").alias("all")).filter(F.col("all") > BLOCK).select("component", F.lit(True).alias("large")))
    family = checkpoint(family.join(small(large, large.count()), "component", "left"))
    # sets are dealt once, by family; there a class has its digest for a name
    few = family.filter("large IS NULL")
    nodes = few.select("node", "component").distinct()
    every = F.lit(True)
    at_once = _sets_of(few, rows).withColumn("node", F.xxhash64("f")).join(small(nodes, nodes.count()), "node")
    at_once = at_once.select("component", F.col("f").alias("id"), "bands", "set").repartition("component").dropDuplicates(["component", "id"])
    found = checkpoint(at_once.withColumns({"left": every, "right": every}).groupBy("component").applyInArrow(_confirm, "u binary, v binary"))
    u, v = (few.select(F.col("f").alias(c), F.col("id").alias(f"{c}_id")) for c in "uv")
    links = checkpoint(found.join(u, "u").join(v, "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v")))
    if not large.take(1):
        return links
    family = family.filter("large").select("component", "id", "k", "f")
    sets = _sets_of(family, rows).select("f", "n", "bands", "set").repartition("f").dropDuplicates(["f"])
    sets = checkpoint(sets.join(family.select("component", "id", "f"), "f").select("component", "id", "n", "bands", "set"))
    family, sets = sets.select("component", "id", "n", "bands"), sets.select("id", "set")
    stars = checkpoint(_stars(family, sets))
    known = components(stars).select(F.col("node").alias("id"), F.col("component").alias("root"))
    rooted = checkpoint(family.join(known, "id", "left").select("id", "n", "bands", F.coalesce("root", "id").alias("root")))
    rest = _unsettled(rooted).join(rooted, "id").select("component", "id", "root", "n", "bands")
    return links.unionByName(stars).unionByName(checkpoint(_in_blocks(checkpoint(rest), sets)))


def _sets_of(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The sets of the rows with the keys of these classes. Other texts of the same keys, which have other digests, are
    among them, and repeated rows."""
    wanted = classes.select("k").distinct()
    return _sets(rows.join(small(wanted, wanted.count()), "k", "left_semi"), whole=True)


def _families(sets: DataFrame) -> DataFrame:
    """node and component of the sets that are connected by shared bands; a set's node is a hash of its digest f, as two
    sets of one node merely make one family of two.

    A band goes to the task that it's dealt to once from each chunk of a task, with one of the nodes that have it
    there. What else has it in the chunk is linked with that node by a band that only these two have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, band, held = [], [], 0
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            node.append(np.repeat(batch.column(0).to_numpy(), BANDS))
            band.append(flat)
            held += len(flat)
            if held >= _CHUNK:
                yield once(np.concatenate(node), np.concatenate(band))
                node, band, held = [], [], 0
        if held:
            yield once(np.concatenate(node), np.concatenate(band))

    def once(node: np.ndarray, band: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((node, band))
        node, band = node[order], band[order]
        first = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        lead = np.repeat(node[first], np.diff(np.append(first, len(band))))
        pairs = np.unique(np.stack([node, lead], axis=1)[node != lead], axis=0)
        tree = np.array([p for p in forest(pairs[:, 0].tolist(), pairs[:, 1].tolist()).items() if p[0] != p[1]], dtype=np.int64).reshape(-1, 2)
        own = mix(mix(tree[:, 0].view(np.uint64)) + tree[:, 1].view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([band[first], own, own])), pa.array(np.concatenate([node[first], tree[:, 0], tree[:, 1]]))], names=["b", "node"])

    dealt = sets.select(F.xxhash64("f").alias("node"), "bands").mapInArrow(tidy(run), "b bigint, node bigint")
    return components(dealt.select(F.lag("node").over(Window.partitionBy("b").orderBy("node")).alias("u"), F.col("node").alias("v")).filter("u <> v"))


def _unsettled(classes: DataFrame) -> DataFrame:
    """id and component of the classes that are connected by bands, where bands whose classes all have the same root
    don't count. classes: id, root and bands."""
    keyed = classes.select("id", "root", F.explode("bands").alias("b"))
    shared = keyed.groupBy("b").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("id").alias("u")).filter("low < high")
    return components(keyed.join(shared, "b").select("u", F.col("id").alias("v"))).select(F.col("node").alias("id"), "component")


def _stars(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links u, v between each class and the first one of each of its bands, where their sets confirm them."""
    keyed = classes.select("id", "n", F.explode("bands").alias("b"))
    first = keyed.groupBy("b").agg(F.min(F.struct("id", "n")).alias("first")).select("b", F.col("first.id").alias("u"), F.col("first.n").alias("m"))
    pairs = keyed.join(first, "b").filter((F.col("id") != F.col("u")) & (100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m"))).select("u", F.col("id").alias("v")).distinct()
    both = pairs.join(sets.select(F.col("id").alias("v"), F.col("set").alias("y")), "v").join(sets.select(F.col("id").alias("u"), F.col("set").alias("x")), "u")
    both = both.select("u", "v", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("c"))
    return both.filter(100 * F.col("c") >= PERCENT * (F.col("m") + F.col("n") - F.col("c"))).select("u", "v")


def _in_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links u, v that connect all that is connected, beside what members of one root are already. members: component
    (the family), id, root, n, bands."""
    # a root of a block or more has blocks of its own; the others of a family share blocks
    by_root = checkpoint(members.groupBy("component", "root").agg(F.sum("n").alias("all")))
    own = by_root.filter(F.col("all") >= BLOCK).select("component", "root", F.ceil(F.col("all") / BLOCK).cast("int").alias("own"))
    pool = by_root.filter(F.col("all") < BLOCK).groupBy("component").agg(F.ceil(F.sum("all") / BLOCK).cast("int").alias("pool"))
    several = pool.filter("pool > 1")
    placed = members.join(small(own, own.count()), ["component", "root"], "left").join(small(several, several.count()), "component", "left")
    placed = placed.withColumn("owner", F.when(F.col("own").isNotNull(), F.col("root")).otherwise(-1)).withColumn("parts", F.coalesce("own", "pool", F.lit(1)))
    placed = placed.select("component", "owner", F.expr("cast(pmod(xxhash64(id), parts) AS int)").alias("p"), "id", "root", "bands")
    parts = own.select("component", F.col("root").alias("owner"), F.col("own").alias("parts")).unionByName(pool.select("component", F.lit(-1).cast("long").alias("owner"), F.col("pool").alias("parts")))
    block = parts.select("component", "owner", F.explode(F.expr("sequence(0, parts - 1)")).alias("p"))
    one, two = (block.select("component", F.struct("owner", "p").alias(c)) for c in "ij")
    meet = one.join(two, "component").filter("i < j OR (i = j AND i.owner = -1)").filter("i.owner <> j.owner OR i.owner = -1")
    sides = meet.select("*", F.explode(F.expr("CASE WHEN i = j THEN array(i) ELSE array(i, j) END")).alias("at"))
    got = sides.join(placed, (sides["component"] == placed["component"]) & (sides["at.owner"] == placed["owner"]) & (sides["at.p"] == placed["p"]))
    got = got.select(sides["component"], "i", "j", (F.col("at") == F.col("i")).alias("left"), (F.col("at") == F.col("j")).alias("right"), "id", "root", "bands")
    return got.join(sets, "id").groupBy("component", "i", "j").applyInArrow(_confirm, "u bigint, v bigint")


def _confirm(block: pa.Table) -> pa.Table:
    """Of two blocks i and j of a family, or one, a spanning forest of the links: pairs that share a band, confirmed on
    their sets if they aren't known to be connected."""
    names = block["id"].combine_chunks()
    size = np.array([len(x) for x in block["set"]], dtype=np.int64)
    flat = block["set"].combine_chunks().values.to_numpy(zero_copy_only=False)
    band = block["bands"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(names), BANDS)
    _, place = np.unique(flat, return_inverse=True)
    first = np.cumsum(size) - size
    left, others = (np.flatnonzero(block[c].to_numpy(zero_copy_only=False)) for c in ("left", "right"))
    alone = len(left) == len(names) == len(others)
    has = np.zeros(int(place.max(initial=-1)) + 1, dtype=bool)
    # of each row, the tree that it's in
    root = np.unique(block["root"].to_numpy(), return_inverse=True)[1] if "root" in block.column_names else np.arange(len(names))
    trees = int(root.max(initial=-1)) + 1
    found: list[tuple[int, int]] = []
    for at, u in enumerate(left):
        if trees == 1:
            break
        right = others[at + 1 :] if alone else others
        right = right[root[right] != root[u]]
        low, high = np.minimum(size[right], size[u]), np.maximum(size[right], size[u])
        right = right[100 * low >= PERCENT * high]
        right = right[(band[right] == band[u]).any(axis=1)]
        if not len(right):
            continue
        mine = place[first[u] : first[u] + size[u]]
        has[mine] = True
        k = 16  # a few at first, as one link may make the others known
        while len(right):
            some, right = right[:k], right[k:]
            k = min(4 * k, 1024)
            n = size[some]
            starts = np.cumsum(n) - n
            index = np.arange(n.sum()) + np.repeat(first[some] - starts, n)
            common = np.add.reduceat(has[place[index]].astype(np.int64), starts)
            for v in some[100 * common >= PERCENT * (n + size[u] - common)].tolist():
                if root[v] != root[u]:
                    root[root == root[v]] = root[u]
                    trees -= 1
                    found.append((u, v))
            right = right[root[right] != root[u]]
        has[mine] = False
    return pa.table({c: names.take(pa.array([pair[k] for pair in found], pa.int64())) for k, c in enumerate("uv")})


def op4_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, links.v FROM r JOIN links ON r.v = links.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
