"""Near duplicates of vectors by E8 lattice hashing.

A table projects unit vectors on random orthogonal axes, eight for a lattice point, and decodes them to the nearest
points of the E8 lattice: the vector's home cell. It also probes the neighbouring cells whose points come next. Two
vectors are candidates if, in any table, one's home is the other's home or among its probes; candidates near 0.9 in
single precision have their cosine computed in double.

Equal vectors are one class from the start. A cell of more than BLOCK vectors is compared in pairs of blocks, so no
task gets a whole cell; tasks return a spanning forest of the links they find, not the links. These make the components;
links are then counted within each, where every pair is compared in double precision, in blocks again.
"""

from __future__ import annotations

import itertools
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interfera.llm.components import components
from interfera.llm.store import checkpoint, small, small_batches, table, tidy
from interfera.llm.words import mix

LEAST = 0.9
BLOCK = 1 << 14


class Plan(NamedTuple):
    """points: lattice points for a table, which make its cells smaller; scale: the width of a cell. Two vectors of
    cosine 0.9 in 64 dimensions meet in a table with a chance of ``meet``, unlike ones with a chance of ``stray``."""

    points: int
    tables: int
    probes: int
    scale: float
    meet: float
    stray: float


#: By the number of vectors that they're for; a pair of cosine 0.9 is missed with a chance of 5e-7 and 2e-6.
PLANS = [(2_000_000, Plan(1, 8, 8, 0.62, 0.84, 1.1e-2)), (1 << 63, Plan(2, 20, 16, 0.75, 0.48, 6e-4))]


def plan_for(n: int) -> Plan:
    return next(plan for most, plan in PLANS if n <= most)


@cache
def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    f = np.rint(x)
    e = x - f
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    i = np.abs(e[odd]).argmax(axis=1)
    f[odd, i] += np.where(e[odd, i] >= 0, 1, -1)
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: an integer point with an even sum, or such a one moved by a half in all places."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@cache
def _axes(size: int, t: int, points: int, scale: float) -> np.ndarray:
    """A row for each axis."""
    rng = np.random.default_rng([8, size, t])
    width = max(size, 8 * points)
    q, _ = np.linalg.qr(rng.normal(size=(width, 8 * points)))
    return np.ascontiguousarray((q[:size] * np.sqrt(width / 8) / scale).T)


def _name(points: np.ndarray, t: int) -> np.ndarray:
    out = np.full(len(points), t + 1, dtype=np.uint64)
    for k in range(points.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + (2 * points[:, k]).astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def cells(unit: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The home cell in each table (n, tables) and the probed ones (n, tables, probes) of unit vectors. A vector's cells
    don't depend on the others'."""
    n = len(unit)
    homes, probes = np.empty((n, plan.tables), np.int64), np.empty((n, plan.tables, plan.probes), np.int64)
    for t in range(plan.tables):
        x = np.einsum("ij,kj->ik", unit, _axes(unit.shape[1], t, plan.points, plan.scale))
        point = np.concatenate([decode(x[:, 8 * g : 8 * g + 8]) for g in range(plan.points)], axis=1)
        gain = np.concatenate([(x - point)[:, 8 * g : 8 * g + 8] @ _minimal().T for g in range(plan.points)], axis=1)
        # the nearest neighbours, in any order; sums of eight are rounded, as their last digits may vary
        best = np.argpartition(-np.round(gain, 9), plan.probes - 1, axis=1)[:, : plan.probes]
        homes[:, t] = _name(point, t)
        for k in range(plan.probes):
            moved, g = point.copy(), best[:, k] // 240
            for i in range(plan.points):
                rows = np.flatnonzero(g == i)
                moved[rows, 8 * i : 8 * i + 8] += _minimal()[best[rows, k] % 240]
            probes[:, t, k] = _name(moved, t)
    return homes, probes


def _units(vectors: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Unit vectors of packed ones, which are all of one length."""
    v = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ends = np.frombuffer(v.buffers()[1], dtype=np.int32)[v.offset : v.offset + len(v) + 1]
    x = np.frombuffer(v.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(v), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows_of(x: pa.Array, kind: str) -> list[bytes | None]:
    """Each vector as bytes, doubles or, if it was made of them, singles; None for those that link with nothing."""
    out = []
    for v in x.to_pylist():
        a = None if v is None or not v or any(c is None for c in v) else np.array(v, dtype=kind)
        if a is not None and np.isfinite(a).all() and (top := np.abs(a).max()) > 0:
            a = a if kind == "<f4" else a / top  # so that no square of doubles is too large or small
            out.append((a + a.dtype.type(0)).tobytes())
        else:
            out.append(None)
    return out


def _compare(cell: pa.Table, kind: str) -> pa.Table:
    """A spanning forest u, v of the links in a cell's blocks i, j; columns b, i, j, side (0: left, 1: right at home, 2:
    right, a prober), id and x."""
    diagonal = cell["i"][0].as_py() == cell["j"][0].as_py()
    side, ids, unit = cell["side"].to_numpy(), cell["id"].to_numpy(), _units(cell["x"], kind)
    single = unit.astype(np.float32)
    least = LEAST - max(1e-4, 3e-7 * unit.shape[1])  # below what single precision may make of 0.9
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
    root = np.arange(len(ids))
    found: list[tuple[int, int]] = []

    def confirm(a: np.ndarray, b: np.ndarray) -> None:
        for k in range(0, len(a), 1 << 14):
            p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
            apart = root[p] != root[q]
            p, q = p[apart], q[apart]
            ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= LEAST
            for x, y in zip(p[ok].tolist(), q[ok].tolist()):
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    found.append((x, y))

    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        for cols in [right, left[k:]] if diagonal else [right]:
            a, b = np.nonzero(single[rows] @ single[cols].T >= least)
            a, b = rows[a], cols[b]
            if cols is not right:
                a, b = a[a < b], b[a < b]
            for key in (a, b):  # one link of each first, which mostly makes the others known
                one = np.unique(key, return_index=True)[1]
                confirm(a[one], b[one])
            confirm(a, b)
    return pa.table({c: pa.array(ids[[pair[k] for pair in found]] if found else [], pa.int64()) for k, c in enumerate("uv")})


def _count(members: pa.Table, kind: str) -> pa.Table:
    """Columns f, component and n: how many vectors each is linked with. members: small components whole (i is -1), or
    blocks i and j of one; component, i, j, left, id, m, x."""
    i, j = members["i"][0].as_py(), members["j"][0].as_py()
    component, ids, many, unit = members["component"].to_numpy(), members["id"].to_numpy(), members["m"].to_numpy(), _units(members["x"], kind)
    n = np.zeros(len(ids), np.int64)
    order = np.argsort(component, kind="stable")
    if i < j:
        at_left = members["left"].to_numpy(zero_copy_only=False)
        sides = [(np.flatnonzero(at_left), np.flatnonzero(~at_left))]
    else:
        sides = [(rows, rows) for rows in np.split(order, np.flatnonzero(np.diff(component[order])) + 1)]
    for left, right in sides:
        for k in range(0, len(left), 128):
            a, b = left[k : k + 128], right[k:] if i == j else right
            near = unit[a] @ unit[b].T >= LEAST
            if i == j:
                near = np.triu(near, 1)
            n[a] += near @ many[b]
            n[b] += many[a] @ near
    return pa.table({"f": pa.array(ids), "component": pa.array(component), "n": pa.array(n)})


def _spread(rows: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """rows: id, x. A row for the home and each probe in each table: b (cell), probe, id, x."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                homes, probes = cells(_units(part.column(1), kind), plan)
                every = np.concatenate([homes[:, :, None], probes], axis=2)
                index = pa.array(np.repeat(np.arange(part.num_rows), plan.tables * (1 + plan.probes)))
                probe = np.tile(np.arange(1 + plan.probes) > 0, part.num_rows * plan.tables)
                spread = part.take(index)
                yield pa.RecordBatch.from_arrays([pa.array(every.reshape(-1)), pa.array(probe), *spread.columns], names=["b", "probe", "id", "x"])

    return rows.mapInArrow(tidy(run), "b bigint, probe boolean, id bigint, x binary")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Returns key, n_links (other vectors linked directly), component_id and kept for each row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of unlike
    lengths are in different spaces and don't link. Equal vectors link, as do equal directions. Rows of one key count
    as so many vectors, unlike ones each by its own. Null keys are compared as the largest integer of 64 bits and
    shown as null. An empty table
    gives none; other columns are ignored, whatever their names.
    """
    top = (1 << 63) - 1
    small_batches(vectors.sparkSession)
    kind = "<f4" if vectors.select(vector).dtypes[0][1] == "array<float>" else "<f8"
    rows = vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(top)).alias("k"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_rows_of(batch.column(1), kind), pa.binary())], names=["k", "x"])

    # a class of equal vectors is named by a hash of them, not by a key: unlike rows may have the same key, or none
    every = checkpoint(rows.mapInArrow(pack, "k bigint, x binary").withColumn("f", F.when(F.col("x").isNotNull(), F.xxhash64("x"))))
    classes = every.filter("x IS NOT NULL").groupBy("f").agg(F.min("k").alias("c"), F.count(F.lit(1)).alias("m"))
    shape = every.filter("x IS NOT NULL").select("f", "x", F.length("x").alias("size"), F.col("k").alias("c"))
    reps = checkpoint(shape.join(classes, ["f", "c"]).dropDuplicates(["f"]).select(F.col("f").alias("id"), "m", "x", "size"))
    sizes = reps.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()  # a row for each length of vectors
    if not sizes:
        alone = F.when(F.col("k") != top, F.col("k"))
        return every.select(alone.alias(key), F.lit(0).cast("long").alias("n_links"), alone.alias("component_id"), F.lit(True).alias("kept"))
    links = reduce(DataFrame.unionByName, [_found(reps.filter(F.col("size") == size).select("id", "x"), plan_for(n), kind) for size, n in sizes])
    of = checkpoint(classes.join(_counts(reps, components(links), kind), "f", "left").select("f", "c", "m", "n", "component"))
    least = of.filter("component IS NOT NULL").groupBy("component").agg(F.min("c").alias("low"))
    of = of.join(least, "component", "left")
    of = of.select("f", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("low", "c").alias("c"))
    out = every.select("k", "f").join(of, "f", "left").withColumn("c", F.coalesce("c", "k"))
    shown = lambda c: F.when(F.col(c) != top, F.col(c))
    return out.select(shown("k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), shown("c").alias("component_id"), (F.col("k") == F.col("c")).alias("kept"))


def _found(reps: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """Links u, v that connect all that the cells of reps (id, x) do."""
    spread = _spread(reps, plan, kind)
    crowd = spread.groupBy("b").agg(F.sum((~F.col("probe")).cast("long")).alias("home"), F.count(F.lit(1)).alias("all")).filter("home > 0 AND all > 1")
    crowd = checkpoint(crowd.select("b", F.ceil(F.col("all") / BLOCK).cast("int").alias("parts")))
    keyed = spread.join(small(crowd, crowd.count()), "b").withColumn("p", F.expr("cast(pmod(xxhash64(id), parts) AS int)"))
    at_right = "transform(sequence(0, {}), k -> struct(k AS i, p AS j, {} AS side))"
    at_left = "transform(sequence(0, parts - 1), k -> struct(p AS i, k AS j, 0 AS side))"
    places = f"CASE WHEN probe THEN {at_right.format('parts - 1', 2)} WHEN p > 0 THEN concat({at_left}, {at_right.format('p - 1', 1)}) ELSE {at_left} END"
    placed = keyed.select("b", "id", "x", F.explode(F.expr(places)).alias("at")).select("b", "at.i", "at.j", "at.side", "id", "x")
    return checkpoint(placed.groupBy("b", "i", "j").applyInArrow(lambda cell: _compare(cell, kind), "u bigint, v bigint"))


def _counts(reps: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """f, component and n (linked vectors) of those of reps (id, m, x, size) that are found (node, component)."""
    found = checkpoint(found)
    total = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).filter("parts > 1")
    large = checkpoint(total)
    groups = found.count() // BLOCK + 1
    member = reps.join(found, F.col("id") == F.col("node")).join(small(large, large.count()), "component", "left").withColumn("p", F.expr("cast(pmod(xxhash64(id), parts) AS int)"))
    pairs = "concat(transform(sequence(p, parts - 1), k -> struct(p AS i, k AS j, true AS left)), filter(transform(sequence(0, p), k -> struct(k AS i, p AS j, false AS left)), x -> x.i < p))"
    whole = "array(struct(-1 AS i, -1 AS j, true AS left))"
    placed = member.select("size", "component", "id", "m", "x", F.when(F.col("parts").isNull(), F.expr(f"pmod(xxhash64(component), {groups})")).otherwise(F.col("component")).alias("g"), F.explode(F.expr(f"CASE WHEN parts IS NULL THEN {whole} ELSE {pairs} END")).alias("at"))
    placed = placed.select("size", "g", "at.*", "component", "id", "m", "x")
    counted = placed.groupBy("size", "g", "i", "j").applyInArrow(lambda members: _count(members, kind), "f bigint, component bigint, n bigint")
    return counted.groupBy("f", "component").agg(F.sum("n").alias("n"))


def op3_e8_lattice(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, list_transform(e, lambda c: c / sqrt(list_dot_product(e, e))) AS e FROM x
  WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, links.v FROM r JOIN links ON r.v = links.u),
c AS (SELECT u AS vec_id, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
