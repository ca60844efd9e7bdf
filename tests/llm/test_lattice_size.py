"""op3 over more vectors: copies for each vector, and cells and components of several blocks."""

import numpy as np

from interfera.llm import lattice


def test_copies_of_a_vector():
    """Of 600,000 vectors, as many come with a table of 6 GB, no more than 72 copies are shuffled each."""
    plan = lattice.plan_for(600_000)
    assert plan.tables * (1 + plan.probes) <= 72


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 8)
    rng = np.random.default_rng(5)
    wide, tight = rng.normal(size=(40, 64)), rng.normal(size=64)
    x = np.concatenate([wide, wide[:10] + 0.1 * rng.normal(size=(10, 64)), tight + 0.33 * rng.normal(size=(40, 64)), wide[:3]])
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.array([low[n].min() for n in near])
    assert 0.1 < near[50:90, 50:90].mean() < 0.99
    assert got == {i: (int(near[i].sum()) - 1, int(low[i])) for i in range(len(x))}
