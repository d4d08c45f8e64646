"""Small vector tables with odd cases, and the integer vectors that a plain loop makes of them."""

import numpy as np

ODD = [
    (0, None, 1), (5, [1.0, None], 1), (10, [float("nan"), 1.0], 0), (15, [float("inf"), 1.0], 1), (20, [], 1), (25, [0.0, 0.0], 0), (30, [1.0], 1),
    (30, [1.0], 1), (30, [2.0, 1.0], 1), (30, [1.875, 1.0], 0), (35, [1e30, -1e30], 1), (None, [1.0, 2.0], 1), (41, [-1.0, -1.0], 0),
    (-45, [0.001, -0.001], 0), (3, [1.0, 1.0, 1.0], 1), (4, [1.0, 0.75, 1.0], 0), (6, [1.0, 0.75], None)]


def clustered(n, dims=6, centres=20, seed=1):
    rng = np.random.default_rng(seed)
    mids = rng.normal(size=(centres, dims))
    return [(i, [float(x) for x in mids[rng.integers(centres)] + rng.normal(size=dims) * 0.05], int(rng.integers(3))) for i in range(n)]


def hot(n, seed=2):
    """Two thirds of the rows share one vector."""
    rng = np.random.default_rng(seed)
    return [(i, [0.5, 0.25, -0.5] if i % 3 else [float(x) for x in rng.normal(size=3)], i % 4) for i in range(n)]


def table(spark, rows):
    """With columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, label int, id string, score int")


def integers(rows, labelled):
    """Distinct (id, label, integer vector) of the rows that take part, and the matrix of all vectors."""
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or None in v or not np.isfinite(v).all() or (labelled and label is None):
            continue
        whole = np.clip(np.floor(256 * np.array(v, np.float32).astype(float)), -(2**20), 2**20).astype(int)
        seen[i, label if labelled else 0, tuple(whole.tolist())] = True
    dims = max((len(v) for *_, v in seen), default=0)
    keys = list(seen)
    return [(i, label) for i, label, _ in keys], np.array([[*v, *[0] * (dims - len(v))] for *_, v in keys])
