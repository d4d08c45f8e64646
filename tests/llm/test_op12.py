import numpy as np
import pytest
from pyspark.sql import functions as F

from outreach_spark.llm import op12_voronoi_join as op12
from outreach_spark.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF_SMALL
from ..oracle import compare, duck
from .vector_rows import ODD, clustered, hot, integers, table


def plain(rows, k, every):
    keys, m = integers(rows, False)
    out = []
    for a, (i, _) in enumerate(keys):
        if i % every == 0:
            s = m @ m[a]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(sorted((-int(s[b]), keys[b][0]) for b in range(len(keys)) if keys[b][0] != i)[:k])]
    return sorted(out)


def got(spark, rows, k=5, **kw):
    return sorted(tuple(r) for r in op12.top_k(table(spark, rows), F.col("vec_id") % 5 == 0, k=k, **kw).collect())


def test_query_equals_sql(spark):
    assert compare(QUERIES["op12_voronoi_join"](spark, SF_SMALL), duck(SF_SMALL), ORACLE_SQL["op12_voronoi_join"]) > 0


@pytest.mark.parametrize("rows, kw", [
    (clustered(1500), {"n_pivots": 32, "group_rows": 40, "chunk_rows": 200}),
    (hot(900), {"n_pivots": 16, "group_rows": 30, "chunk_rows": 100, "k": 7}),
    (ODD, {"n_pivots": 4}),
    (ODD, {"n_pivots": 1, "group_rows": 1, "chunk_rows": 1})])
def test_cells_groups_chunks_copies_ties_and_odd_rows(spark, rows, kw):
    want = plain(rows, kw.get("k", 5), 5)
    assert want and got(spark, rows, **kw) == want


def test_empty_tables_no_queries_and_few_candidates(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 0)]) == []
    assert got(spark, [(5, [1.0], 0)]) == []
    assert got(spark, [(5, [1.0], 0), (6, [0.5], 0)]) == [(5, 1, 6, 32768)]


def test_bounds_drop_rows_and_lose_none():
    rng = np.random.default_rng(5)
    mids = rng.normal(size=(12, 5)) * 3
    v = np.floor(256 * (mids[rng.integers(12, size=3000)] + rng.normal(size=(3000, 5)) * 0.02))
    p = op12.Pivots(np.unique(v[::100], axis=0), float((v**2).sum(axis=1).max()))
    q, k = v[::10], 4
    d, dq = p.from_rows(v), p.from_queries(q)
    cell, own = d.argmin(axis=1), dq.argmin(axis=1)
    gap = d[np.arange(len(v)), cell]
    reach = np.full(len(p.at), np.nan)
    for c in np.unique(own):
        reach[c] = dq[own == c, c].max()
    summary = [(int(cell[i]), float(gap[i]), int(i)) for c in np.unique(cell) for i in np.flatnonzero(cell == c)[np.argsort(gap[cell == c], kind="stable")[: k + 1]]]
    least = op12.join_bounds(p.between, reach, summary, k) - p.slack
    needed = gap[None, :] >= least[own][:, cell]  # query x row
    assert needed.mean() < 0.9
    best = np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :k]
    assert needed[np.arange(len(q))[:, None], best].all()


def test_groups_merge_near_cells_and_split_hot_ones():
    between = np.abs(np.subtract.outer(np.arange(4.0), np.arange(4.0)))
    groups = op12.group_cells(between, np.array([500, 10, 20, 0]), group_rows=100)
    assert groups == [([0], 5), ([2, 1], 1)]
