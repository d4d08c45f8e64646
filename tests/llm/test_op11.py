import numpy as np
import pytest
from pyspark.sql import functions as F

from outreach_spark.llm import op11_gnat_negatives as op11
from outreach_spark.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF_SMALL
from ..oracle import compare, duck
from .vector_rows import ODD, clustered, hot, integers, table


def plain(rows, positives, negatives, every):
    """Row loops: (anchor, positive, rank, negative, positive score, negative score)."""
    keys, m = integers(rows, True)
    out = []
    for a, (i, label) in enumerate(keys):
        if i % every:
            continue
        s = [int(x) for x in m @ m[a]]
        for ps, p in sorted((-s[b], k[0]) for b, k in enumerate(keys) if k[0] != i and k[1] == label)[:positives]:
            fits = sorted((-s[b], k[0]) for b, k in enumerate(keys) if k[1] != label and 80 * -ps <= 100 * s[b] <= 100 * -ps)
            out += [(i, p, r + 1, n, -ps, -ns) for r, (ns, n) in enumerate(fits[:negatives])]
    return sorted(out)


def got(spark, rows, **kw):
    return sorted(tuple(r) for r in op11.mine(table(spark, rows), F.col("vec_id") % 5 == 0, **kw).collect())


def test_query_equals_sql(spark):
    assert compare(QUERIES["op11_gnat_negatives"](spark, SF_SMALL), duck(SF_SMALL), ORACLE_SQL["op11_gnat_negatives"]) > 0


@pytest.mark.parametrize("rows, kw", [
    (clustered(1200), {"shard_rows": 200, "degree": 5, "leaf_rows": 10, "block_rows": 60}),
    (hot(900), {"shard_rows": 150, "degree": 4, "leaf_rows": 8, "block_rows": 50, "positives": 3, "negatives": 4}),
    (ODD, {}),
    (ODD, {"shard_rows": 1, "degree": 2, "leaf_rows": 1, "block_rows": 1})])
def test_shards_blocks_copies_ties_and_odd_rows(spark, rows, kw):
    want = plain(rows, kw.get("positives", 5), kw.get("negatives", 5), 5)
    assert want and got(spark, rows, **kw) == want


def test_empty_tables_and_no_anchors(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []


def test_stored_ranges_hold_and_prune():
    rows = clustered(4000)
    ids, v, labels = np.array([r[0] for r in rows]), np.floor(256 * np.array([r[1] for r in rows])), np.array([r[2] for r in rows])
    tree = op11.Gnat.build(ids, labels, v, degree=8, leaf_rows=40)
    wide = np.hstack([tree.points, np.sqrt(np.maximum(tree.top - (tree.points**2).sum(axis=1), 0))[:, None]])
    for node in np.flatnonzero(tree.width):
        w = tree.width[node]
        for i in range(w):
            for j in range(w):
                kid = tree.child[node] + j
                d = np.linalg.norm(wide[tree.lo[kid] : tree.hi[kid]] - wide[tree.split[tree.child[node] + i]], axis=1)
                at = tree.ranges[node] + i * w + j
                assert np.isclose(d.min(), tree.nearest[at]) and np.isclose(d.max(), tree.furthest[at])
    q = v[:200]
    s = q @ v.T
    low, high = np.quantile(s, 0.6, axis=1).round(), np.quantile(s, 0.7, axis=1).round()
    query, found, score, seen = tree.search(q, labels[:200], ids[:200], low, high, 5, False)
    assert seen < 0.9 * s.size  # siblings outside the annulus are never met
    for a in range(200):
        want = sorted((-s[a, b], b) for b in np.flatnonzero((labels != labels[a]) & (s[a] >= low[a]) & (s[a] <= high[a])))[:5]
        assert list(zip(-score[query == a], found[query == a])) == want
