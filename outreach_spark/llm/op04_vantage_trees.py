"""Operator 4: nearest neighbours by inner product with vantage-point trees, one per shard.

Largest inner product becomes nearest Euclidean neighbour by one more coordinate: a vector x gets
``sqrt(M^2 - |x|^2)`` (M: the largest norm), a query gets 0. Vectors are dealt into shards of about
``shard_rows`` by a hash of the id. In a shard, equal vectors are one point with the list of their ids, and
the points form a vantage-point tree: a node holds a vantage point, and splits the rest at the median
distance to it; leaves hold up to ``leaf_rows`` points. Trees are written as a table (the index).

Queries are packed into blocks of ``block_rows``, one binary value each, written as a table. Every shard gets all blocks
after its tree, as rows of one sorted stream, so a task holds one tree and one block at a time and no vector
passes the driver. A block goes through a tree together: each node meets the queries that still need it,
nearer side first, and a query skips a side when the triangle inequality, relaxed by ``factor``, says that
nothing there beats its k-th best: when ``factor`` times its k-th distance is less than its distance to the
boundary. Factor 1 is exact; smaller factors prune more. Found candidates are scored again from the
original vectors, in double precision and coordinate order.

Only ``k + 1`` ids of a point can enter a result (equal scores go to smaller ids, and a query skips itself),
so a vector that a third of all rows share costs no more than another.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, rows without an id neither;
shorter vectors count as filled up with zeros; rows equal in id and vector count once; rows that share an id with
different vectors are queries and candidates of their own, but never of a query with that id; ties go to the smaller id;
with fewer candidates than k all are returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship_package
from .vectors import matrix, pack, padded, unpack


def valid(vec: Column) -> Column:
    """Non-null, non-zero and finite throughout."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


# ---------------------------------------------------------------- tree


class Tree:
    """A vantage-point tree over distinct points, as flat arrays.

    ``points``: original vectors in tree order; node i covers points ``lo[i]..hi[i]``. An inner node's first
    point is its vantage point, ``inner[i]`` its nearer child, ``outer[i]`` the other one, ``edge_*`` the
    largest distance inside and the smallest outside. ``ids`` and ``ends``: the rows of each point, by id.
    """

    FIELDS = ("points", "lift", "lo", "hi", "inner", "outer", "edge_in", "edge_out", "ids", "ends")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)
        self.wide = np.hstack([self.points, self.lift[:, None]])
        self.square = np.einsum("ij,ij->i", self.wide, self.wide)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, top_norm: float, leaf_rows: int, seed: int = 7) -> Tree:
        points, where = np.unique(vectors, axis=0, return_inverse=True)
        by_point = np.lexsort((ids, where))
        ids, counts = ids[by_point], np.bincount(where, minlength=len(points))
        lift = np.sqrt(np.maximum(top_norm**2 - np.einsum("ij,ij->i", points, points), 0))
        wide = np.hstack([points, lift[:, None]])
        rng = np.random.default_rng(seed)
        order = np.arange(len(points))
        nodes: list[list] = []
        stack = [(0, len(points), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            me = len(nodes)
            nodes.append([lo, hi, -1, -1, 0.0, 0.0])
            if parent >= 0:
                nodes[parent][2 + side] = me
            if hi - lo <= max(leaf_rows, 8):
                continue
            some = rng.choice(np.arange(lo, hi), 5, replace=False)
            spread = [np.var(np.linalg.norm(wide[order[rng.choice(np.arange(lo, hi), 40)]] - wide[order[s]], axis=1)) for s in some]
            s = some[int(np.argmax(spread))]
            order[lo], order[s] = order[s], order[lo]
            d = np.linalg.norm(wide[order[lo + 1 : hi]] - wide[order[lo]], axis=1)
            by = np.argsort(d, kind="stable")
            order[lo + 1 : hi] = order[lo + 1 : hi][by]
            mid = lo + 1 + len(by) // 2
            nodes[me][4:] = [d[by[mid - lo - 2]], d[by[mid - lo - 1]]]
            stack += [(lo + 1, mid, me, 0), (mid, hi, me, 1)]
        lo, hi, inner, outer, edge_in, edge_out = (np.array(x) for x in zip(*nodes))
        starts = np.cumsum(counts) - counts
        sizes = counts[order]
        take = np.repeat(starts[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
        return cls(points=points[order], lift=lift[order], lo=lo, hi=hi, inner=inner, outer=outer, edge_in=edge_in, edge_out=edge_out, ids=ids[take], ends=np.cumsum(sizes))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as got:
            return cls(**{f: got[f] for f in cls.FIELDS})

    def search(self, queries: np.ndarray, kth: np.ndarray, k: int, factor: float, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray, int]:
        """Candidate pairs (query row, point) that may belong to the k best, and how many products were computed.

        ``kth``: each query's k-th largest product so far, raised in place; it carries over to the next tree. A
        point counts as one here though more rows may share it. As a query may itself be among the rows,
        callers ask for one more than they need.
        """
        n = len(queries)
        top = np.full((n, k), -np.inf)
        found_q, found_p, found_s = [], [], []
        both_squares = np.einsum("ij,ij->i", queries, queries) + self.square[0]  # lifted points have one norm
        seen = 0

        def meet(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
            nonlocal seen
            seen += len(rows) * (hi - lo)
            s = queries[rows] @ self.points[lo:hi].T
            hits = s >= (kth[rows] - slack)[:, None]
            some = np.flatnonzero(hits.any(axis=1))
            if len(some):
                at, hits = rows[some], hits[some]
                both = np.hstack([top[at], np.where(hits, s[some], -np.inf)])
                top[at] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kth[at] = np.maximum(kth[at], top[at].min(axis=1))
                r, p = np.nonzero(hits & (s[some] >= (kth[at] - slack)[:, None]))
                found_q.append(at[r])
                found_p.append(lo + p)
                found_s.append(s[some][r, p])
            return s

        stack: list[tuple] = [(0, np.arange(n), None)]
        while stack:
            node, rows, gap = stack.pop()
            if gap is not None:  # what lies beyond the boundary is at least this far away
                reach = np.sqrt(np.maximum(both_squares[rows] - 2 * kth[rows], 0))
                rows = rows[gap <= factor * reach + slack]
            if not len(rows):
                continue
            lo, hi = self.lo[node], self.hi[node]
            if self.inner[node] < 0:
                meet(rows, lo, hi)
                continue
            d = np.sqrt(np.maximum(both_squares[rows] - 2 * meet(rows, lo, lo + 1)[:, 0], 0))
            to_in, to_out = np.maximum(d - self.edge_in[node], 0), np.maximum(self.edge_out[node] - d, 0)
            nearer = to_in <= to_out
            a, b = self.inner[node], self.outer[node]
            # a side whose boundary the query is inside of has gap 0 and is always met; it goes first
            stack += [(b, rows[nearer], to_out[nearer]), (a, rows[~nearer], to_in[~nearer]), (a, rows[nearer], to_in[nearer]), (b, rows[~nearer], to_out[~nearer])]
        q, p, s = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((found_q, np.int64), (found_p, np.int64), (found_s, float)))
        keep = s >= kth[q] - slack
        return q[keep], p[keep], seen


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added from the first coordinate to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


# ---------------------------------------------------------------- index and search


def build_index(vectors: DataFrame, shard_rows: int = 8192, leaf_rows: int = 256) -> tuple[DataFrame, int]:
    """Trees of all shards (``shard, data``) as a written table, and the number of shards. ``vectors``: ``id``, ``v``."""
    rows, norm = vectors.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()
    shards = max(1, -(-rows // shard_rows))

    def build(table: pa.Table) -> pa.Table:
        tree = Tree.build(table.column("id").to_numpy(), matrix(table.column("v")), norm, leaf_rows)
        return pa.table({"shard": table.column("shard")[:1], "data": [tree.dump()]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)))
    return cut(dealt.groupBy("shard").applyInArrow(build, "shard long, data binary"), "vantage-trees"), shards


def query_blocks(queries: DataFrame, block_rows: int) -> DataFrame:
    """Queries (``no, id, v``) packed into blocks of about ``block_rows``, written."""
    blocks = max(1, -(-queries.count() // block_rows))

    def put(table: pa.Table) -> pa.Table:
        return pa.table({"data": [pack(no=table.column("no").to_numpy(), id=table.column("id").to_numpy(), v=matrix(table.column("v")))]})

    return cut(queries.groupBy(F.pmod(F.xxhash64("no"), F.lit(blocks)).alias("block")).applyInArrow(put, "data binary"), "query-blocks")


def search_tree(tree: Tree, no: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
    """The k best rows of one shard for each query of one block (``no``: the query's number)."""
    q, p, _ = tree.search(queries, np.full(len(ids), -np.inf), k + 1, factor)
    score = in_order(queries[q], tree.points[p])
    first = np.concatenate(([0], tree.ends[:-1]))[p]
    n = np.minimum(tree.ends[p] - first, k + 1)  # ids of a point are in order
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    q, v, s = np.repeat(q, n), tree.ids[at], np.repeat(score, n)
    other = ids[q] != v
    q, v, s = q[other], v[other], s[other]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, np.arange(len(ids)))[q] < k
    return pa.RecordBatch.from_arrays([pa.array(no[q[keep]]), pa.array(ids[q[keep]]), pa.array(v[keep]), pa.array(s[keep])], names=["no", "query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = 8192, leaf_rows: int = 256, block_rows: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    ship_package(spark)
    wide = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    wide = cut(wide.where(valid(F.col("v")) & F.col("id").isNotNull()).groupBy("id", "v").agg(F.max("asks").alias("asks")), "vectors")
    dims = wide.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wide = padded(wide, dims, fill=0.0)
    trees, shards = build_index(wide.select("id", "v"), shard_rows, leaf_rows)
    asking = cut(wide.where("asks").select(F.monotonically_increasing_id().alias("no"), "id", "v"), "queries")
    blocks = query_blocks(asking, block_rows)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    stream = trees.select("shard", F.lit(0).alias("turn"), "data").unionByName(blocks.select(every, F.lit(1).alias("turn"), "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for batch in batches:
            for shard, turn, data in zip(*(batch.column(c) for c in ("shard", "turn", "data"))):
                if turn.as_py() == 0:
                    tree, of = Tree.load(data.as_py()), shard
                elif shard == of:  # a shard that got no rows has no tree
                    b = unpack(data.as_py())
                    yield search_tree(tree, b["no"], b["id"], b["v"], k, factor)

    found = stream.repartition("shard").sortWithinPartitions("shard", "turn").mapInArrow(run, "no long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
