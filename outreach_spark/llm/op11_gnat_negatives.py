"""Operator 11: hard negatives by a GNAT-style multiway hyperplane tree.

Rows are scaled to integers and dealt into shards of about ``shard_rows`` by a hash of the row. In a shard, rows
equal in vector and label are one point, and the points form a tree: an inner node holds up to ``degree`` split
points, far from each other, and every other point goes to the subtree of the split point nearest to it, so
subtrees lie between hyperplanes. For each pair of siblings (i, j) the node stores the smallest and largest distance from
split point i to the points of subtree j. Leaves hold up to ``leaf_rows`` points. Trees are written as a table.

Largest inner product is nearest distance after one more coordinate (``sqrt(M^2 - |x|^2)`` for a row, 0 for a
query), so a window of scores is an annulus around a query: all rows in it are between ``near`` and ``far`` from the
query. Subtree j is met only if, for every split point i, the interval in which points of the annulus can lie
as seen from i, ``[max(d_i - far, near - d_i), d_i + far]``, intersects the stored range (i, j). As rows are found, the
k-th best score raises the window's lower end, and a subtree is tested again before it is entered. Leaves are
computed exactly: integer products are exact in doubles.

Two searches: an anchor's positives (same label, no window), then for each positive the negatives (other label) whose
scores lie in the window that its own score sets. Queries are packed into blocks of ``block_rows``; every shard gets all
blocks after its tree, as rows of one sorted stream, so a task holds one tree and one block at a time and nothing
passes the driver. The k best per shard are ranked once more by Spark.

Only ``k + 1`` ids of a point can enter a result, so a vector that a third of all rows share costs no more than another.

Defined cases: a row with a null id, label or vector, or a null or non-finite component takes no part; shorter vectors count
as filled up with zeros; scaled components beyond +-2^20 are held there; rows equal in id, label and vector count once;
rows that share an id and differ otherwise are anchors, positives and negatives of their own, but no positive has its
anchor's id; ties go to the smaller id; a window without rows (every negative positive score) gives none; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship_package
from .vectors import best, finite, kth_largest, matrix, pack, padded, scaled, unpack

#: Roots of differences lose half of a double's digits; ranges are widened by this share of the largest norm.
SLACK = 1e-6


class Gnat:
    """The tree over one shard's points, as flat arrays.

    Points are in tree order; node n covers ``lo[n]..hi[n]``. An inner node has ``width[n]`` children from
    ``child[n]`` on, its split points are the first points of its children, and its ranges start at ``ranges[n]``: for
    split point i and subtree j the pair at ``i * width + j``. ``ids`` up to ``ends``: the rows of each point, by id.
    """

    FIELDS = ("points", "labels", "lo", "hi", "child", "width", "ranges", "split", "nearest", "furthest", "ids", "ends", "top")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)
        self.first = self.ids[np.concatenate(([0], self.ends[:-1]))] if len(self.ends) else self.ids
        self.slack = SLACK * (float(self.top) ** 0.5 + 1)

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, degree: int = 16, leaf_rows: int = 128, seed: int = 11) -> Gnat:
        both, where = np.unique(np.hstack([vectors, labels[:, None]]), axis=0, return_inverse=True)
        by_point = np.lexsort((ids, where))
        ids, counts = ids[by_point], np.bincount(where, minlength=len(both))
        points, labels = both[:, :-1], both[:, -1].astype(np.int64)
        square = (points**2).sum(axis=1)
        top = square.max()
        lift = np.sqrt(top - square)
        wide = np.hstack([points, lift[:, None]])

        def distances(rows: np.ndarray, to: int) -> np.ndarray:
            return np.sqrt(((wide[rows] - wide[to]) ** 2).sum(axis=1))

        rng = np.random.default_rng(seed)
        order = np.arange(len(points))
        nodes, nearest, furthest, n_ranges = [[0, len(points), -1, 0, 0, 0]], [], [], 0
        stack = [0]
        while stack:
            me = stack.pop()
            lo, hi = nodes[me][:2]
            if hi - lo <= leaf_rows:
                continue
            mine = order[lo:hi]
            some = rng.choice(mine, min(len(mine), 3 * degree), replace=False)  # split points: each far from those before
            split, gap = [some[0]], distances(some, some[0])
            while len(split) < degree and gap.max() > 0:
                split.append(some[int(gap.argmax())])
                gap = np.minimum(gap, distances(some, split[-1]))
            if len(split) < 2:  # one place under several labels
                continue
            d = np.stack([distances(mine, s) for s in split])
            side = d.argmin(axis=0)
            by = np.argsort(side, kind="stable")
            order[lo:hi], side, d = mine[by], side[by], d[:, by]
            starts = np.searchsorted(side, np.arange(len(split) + 1))
            nodes[me][2:5] = [len(nodes), len(split), n_ranges]
            n_ranges += len(split) ** 2
            nearest.append(np.minimum.reduceat(d, starts[:-1], axis=1).ravel())
            furthest.append(np.maximum.reduceat(d, starts[:-1], axis=1).ravel())
            for a, b, of in zip(starts, starts[1:], split):
                stack.append(len(nodes))
                nodes.append([lo + a, lo + b, -1, 0, 0, of])
        lo, hi, child, width, ranges, split = np.array(nodes).T
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        starts, sizes = np.cumsum(counts) - counts, counts[order]
        take = np.repeat(starts[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (nearest, furthest)]
        return cls(points=points[order], labels=labels[order], lo=lo, hi=hi, child=child, width=width, ranges=ranges, split=place[split], nearest=flat[0], furthest=flat[1],
                   ids=ids[take], ends=np.cumsum(sizes), top=np.array(top))

    def dump(self) -> bytes:
        return pack(**{f: getattr(self, f) for f in self.FIELDS})

    def search(self, q: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The k best rows of each query in its window: (query, id, score), and how many products were computed.

        ``low`` and ``high`` bound the scores (infinite where there is no bound); ``same``: rows of the query's label
        but not of its id ``own``, else rows of another label.
        """
        reach = self.top + (q**2).sum(axis=1)  # distance^2 = reach - 2 score
        kth, top = low.astype(float), np.full((len(q), k + 1), -np.inf)
        near = np.sqrt(np.maximum(reach - 2 * np.where(np.isinf(high), reach / 2, high), 0))
        found: list[tuple] = []
        seen = 0

        def far(rows: np.ndarray) -> np.ndarray:
            return np.where(np.isinf(kth[rows]), np.inf, np.sqrt(np.maximum(reach[rows] - 2 * kth[rows], 0)) + self.slack)

        stack: list[tuple] = [(0, np.arange(len(q)), None)]
        while stack:
            node, rows, away = stack.pop()
            if away is not None:  # found rows may have narrowed the annulus
                rows = rows[away <= far(rows)]
            if not len(rows):
                continue
            lo, hi, w = self.lo[node], self.hi[node], self.width[node]
            seen += len(rows) * (w or hi - lo)
            if not w:
                by_id = lo + np.argsort(self.first[lo:hi], kind="stable")  # ties go to earlier columns
                s = q[rows] @ self.points[by_id].T
                fits = (s >= kth[rows][:, None]) & (s <= high[rows][:, None])
                fits &= (self.labels[by_id][None, :] == labels[rows][:, None]) == same
                s[~fits] = -np.inf
                r, p = best(s, k + 1)
                if len(r):
                    found.append((rows[r], by_id[p], s[r, p]))
                    both = np.hstack([top[rows], s])
                    top[rows] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -k - 1 :]
                    kth[rows] = np.maximum(kth[rows], kth_largest(top[rows], k + 1))
                continue
            kids = np.arange(self.child[node], self.child[node] + w)
            d = np.sqrt(np.maximum(reach[rows][:, None] - 2 * (q[rows] @ self.points[self.split[kids]].T), 0))
            at = slice(self.ranges[node], self.ranges[node] + w * w)
            nearest, furthest = self.nearest[at].reshape(w, w), self.furthest[at].reshape(w, w)
            away = np.zeros((len(rows), w))  # no point of subtree j is nearer to the query than this
            reachable = np.full((len(rows), w), np.inf)  # and none is further than this
            for i in range(w):
                away = np.maximum(away, np.maximum(d[:, i, None] - furthest[i], nearest[i] - d[:, i, None]))
                reachable = np.minimum(reachable, d[:, i, None] + furthest[i])
            alive = (away <= far(rows)[:, None]) & (reachable >= near[rows][:, None] - self.slack)
            for j in np.argsort(-away.mean(axis=0), kind="stable"):  # the nearest subtree is entered first
                if alive[:, j].any():
                    stack.append((kids[j], rows[alive[:, j]], away[alive[:, j], j]))
        query, point, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        good = score >= kth[query]
        query, point, score = query[good], point[good].astype(int), score[good]
        start = np.concatenate(([0], self.ends))[point]
        n = np.minimum(self.ends[point] - start, k + 1)  # ids of a point are in order
        take = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        query, ids, score = np.repeat(query, n), self.ids[take], np.repeat(score, n)
        if same:
            other = ids != own[query]
            query, ids, score = query[other], ids[other], score[other]
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, np.arange(len(q)))[query] < k
        return query[keep], ids[keep], score[keep], seen


def build_index(rows: DataFrame, shard_rows: int, degree: int, leaf_rows: int) -> tuple[DataFrame, int]:
    """Trees of all shards (``shard, data``) as a written table, and the number of shards."""
    shards = max(1, -(-rows.count() // shard_rows))

    def build(table: pa.Table) -> pa.Table:
        tree = Gnat.build(table.column("id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("v")), degree, leaf_rows)
        return pa.table({"shard": table.column("shard")[:1], "data": [tree.dump()]})

    dealt = rows.select("id", "label", "v", F.pmod(F.xxhash64("id", "label", "v"), F.lit(shards)).alias("shard"))
    return cut(dealt.groupBy("shard").applyInArrow(build, "shard long, data binary"), "gnat-trees"), shards


def _blocks(queries: DataFrame, block_rows: int) -> DataFrame:
    """Queries (``no`` to ``high``) packed into blocks of about ``block_rows``: one binary value per block."""
    blocks = max(1, -(-queries.count() // block_rows))

    def put(table: pa.Table) -> pa.Table:
        arrays = {n: table.column(n).to_numpy() for n in ("no", "id", "label", "low", "high")}
        return pa.table({"data": [pack(v=matrix(table.column("v")), **arrays)]})

    return queries.groupBy(F.pmod(F.xxhash64("no"), F.lit(blocks)).alias("block")).applyInArrow(put, "data binary")


def search(trees: DataFrame, shards: int, queries: DataFrame, k: int, same: bool, block_rows: int) -> DataFrame:
    """``no, vec_id, score``: the k best rows per query number and shard.

    Every shard's rows are its tree (``turn`` 0) and then all blocks (1), sorted, so one pass serves them.
    """
    blocks = cut(_blocks(queries, block_rows), "blocks")
    stream = trees.select("shard", F.lit(0).alias("turn"), "data").unionByName(
        blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("turn"), "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for batch in batches:
            for shard, turn, data in zip(*(batch.column(c) for c in ("shard", "turn", "data"))):
                if turn.as_py() == 0:
                    tree, of = Gnat(**unpack(data.as_py())), shard
                elif shard == of:  # a shard that got no rows has no tree
                    b = unpack(data.as_py())
                    q, ids, score, _ = tree.search(b["v"], b["label"], b["id"], b["low"], b["high"], k, same)
                    yield pa.RecordBatch.from_arrays([pa.array(b["no"][q]), pa.array(ids), pa.array(score.astype(np.int64))], names=["no", "vec_id", "score"])

    return stream.repartition("shard").sortWithinPartitions("shard", "turn").mapInArrow(run, "no long, vec_id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: float = 256.0,
         shard_rows: int = 8192, degree: int = 16, leaf_rows: int = 128, block_rows: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding",
         label: Column | str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every row that ``is_anchor`` holds for.

    Negatives have ``window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score``.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where(finite(F.col("v")) & F.col("id").isNotNull() & F.col("label").isNotNull()).withColumn("v", scaled(F.col("v"), scale))
    rows = cut(rows.groupBy("id", "label", "v").agg(F.max("asks").alias("asks")), "integers")
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dims is None:
        return spark.createDataFrame([], out)
    rows = padded(rows, dims)
    trees, shards = build_index(rows, shard_rows, degree, leaf_rows)
    free = F.lit(float("inf"))
    anchors = cut(rows.where("asks").select(F.monotonically_increasing_id().alias("no"), "id", "label", "v", (-free).alias("low"), free.alias("high")), "anchors")

    def first(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    near = first(search(trees, shards, anchors, positives, True, block_rows), positives)
    pairs = near.select(F.col("no").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # floor and ceiling of the window's ends as integer scores
    least, most = -F.floor(F.col("positive_score") * -window[0] / 100), F.floor(F.col("positive_score") * window[1] / 100)
    pairs = pairs.withColumn("low", least.cast("double")).withColumn("high", most.cast("double")).where(F.col("low") <= F.col("high"))
    asked = anchors.select(F.col("no").alias("anchor"), "id", "label", "v")
    windows = cut(pairs.join(asked, "anchor").withColumn("no", F.monotonically_increasing_id()), "windows")
    hard = first(search(trees, shards, windows.select("no", "id", "label", "v", "low", "high"), negatives, False, block_rows), negatives)
    named = hard.select("no", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return windows.select("no", F.col("id").alias("anchor_id"), "positive_id", "positive_score").join(named, "no").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
