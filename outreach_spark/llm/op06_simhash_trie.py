"""Operator 6: SimHash near-duplicates by a binary trie self-join.

Fingerprints: lower-case A-Z, words are runs of non-blank characters, shingles are ``words`` consecutive
words joined by one space (repeats count; fewer words give one shingle of the whole sequence), each
hashed with XXH64 (seed 42); a fingerprint bit is set if it is set in over half of the hashes.

Links: distinct fingerprints within ``max_bits`` differing bits. The 64 bits are cut into
``max_bits + 1`` blocks; two linked fingerprints agree on at least one whole block, so every
fingerprint joins one trie per block, rotated so that this block stands at the root, and the tries of
different block values are independent tasks. In a trie a frontier of node pairs goes down together:
(node, itself) and pairs of siblings, each with the differing bits so far; a pair is pruned as soon as
these exceed ``max_bits``, and small pairs are settled by counting bits. A node is a range of the
sorted keys, so the trie needs no pointers.

Only a spanning forest of each trie's links leaves a task (at most one edge per fingerprint), never all
pairs of a group. Alternating large-star / small-star steps over written tables then give components.

Defined cases: null or empty text has fingerprint zero, linked like any other; repeated rows give
repeated result rows; null ids take part, and a component made only of null ids has a null
``component_id``; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, map_texts

SEED = 42
_BITS = 64
#: Node pairs with at most this many key pairs are settled by counting bits.
_LEAF_PAIRS = 32
#: Frontier entries expanded at once: bounds a task's memory whatever the tries hold.
_CHUNK = 1 << 17


# ---------------------------------------------------------------- fingerprints


def fingerprint(data: bytes, words: int) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    tokens = data.lower().split()  # bytes.lower and bytes.split know ASCII letters and blanks only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-words]))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())), np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of ``hashes``; counted in blocks so that long texts need little memory."""
    counts = np.zeros(_BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        block = hashes[i : i + 8192]
        counts += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes)))


def add_fingerprint(docs: DataFrame, out: str, text_col: str = "text", words: int = 4) -> DataFrame:
    """``docs`` plus the struct column ``out`` with ``fp``, the fingerprint as a signed long."""

    def make():
        return lambda texts: [np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64).tolist()]

    return map_texts(docs, text_col, out, T.StructType([T.StructField("fp", T.LongType())]), make)


# ---------------------------------------------------------------- trie self-join


class _Forest:
    """Union-find over positions; roots are the smallest position of their set."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            s = self.up[r]
            if np.array_equal(s, r):
                break
            r = s
        self.up[at] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def trie_links(keys: np.ndarray, groups: np.ndarray, depth: int, max_bits: int) -> np.ndarray:
    """Root position of every key, linking keys of one group within ``max_bits`` differing bits.

    ``keys``: uint64, sorted by (group, key); the first ``depth`` bits are equal within a group.
    """
    n = len(keys)
    forest = _Forest(n)
    if n < 2:
        return forest.up
    cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    ends = np.concatenate((cuts[1:], [n]))
    big = ends - cuts > 1
    lo, hi = cuts[big], ends[big]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > _CHUNK:
            stack += [(d, *(x[i : i + _CHUNK] for x in (alo, ahi, blo, bhi, err))) for i in range(0, len(alo), _CHUNK)]
            continue
        size = (ahi - alo) * (bhi - blo)
        leaf = (size <= _LEAF_PAIRS) | (d >= _BITS)
        if leaf.any():
            _settle(keys, forest, alo[leaf], ahi[leaf], blo[leaf], bhi[leaf], max_bits, d >= _BITS)
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        amid, bmid = _split(keys, alo, ahi, d), _split(keys, blo, bhi, d)
        same = alo == blo  # a node with itself: its mixed children pair is taken once
        parts = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            tuple(x[~same] for x in (amid, ahi, blo, bmid, err + 1)),
        ]
        a0, a1, b0, b1, e = (np.concatenate(x) for x in zip(*parts))
        live = (a1 > a0) & (b1 > b0) & (e <= max_bits) & ((a0 != b0) | (a1 - a0 > 1))
        if live.any():
            stack.append((d + 1, a0[live], a1[live], b0[live], b1[live], e[live]))
    return forest.roots(np.arange(n))


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
    """First position in each range whose bit ``d`` (from the top) is set, by bisection on all ranges at once."""
    shift = np.uint64(_BITS - 1 - d)
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = ((keys[np.minimum(mid, len(keys) - 1)] >> shift) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _settle(keys: np.ndarray, forest: _Forest, alo, ahi, blo, bhi, max_bits: int, equal: bool) -> None:
    """Link the pairs of small node pairs by counting differing bits (at full depth: link each node's keys)."""
    if equal:
        forest.link(alo, blo)
        return
    na, nb = ahi - alo, bhi - blo
    total = na * nb
    which = np.repeat(np.arange(len(alo)), total)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
    a, b = alo[which] + nth // nb[which], blo[which] + nth % nb[which]
    near = np.bitwise_count(keys[a] ^ keys[b]) <= max_bits
    near &= a != b
    forest.link(a[near], b[near])


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of the ``max_bits + 1`` blocks."""
    n = max_bits + 1
    edges = [i * _BITS // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _link_runs(batches: Iterator[pa.RecordBatch], cuts: list[tuple[int, int]], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, value, fp) sorted by block and value: one edge from each linked fingerprint to its root."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def flush(block: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        out_a, out_b = [], []
        for j, (first, width) in enumerate(cuts):
            own = block == j
            if not own.any():
                continue
            f, v = fp[own], value[own]
            keys = (f << np.uint64(first)) | (f >> np.uint64(_BITS - first)) if first else f
            order = np.lexsort((keys, v))
            f, v, keys = f[order], v[order], keys[order]
            root = trie_links(keys, v, width, max_bits)
            linked = root != np.arange(len(root))
            out_a.append(f[linked])
            out_b.append(f[root[linked]])
        a = np.concatenate(out_a).view(np.int64) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b).view(np.int64) if out_b else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        block, value, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        held.append((block, value, fp.view(np.uint64)))
        rows += len(block)
        if rows < 1 << 18:
            continue
        block, value, fp = (np.concatenate(x) for x in zip(*held))
        keep = np.flatnonzero((block == block[-1]) & (value == value[-1]))[0]  # the last trie may go on in the next batch
        if keep:
            yield flush(block[:keep], value[:keep], fp[:keep])
        held, rows = [(block[keep:], value[keep:], fp[keep:])], len(block) - keep
    if rows:
        yield flush(*(np.concatenate(x) for x in zip(*held)))


def link_fingerprints(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (``a``, ``b``) that connect all distinct ``fp`` within ``max_bits`` bits: a spanning forest per trie."""
    cuts = blocks(max_bits)
    entries = fps.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(j).alias("block"), F.shiftrightunsigned("fp", _BITS - first - width).bitwiseAND(F.lit((1 << width) - 1)).alias("value"), F.col("fp"))
                    for j, (first, width) in enumerate(cuts)
                ]
            )
        ).alias("e")
    ).select("e.*")
    return (
        entries.repartition("block", "value")
        .sortWithinPartitions("block", "value")
        .mapInArrow(lambda it: _link_runs(it, cuts, max_bits), "a long, b long")
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) for the nodes of ``edges`` (``a``, ``b``): root is the smallest reachable node.

    Large-star then small-star per round, each an aggregate of minima joined back on the node, so a hub
    with a third of all nodes is pre-aggregated and its join side can be split. Each round's edges are a
    written table; rounds end when nothing changes.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _components(prints: DataFrame, max_bits: int) -> DataFrame:
    """(``fp``, ``component_id``) for every distinct fingerprint of ``prints`` (``doc_id``, ``fp``)."""
    low = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = connected_components(link_fingerprints(low.select("fp"), max_bits))
    members = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    smallest = members.join(low, "fp").groupBy("root").agg(F.min("low").alias("smallest"))
    linked = members.join(smallest, "root").select("fp", "smallest", F.lit(True).alias("linked"))
    return low.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("low")).alias("component_id"))


def _prints(docs: DataFrame, words: int) -> DataFrame:
    return cut(add_fingerprint(docs, "__f", words=words).select("doc_id", F.col("__f.fp").alias("fp")), "fingerprints")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed long) and ``component_id``."""
    prints = _prints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words)
    return prints.join(_components(prints, max_bits), "fp").select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` without the members of a group beyond its first (smallest id, then smallest text hash).

    Repeated rows of that first document are reduced to one; documents without an id are kept only
    when no row with an id is in their group, and then one of them.
    """
    name = free_name(docs, "row")
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    prints = _prints(docs.select(row.alias("doc_id"), F.col(text_col).alias("text")), words)
    first = _components(prints, max_bits).select(F.col("component_id").alias("__first")).distinct()
    kept = docs.withColumn(name, row).join(first, F.col(name).eqNullSafe(F.col("__first")), "left_semi")
    return kept.dropDuplicates([name]).drop(name)
