"""Operator 13: resampling towards a target distribution by importance weights over hashed features.

A text's features are its runs of 1 to ``max_run`` consecutive words, repeats included, hashed by crc32 of their
UTF-8 bytes into ``n_buckets``. The hashes come from length-bucketed CRC matrices: the distinct features that a
task has not met before are grouped by byte length, each group is one two-dimensional uint8 array, all its
CRCs are updated column by column through one table of 256 entries, and the buckets are scattered back to
the features' places; features beyond 64 bytes are cut into rows of 64 whose CRCs are joined. The bucket of a feature met before is looked up (a bounded table; when it is full it starts
anew, which costs time only).

One pass over the texts writes each document's buckets as a table; Spark sums its counts per bucket over all
documents, and those of the target texts, into one gain per bucket (``n_buckets`` numbers, the only thing
that passes the driver). A second pass over the written buckets, not the texts, sums the gains to weights. A
Gumbel draw from a hash of the document's id turns weights into scores, so taking the highest scores samples
without replacement in proportion to the importance weights. The rank is global and needs no global
sort in one task: scores are range-partitioned, sorted and written, and a row's rank is its place in its
range plus the rows of the ranges before it.

Defined cases: a null text has no words; an empty one neither; texts below ``min_words`` are scored and never drawn;
a null id draws as the empty text does; rows with one id are documents of their own and share their draw; ties go to
the smaller id, null ids last, then to the smaller count of features and the place in the table; empty tables (either) give gains from the
add-one counts alone, and no rows for no documents; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship_package, slices

#: Bytes of words (digits, letters, everything beyond ASCII) to themselves in lower case, all others to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The CRC-32 step for every value of the low byte: eight shifts by the reflected polynomial.
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, (_STEP >> np.uint32(1)) ^ np.uint32(0xEDB88320), _STEP >> np.uint32(1))
#: Features beyond this many bytes are cut into rows of so many.
_ROW = 64
#: Slices of texts and tables of known features hold about this many bytes and features.
_SLICE = 4 << 20
_KNOWN = 1 << 19


def _columns(block: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The CRC registers of all rows of a matrix of bytes, updated column by column."""
    for column in block.T:
        crc = _STEP[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc


def _shift(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Registers moved on over zero bytes; ``table[i, b]``: what byte ``b`` at place ``i`` of a register becomes."""
    return table[0, crc & 0xFF] ^ table[1, (crc >> np.uint32(8)) & 0xFF] ^ table[2, (crc >> np.uint32(16)) & 0xFF] ^ table[3, crc >> np.uint32(24)]


def _long(features: list[bytes], rows: int) -> np.ndarray:
    """CRC-32 of long features that fill up to ``rows`` (a power of two) rows of ``_ROW`` bytes.

    A register that starts at 0 passes over leading zeros unchanged, so the features are filled up in front (their
    first four bytes inverted in place of the usual start), all rows of all features are one matrix, and
    neighbouring rows join in pairs: the left one is shifted by the right one's length, which doubles each time."""
    data = np.zeros((len(features), rows * _ROW), np.uint8)
    for line, f in zip(data, features):
        line[-len(f) :] = np.frombuffer(f, np.uint8)
        line[-len(f) : rows * _ROW - len(f) + 4] ^= 0xFF
    crc = _columns(data.reshape(-1, _ROW), np.zeros(len(features) * rows, np.uint32))
    table = np.stack([_columns(np.zeros((256, _ROW), np.uint8), np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])
    while len(crc) > len(features):
        crc = _shift(table, crc[0::2]) ^ crc[1::2]
        table = _shift(table, table)
    return ~crc


def crc_matrices(features: list[bytes]) -> np.ndarray:
    """CRC-32 of every feature: one matrix per byte length (beyond ``_ROW`` bytes, per number of rows)."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    rows = 1 << np.ceil(np.log2(np.maximum(-(-lengths // _ROW), 1))).astype(np.int64)
    sizes = np.where(lengths <= _ROW, lengths, rows * _ROW)
    order = np.argsort(sizes, kind="stable")
    out = np.zeros(len(features), np.uint32)
    found, starts = np.unique(sizes[order], return_index=True)
    for size, lo, hi in zip(found.tolist(), starts, [*starts[1:], len(features)]):
        same = [features[i] for i in order[lo:hi]]
        if size > _ROW:
            out[order[lo:hi]] = _long(same, size // _ROW)
        else:
            block = np.frombuffer(b"".join(same), np.uint8).reshape(len(same), size)
            out[order[lo:hi]] = ~_columns(block, np.full(len(same), 0xFFFFFFFF, np.uint32))
    return out


class Hasher:
    """Features of texts to buckets."""

    def __init__(self, max_run: int, n_buckets: int) -> None:
        self.max_run, self.n_buckets, self.known = max_run, n_buckets, {}

    def features(self, text: bytes) -> tuple[int, list[bytes]]:
        words = text.translate(_FOLD).split()
        runs = words
        for n in range(2, self.max_run + 1):
            runs = runs + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        return len(words), runs

    def buckets(self, features: list[bytes]) -> np.ndarray:
        if len(self.known) > _KNOWN:
            self.known = {}
        known = self.known
        new = list(set(features).difference(known))
        if new:
            known.update(zip(new, (crc_matrices(new) % np.uint32(self.n_buckets)).tolist()))
        out = np.fromiter(map(known.__getitem__, features), np.int32, len(features))
        for f in new:
            if len(f) > 4 * _ROW:  # long ones are not kept
                del known[f]
        return out


def hashed(docs: DataFrame, text_col: str, max_run: int, n_buckets: int) -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``n_words`` and ``buckets`` (little-endian 32-bit, one per feature)."""
    ship_package(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(*rest, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(max_run, n_buckets)
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            for lo, hi in slices(texts, _SLICE):
                made = [hasher.features(t) for t in texts[lo:hi]]
                flat = hasher.buckets([f for _, fs in made for f in fs]).astype("<i4").tobytes()
                ends = (4 * np.cumsum([0] + [len(fs) for _, fs in made])).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], pa.array([w for w, _ in made], pa.int64()),
                     pa.array([flat[a:b] for a, b in zip(ends, ends[1:])], pa.binary())],
                    names=[*rest, "n_words", "buckets"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema.fields)
    return rows.mapInArrow(run, f"{kept + ', ' if rest else ''}n_words long, buckets binary")


def _counts(rows: DataFrame, n_buckets: int) -> DataFrame:
    """``bucket, n`` over all rows; every task sends one row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_py(), "<i4"), minlength=n_buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """The gain of every bucket (``n_buckets`` numbers) from the two tables of hashed texts."""
    both = _counts(source, n_buckets).withColumnRenamed("n", "s").join(_counts(target, n_buckets).withColumnRenamed("n", "t"), "bucket", "full")
    found = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).collect()  # at most n_buckets rows
    s, t = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
    for r in found:
        s[r.bucket], t[r.bucket] = r.s, r.t
    up, down = (t + 1).astype(float) * float(s.sum() + n_buckets), (s + 1).astype(float) * float(t.sum() + n_buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def _weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """The hashed rows with ``n_features`` and ``weight`` instead of ``buckets``."""
    rest = [c for c in rows.columns if c != "buckets"]
    sent = rows.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b.as_py(), "<i4") for b in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array([len(x) for x in ids], pa.int64()), pa.array([int(sent.value[x].sum()) for x in ids], pa.int64())],
                names=[*rest, "n_features", "weight"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema.fields)
    return rows.mapInArrow(run, f"{kept}, n_features long, weight long")


def gumbel(id_col: str, seed: str) -> Column:
    """The draw of an id: ``floor(-1000 ln(-ln((h + 0.5) / 2^32)))``, h from sha256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def global_ranks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given order: range partitions, sorted and written; a row's rank is its
    place in its part plus the rows of earlier parts (one number per part)."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    joined = placed.withColumn("__part", part).join(starts, "__part")
    return joined.withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__before", "__at")


def resample(docs: DataFrame, target: DataFrame, max_run: int = 1, n_buckets: int = 10000, min_words: int = 20, percent: int = 10,
             seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``id, n_features, weight, score, rank`` of every document; ``rank`` is null where it is not drawn.

    Of the N documents with ``min_words`` words or more the ``floor(percent N / 100)`` with the highest scores are drawn.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__words"))
    source = cut(hashed(rows, "__words", max_run, n_buckets), "buckets")
    aim = hashed(target.select(F.col(target_col).alias("__words")), "__words", max_run, n_buckets)
    scored = _weights(source, gains(source, aim, n_buckets)).withColumn("score", F.col("weight") + gumbel("__id", seed))
    scored = cut(scored.withColumn("__row", F.monotonically_increasing_id()), "scores")  # __row parts equal rows among ranges
    able = F.col("n_words") >= min_words
    n_drawn = scored.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("__id"), F.asc("n_features"), F.asc("__row")]
    ranked = global_ranks(scored.where(able), order).withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    out = ranked.unionByName(rest)
    return out.select(F.col("__id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
