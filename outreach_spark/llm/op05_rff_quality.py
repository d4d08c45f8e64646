"""Operator 5: quality classifier on random Fourier features.

Each whole text gives a fixed vector of document statistics (``FEATURES``). Standardised with the mean
and deviation over all documents, they go through ``z(x) = sqrt(2/D) cos(xW + b)``, whose inner products
approximate a Gaussian kernel. A ridge score is fitted by normal equations: every task sums ``Z'Z`` and
``Z'y`` over its rows, the sums are added by position, and only the D+1 square total reaches the driver.
An isotonic regression, fitted on other labelled rows than the ridge, turns the score into a probability;
one per cent of the raw score's sigmoid is mixed in, so that documents on one isotonic step keep their
order.

Labels are learned from documents outside fold 0 of ``crc32(id) mod 5`` only: fold 4 calibrates, the
others fit. Ids, sources, languages and labels are no inputs of a score.

Defined cases: null or empty text has a vector of zeros and is scored; null ids have no label and are
scored; repeated rows are scored alike; several labels of one id count as their mean, null labels as
none; without labels every score is 0.5; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BREAKS, cut, fold, free_name, map_texts

FEATURES = (
    "log_words", "word_chars", "word_chars_dev", "distinct_share", "distinct_pair_share", "run_share", "top_share", "dup_line_share", "log_line_words",
    "symbol_share", "mark_share", "bang_share", "pipe_share", "digit_share", "capital_share", "capital_start_share", "high_byte_share", "single_share",
    "log_longest", "link_share", "caps_word_share", "wordless_share",
)

_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_HIGH = bytes(range(128, 256))
_LETTERS = _UPPER + _LOWER + _HIGH


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def text_features(data: bytes) -> list[float]:
    """``FEATURES`` of one whole text."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(data.translate(None, WORD_BREAKS))
    lengths = np.fromiter(map(len, words), np.float64, n)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    pairs = ids[:-1] * np.int64(len(names)) + ids[1:]
    lines = [x for x in data.split(b"\n") if x.strip(WORD_BREAKS)]
    bare = sum(1 for w in names if len(w.translate(None, _LETTERS)) == len(w))
    caps = {i for w, i in names.items() if len(w) > 1 and w.upper() == w and w.lower() != w}
    per_name = np.bincount(ids)
    return [
        math.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        len(names) / n,
        len(np.unique(pairs)) / max(1, n - 1),
        float(np.count_nonzero(ids[1:] == ids[:-1])) / n,
        float(per_name.max()) / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        _count(data, b"#*$%&<>@^~=+_\\{}[]") / size,
        _count(data, b".,;:?!") / size,
        data.count(b"!") / size,
        data.count(b"|") / size,
        _count(data, _DIGITS) / size,
        _count(data, _UPPER) / size,
        sum(1 for w in words if 65 <= w[0] <= 90) / n,
        _count(data, _HIGH) / size,
        float(np.count_nonzero(lengths == 1)) / n,
        math.log1p(float(lengths.max())),
        (data.count(b"://") + data.count(b"@")) / n,
        float(sum(per_name[i] for i in caps)) / n,
        bare / len(names),
    ]


def add_features(docs: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    def make():
        return lambda texts: [[text_features(t) for t in texts]]

    return map_texts(docs, text_col, out, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]), make)


@dataclass(frozen=True)
class Classifier:
    """All parts are bounded: ``dims`` x number of statistics, and at most 2001 calibration points."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of raw statistics, with a constant last."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.turn + self.shift
        return np.hstack([math.sqrt(2 / len(self.shift)) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        even = np.interp(raw, self.knots, self.levels) if len(self.knots) else np.clip(raw, 0, 1)
        return np.clip(0.99 * even + 0.01 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def fit_classifier(
    features: DataFrame,
    labels: DataFrame,
    dims: int = 256,
    width: float = 1.0,
    ridge: float = 1.0,
    seed: int = 5,
    task_rows: int = 16384,
) -> Classifier:
    """``features``: ``doc_id`` and ``x``; ``labels``: ``doc_id``, ``quality``. See the module text.

    ``width`` scales the kernel's radius (in units of the root of the number of statistics).
    """
    n_stats = len(FEATURES)
    x = [F.col("x")[i] for i in range(n_stats)]
    got = features.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    moments = np.array([v or 0.0 for v in got], np.float64)
    rng = np.random.default_rng(seed)
    model = Classifier(
        mean=moments[:n_stats],
        scale=np.maximum(moments[n_stats:], 1e-6),
        turn=rng.normal(0, 1 / (width * math.sqrt(n_stats)), (n_stats, dims)),
        shift=rng.uniform(0, 2 * math.pi, dims),
        weights=None,
        knots=np.zeros(0),
        levels=np.zeros(0),
    )
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = cut(features.where(fold("doc_id", 5) > 0).join(truth, "doc_id").select(fold("doc_id", 5).alias("fold"), "x", "y"), "labelled-features")
    n_known = known.count()
    if not n_known:
        return model

    def sums(batches):
        total = np.zeros((dims + 1, dims + 2))
        for b in batches:
            z = model.lift(_matrix(b.column("x")))
            total += z.T @ np.hstack([z, b.column("y").to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    rows = known.where("fold < 4").select("x", "y").repartition(max(1, -(-n_known // task_rows))).mapInArrow(sums, "at long, v double")
    total = np.zeros((dims + 1) * (dims + 2))
    for at, v in rows.groupBy("at").agg(F.sum("v")).toLocalIterator():  # (dims + 1) x (dims + 2) rows at any input size
        total[at] = v
    total = total.reshape(dims + 1, dims + 2)
    weights = np.linalg.solve(total[:, :-1] + ridge * np.eye(dims + 1), total[:, -1])
    model = Classifier(**{**model.__dict__, "weights": weights})

    def raws(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b.column("x")))), b.column("y")], names=["raw", "y"])

    grid = (
        known.where("fold = 4").select("x", "y").mapInArrow(raws, "raw double, y double")
        .groupBy(F.round(F.greatest(F.least("raw", F.lit(2.0)), F.lit(-1.0)) * 500).alias("step"))
        .agg(F.avg("y").alias("label"), F.count("*").cast("double").alias("weight"))
        .select(array_to_vector(F.array(F.col("step") / 500)).alias("features"), "label", "weight")
    )
    if grid.isEmpty():
        return model
    fitted = IsotonicRegression(weightCol="weight").fit(grid)
    return Classifier(**{**model.__dict__, "knots": np.array(fitted.boundaries.toArray()), "levels": np.array(fitted.predictions.toArray())})


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return cut(add_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "__x").select("doc_id", F.col("__x.x").alias("x")), "features")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(``doc_id``, ``held_out``, ``score``) per document."""
    features = _features(docs, id_col, text_col)
    model = fit_classifier(features, labels, **how)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(_matrix(b.column("x"))))], names=["doc_id", "held_out", "score"])

    schema = T.StructType([features.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return features.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "x").mapInArrow(run, schema)


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, columns as they are; texts are not shuffled."""
    model = fit_classifier(_features(docs, id_col, text_col), labels, **how)
    name = free_name(docs, "score")

    def make():
        return lambda texts: [model.score(np.array([text_features(t) for t in texts]).reshape(len(texts), len(FEATURES))).tolist()]

    scored = map_texts(docs, text_col, name, T.StructType([T.StructField("v", T.DoubleType())]), make)
    return scored.where(F.col(name)["v"] >= threshold).drop(name)
