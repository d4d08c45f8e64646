import zlib

import numpy as np
from pyspark.sql import types as T

from outreach_spark.llm import op05_rff_quality as op5
from outreach_spark.llm.queries import QUERIES

from ..conftest import SF_MED

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
LABELS = "doc_id long, quality int"


def test_held_out_accuracy(spark):
    rows = QUERIES["op5_rff_quality"](spark, SF_MED).collect()
    docs = spark.read.parquet(f"{SF_MED}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MED}/labels.parquet").collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    d, dims = len(op5.FEATURES), 4096
    m = op5.Classifier(np.zeros(d), np.ones(d), rng.normal(0, 1 / np.sqrt(d), (d, dims)), rng.uniform(0, 2 * np.pi, dims), None, np.zeros(0), np.zeros(0))
    x = rng.normal(size=(8, d))
    z = m.lift(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - want).max() < 0.08


def test_small_cases(spark):
    rows = [(i, "good words stay here always " * 3 if i % 2 else "### ### $$$", "x") for i in range(40)] + [(None, None, "x"), (50, "", "x"), (50, "", "x"), (51, "a" * 100_000, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], LABELS)
    got = op5.score_documents(docs, none)
    assert got.count() == len(rows) and {r.score for r in got.collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (50, None), (None, 1)], LABELS)
    scores = op5.score_documents(docs, labels).collect()
    by = {r.doc_id: r.score for r in scores}
    assert len(scores) == len(rows) and min(by[i] for i in range(1, 40, 2)) > max(by[i] for i in range(0, 40, 2))
    kept = op5.filter_documents(docs, labels, threshold=0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 3}
    assert op5.score_documents(docs.limit(0), labels).collect() == []
