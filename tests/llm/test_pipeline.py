"""Each stage of the pipeline against its brute-force version on its own input, and on odd tables."""

import pytest
from pyspark.sql import types as T

import corpus_pipeline as cp
from outreach_spark.llm import op05_rff_quality as op5
from outreach_spark.llm.common import cut, read_table

from ..conftest import SF_SMALL
from .test_op03 import plain
from .test_op06 import plain_components, plain_fingerprint
from .test_op08 import check_packing
from .test_op10 import plain_base


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "near_dedup", "packing"]


def test_every_stage_equals_brute_force(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    labels = read_table(spark, SF_SMALL, "labels")
    stages = dict(cp.STAGES)

    def texts(df):
        return {r.doc_id: r.text for r in df.collect()}

    kept = cut(stages["quality_rules"](spark, docs, SF_SMALL), "t1")
    base = {i: plain_base(t) for i, t in texts(docs).items()}
    # too few labels here for any certified cutoff: the base rules decide
    assert texts(kept) == {i: t for i, t in texts(docs).items() if not (base[i][0] < 20 or 100 * base[i][4] > 30 * base[i][0])}
    assert kept.columns == docs.columns

    good = cut(stages["quality_classifier"](spark, kept, SF_SMALL), "t2")
    scores = {r.doc_id: r.score for r in op5.score_documents(kept, labels).collect()}
    assert texts(good) == {i: t for i, t in texts(kept).items() if scores[i] >= 0.3}

    lines = cut(stages["line_dedup"](spark, good, SF_SMALL), "t3")
    assert texts(lines) == plain(list(texts(good).items()), 50)
    assert {r.doc_id: r.n_chars for r in lines.collect()} == {i: len(t) for i, t in texts(lines).items()}

    unique = cut(stages["near_dedup"](spark, lines, SF_SMALL), "t4")
    comp = plain_components({i: plain_fingerprint(t) for i, t in texts(lines).items()})
    assert texts(unique) == {i: t for i, t in texts(lines).items() if comp[i] == i}
    assert unique.columns == docs.columns and 0 < unique.count() < lines.count()

    packed = stages["packing"](spark, unique, SF_SMALL).collect()
    check_packing(packed, texts(unique))
    whole = cp.run(spark, SF_SMALL)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed))


@pytest.fixture()
def odd_dir(spark, scratch):
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("__row", T.StringType()),
    ])
    long = " ".join(f"word{i} more" for i in range(30_000))
    body = " ".join(f"plain{i}" for i in range(60))
    rows = [(1, None), (2, ""), (2, ""), (None, body), (4, body), (4, body), (5, long), (6, "x" * 200_000), (7, "\n" * 50_000), (8, f"own words first\n{body}")]
    spark.createDataFrame([(i, t, None, None, None, "s", 1, "r") for i, t in rows], schema).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, None), (8, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    return scratch


def test_odd_documents_pass_every_stage(spark, odd_dir):
    docs = read_table(spark, odd_dir, "documents")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert out.count() <= docs.count()
    rows = cp.run(spark, odd_dir).collect()
    assert {r.doc_id for r in rows} >= {5, 8}
    assert all(cp.STAGES[-1][1](spark, docs, odd_dir).where("start = 0").count() == docs.count() for _ in [0])


def test_empty_documents(spark, odd_dir, tmp_path):
    empty = str(tmp_path / "empty")
    read_table(spark, odd_dir, "documents").limit(0).write.parquet(f"{empty}/documents.parquet")
    read_table(spark, odd_dir, "labels").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert cp.run(spark, empty).collect() == []
