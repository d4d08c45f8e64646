import public_tokenizers
import sentencepiece
from pyspark.sql import types as T

from outreach_spark.llm import op07_prefix_counts as op7
from outreach_spark.llm.queries import QUERIES

from ..conftest import SF_MED, SF_SMALL
from .test_op08 import HARD

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [t[:300] for t in HARD] + ["  ", "    lots     of                     space   ", "▁▁ x▁y", "\n\n", " \n ", "\x00\x01", "trail  ", "<s> </s> <unk> <0x0A>", "ﬁ Ａ"]


def test_every_prefix_equals_library(spark):
    texts = TEXTS + [r.text[:400] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()][:40]
    for text, table in zip(texts, op7.PrefixCounter(PATH).tables_of(texts)):
        assert table.tolist() == [len(LIBRARY.encode(text[:p])) for p in range(len(text) + 1)], text


def test_query_equals_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_MED}/documents.parquet").collect()}
    rows = QUERIES["op7_prefix_counts"](spark, SF_MED).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in rows} == {(i, len(t.encode()), len(LIBRARY.encode(t))) for i, t in docs.items()}
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows) and len(rows) == len(docs)


def test_small_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])
    long = "word " * 40_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "hi there", None), (3, "hi there", "x"), (3, "hi there", "x"), (4, long, "x")], schema)
    rows = op7.token_counts(df, PATH, limit=1, with_table=True).collect()
    assert len(rows) == 6
    for r in rows:
        text = {1: "", 2: "", 4: long}.get(r.doc_id, "hi there")
        assert r.n_tokens == len(LIBRARY.encode(text)) == r.counts[-1] and len(r.counts) == len(text) + 1
        assert r.fits == max(p for p, n in enumerate(r.counts) if n <= 1)
    assert op7.token_counts(df.limit(0), PATH).collect() == []
