import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from outreach_spark.llm import op08_harmonic_packing as op8
from outreach_spark.llm.queries import QUERIES

from ..conftest import SF_MED, SF_SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "Don't STOP 123 <|endoftext|> x", "É́ İstanbul ΣΑΣ ß", "日本 語　\xa0x\x1cy\x85", "a" * 5000, "it'S we'Ll 'd", "tab\tnew\r\nline\x0b", "-- ## !!!", "emoji 👍🏽 ok", "<|start oftext|>", "x́\ńy", "²½ Ⅷ ٣"]


LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check_packing(rows, docs, capacity=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = np.array([*ids_of(text or ""), 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
        padding += 0 if at.bit_count() == 1 else capacity - at
    return padding / (padding + total)


def test_encoder_equals_library(spark):
    texts = HARD + [r.text for r in spark.read.parquet(f"{SF_MED}/documents.parquet").collect()][:400]
    got = op8.word_encoder(PATH)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t) for t in texts]


def test_equal_rows_are_dealt_over_buckets(spark):
    from pyspark.sql import functions as F

    docs = spark.range(6000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 != 0, "a b").alias("text"))
    pieces = op8.piece_table(docs, PATH, 2048, 1)
    dealt = pieces.groupBy(F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(10)).alias("b")).count().collect()
    assert len(dealt) == 10 and max(r["count"] for r in dealt) < 1.5 * 600
    packed = op8.pack(docs, PATH, bucket_rows=500)
    assert packed.count() == 6000 and packed.where("doc_id is null").count() == 2000
    assert packed.select("sequence_id", "offset").distinct().count() == 6000


def test_random_odd_texts_equal_library(spark):
    rng = random.Random(6)
    letters = [*"abcXYZ 019'.,-#\n\t", *"\x1c\x1f\x85\xa0", "\u0130", "\u00e9", "e\u0301", "\u65e5", "\u3000", "'s", "'LL", "<|endoftext|>", "\U0001f44d", "\u2028", "\x00", "\u00df", "\u017f"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    got = op8.word_encoder(PATH)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t) for t in texts]


def test_query_packs_every_id_once(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert check_packing(QUERIES["op8_harmonic_packing"](spark, SF_SMALL).collect(), docs) < 0.05


@pytest.mark.parametrize("capacity", [8, 100, 2048])
def test_cuts(capacity):
    rnd = random.Random(2)
    for n in [1, 2, capacity - 1, capacity, capacity + 1, *(rnd.randint(1, 6 * capacity) for _ in range(300))]:
        cuts = op8.cut_lengths(n, capacity)
        assert sum(cuts) == n and min(cuts) > 0 and max(cuts) <= capacity


def test_small_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("k", T.StringType())])
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "word here", "x"), (4, "b " * 9000, "x"), *((i, "aa bb", "x") for i in range(10, 60))]
    df = spark.createDataFrame(rows, schema)
    got = op8.pack(df, PATH, with_ids=True, bucket_rows=7)
    assert sorted(str(r.doc_id) for r in got.collect() if r.start == 0) == sorted(str(r[0]) for r in rows)
    seqs = op8.sequences(got).collect()
    assert all(len(r.ids) == 2048 or r.n_tokens.bit_count() == 1 for r in seqs)
    assert sum(r.n_tokens for r in seqs) == got.agg({"length": "sum"}).first()[0]
    assert op8.pack(df.limit(0), PATH).collect() == []
