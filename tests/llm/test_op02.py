import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from outreach_spark.llm import op02_automaton_bpe as op2
from outreach_spark.llm.bpe import ByteWords, Merger
from outreach_spark.llm.queries import QUERIES

from ..conftest import SF_MED, SF_SMALL
from .test_op08 import HARD

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [*HARD, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "  two  \n\n three   ", "x 　 y", "\n", " \n ", "\x00\x01퟿", "q" * 4000, "ab " * 300]


def test_equals_library(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF_MED}/documents.parquet").collect()][:400]
    words = sorted({w.encode() for t in texts[:200] for w in op2.word_cutter([])(t)})[::2]
    auto = op2.Automaton(op2.compile_automaton(words, ByteWords(Merger(PATH)).encode(words)))
    got = op2.Encoder(PATH, auto)(texts)
    table = op2.token_bytes(Merger(PATH))
    for t, g in zip(texts, got):
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(g, "<u4").tolist() == ids, t[:80]
        assert b"".join(table[i] for i in ids).decode("utf-8", "replace") == LIBRARY.decode(ids, skip_special_tokens=False)


def test_random_texts_are_cut_alike(spark):
    rnd = random.Random(3)
    letters = [*"abcXYZ 0189'.,-#", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x00", "\x7f", "'s", "'LL", "'re", "  ", "<|endoftext|>"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(3000)]
    encoder = op2.Encoder(PATH, op2.Automaton(op2.compile_automaton([], [])))
    for t, g in zip(texts, encoder(texts)):
        assert np.frombuffer(g, "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, t


def test_automaton_is_a_minimal_perfect_numbering():
    rnd = random.Random(4)
    words = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 6))) for _ in range(400)})
    auto = op2.Automaton(op2.compile_automaton(words, [i.to_bytes(4, "little") for i in range(len(words))]))
    assert auto.places(words).tolist() == list(range(len(words)))
    assert auto.look_up([b"", b"abcabcabc", b"zz", words[7]]) == [None, None, None, (7).to_bytes(4, "little")]
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(auto.final) == len(endings)  # one state per distinct set of endings
    assert op2.Automaton(op2.compile_automaton([], [])).look_up([b"a"]) == [None]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op2_automaton_bpe"](spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_words_stay_out_of_the_lexicon(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(i, f"{long} some words") for i in range(20)], "doc_id long, text string")
    name = op2.build_lexicon(df, PATH)
    from pyspark import SparkFiles

    auto = op2.Automaton(np.load(SparkFiles.get(name)))
    assert auto.look_up([long.encode()]) == [None] and auto.look_up([b" words"]) != [None]
    ids = LIBRARY.encode(f"{long} some words", add_special_tokens=False).ids
    assert {r.n_tokens for r in op2.round_trip(spark, df, PATH).collect()} == {len(ids)}


def test_small_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "hi there", None), (3, "hi there", "x"), (3, "hi there", "x")], schema)
    got = sorted(((r.doc_id, r.n_tokens, r.text) for r in op2.round_trip(spark, df, PATH).collect()), key=str)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (None, 2, "hi there"), (3, 2, "hi there"), (3, 2, "hi there")], key=str)
    assert op2.round_trip(spark, df.limit(0), PATH).collect() == []
    odd = spark.createDataFrame([(bytes([255, 255, 0, 0]),), (None,)], "ids binary")
    assert [r.d.text for r in op2.decode(odd, PATH, "ids", "d").collect()] == ["", ""]
