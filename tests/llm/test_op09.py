import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from outreach_spark.llm import gru
from outreach_spark.llm import op09_gru_scoring as op9
from outreach_spark.llm.queries import QUERIES

from ..conftest import SF_MED


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_base_equals_brute_force_and_model_beats_it(spark):
    docs = {r.doc_id: plain_words(r.text) for r in spark.read.parquet(f"{SF_MED}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, ws in docs.items() if not held[i] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op9_gru_scoring"](spark, SF_MED).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ws = [*docs[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_gradient_equals_differences(monkeypatch):
    monkeypatch.setattr(gru, "F4", np.float64)
    shape, rng = gru.Shape(7, hidden=4, per_class=3), np.random.default_rng(0)
    flat = shape.start(np.arange(8) + 1.0)
    inputs, targets = rng.integers(0, 8, (3, 5)), rng.integers(0, 8, (3, 5))
    loss = lambda f: gru.gradient(shape, shape.split(f), inputs, targets, np.zeros((3, 4)))[1]
    grad, _ = gru.gradient(shape, shape.split(flat), inputs, targets, np.zeros((3, 4)))
    diff = np.array([(loss(flat + e) - loss(flat - e)) / 2e-5 for e in np.eye(len(flat)) * 1e-5])
    assert np.abs(diff - grad).max() < 1e-8


def test_distribution_sums_to_one_and_windows_carry_the_state():
    shape = gru.Shape(40, hidden=5, per_class=16)
    flat = shape.start(np.arange(41) + 1.0) * 3
    state = np.random.default_rng(1).normal(size=(1, 5)).astype(np.float32)
    probs = [math.exp(gru.log_probs(shape, shape.split(flat), state, np.array([s]))[0]) for s in range(41)]
    assert abs(sum(probs) - 1) < 1e-4  # padded words of the last class have next to none
    docs = [np.append(np.random.default_rng(i).integers(1, 41, n), 0) for i, n in enumerate([0, 3, 200, 65, 64, 63])]
    small, large = gru.document_log_probs(shape, flat, docs, window=7), gru.document_log_probs(shape, flat, docs, window=500)
    alone = [gru.document_log_probs(shape, flat, [d])[0] for d in docs]
    for a, b, c in zip(small, large, alone):
        assert np.allclose(a, b, atol=1e-4) and np.allclose(a, c, atol=1e-4)


def test_small_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("chunk", T.StringType())])
    rows = [(1, None, "x"), (2, "", "x"), (None, "A b a", "x"), (3, "a B", "x"), (3, "a B", "x"), (4, "w " * 30_000, "x"), (5, "q" * 200_000, "x")]
    df = spark.createDataFrame(rows, schema)
    got = op9.score_documents(df, chunk_bytes=1000, train_share=1).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 3, 3, 4, 30_001]
    assert op9.score_documents(df.limit(0)).collect() == []
    only_held = df.where("doc_id is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in op9.score_documents(only_held).collect())


def test_every_training_document_reaches_the_model(spark, monkeypatch):
    read, train_rounds = [], op9.train_rounds

    def spy(samples, *args):
        read.append(sum(len(op9.unpack_ids(r.symbols)) for r in samples.select("symbols").collect()))
        return train_rounds(samples, *args)

    monkeypatch.setattr(op9, "train_rounds", spy)
    rows = QUERIES["op9_gru_scoring"](spark, SF_MED).collect()
    assert read == [sum(r.n_tokens for r in rows if not r.held_out)] and read[0] == rows[0].train_tokens


def test_training_reads_every_symbol():
    shape = gru.Shape(5, hidden=3, per_class=3)
    flat = shape.start(np.ones(6))
    for n in (1, 2, 47, 48, 97, 500, 24 * 2 * 7 + 5):
        stream = np.random.default_rng(n).integers(0, 6, n)
        other = np.append(stream[:-1], (stream[-1] + 1) % 6)
        got, read = gru.train(shape, flat, [stream, stream[:1]], rows=4)
        assert read == n + 1
        assert not np.array_equal(got, gru.train(shape, flat, [other, stream[:1]], rows=4)[0])


def test_vocabulary_grows_with_the_corpus(spark, monkeypatch):
    shapes, train_rounds = [], op9.train_rounds
    monkeypatch.setattr(op9, "train_rounds", lambda samples, shape, *args: shapes.append(shape) or train_rounds(samples, shape, *args))
    docs = spark.read.parquet(f"{SF_MED}/documents.parquet")
    c = Counter(w for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in plain_words(r.text))
    QUERIES["op9_gru_scoring"](spark, SF_MED)
    often = sum(n >= math.sqrt(sum(c.values())) / 32 for n in c.values())
    assert shapes[0].words == often + 1 > 512 and shapes[0].classes <= 2 * math.sqrt(often)


def test_untouched_rows_keep_their_weights():
    shape = gru.Shape(90, hidden=3, per_class=10)
    flat = shape.start(np.ones(91))
    got = shape.split(gru.train(shape, flat, [np.tile([1, 25, 0], 40)])[0])
    was = shape.split(flat)
    assert [k for k in range(9) if not np.array_equal(got["out"][k], was["out"][k])] == [0, 2]
    assert [i for i in range(91) if not np.array_equal(got["inp"][i], was["inp"][i])] == [0, 1, 25]


def test_gates_of_a_window_are_gathered_in_runs():
    shape, rows, time = gru.Shape(50), 2000, 64
    p, inputs = shape.split(shape.start(np.ones(51))), np.random.default_rng(0).integers(0, 51, (2000, 64))
    tracemalloc.start()
    states = gru.steps(p, shape.hidden, inputs, np.zeros((rows, shape.hidden), np.float32), np.full(time, rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * states.nbytes  # all gates at once are three times the states, twice over
    one = [gru.steps(p, shape.hidden, inputs[i : i + 1], np.zeros((1, shape.hidden), np.float32)) for i in (0, 999)]
    assert np.allclose(states[[0, 999]], np.concatenate(one), atol=1e-5)


def test_large_and_vanishing_logits():
    shape, rng = gru.Shape(6, hidden=3, per_class=3), np.random.default_rng(2)
    for scale, bias in ((1, 0), (1, 300), (200, 0)):
        p = shape.split((rng.normal(size=shape.size) * scale).astype(np.float32))
        p["word"][:, -1] += bias
        states, targets = rng.uniform(-1, 1, (7, 3)).astype(np.float32), np.arange(7)
        x = np.append(states, np.ones((7, 1)), axis=1)
        logp = lambda w, at: (x @ w.T.astype(float))[np.arange(7), at] - np.logaddexp.reduce(x @ w.T.astype(float), axis=1)
        want = logp(p["cls"], targets // 3)
        for k in (0, 1):
            want += np.where(targets // 3 == k, logp(p["out"][k], targets % 3), 0)
        assert np.allclose(gru.log_probs(shape, p, states, targets), want, rtol=1e-4, atol=1e-3)


def test_scores_without_documents_and_without_symbols():
    shape = gru.Shape(5, hidden=3, per_class=3)
    flat, none = shape.start(np.ones(6)), np.zeros(0, np.int64)
    assert gru.document_log_probs(shape, flat, []) == []
    assert [len(x) for x in gru.document_log_probs(shape, flat, [none, np.array([1, 0]), none])] == [0, 2, 0]
