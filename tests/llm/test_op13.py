import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from outreach_spark.llm import op13_importance_resampling as op13
from outreach_spark.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF_SMALL
from ..oracle import compare, duck

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, runs):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, runs, buckets, min_words, percent, seed):
    """Row loops: {(id, n_features, weight, score, rank): times}."""
    made = [(i, *features(t, runs)) for i, t in docs]
    hashed = [[zlib.crc32(f.encode()) % buckets for f in fs] for _, _, fs in made]
    s = Counter(b for bs in hashed for b in bs)
    t = Counter(zlib.crc32(f.encode()) % buckets for x in target for f in features(x, runs)[1])
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for (i, words, fs), bs in zip(made, hashed):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in bs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((len(words), i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= min_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    drawn = len(able) * percent // 100
    ranked = [(*r[1:], n + 1 if n < drawn else None) for n, r in enumerate(able)]
    return Counter(ranked + [(*r[1:], None) for r in rows if r[0] < min_words])


def got(spark, docs, target, **kw):
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, score int, __id string")
    b = spark.createDataFrame([(1, x) for x in target], "item_id long, text string")
    return Counter(tuple(r) for r in op13.resample(d, b, **kw).collect())


def test_query_equals_sql(spark):
    assert compare(QUERIES["op13_importance_resampling"](spark, SF_SMALL), duck(SF_SMALL), ORACLE_SQL["op13_importance_resampling"]) > 0


def test_matrices_equal_the_library():
    rng = random.Random(4)
    some = [rng.randbytes(rng.choice([0, 1, 2, 5, 63, 64, 65, 127, 128, 129, 200, 1000])) for _ in range(400)] + [rng.randbytes(100_003)]
    assert op13.crc_matrices(some).tolist() == [zlib.crc32(f) for f in some]


ODD = [(0, None), (1, ""), (2, "ab " * 40), (3, "ab " * 40), (3, "ab " * 40), (3, "AB é日本 x9-y " * 9), (None, "ab cd " * 30), (None, "ab cd " * 30),
       (4, "x" * 5000 + " " + "日" * 3000), (5, "K İ \x00\x7f ß" * 8), (6, "one two")]


@pytest.mark.parametrize("runs, buckets, percent", [(1, 10000, 50), (3, 50, 100), (2, 7, 0)])
def test_odd_rows_ties_and_runs(spark, runs, buckets, percent):
    target = ["ab cd", None, "", "日本 ab", "x" * 5000]
    kw = {"n_buckets": buckets, "min_words": 5, "percent": percent, "seed": "s"}
    assert got(spark, ODD, target, max_run=runs, **kw) == plain(ODD, target, runs, buckets, 5, percent, "s")


def test_empty_tables(spark):
    assert got(spark, [], ["a"]) == Counter()
    assert got(spark, ODD, []) == plain(ODD, [], 1, 10000, 20, 10, "2024")


def test_ranks_over_many_ranges_and_a_hot_row(spark):
    rng = random.Random(1)
    docs = [(7, "a b c")] * 300 + [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 9)))) for i in range(600)]
    assert got(spark, docs, ["a a b"], min_words=2, percent=40) == plain(docs, ["a a b"], 1, 10000, 2, 40, "2024")


def test_long_features_are_not_kept():
    h = op13.Hasher(1, 100)
    h.buckets([b"a", b"b" * 1000])
    assert list(h.known) == [b"a"] and np.array_equal(h.buckets([b"a", b"a"]), [zlib.crc32(b"a") % 100] * 2)
