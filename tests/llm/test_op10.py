import random
import re
from collections import Counter
from math import comb

from pyspark.sql import types as T

from outreach_spark.llm import op10_quality_rules as op10
from outreach_spark.llm.queries import QUERIES

from ..conftest import SF_SMALL


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op10_quality_rules"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_repeated_words_equal_brute_force():
    rnd = random.Random(1)
    for n in list(range(0, 30)) + [200]:
        words = [rnd.choice("ab" if n < 30 else "abcdef") for _ in range(n)]
        text = " ".join(words)
        assert op10.text_stats(text.encode())[4] == plain_base(text)[4]


def test_binomial_bound_is_exact():
    for n, k, e in ((50, 0, 0.01), (50, 3, 0.05), (400, 2, 1e-4)):
        p = op10.binomial_upper(k, n, e)
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(tail - e) < 1e-9
    assert op10.binomial_upper(5, 5, 0.05) == 1.0 and op10.binomial_upper(0, 0, 0.05) == 1.0


def test_cutoffs_bound_false_rejection_of_fresh_documents():
    rnd = random.Random(7)
    draw = lambda: min(op10.LEVELS, int(rnd.expovariate(0.4)))
    hist = Counter(draw() for _ in range(20_000))
    cut = op10.choose_cutoffs({(1, "run_share"): hist}, 0.03, 0.05).level[(1, "run_share")]
    fresh = [draw() for _ in range(20_000)]
    assert cut < op10.LEVELS - 1
    assert sum(x > cut for x in fresh) / len(fresh) < 0.03 / len(op10.RULES)
    assert op10.choose_cutoffs({(1, "run_share"): {3: 20}}, 0.03, 0.05).level == {}


def test_small_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType())])
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(1, good, "x"), (1, good, "x"), (None, good, "x"), (2, None, "x"), (3, "", None), (4, "same " * 9000, "x"), (5, "q" * 300_000, "x")]
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    kept = op10.filter_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    judged = op10.judge_documents(docs, labels)
    assert judged.count() == len(rows)
    assert op10.judge_documents(docs.limit(0), labels.limit(0)).collect() == []
