from collections import defaultdict

from pyspark.sql import types as T

from outreach_spark.llm import op03_line_winnow as op3
from outreach_spark.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SF_SMALL
from ..oracle import compare, duck


def plain(rows, min_words):
    """Brute force over all pairs of runs: rows (id, text) with distinct ids; returns {id: text}."""
    docs = {i: [(p, x) for p, x in enumerate(t.split("\n")) if x.split()] for i, t in rows if t is not None}
    gone = defaultdict(set)
    seen = set()
    for i in sorted(docs):
        own = docs[i]
        for a in range(len(own)):
            for b in range(a, len(own)):
                run = tuple(x for _, x in own[a : b + 1])
                if sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone[i] |= {p for p, _ in own[a : b + 1]}
                    seen.add(run)
    return {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in rows}


def test_query_equals_sql(spark):
    assert compare(QUERIES["op3_line_winnow"](spark, SF_SMALL), duck(SF_SMALL), ORACLE_SQL["op3_line_winnow"]) > 0


def test_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    lines = ["a b c", "d", "e f", "g h i j k", "l m", "", "  ", "n o p q r s t u v w x y"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 9)))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in op3.dedup_lines(df, min_words=6).collect()}
    assert got == plain(rows, 6)
    assert got != dict(rows)


def test_small_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("n_chars", T.IntegerType())])
    run = "one two three\nfour five six"
    rows = [(1, run, "x", 28), (1, run, "x", 28), (2, f"own\r\n\n{run}\n", "x", 5), (None, run, "x", 28), (3, None, None, None), (4, "", "x", 0)]
    df = spark.createDataFrame(rows, schema)
    out = op3.dedup_lines(df, min_words=5)
    assert out.schema == df.schema
    got = sorted(map(tuple, out.collect()), key=str)
    # the row without an id comes first in order and keeps the run
    assert got == sorted([(1, "", "x", 0), (1, "", "x", 0), (2, "own\r\n\n", "x", 6), (None, run, "x", 28), (3, None, None, None), (4, "", "x", 0)], key=str)
    assert op3.dedup_lines(df.limit(0)).collect() == []


def test_fingerprints_are_window_minima_and_fewer_than_lines(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, "\n".join(" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(0, 60)))) for i in range(20)]
    lines = op3.line_table(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    by_doc = defaultdict(list)
    for r in lines.collect():
        by_doc[r.k.id].append((r.pos, r.h, r.w))
    expected = set()
    for i, own in by_doc.items():
        own.sort()
        for a in range(len(own)):
            ends = [b for b in range(a, len(own)) if sum(w for _, _, w in own[a : b + 1]) >= 12]
            if ends:
                least = min((h, -p) for p, h, _ in own[a : ends[0] + 1])
                expected.add((i, -least[1], least[0]))
    fresh = op3.winnow(lines, 12).where("fresh").collect()
    assert len(fresh) == len(expected) and {(r.k.id, r["at"], r.fingerprint) for r in fresh} == expected
    assert len(fresh) < sum(map(len, by_doc.values())) / 2


def test_a_common_line_with_other_surroundings_stays(spark):
    """The common line may be the fingerprint everywhere; only the passage that repeats with it is deleted."""
    passage = ["one two three", "the same line", "four five"]
    texts = [f"own{i} a\nthe same line\nown{i} b" for i in range(30)]
    texts += ["\n".join([f"head{i} x", *passage, "", *(["six seven"] if i % 2 else []), f"tail{i} y"]) for i in range(5)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.text for r in op3.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=8).collect()}
    assert got == plain(rows, 8)
    assert [got[i] for i in range(30)] == texts[:30] and got[31] == "head1 x\n\nsix seven\ntail1 y" and got[33] == "head3 x\n\ntail3 y"
