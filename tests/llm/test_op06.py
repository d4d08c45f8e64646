import numpy as np
import xxhash
from pyspark.sql import types as T

from outreach_spark.llm import op06_simhash_trie as op6
from outreach_spark.llm.queries import QUERIES

from ..conftest import SF_SMALL


def plain_fingerprint(text, words=4):
    import re

    toks = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not toks:
        return 0
    sh = [" ".join(toks[i : i + words]) for i in range(max(1, len(toks) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, max_bits=4):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (fps[ids[x]] ^ fps[ids[y]]).bit_count() <= max_bits:
                a, b = root(ids[x]), root(ids[y])
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    comp = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_trie"](spark, SF_SMALL).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in docs}
    assert len(set(comp.values())) < len(comp)


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 8), replace=False))) for b in base for _ in range(6)]
    keys = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    got = op6.trie_links(keys, np.zeros(len(keys), np.int64), 0, 4)
    want = plain_components({i: int(k) for i, k in enumerate(keys)})
    assert got.tolist() == [want[i] for i in range(len(keys))]


def test_small_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])
    rows = [(3, None, "x"), (2, "", "x"), (5, "one two", "x"), (5, "one two", "x"), (None, "ONE two", "x"), (9, "something else here now " * 3, "x")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.component_id) for r in op6.simhash_groups(df).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (5, 5), (5, 5), (None, 5), (9, 9)], key=str)
    kept = op6.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 9]
    assert op6.simhash_groups(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id as a", "id - 1 as b")
    got = op6.connected_components(edges).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, 300)}
