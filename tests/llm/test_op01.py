from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from outreach_spark.llm import op01_url_rules as op1
from outreach_spark.llm.queries import QUERIES, URL_RULES

from ..conftest import SF_MED


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def plain_verdicts(rows, min_support, min_confidence, default="allow"):
    """Brute force: every subset of every labelled token set is counted. rows: (tokens, given verdict or None)."""
    labelled = [(frozenset(t), v) for t, v in rows if v]
    n = len(labelled)
    sets, both = Counter(), Counter()
    for t, v in labelled:
        for k in range(1, len(t) + 1):
            for c in combinations(sorted(t), k):
                sets[c] += 1
                both[c, v] += 1
    rules = {(c, v): (m / sets[c], m / n) for (c, v), m in both.items() if m >= -(-min_support * n // 1) and m / sets[c] >= min_confidence}
    kept = {
        (c, v): s for (c, v), s in rules.items()
        if not any(rules.get((tuple(x for x in c if x != y), v), (0, 0))[0] >= s[0] for y in c)
    }
    out = []
    for t, given in rows:
        fired = [(*s, -len(c), v) for (c, v), s in kept.items() if set(c) <= set(t)]
        out.append(given or (max(fired)[3] if fired else default))
    return out


def test_query_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF_MED}/pages.parquet")
    host, path = op1.url_parts(F.col("__url"))
    toks = pages.select("page_id", "url", F.col("url").alias("__url")).withColumns({"host": host, "path": path}).select("page_id", "url", op1.tokens(F.col("__url"), F.col("host"), F.col("path")).alias("t")).collect()
    rows = {r.page_id: r for r in QUERIES["op1_url_rules"](spark, SF_MED).collect()}
    assert sorted(rows) == sorted(r.page_id for r in toks)
    given = []
    for r in toks:
        h, p = plain_parts(r.url)
        rule = plain_rule(h, p)
        got = rows[r.page_id]
        assert (got.host, got.path, got.rule) == (h, p, rule.text if rule else None)
        given.append((r.t, rule.verdict if rule else None))
    want = plain_verdicts(given, 0.01, 0.8)
    assert [rows[r.page_id].verdict for r in toks] == want
    assert {v for (_, g), v in zip(given, want) if g is None} == {"allow", "block"}


def test_small_cases(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("verdict", T.StringType())])
    urls = [None, "", "no scheme/de/", "http://A.Example.ORG/es/x?y", "http://example.org", "http://org/", "x://example.org/en/1#t", "http://b.com/de/1", "http://B.com/fr/", "http://com?x", "a://b://org/c", "http://notorg/", "http://é.org/É?", "http://x.org/" + "a/" * 5000]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[3], "x"), (3, urls[3], "x")]
    df = spark.createDataFrame(rows, schema)
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in op1.judge_urls(df, URL_RULES).collect()]
    assert len(got) == len(rows)
    by = {i: x for i, *x in got if i is not None}
    for i, u in enumerate(urls):
        h, p = plain_parts(u)
        rule = plain_rule(h, p)
        assert by[i][:3] == [h, p, rule.text if rule else None]
        assert rule is None or by[i][3] == rule.verdict
    assert by[3] == ["a.example.org", "/es/x", "example.org/es/", "block"]
    assert op1.judge_urls(df.limit(0), URL_RULES).collect() == []
    assert {r.verdict for r in op1.judge_urls(df.where("page_id < 3"), URL_RULES).collect()} == {"allow"}


def plain_tokens(spark, url):
    df = spark.createDataFrame([(url,)], "__url string")
    host, path = op1.url_parts(F.col("__url"))
    return df.select(op1.tokens(F.col("__url"), host, path).alias("t")).first().t


def test_every_part_of_a_url_has_a_token(spark):
    got = plain_tokens(spark, "http://blog.own.name.example.com/a/b/c12/d/c3/e.html?x=1&y=2&x&#?z=1")
    assert {"sub=blog", "label=own", "label=name", "site=example.com", "tld=com", "first=a", "second=b", "segment=c0", "segment=d", "segment=e.html", "kind=html", "query=x", "query=y", "depth=6"} == set(got)
    assert len(got) == len(set(got))


def test_urls_that_differ_in_one_middle_part_get_their_own_verdict(spark):
    shapes = ["http://blog.{}.example.com/p/q/r", "http://www.example.com/p/q/{}/s/t", "http://www.example.com/p?a=1&{}=2"]
    rules = [op1.Rule("block", "known.org", "/bad"), op1.Rule("allow", "known.org", "/good")]
    for shape in shapes:
        # labelled urls hold the part in the same place, below another host
        rows = [(None, None)] * 0
        for n in range(10):
            for verdict, word in (("bad", "spam"), ("good", "ham")):
                known = shape.format(word).replace("example.com/p", f"known.org/{verdict}{n}")
                rows.append((len(rows), known))
        rows += [(100, shape.format("spam")), (101, shape.format("ham"))]
        got = {r.page_id: r.verdict for r in op1.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, default="none").collect()}
        assert (got[100], got[101]) == ("block", "allow"), shape
