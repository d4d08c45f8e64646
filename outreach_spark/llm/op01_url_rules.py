"""Operator 1: URL filter with given rules, extended by mined association rules.

Given rules (host and path prefix, allow or block) decide first; the longest that fits wins. The urls that
they decide are the labelled set. Spark's FP-growth mines combinations of url tokens from it, with the label
as one more item; rules ``tokens -> label`` are kept with enough support and confidence, and dropped when
the same rule with one token fewer is at least as confident. The rest of the urls is judged by the mined
rules: an inverted index holds each rule under its rarest token, a url looks up its own tokens, and a rule
fires when all its tokens are there. The most confident rule wins, then support, then fewer tokens, then
block before allow; with no rule ``default`` holds.

Every host label, path segment and query name of a url is in its tokens, each once, and support prunes them.
Tokens that the same labelled urls have are one item of the mining: with two of them a rule is as confident as
with one, and would be dropped, so this changes no verdict and a rule fires whichever of them a url has. Urls
are judged by distinct token set, so a host that a third of all urls share is judged once per set.

Defined cases: a null url, or one without ``://``, has an empty host and path, no tokens, and gets ``default``;
null ids and repeated rows are judged like any others; without labelled urls every verdict is ``default``; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    the path from there to ``?``, ``#`` or the end. Both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_column(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The url's distinct tokens, sorted."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.try_element_at(segments, F.lit(-1))
    plain = lambda s: F.regexp_replace(s, r"[0-9]+", "0")
    fields = [
        ("tld", F.when(host != "", F.try_element_at(labels, F.lit(-1)))),
        ("site", F.when(F.size(labels) >= 2, F.concat_ws(".", F.slice(labels, -2, 2)))),
        ("sub", F.when(F.size(labels) >= 3, F.try_element_at(labels, F.lit(1)))),
        ("first", F.when(F.size(segments) >= 1, plain(F.try_element_at(segments, F.lit(1))))),
        ("second", F.when(F.size(segments) >= 2, plain(F.try_element_at(segments, F.lit(2))))),
        ("digit", F.nullif(F.regexp_extract(F.coalesce(last, F.lit("")), r"^([0-9])", 1), F.lit(""))),
        ("kind", F.nullif(F.lower(F.regexp_extract(F.coalesce(last, F.lit("")), r"\.([A-Za-z0-9]{1,8})$", 1)), F.lit(""))),
        ("depth", F.when(host != "", F.size(segments).cast("string"))),
    ]
    asked = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(asked, "&"), lambda q: F.substring_index(q, "=", 1))
    lists = [
        ("label", F.slice(labels, 2, F.greatest(F.size(labels) - 3, F.lit(0)))),
        ("segment", F.transform(F.slice(segments, 3, F.greatest(F.size(segments) - 2, F.lit(0))), plain)),
        ("query", F.filter(names, lambda q: q != "")),
    ]
    one = F.array_compact(F.array(*[F.concat(F.lit(name + "="), value) for name, value in fields]))
    named = lambda name: lambda value: F.concat(F.lit(name + "="), value)
    many = [F.transform(values, named(name)) for name, values in lists]
    return F.array_sort(F.array_distinct(F.concat(one, *many)))


def token_items(labelled: DataFrame, min_support: float) -> DataFrame:
    """(``token``, ``item``) of the tokens with enough support; tokens that occur in the same sets share an item."""
    sets = cut(labelled.groupBy("tokens").count(), "url-sets")
    least = min_support * sets.agg(F.sum("count")).first()[0]
    mark = [F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("n")]
    found = (
        sets.select(F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit("b"), "tokens").alias("b"), "count", F.explode("tokens").alias("token"))
        .groupBy("token").agg(*mark, F.sum("count").alias("freq")).where(F.col("freq") >= least)
    )
    return cut(found.select("token", F.min("token").over(Window.partitionBy("a", "b", "n")).alias("item")), "url-items")


def as_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(``tokens``, ``items``) of the distinct ``tokens`` that have any item."""
    return sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(items, "token").groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(``key, needs, verdict, confidence, support``) from ``tokens`` and ``verdict``; see the module text."""
    mark = "verdict="
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit(mark), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = cut(
        model.associationRules.where(F.col("consequent")[0].startswith(mark))
        .select(F.array_sort("antecedent").alias("needs"), F.substring(F.col("consequent")[0], len(mark) + 1, 1000).alias("verdict"), "confidence", "support"),
        "url-rules",
    )
    shorter = found.select(F.col("needs").alias("part"), "verdict", F.col("confidence").alias("part_confidence"))
    drop = (
        found.select("needs", "verdict", "confidence", F.explode("needs").alias("less"))
        .select("needs", "verdict", "confidence", F.array_remove("needs", F.col("less")).alias("part"))
        .join(shorter, ["part", "verdict"]).where("part_confidence >= confidence").select("needs", "verdict")
    )
    kept = found.join(drop, ["needs", "verdict"], "left_anti")
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    key = (
        kept.select("needs", "verdict", F.explode("needs").alias("token")).join(often, "token")
        .groupBy("needs", "verdict").agg(F.min(F.struct("freq", "token")).alias("rarest"))
    )
    return cut(kept.join(key, ["needs", "verdict"]).select(F.col("rarest.token").alias("key"), "needs", "verdict", "confidence", "support"), "url-rule-index")


def match_rules(sets: DataFrame, index: DataFrame) -> DataFrame:
    """(``tokens``, ``verdict``) of the token sets on which a rule fires; ``sets``: distinct ``tokens``."""
    hits = (
        sets.select("tokens", F.explode("tokens").alias("key")).join(index, "key")
        .where(F.size(F.array_except("needs", "tokens")) == 0)
    )
    best = F.struct("confidence", "support", (-F.size("needs")).alias("fewer"), "verdict")
    return hits.groupBy("tokens").agg(F.max(best).alias("best")).select("tokens", F.col("best.verdict").alias("verdict"))


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    min_support: float = 0.01,
    min_confidence: float = 0.8,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: the id, ``host``, ``path``, ``rule`` (of the given rules, else null) and ``verdict``."""
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    host, path = url_parts(F.col("__url"))
    read = read.withColumns({"host": host, "path": path})
    text, verdict = rule_column(rules, F.col("host"), F.col("path"))
    read = cut(read.select("page_id", "host", "path", text.alias("rule"), verdict.alias("given"), tokens(F.col("__url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
    labelled = read.where("given is not null").select("tokens", F.col("given").alias("verdict"))
    if labelled.isEmpty():
        return read.select("page_id", "host", "path", "rule", F.lit(default).alias("verdict"))
    items = token_items(labelled, min_support)
    baskets = labelled.join(as_items(labelled, items), "tokens", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("tokens"), "verdict")
    index = mine_rules(baskets, min_support, min_confidence)
    sets = cut(as_items(read.where("given is null"), items), "url-item-sets")
    fired = match_rules(sets.select(F.col("items").alias("tokens")).distinct(), index).withColumnRenamed("tokens", "items")
    judged = sets.join(fired, "items").select("tokens", "verdict")
    out = read.join(judged, "tokens", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "verdict", F.lit(default)).alias("verdict"))
