"""Operator 10: quality rules with risk-controlled thresholds.

Every document gets rule statistics from its whole text. Two fixed base rules reject first. Further
rules compare a statistic with a cutoff, and the cutoffs are not guessed: on labelled documents of
good quality (the holdout; no rule is fitted on them beforehand, the cutoff grid is fixed), a cutoff
is admissible for a stratum only if the exact one-sided binomial (Clopper-Pearson) upper bound on the
share of good documents it rejects is at most ``max_false_rejection / number of rules``. The bound
holds at confidence ``1 - error / (strata x rules x cutoffs)``: a Bonferroni correction over every
test that could have been run, so all chosen cutoffs hold together with probability ``1 - error``.
The lowest admissible cutoff of a rule and stratum is used; with none, the rule rejects nothing there.

Strata are length classes (``BANDS``, by number of words), so their number is fixed.

Defined cases: null or empty text has zero words and fails the base rule; a null ``doc_id`` is judged
like any other row but has no label; repeated rows are judged one by one; labels that disagree for
one id, or are null, leave the holdout; an empty table gives an empty result; without labels only the
base rules reject; columns of any name pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BREAKS, cut, free_name, map_texts

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Upper ends (number of words, exclusive) of the length strata; the last one is open.
BANDS = (64, 256, 1024)
#: Cutoff levels: each rule's statistic lies in 0..1 and is compared on a grid of this many steps.
LEVELS = 50
RULES = ("symbol_share", "repeat_share", "dup_line_share", "capital_share", "run_share", "long_word_share")

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_runs", "n_long_words")]
)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Positions covered by a window of ``window`` (a power of two) consecutive ids that occurs twice or more.

    Windows are named exactly by doubling: a name for each pair, each four, each eight. As soon as all
    names differ nothing longer can repeat.
    """
    n = len(ids)
    if n <= window:
        return 0
    names, width = ids.astype(np.int64), 1
    while width < window:
        pairs = names[: len(names) - width] * np.int64(n + 1) + names[width:]
        distinct, names = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        width *= 2
    hit = np.bincount(names)[names] > 1
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def text_stats(data: bytes) -> tuple[int, ...]:
    """The values of ``STATS`` for one text."""
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(STATS.fields)
    bare = data.translate(None, WORD_BREAKS)
    lines = [x for x in data.split(b"\n") if x.strip(WORD_BREAKS)] if b"\n" in data else [data]
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    return (
        n,
        len(bare.decode("utf-8", "replace")),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(bare) - len(bare.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        int(np.count_nonzero(ids[1:] == ids[:-1])),
        sum(1 for w in names if len(w) > 40),
    )


def add_stats(docs: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus the struct column ``out`` of rule statistics."""

    def make():
        return lambda texts: list(zip(*map(text_stats, texts))) or [[] for _ in STATS.fields]

    return map_texts(docs, text_col, out, STATS, make)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def stratum(s: Column) -> Column:
    c = F.lit(len(BANDS))
    for i in reversed(range(len(BANDS))):
        c = F.when(s["n_words"] < BANDS[i], i).otherwise(c)
    return c


def _level(s: Column, rule: str) -> Column:
    """The rule's statistic on the grid: a document is rejected at cutoff L when its level exceeds L."""
    top, bottom = {
        "symbol_share": ("n_symbols", "word_chars"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "capital_share": ("n_capitals", "word_chars"),
        "run_share": ("n_runs", "n_words"),
        "long_word_share": ("n_long_words", "n_words"),
    }[rule]
    return F.least(F.ceil(F.lit(float(LEVELS)) * s[top] / F.greatest(s[bottom], F.lit(1))), F.lit(LEVELS)).cast("int")


def binomial_upper(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest p with P(X <= k | n, p) >= error, by bisection on the exact tail."""
    if k >= n:
        return 1.0
    ks = range(k + 1)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in ks]

    def tail(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        return math.fsum(math.exp(c + i * a + (n - i) * b) for i, c in zip(ks, logs))

    lo, hi = k / n, 1.0 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid > 0 and tail(mid) >= error else (lo, mid)
    return hi


@dataclass(frozen=True)
class Cutoffs:
    """``level[(stratum, rule)]``: documents whose grid level exceeds it are rejected; absent: no rejection."""

    level: dict[tuple[int, str], int] = field(default_factory=dict)

    def kept(self, s: Column) -> Column:
        """False where the base rules or a certified cutoff reject."""
        bad = base_failed(s)
        for (band, rule), at in sorted(self.level.items()):
            bad = bad | ((stratum(s) == band) & (_level(s, rule) > at))
        return ~bad


def choose_cutoffs(histogram: dict[tuple[int, str], dict[int, int]], max_false_rejection: float, error: float) -> Cutoffs:
    """``histogram[(stratum, rule)][level]``: good documents at that level. See the module text."""
    tests = (len(BANDS) + 1) * len(RULES) * LEVELS
    chosen = {}
    for key, counts in histogram.items():
        n = sum(counts.values())
        rejected = 0
        for at in range(LEVELS - 1, -1, -1):  # nested sets: lower cutoffs reject more
            rejected += counts.get(at + 1, 0)
            if binomial_upper(rejected, n, error / tests) > max_false_rejection / len(RULES):
                break
            chosen[key] = at
    return Cutoffs(chosen)


def fit_cutoffs(stats: DataFrame, s: str, labels: DataFrame, id_col: str = "doc_id", max_false_rejection: float = 0.03, error: float = 0.05) -> Cutoffs:
    """Cutoffs from ``stats`` (``id_col`` and the struct ``s``) and ``labels`` (``doc_id``, ``quality``).

    Only a histogram reaches the driver: at most strata x rules x (levels + 1) rows at any input size.
    """
    good = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min("quality").alias("__lo"), F.max("quality").alias("__hi"))
        .where("__lo = 1 and __hi = 1")
        .select("__id")
    )
    held = stats.select(F.col(id_col).alias("__id"), F.col(s).alias("__s")).join(good, "__id", "left_semi").where(~base_failed(F.col("__s")))
    c = F.col("__s")
    rows = (
        held.select(stratum(c).alias("band"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _level(c, r).alias("level")) for r in RULES])).alias("x"))
        .groupBy("band", "x.rule", "x.level")
        .count()
        .collect()
    )
    histogram: dict[tuple[int, str], dict[int, int]] = {}
    for band, rule, level, n in rows:
        histogram.setdefault((band, rule), {})[level] = n
    return choose_cutoffs(histogram, max_false_rejection, error)


def judge_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the statistics, ``base_failed`` and ``kept``."""
    stats = cut(add_stats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "__s").select("doc_id", "__s"), "rule-stats")
    cutoffs = fit_cutoffs(stats, "__s", labels)
    s = F.col("__s")
    return stats.select("doc_id", "__s.*", base_failed(s).alias("base_failed"), cutoffs.kept(s).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns as they are.

    Two passes over the texts: narrow statistics for the cutoffs first, then the judgement beside each
    row, so texts are never shuffled and rows need no key.
    """
    name = free_name(docs, "rules")
    stats = cut(add_stats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "__s").select("doc_id", "__s"), "rule-stats")
    cutoffs = fit_cutoffs(stats, "__s", labels)
    return add_stats(docs, name, text_col).where(cutoffs.kept(F.col(name))).drop(name)
