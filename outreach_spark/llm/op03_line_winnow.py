"""Operator 3: line dedup by winnowing over line hashes, in DataFrame functions only.

A text is its newline-separated lines; lines without a word are transparent (never matched, never
deleted). The window of a line is the fewest lines from it on that hold ``min_words`` words. Winnowing selects in every
window the line with the least hash (the last one of equal ones). Equal windows select the same place, so every run of
``min_words`` words or more that occurs twice holds a selected line in both places: selected lines are guaranteed
fingerprints, and neighbouring windows mostly share one. Then:

1. Fingerprints that are selected at one place only are dropped, and all windows around them.
2. A match at a repeated fingerprint is extended to the left over the windows that select it: their lines are compared
   (by two hashes of all lines of the window), and each is matched to its earliest equal window.
3. Where a window is repeated, its match is extended to the right, beyond the last full window, over the lines that have the
   window's start as the last start from which ``min_words`` words lie before them.
4. Later ones of these runs are intervals of lines; they are merged and deleted.

Earliest places come from aggregates of minima and one join back, so a copy makes a row, never pairs, and a
line that a third of all documents share is compared only with equal surroundings. Every repeated run is the union of its
windows and their extensions, so exactly its lines are found. Order is (doc_id, text hash, line number), nulls first; every
deleted line has an equal one that stays.

Defined cases: null text stays null and takes no part; empty text stays empty; repeated rows (same id
and text) count as one document and stay alike; null ids take part; with no repeated run a text is
returned byte for byte; an empty table gives an empty result; other columns pass through, except that a
``n_chars`` column is set to the new length where a text changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, cut, free_name

#: Keys are two 64-bit hashes with different seeds.
_SALT = "line"


def _row_key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).isNotNull().alias("has_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with a word: ``k`` (row key), ``pos`` (line number), ``h`` and ``h2`` (hashes), ``w`` (words)."""
    lines = docs.where(F.col(text_col).isNotNull()).select(_row_key(id_col, text_col).alias("k"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    words = F.regexp_count("line", F.lit(WORD_CLASS))
    return lines.select("k", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(_SALT), "line").alias("h2"), words.alias("w")).where("w > 0")


def winnow(lines: DataFrame, min_words: int) -> DataFrame:
    """Each line with its window's end ``hi``, selected line (``fingerprint``, its hash, at ``at``) and ``run`` (two hashes
    of the window's lines), ``fresh`` where the window before selected another place; nulls where fewer words follow. ``start`` and
    ``tail`` (hashes) are set on lines that extend a window: the last start with ``min_words`` words up to here, if its window ended before.
    """
    lines = lines.repartition("k").dropDuplicates(["k", "pos"])
    upto = lines.withColumn("c", F.sum("w").over(Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("s", F.col("c") - F.col("w"))
    from_here = Window.partitionBy("k").orderBy("s")  # words before a line: they grow with every line
    right, left = from_here.rangeBetween(0, min_words - 1), Window.partitionBy("k").orderBy("c").rangeBetween(1 - min_words, 0)
    full = F.max("c").over(right) - F.col("s") >= min_words

    def run(frame) -> Column:
        return F.struct(F.xxhash64(F.collect_list("h").over(frame)).alias("a"), F.xxhash64(F.collect_list("h2").over(frame)).alias("b"))

    chosen = upto.select(
        "k", "pos", "h", "h2", "s", "c",
        F.when(full, F.max("pos").over(right)).alias("hi"),
        F.when(full, F.min(F.struct("h", (-F.col("pos")).alias("p"))).over(right)).alias("least"),
        F.when(full, run(right)).alias("run"),
    )
    chosen = chosen.withColumn("fresh", F.col("least").isNotNull() & ~F.lag("least").over(from_here).eqNullSafe(F.col("least")))
    longer = (F.col("s") - F.min("s").over(left) >= min_words) & (F.col("c") >= min_words)
    return chosen.select(
        "k", "pos", "hi", "run", "fresh",
        F.col("least.h").alias("fingerprint"),
        (-F.col("least.p")).alias("at"),
        F.when(longer, F.min("pos").over(left)).alias("start"),
        F.when(longer, run(left)).alias("tail"),
    )


def _earliest(rows: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """The keys at two places or more, with their earliest place ``first``."""
    return rows.groupBy(*keys).agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").drop("last")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(``k``, ``lo``, ``hi``): disjoint intervals of line numbers inside runs of ``min_words`` words or more that occurred before."""
    found = cut(winnow(line_table(docs, id_col, text_col), min_words), "line-fingerprints")  # read by the steps below
    often = found.where("fresh").groupBy("fingerprint").agg(F.count("*").alias("places")).where("places > 1").select("fingerprint")
    near = cut(found.where("run is not null").join(often, "fingerprint", "left_semi").select("k", "pos", "hi", "fingerprint", "run"), "line-windows")
    at = F.struct("k", "pos")
    same = near.join(_earliest(near, ["fingerprint", "run"], at), ["fingerprint", "run"])
    same = cut(same.select("k", "pos", "hi", (F.col("first") < at).alias("later")), "line-matches")
    starts = same.select("k", F.col("pos").alias("start"))
    tails = found.where("start is not null").select("k", "pos", "start", "tail").join(starts, ["k", "start"])
    tails = cut(tails.select("k", "pos", "start", "tail"), "line-tails")
    later = tails.join(_earliest(tails, ["tail"], at), "tail").where(F.col("first") < at).select("k", F.col("start").alias("lo"), F.col("pos").alias("hi"))
    gone = same.where("later").select("k", F.col("pos").alias("lo"), "hi").unionByName(later)
    before = Window.partitionBy("k").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    opened = gone.withColumn("opens", F.coalesce((F.col("lo") > F.max("hi").over(before) + 1).cast("long"), F.lit(1)))
    numbered = opened.withColumn("island", F.sum("opens").over(Window.partitionBy("k").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("k", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text_col``; the same rows and columns."""
    name, gone = free_name(docs, "row"), free_name(docs, "gone")
    drop = repeated_runs(docs, id_col, text_col, min_words).groupBy(F.col("k").alias("__k")).agg(F.collect_list(F.struct("lo", "hi")).alias("__runs"))
    out = docs.withColumn(name, _row_key(id_col, text_col)).join(drop, F.col(name).eqNullSafe(F.col("__k")), "left").withColumnRenamed("__runs", gone)

    def stays(line: Column, i: Column) -> Column:
        return ~F.exists(F.col(gone), lambda run: i.between(run["lo"], run["hi"])) | ~F.regexp_like(line, F.lit(WORD_CLASS))

    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), stays), "\n")
    out = out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept))
    if "n_chars" in docs.columns:
        length = F.char_length(text_col).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(length))
    return out.select(*docs.columns)
