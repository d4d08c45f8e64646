"""Reports kept up to date from what changed between two versions of the contacts table.

A changed row counts once with its old values and sign -1, and once with its new ones and sign +1. Reports whose
numbers are sums over rows take these signed rows as they take any rows, so a day's update costs the day's changes
once they are known, and corrections of old rows are no special case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` differ between two versions: ``keys``, ``change`` (inserted, deleted, changed), ``old``, ``new`` (structs
    of the columns, null where there is no row). One row per key in each version; null keys match each other."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.struct(*columns).alias(name))

    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}"))
    both = side(old, "old").join(side(new, "new"), same, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").otherwise("changed")
    return both.select(*[F.coalesce(f"_new_{k}", f"_old_{k}").alias(k) for k in keys], change.alias("change"), "old", "new")


def signed_rows(changes: DataFrame) -> DataFrame:
    """The changes as rows with ``sign``: the old values leave (-1), the new ones come (+1)."""
    sides = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("r")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("r")))
    return changes.select(F.explode(sides).alias("s")).filter(F.col("s.r").isNotNull()).select("s.sign", "s.r.*")


class Report:
    """A report of sums: what a contact row adds to which group."""

    def __init__(self, columns: list[str], keys: list[str], measures: list[str], rows: Callable[[DataFrame], DataFrame]) -> None:
        self.columns, self.keys, self.measures, self._rows = columns, keys, measures, rows

    def full(self, contacts: DataFrame) -> DataFrame:
        """The report over all rows."""
        return self._sum(self._rows(contacts.select(*self.columns, F.lit(1).alias("sign"))))

    def updated(self, report: DataFrame, changes: DataFrame) -> DataFrame:
        """The report after ``changes`` (``snapshot_changes`` over at least this report's columns)."""
        moved = self._rows(signed_rows(changes).select(*self.columns, "sign"))
        return self._sum(report.select(*self.keys, *self.measures).unionByName(self._sum(moved)))

    def _sum(self, rows: DataFrame) -> DataFrame:
        summed = rows.groupBy(*self.keys).agg(*[F.sum(m).cast("bigint").alias(m) for m in self.measures])
        empty = F.lit(True)
        for m in self.measures:
            empty = empty & (F.col(m) == 0)
        return summed.filter(~empty)


def _count(condition: Column | None = None) -> Column:
    sign = F.col("sign").cast("bigint")
    return sign if condition is None else F.when(F.coalesce(condition, F.lit(False)), sign).otherwise(F.lit(0).cast("bigint"))


def _status(c: DataFrame) -> DataFrame:
    return c.select(F.coalesce(F.nullif(F.col("email_status"), F.lit("")), F.lit("unknown")).alias("email_status"), _count().alias("count"))


def _days(c: DataFrame) -> DataFrame:
    return c.filter(F.col("contacted_at").isNotNull()).select(
        F.to_date("contacted_at").alias("day"), *[_count(F.col("channel") == ch).alias(ch) for ch in K.CHANNELS])


def _genres(c: DataFrame) -> DataFrame:
    g = c.select(F.explode_outer("genres").alias("g"), "open_detected", "replied", "sign")
    return g.select(F.coalesce(F.nullif(F.trim("g"), F.lit("")), F.lit("Unknown")).alias("genre"), _count().alias("total"),
                    _count(F.col("open_detected")).alias("opens"), _count(F.col("replied")).alias("replies"))


def _variants(c: DataFrame) -> DataFrame:
    sent = c.filter((F.col("email_status") == "sent") & F.col("ab_variant").isNotNull())
    return sent.select("channel", "ab_variant", _count().alias("sent"), _count(F.col("open_detected")).alias("opens"), _count(F.col("replied")).alias("replies"))


#: The sums behind A7, A2 / A4 (by day), A3 (before its top n) and A5.
REPORTS = {
    "status": Report(["email_status"], ["email_status"], ["count"], _status),
    "days": Report(["contacted_at", "channel"], ["day"], list(K.CHANNELS), _days),
    "genres": Report(["genres", "open_detected", "replied"], ["genre"], ["total", "opens", "replies"], _genres),
    "variants": Report(["channel", "ab_variant", "email_status", "open_detected", "replied"], ["channel", "ab_variant"], ["sent", "opens", "replies"], _variants),
}
#: All columns that the reports read.
REPORT_COLUMNS = sorted({c for r in REPORTS.values() for c in r.columns})
