"""Per-group top-n.

``row_number() <= n`` over a window is planned by Spark (3.5+) with a *partial* WindowGroupLimit
before the shuffle: every map task keeps at most n rows per group, so a group holding a third of
all rows ships at most n x (map tasks) rows to its reducer. The order must be total (end with a
unique key) for the result to be deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w).cast("bigint")).filter(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)
