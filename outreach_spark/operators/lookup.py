"""Lookups of one row per key that stay even when a key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedupe import spread_key


def one_row_lookup(rows: DataFrame, table: DataFrame, key: str, heavy: int = 0) -> DataFrame:
    """``rows`` left-joined to ``table`` (at most one row per text ``key``). Rows without a key are dealt over all tasks.

    With ``heavy`` the commonest keys of ``rows`` (a sketch of that many counters finds them, one number per key, in one
    pass over the key) are answered from a map of their table rows, which enters as one value of at most ``heavy``
    entries; their rows take no part in the shuffle by key and are dealt instead. Which keys the sketch names changes the
    plan's balance only, never the result.
    """
    values = [c for c in table.columns if c != key]
    row = F.xxhash64(*[c for c in rows.columns])
    right = table.select(F.col(key).alias("_k"), F.struct(*values).alias("_v"))
    if not heavy:
        j = rows.withColumn("_k", spread_key(F.col(key), row)).join(right, "_k", "left")
        return j.select(*rows.columns, *[F.col("_v")[c].alias(c) for c in values])
    named = rows.filter(F.col(key).isNotNull()).agg(F.transform(F.call_function("approx_top_k", F.col(key), F.lit(heavy), F.lit(8 * heavy)), lambda x: x["item"]).alias("keys"))
    keys = named.select("keys").scalar()
    few = table.filter(F.array_contains(keys, F.col(key))).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct(*values)))).alias("m"))
    m = few.select("m").scalar()
    is_heavy = F.coalesce(F.array_contains(keys, F.col(key)), F.lit(False))
    dealt = rows.withColumn("_heavy", F.when(is_heavy, F.try_element_at(m, F.col(key)))).withColumn("_k", spread_key(F.when(~is_heavy, F.col(key)), row))
    j = dealt.join(right, "_k", "left")
    return j.select(*rows.columns, *[F.coalesce(F.col("_heavy")[c], F.col("_v")[c]).alias(c) for c in values])
