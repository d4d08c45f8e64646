"""Positions without gathering: the place of a row in its (possibly hot) group, and pages of a sorted table by number.

Both stand on range partitions. Rows are dealt by ranges of (group, order), so a group that holds a third of all rows lies
in many parts; a row's place is its place in its part plus the sizes of the group's earlier parts, a few numbers each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import scratch_path


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "seq") -> DataFrame:
    """``df`` with ``name``: the row's place in its group from 0, by ``order`` (which ends with a unique key). Rows without a
    key are a group like any other.

    The dealt rows are written once in the shared folder, because a second dealing could cut the ranges elsewhere; carry
    only what identifies a row and join the rest by it.
    """
    dealt = df.repartitionByRange(*[F.col(k).asc() for k in keys], *order).withColumn("_part", F.spark_partition_id())
    path = scratch_path(df.sparkSession, f"positions-{uuid.uuid4().hex}")
    dealt.write.parquet(path)
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    within = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias("_s_" + k) for k in keys], F.col("_part").alias("_s_part"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_s_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_s_" + k))
    placed = dealt.withColumn("_within", within).join(starts, same)
    return placed.select(*df.columns, (F.col("_before") + F.col("_within") - 1).alias(name))


def message_positions(messages: DataFrame) -> DataFrame:
    """``msg_id, author_id, seq`` of messages that come without a position: by time, then message id."""
    narrow = messages.select("msg_id", "author_id", "timestamp")
    return positions(narrow, ["author_id"], [F.col("timestamp").asc_nulls_first(), F.col("msg_id").asc()]).select("msg_id", "author_id", "seq")


def with_positions(messages: DataFrame) -> DataFrame:
    """Messages with their ``seq``, as ``thread_text`` (W8) and ``followup_context`` (J10) need it."""
    return messages.drop("seq").join(message_positions(messages).drop("author_id"), "msg_id")


PAGE_COLUMNS = ["id", "full_name", "email", "email_status", "contacted_at", "open_detected", "replied", "channel"]


def _newest() -> list[Column]:
    return [F.col("contacted_at").desc_nulls_last(), F.col("id").asc()]


def write_pages(contacts: DataFrame, root: str, parts: int = 64) -> None:
    """W4 for deep pages: the contacts in the order of the page, one folder per range, and an index of the rows per range,
    channel and status (``parts`` times a few rows). ``root`` is a new folder per snapshot version."""
    rows = contacts.select(*PAGE_COLUMNS).repartitionByRange(parts, *_newest()).withColumn("part", F.spark_partition_id())
    rows.write.partitionBy("part").parquet(f"{root.rstrip('/')}/rows")
    written = contacts.sparkSession.read.parquet(f"{root.rstrip('/')}/rows")
    written.groupBy("part", "channel", "email_status").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{root.rstrip('/')}/index")


def read_page(spark: SparkSession, root: str, page: int, per_page: int = K.PAGE_SIZE, status: str | None = None, channel: str = "all") -> DataFrame:
    """Page ``page`` with the columns of ``contacts_page``. The index says in which ranges it lies and gives the total, so only
    those are read and sorted, however deep the page is."""
    if channel not in ("all", "main", "gmail"):
        raise ValueError(f"unknown channel: {channel}")

    def wanted(df: DataFrame) -> DataFrame:
        df = df if channel == "all" else df.filter(F.col("channel") == channel)
        return df.filter(F.col("email_status") == status) if status else df

    sizes = wanted(spark.read.parquet(f"{root.rstrip('/')}/index")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per range
    start, before, skip, parts = (page - 1) * per_page, 0, 0, []
    for r in sizes:
        if before + r.n > start and before < start + per_page:
            skip = skip if parts else start - before
            parts.append(r.part)
        before += r.n
    reader = spark.read.option("basePath", f"{root.rstrip('/')}/rows")
    rows = reader.parquet(*[f"{root.rstrip('/')}/rows/part={p}" for p in parts]) if parts else reader.parquet(f"{root.rstrip('/')}/rows").limit(0)
    rows = wanted(rows).select(*PAGE_COLUMNS).orderBy(*_newest()).offset(skip).limit(per_page)
    return rows.select("*", F.lit(before).cast("bigint").alias("total"), F.lit(-(-before // per_page)).cast("bigint").alias("pages"), F.lit(page).alias("current_page"))
