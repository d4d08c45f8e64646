"""Record linkage and deduplication.

Anti / semi joins on the normalised ``email_key`` replace the application's per-record point
lookups. "First wins" and "last write wins" are keyed aggregates (min / max over a struct that
starts with the ordering key), so a hot key is combined map-side instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as SC
from ..functions.emails import email_key


def _keyed(df: DataFrame, col: str = "email") -> DataFrame:
    return df if "email_key" in df.columns else df.withColumn("email_key", email_key(col))


def spread_key(key: Column, row: Column) -> Column:
    """A left-join key under which rows without ``key`` are dealt by ``row`` and match nothing (no address
    holds a space)."""
    return F.coalesce(key, F.concat(F.lit("no key "), row.cast("string")))


def not_contacted(candidates: DataFrame, contacts: DataFrame, scope: str = "both") -> DataFrame:
    """J1 (scope='main') / J2 (scope='both'): drop candidates whose email was contacted in the scope."""
    if scope not in ("main", "gmail", "both"):
        raise ValueError(f"unknown scope: {scope}")
    seen = contacts if scope == "both" else contacts.filter(F.col("channel") == scope)
    return absent_from(_keyed(candidates), _keyed(seen), "email_key")


def absent_from(rows: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` no row of ``history`` has; rows without a key stay.

    Of the history only the keys that ``rows`` name are kept, by a semi-join: a run's keys are few, so it is a map-side
    one and the history is scanned (one column) but not shuffled, however long it grows. Rows without a key are dealt."""
    asked = rows.filter(F.col(key).isNotNull()).select(key)
    named = history.select(key).join(asked, key, "left_semi").select(F.col(key).alias("_k"))
    dealt = rows.withColumn("_k", spread_key(F.col(key), F.xxhash64(*rows.columns)))
    return dealt.join(named, "_k", "left_anti").drop("_k")


def name_key(c):
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def not_contacted_by_name(candidates: DataFrame, contacts: DataFrame, name_col: str = "name") -> DataFrame:
    """Drop candidates whose lower(trim(name)) was contacted on either channel."""
    seen = contacts.select(name_key(F.col("full_name")).alias("_nk"))
    return absent_from(candidates.withColumn("_nk", name_key(F.col(name_col))), seen, "_nk").drop("_nk")


def first_per_email(candidates: DataFrame, order_cols: list[str]) -> DataFrame:
    """Within a run the first candidate per email wins (order_cols must end with a unique key).

    The choice is made on the order columns alone; the rows are joined once, by address and order, so a hot
    address is combined map-side and its rows stay spread."""
    c = _keyed(candidates).filter(F.col("email_key").isNotNull())
    best = c.groupBy(F.col("email_key").alias("_k")).agg(F.min(F.struct(*order_cols)).alias("_first"))
    best = best.select("_k", *[F.col("_first")[x].alias("_o_" + x) for x in order_cols])
    same = F.col("email_key") == F.col("_k")
    for x in order_cols:
        same = same & F.col(x).eqNullSafe(F.col("_o_" + x))
    rest = [x for x in c.columns if x not in order_cols and x != "email_key"]
    return c.join(best, same).select("email_key", *order_cols, *rest)


def channel_emails(contacts: DataFrame) -> DataFrame:
    """Distinct (email_key, channel) pairs: each channel is joined once."""
    return _keyed(contacts).filter(F.col("email_key").isNotNull()).select("email_key", "channel").distinct()


def known_sender_replies(replies: DataFrame, contacts: DataFrame, sender_col: str = "sender") -> DataFrame:
    """Replies whose sender is a known contact, once per channel that knows the sender."""
    r = replies.withColumn("email_key", email_key(F.col(sender_col)))
    return r.join(channel_emails(contacts), "email_key", "inner")


def cross_channel_overlap(contacts: DataFrame) -> DataFrame:
    """Addresses contacted on both channels (should be none), with attempts per channel."""
    k = _keyed(contacts).filter(F.col("email_key").isNotNull())
    per = k.groupBy("email_key").agg(
        F.count_if(F.col("channel") == "main").alias("main_attempts"),
        F.count_if(F.col("channel") == "gmail").alias("gmail_attempts"),
    )
    return per.filter((F.col("main_attempts") > 0) & (F.col("gmail_attempts") > 0))


def order_text(c: Column, kind: str) -> Column:
    """A column as text that sorts as the column does: whole numbers and times as hex digits of their distance from the
    smallest one, anything else as its own text."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        c, kind = F.unix_micros(c.cast("timestamp")), "bigint"
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return c.cast("string")


def upsert_contacts(existing: DataFrame, incoming: DataFrame, order_col: str = "seq") -> DataFrame:
    """K1: insert-or-replace with two unique keys (id and email_key).

    Rows are applied in order: ``existing`` first, then ``incoming`` by (``order_col``, id, address); the
    column is required, since without an order "the last one wins" has no meaning. A row survives iff no
    later row shares its id or its email_key. When a surviving row replaced an existing row with the same id,
    that row's engagement columns are kept (D7). Works on the contact columns ``existing`` has (id and
    email_key required), so callers carry only what they need. Ids are text or numbers, of one type in both.

    The place of a row in that order is one short text that sorts as (order, id, address) do, and by a hash of the row beyond
    that, empty for existing rows, so both "last" aggregates carry that text and a key, never a row; the engagement of replaced rows is read for
    the incoming ids only.
    """
    if order_col not in incoming.columns:
        raise ValueError(f"upsert_contacts needs the order column {order_col!r} on the incoming rows")
    cols = [f.name for f in SC.CONTACTS.fields if f.name in existing.columns]
    kept = [c for c in SC.ENGAGEMENT_COLUMNS if c in cols]
    kinds = dict(incoming.dtypes)
    parts = [F.coalesce(order_text(F.col(c), kinds[c]), F.lit("")) for c in (order_col, "id", "email_key")]
    at = F.concat(F.lit("+"), F.concat_ws("\u0001", *parts, F.hex(F.xxhash64(*cols))))
    batch = incoming.select(*cols, order_col).distinct().select(*cols, at.alias("_v"))
    rows = existing.select(*cols, F.lit("").alias("_v")).unionByName(batch)
    by_id = rows.groupBy("id").agg(F.max("_v").alias("_vid"))
    by_email = rows.filter(F.col("email_key").isNotNull()).groupBy(F.col("email_key").alias("_k")).agg(F.max("_v").alias("_vem"))
    survivors = (
        rows.join(by_id, "id").filter(F.col("_v") == F.col("_vid"))
        .withColumn("_k", spread_key(F.col("email_key"), F.col("id"))).join(by_email, "_k", "left")
        .filter(F.col("_vem").isNull() | (F.col("_v") == F.col("_vem")))
    )
    if not kept:
        return survivors.select(*cols)
    replaced = existing.join(incoming.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max(F.struct(*kept)).alias("_old"))
    carried = (F.col("_v") != "") & F.col("_old").isNotNull()
    return survivors.join(replaced, "id", "left").select(*[
        F.when(carried, F.col("_old")[c]).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in cols
    ])
