"""Ranking, paging and top-k.

Global top-k is ``orderBy(...).limit(k)``: Spark plans TakeOrderedAndProject (per-task top-k,
then a k-way merge), never a full sort. Every order ends with a unique key so ties are stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.emails import mask_email


def fill_to_target(stubs: DataFrame, n: int, source_order: list[str], seq_col: str = "seq") -> DataFrame:
    """Take sources in the given order until n candidates (top-k over (source rank, seq))."""
    rank = F.array_position(F.array(*[F.lit(s) for s in source_order]), F.col("source_platform"))
    ranked = stubs.withColumn("source_rank", F.when(rank > 0, rank).otherwise(F.lit(len(source_order) + 1)))
    return ranked.orderBy("source_rank", seq_col).limit(n)


def contacts_page(contacts: DataFrame, page: int = 1, per_page: int = K.PAGE_SIZE, status: str | None = None,
                  search: str | None = None, channel: str = "all", after: tuple | None = None) -> DataFrame:
    """Optional status / search (case-insensitive LIKE on name or email) / channel; newest first; one page.

    ``total`` and ``pages`` come from a scalar subquery over the same filters (no join, no driver round trip).
    ``after=(contacted_at, id)`` gives the keyset form: the page that follows that row (rows strictly
    after it in (contacted_at desc, id asc) order), so a deep page costs a per-task top-k of
    ``per_page`` rows instead of ``offset + per_page``; ``page`` is then ignored.
    """
    if channel not in ("all", "main", "gmail"):
        raise ValueError(f"unknown channel: {channel}")
    c = contacts
    if channel != "all":
        c = c.filter(F.col("channel") == channel)
    if status:
        c = c.filter(F.col("email_status") == status)
    if search:
        pat = f"%{search}%"
        c = c.filter(F.col("full_name").ilike(pat) | F.col("email").ilike(pat))
    c = c.select("id", "full_name", "email", "email_status", "contacted_at", "open_detected", "replied", "channel")
    total = c.agg(F.count("*")).scalar()
    ordered = c
    if after is not None:
        ts, last_id = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        ordered = c.filter((F.col("contacted_at") < ts) | ((F.col("contacted_at") == ts) & (F.col("id") > last_id)))
    ordered = ordered.orderBy(F.col("contacted_at").desc_nulls_last(), F.col("id").asc())
    rows = ordered.limit(per_page) if after is not None else ordered.offset((page - 1) * per_page).limit(per_page)
    return rows.select("*", total.alias("total"), F.ceil(total / F.lit(per_page)).cast("bigint").alias("pages"),
                       F.lit(page).alias("current_page"))


def activity_feed(contacts: DataFrame, n: int = K.ACTIVITY_FEED_SIZE) -> DataFrame:
    """Latest n of sent events and open events, both channels."""
    sent = contacts.filter(F.col("email_status") == "sent").select(
        F.lit("email_sent").alias("type"), "id", "full_name", F.col("contacted_at").alias("timestamp"), "channel")
    opened = contacts.filter(F.col("open_detected")).select(
        F.lit("open").alias("type"), "id", "full_name", F.col("open_detected_at").alias("timestamp"), "channel")
    return sent.unionByName(opened).orderBy(
        F.col("timestamp").desc_nulls_last(), F.col("type").asc(), F.col("id").asc()).limit(n)


def top_leads(contacts: DataFrame, n: int = K.TOP_LEADS_SIZE, scores: DataFrame | None = None) -> DataFrame:
    """Score > 0 or interested; interested ranks as 1000; top n (ties by id).

    ``scores`` (author_id, lead_score and, with ``source``, per channel), e.g. from the event feed, replaces the stored
    score when given.
    """
    c = contacts
    if scores is not None:
        keys = ["id", "channel"] if "source" in scores.columns else ["id"]
        c = c.drop("lead_score").join(
            scores.withColumnsRenamed({"author_id": "id", "source": "channel"}), keys, "left"
        ).withColumn("lead_score", F.coalesce(F.col("lead_score"), F.lit(0).cast("bigint")))
    interested = F.coalesce(F.col("reply_sentiment") == "interested", F.lit(False))
    c = c.filter((F.col("lead_score") > 0) | interested)
    rank = F.when(interested, F.lit(K.INTERESTED_RANK_SCORE).cast("bigint")).otherwise(F.col("lead_score"))
    return (
        c.select("id", "full_name", "email", "lead_score", "reply_sentiment", "channel", rank.alias("rank_score"))
        .orderBy(F.col("rank_score").desc(), F.col("id").asc())
        .limit(n)
    )


def pending_approvals(contacts: DataFrame) -> DataFrame:
    """Approval queue, newest first."""
    return (
        contacts.filter(F.col("approval_status") == "pending")
        .select("id", "full_name", "email", "source_platform", F.col("contacted_at").alias("found_at"), "channel")
        .orderBy(F.col("found_at").desc_nulls_last(), F.col("id").asc())
    )


THREAD_CHUNK_MESSAGES = 64


def thread_text(messages: DataFrame, key: str = "author_id", chunk_messages: int = THREAD_CHUNK_MESSAGES) -> DataFrame:
    """Per thread, "[DIRECTION] Subject: ...\nBody: ...\n---\n" per message in time order.

    The text is emitted in ordered chunks: chunk = seq div ``chunk_messages``, so no aggregate holds
    more than ``chunk_messages`` messages however long a thread grows; the whole thread text is the
    chunks' texts in chunk order. ``n_messages`` counts the whole thread (a partial count map-side).
    """
    line = F.concat(
        F.lit("["), F.upper(F.col("direction")), F.lit("] Subject: "), F.coalesce(F.col("subject"), F.lit("")),
        F.lit("\nBody: "), F.coalesce(F.col("body"), F.lit("")), F.lit("\n---\n"),
    )
    parts = messages.select(key, F.floor(F.col("seq") / chunk_messages).alias("chunk"),
                            F.struct(F.col("timestamp").alias("t"), F.col("seq").alias("s"), line.alias("l")).alias("m"))
    chunks = parts.groupBy(key, "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["l"]), "").alias("thread_text"))
    counts = messages.groupBy(key).agg(F.count("*").alias("n_messages"))
    return chunks.join(counts, key).select(key, "chunk", "n_messages", "thread_text")


def top_contacted(run: DataFrame, n: int = K.TOP_CONTACTED_SIZE, seq_col: str = "seq") -> DataFrame:
    """First n contacted in a run: rank, name, first title or N/A, masked email."""
    first = run.orderBy(seq_col).limit(n)
    from pyspark.sql import Window

    w = Window.orderBy(seq_col)  # at most n rows: the limit bounds this single-partition window
    return first.select(
        F.row_number().over(w).cast("bigint").alias("rank"), F.col("full_name"),
        F.coalesce(F.get(F.col("book_titles"), 0), F.lit("N/A")).alias("first_title"),
        mask_email(F.col("email")).alias("masked_email"),
    )
