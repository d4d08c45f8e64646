"""Keyed engagement state from the event feed, and batch state transitions.

Events are the source of truth and every state column is an order-independent aggregate over
them (sum, max, max_by), so replays of de-duplicated events and late events give the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def event_points(event: Column) -> Column:
    """Points per event: open +1, click +5, others 0."""
    return F.when(event == "open", F.lit(K.OPEN_POINTS)).when(event == "click", F.lit(K.CLICK_POINTS)).otherwise(F.lit(0))


def lead_scores(events: DataFrame, by_channel: bool = False) -> DataFrame:
    """A10: sum of points per author (events without an author are ignored)."""
    keys = ["author_id", "source"] if by_channel else ["author_id"]
    ev = events.filter(F.col("author_id").isNotNull() & F.col("event").isin("open", "click"))
    return ev.groupBy(*keys).agg(F.sum(event_points(F.col("event"))).cast("bigint").alias("lead_score"))


def open_state(events: DataFrame, by_channel: bool = False) -> DataFrame:
    """Opened flag, last (and first) open time per author, or per author and channel (the
    event's ``source``, as the tracking pixel names it)."""
    keys = ["author_id", "source"] if by_channel else ["author_id"]
    ev = events.filter(F.col("author_id").isNotNull() & (F.col("event") == "open"))
    return ev.groupBy(*keys).agg(
        F.lit(True).alias("open_detected"), F.max("ts").alias("open_detected_at"),
        F.min("ts").alias("first_open_at"), F.count("*").alias("opens"),
    )


def reply_state(replies: DataFrame, key: str = "email_key") -> DataFrame:
    """Replied flag, the latest sentiment (ties by msg_id) and the number of messages per address.

    Rows of one message (one per channel, or redelivered) count once: a first aggregate reduces to messages. A row without a
    message id is a message of its own."""
    one = replies.withColumn("_id", F.coalesce(F.col("msg_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))))
    per_message = one.groupBy(key, "msg_id", "_id").agg(F.max(F.struct("ts", "sentiment")).alias("_m"))
    return per_message.groupBy(key).agg(
        F.lit(True).alias("replied"),
        F.max(F.struct("_m.ts", "msg_id", "_m.sentiment"))["sentiment"].alias("reply_sentiment"),
        F.max("_m.ts").alias("last_reply_at"), F.count("*").alias("replies"),
    )


def delivery_status(events: DataFrame, by_channel: bool = False) -> DataFrame:
    """The last bounce / dropped event per author (and channel) sets its status."""
    keys = ["author_id", "source"] if by_channel else ["author_id"]
    ev = events.filter(F.col("author_id").isNotNull() & F.col("event").isin("bounce", "dropped"))
    last = ev.groupBy(*keys).agg(F.max(F.struct("ts", "event_id", "event")).alias("l"))
    return last.select(*keys, F.when(F.col("l.event") == "bounce", "bounced").otherwise("dropped").alias("email_status"),
                       F.col("l.ts").alias("status_at"))


def engagement_of(events: DataFrame) -> DataFrame:
    """One row per (author_id, source): points, last open and last status, in a single aggregate of the feed."""
    e = F.col("event")
    ev = events.filter(F.col("author_id").isNotNull() & e.isin("open", "click", "bounce", "dropped"))
    return ev.groupBy("author_id", "source").agg(
        F.sum(event_points(e)).cast("bigint").alias("points"),
        F.max(F.when(e == "open", F.col("ts"))).alias("open_at"),
        F.max(F.when(e.isin("bounce", "dropped"), F.struct("ts", "event_id", "event")))["event"].alias("last_status"),
    )


def apply_engagement(contacts: DataFrame, events: DataFrame, base_scores: bool = True) -> DataFrame:
    """Fold the event feed into the contacts snapshot (opens, last open, scores, bounce status).

    Events go to the contact of their id AND channel (``source``). ``events`` is the whole (de-duplicated)
    feed and the fold is a function of it, so folding twice gives the same rows: an open time is the
    greatest of stored and seen, and the score is ``score_base`` (the score before any event, kept from the
    first fold on) plus the feed's points.
    """
    return _fold(contacts, engagement_of(events), base_scores)


def apply_engagement_state(contacts: DataFrame, state: DataFrame, base_scores: bool = True) -> DataFrame:
    """The same fold from the state that the event stream keeps (``read_engagement``), so that opens, scores and bounces
    reach the snapshot, and with it the circuit breaker, without reading the feed again."""
    seen = state.select("author_id", "source", F.col("lead_score").alias("points"), F.col("open_detected_at").cast("timestamp_ntz").alias("open_at"),
                        F.col("status.event").alias("last_status"))
    return _fold(contacts, seen, base_scores)


def _fold(contacts: DataFrame, seen: DataFrame, base_scores: bool) -> DataFrame:
    seen = seen.select(F.col("author_id").alias("id"), F.col("source").alias("channel"), "points", "open_at", "last_status")
    j = contacts.join(seen, ["id", "channel"], "left")
    base = F.col("score_base") if "score_base" in contacts.columns else F.col("lead_score")
    made = {
        "lead_score": base + F.coalesce(F.col("points"), F.lit(0)),
        "open_detected": F.col("open_detected") | F.col("open_at").isNotNull(),
        "open_detected_at": F.greatest("open_at", "open_detected_at"),
        "email_status": F.coalesce(F.when(F.col("last_status") == "bounce", "bounced").when(F.col("last_status") == "dropped", "dropped"), F.col("email_status")),
    }
    out = [made[c].alias(c) if c in made else F.col(c) for c in contacts.columns if c != "score_base"]
    return j.select(*out, *([base.alias("score_base")] if base_scores else []))


def set_approval(contacts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (id, decision) to the main row of that id, else to the gmail row (one row per id per channel).

    Several decisions for one id: the latest by ``decided_at`` when that column is there, and a rejection
    before an approval when they tie (or have no time)."""
    when = [F.col("decided_at")] if "decided_at" in decisions.columns else []
    order = F.struct(*when, (F.col("decision") != "approved").alias("_no"), F.col("decision").alias("_d"))
    dec = decisions.groupBy("id").agg(F.max(order)["_d"].alias("_decision"))
    # the target channel: main when that row exists, from a min over the decision-sized part of contacts
    prio = F.when(F.col("channel") == "main", 0).otherwise(1)
    target = contacts.select("id", prio.alias("p")).join(dec.select("id"), "id", "left_semi").groupBy("id").agg(F.min("p").alias("_target"))
    j = contacts.join(dec.join(target, "id"), "id", "left")
    hit = F.col("_target") == prio
    return j.withColumn("approval_status", F.when(hit, F.col("_decision")).otherwise(F.col("approval_status"))) \
        .withColumn("updated", F.coalesce(hit, F.lit(False))).drop("_decision", "_target")


def followup_eligible(contacts: DataFrame, as_of, delay_days: int = K.FOLLOW_UP_DELAY_DAYS) -> DataFrame:
    """Sent, opened, not replied, no follow-up yet, contacted at least delay_days before as_of."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    cutoff = now - F.make_dt_interval(F.lit(delay_days))
    return contacts.filter(
        (F.col("email_status") == "sent") & F.col("open_detected") & ~F.col("replied")
        & ~F.col("followup_sent") & (F.col("contacted_at") <= cutoff)
    )


def mark_followup_sent(contacts: DataFrame, sent: DataFrame, sent_at_col: str = "sent_at") -> DataFrame:
    """Set the follow-up flag and time for the rows in ``sent`` (id, and channel when it has one); of
    several rows for one contact the latest time counts."""
    keys = ["id", "channel"] if "channel" in sent.columns else ["id"]
    s = sent.groupBy(*keys).agg(F.max(sent_at_col).alias("_at"))
    j = contacts.join(s, keys, "left").select(*contacts.columns, "_at")
    return j.withColumn("followup_sent", F.col("followup_sent") | F.col("_at").isNotNull()) \
        .withColumn("followup_sent_at", F.coalesce(F.col("_at"), F.col("followup_sent_at"))).drop("_at")
