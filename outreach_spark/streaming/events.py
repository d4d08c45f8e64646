"""Delivery / tracking / reply streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as SC
from ..functions.emails import email_key, sender_address
from ..functions.text import normalise_sentiment
from ..operators.engagement import event_points, lead_scores, open_state
from ..operators.state import ChangedKeys, make_folder
from . import feeds


def as_event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session time zone is UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"


#: The columns of the event feed, whatever it came from.
EVENT_COLUMNS = ["event_key", "event_id", "ts", "arrived_at", "author_id", "email", "event", "source"]


def parse_delivery_payloads(df: DataFrame, body_col: str = "body", timestamp_format: str = ISO_MICROS) -> DataFrame:
    """Webhook bodies (JSON arrays of events) -> one row per event; malformed bodies give no rows.

    Ids are text. With a place (``feeds.PLACE``) an event without a time happened when it arrived, and one without an id is
    known by its place; without a place such an event has no ``event_key``."""
    e = feeds.parsed_bodies(df, body_col, timestamp_format)
    placed = feeds.has_place(df)
    arrived = F.col("arrived_at") if placed else F.lit(None).cast("timestamp")
    made = e.select(
        *([feeds.place_key("pos").alias("_place")] if placed else [F.lit(None).cast("string").alias("_place")]), arrived.alias("arrived_at"),
        feeds.text_id("e.event_id").alias("event_id"), F.coalesce(F.col("e.ts"), arrived).alias("ts"), feeds.text_id("e.author_id").alias("author_id"),
        F.nullif(F.trim("e.email"), F.lit("")).alias("email"), F.col("e.event").alias("event"), F.coalesce(feeds.text_id("e.source"), F.lit("main")).alias("source"))
    return made.select(F.coalesce(F.concat(F.lit("id|"), F.col("event_id")), F.col("_place")).alias("event_key"), *EVENT_COLUMNS[1:])


def _q(url: Column, key: str) -> Column:
    return F.regexp_extract(url, r"[?&]" + key + r"=([^&#]*)", 1)


def parse_tracking_hits(df: DataFrame, url_col: str = "request_url") -> DataFrame:
    """Pixel / click request URLs -> (author_id, source default 'main', event open|click, target url). Ids are text
    of any form; a request without an author gives no row."""
    u = F.col(url_col)
    path = F.regexp_extract(u, r"/track/(open|click)\b", 1)
    return df.select(
        *[c for c in df.columns if c != url_col],
        feeds.text_id(F.try_url_decode(_q(u, "author_id"))).alias("author_id"),
        F.coalesce(F.nullif(_q(u, "source"), F.lit("")), F.lit("main")).alias("source"),
        F.nullif(path, F.lit("")).alias("event"),
        F.nullif(F.try_url_decode(_q(u, "url")), F.lit("")).alias("target_url"),
    ).filter(F.col("author_id").isNotNull())


def inbound_posts(df: DataFrame, body_col: str = "value") -> DataFrame:
    """The inbound form posts (one JSON object per line: ``from``, ``text``, and what the model said of it) as mail
    rows with their place; they carry neither a message id nor a time."""
    post = F.from_json(F.col(body_col), feeds.INBOUND_POST)
    rows = df.select(*feeds.PLACE, post.alias("p")).filter(F.col("p").isNotNull())
    return rows.select(F.lit(None).cast("string").alias("msg_id"), F.lit(None).cast("timestamp").alias("ts"), F.col("p.from").alias("from_header"),
                       F.coalesce("p.text", F.lit("")).alias("body"), F.col("p.model_output").alias("model_output"), *feeds.PLACE)


def parse_inbound(df: DataFrame, from_col: str = "from_header") -> DataFrame:
    """Inbound messages -> sender address and reply label. With a place a message without an id is known
    by it, and one without a time was sent when it arrived."""
    msg_id, ts = F.col("msg_id"), F.col("ts")
    if feeds.has_place(df):
        msg_id = F.coalesce(feeds.text_id("msg_id"), feeds.place_key())
        ts = F.coalesce(ts.cast("timestamp"), F.col("arrived_at"))
    return df.select(msg_id.alias("msg_id"), ts.alias("ts"), sender_address(F.col(from_col)).alias("sender"), "body",
                     normalise_sentiment(F.col("model_output")).alias("sentiment")).filter(F.col("sender").isNotNull())


def route_events(events: DataFrame) -> DataFrame:
    """Open -> mark + score; click -> score; bounce / dropped -> warning; other types ignored;
    open / click without an author ignored. The address goes along where the feed has one."""
    e = F.col("event")
    action = (
        F.when((e == "open") & F.col("author_id").isNotNull(), "mark_open_and_score")
        .when((e == "click") & F.col("author_id").isNotNull(), "score")
        .when(e.isin("bounce", "dropped"), "log_warning")
    )
    email = F.col("email") if "email" in events.columns else F.lit(None).cast("string")
    return events.select(event_key(events).alias("event_key"), "event_id", "ts", "author_id", email.alias("email"), "source", "event", action.alias("action"),
                         event_points(e).alias("points")).filter(F.col("action").isNotNull())


def stream_lead_scores(events: DataFrame) -> DataFrame:
    """Running score per author and channel (streaming aggregation; complete or update mode)."""
    return lead_scores(events, by_channel=True)


def stream_open_state(events: DataFrame) -> DataFrame:
    """Opened flag and last open time per author and channel."""
    return open_state(events, by_channel=True).select("author_id", "source", "open_detected", "open_detected_at")


def event_key(events: DataFrame) -> Column:
    """What makes an event one event: the key that the feed gave it (its id, else its place); for rows that no feed
    stamped its id, else its content with its time; a row with neither is an event of its own."""
    given = F.col("event_key") if "event_key" in events.columns else F.lit(None).cast("string")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("author_id", "event", "source", "ts")]
    content = F.when(F.col("ts").isNotNull(), F.concat_ws("|", F.lit("hit"), *parts))
    return F.coalesce(given, F.concat(F.lit("id|"), F.col("event_id").cast("string")), content, F.concat(F.lit("row|"), F.uuid()))


def stream_event_dedup(events: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Drop repeated deliveries of an event.

    In a stream a key is remembered for ``horizon`` of processing time. The watermark is on the time of the micro-batch, not
    of the event, so an event may be as late as it likes and is never dropped for it."""
    keyed = events.withColumn("event_key", event_key(events))
    if events.isStreaming:
        out = keyed.withColumn("_seen_at", F.current_timestamp()).withWatermark("_seen_at", horizon).dropDuplicatesWithinWatermark(["event_key"]).drop("_seen_at")
    else:
        out = keyed.dropDuplicates(["event_key"])
    return out if "event_key" in events.columns else out.drop("event_key")


def feed_health(events: DataFrame, late_after: str = "1 day") -> DataFrame:
    """Per arrival day and type: events, and of these how many came later than ``late_after`` after they happened, without an
    id, and without an author. Late events are counted here; none is dropped."""
    late = F.col("ts") < F.col("arrived_at") - F.expr(f"INTERVAL {late_after}")
    return events.groupBy(F.to_date("arrived_at").alias("day"), "event").agg(
        F.count("*").alias("events"), F.count_if(late).alias("late"), F.count_if(F.col("event_id").isNull()).alias("without_id"),
        F.count_if(F.col("author_id").isNull()).alias("without_author"))


def stream_daily_counts(events: DataFrame) -> DataFrame:
    """Events per UTC day and type (tumbling 1-day windows). The state is one row per day and type, so no watermark
    is needed and late events still count (update or complete mode)."""
    w = events.groupBy(F.window("ts", "1 day").alias("w"), "event").agg(F.count("*").alias("events"))
    return w.select(F.to_date(F.col("w.start")).alias("day"), "event", "events")


def stream_logs(routed: DataFrame) -> DataFrame:
    """One log row per applied event; a bounce names the address, else the author."""
    a, aid = F.col("action"), F.col("author_id").cast("string")
    gm = F.when(F.col("source") == "gmail", F.lit(K.LOG_GMAIL_SUFFIX)).otherwise(F.lit(""))
    email = F.nullif(F.col("email"), F.lit("")) if "email" in routed.columns else F.lit(None).cast("string")
    msg = (
        F.when(a == "mark_open_and_score", F.concat(F.lit(K.LOG_OPENED), aid, gm))
        .when(a == "score", F.concat(F.lit(K.LOG_CLICKED), aid, gm))
        .otherwise(F.concat(F.lit("Email "), F.col("event"), F.lit(" for "), F.coalesce(email, aid, F.lit("unknown"))))
    )
    return routed.select(
        F.col("ts").alias("timestamp"), F.when(a == "log_warning", "WARNING").otherwise("INFO").alias("level"),
        F.lit("WEBHOOK").alias("category"), msg.alias("message"), F.lit(None).cast("string").alias("details"),
        F.concat(F.lit("event:"), event_key(routed)).alias("log_key"),
    )


def reply_lookback(replies: DataFrame, as_of, days: int = K.REPLY_LOOKBACK_DAYS) -> DataFrame:
    """T5: messages dated (calendar day) no earlier than as_of's date minus ``days``."""
    d = F.to_date(F.lit(as_of).cast("timestamp_ntz")) if not isinstance(as_of, Column) else F.to_date(as_of)
    return replies.filter(F.to_date(F.col("ts")) >= F.date_sub(d, days))


def known_addresses(contacts: DataFrame) -> DataFrame:
    """One row per address: the id that knows it on each channel (the smallest)."""
    c = contacts.filter(F.col("email_key").isNotNull())
    one = lambda ch: F.min(F.when(F.col("channel") == ch, F.col("id")))
    return c.groupBy("email_key").agg(one("main").alias("main_id"), one("gmail").alias("gmail_id"))


def once_per_message(messages: DataFrame, horizon: str) -> DataFrame:
    """A stream of messages without redeliveries; a message without an id is never taken for another one."""
    keyed = messages.withColumn("_key", F.coalesce("msg_id", F.concat(F.lit("row|"), F.uuid()))).withColumn("_seen_at", F.current_timestamp())
    return keyed.withWatermark("_seen_at", horizon).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_seen_at")


def stream_replies(inbound: DataFrame, contacts: DataFrame, horizon: str | None = None) -> DataFrame:
    """T4: inbound -> sender -> label; with a ``horizon`` (streams) one row per message.

    The author is the contact with the sender's address (main before gmail, D10); a sender that no channel
    knows is kept without an author, as the inbound webhook logs it."""
    r = parse_inbound(inbound).withColumn("email_key", email_key(F.col("sender")))
    if horizon:
        r = once_per_message(r, horizon)
    j = r.join(known_addresses(contacts), "email_key", "left")
    known = F.col("main_id").isNotNull() | F.col("gmail_id").isNotNull()
    text = F.when(F.col("main_id").isNotNull(), K.LOG_REPLY_MAIN).when(F.col("gmail_id").isNotNull(), K.LOG_REPLY_GMAIL).otherwise(K.LOG_REPLY_WEBHOOK)
    return j.select(
        "msg_id", "ts", "email_key", F.coalesce("main_id", "gmail_id").alias("author_id"),
        F.col("main_id").isNotNull().alias("known_main"), F.col("gmail_id").isNotNull().alias("known_gmail"), "sentiment",
        F.lit("incoming").alias("direction"), F.when(known, K.REPLY_SUBJECT).otherwise(K.REPLY_SUBJECT_WEBHOOK).alias("subject"), "body",
        F.concat(text, F.col("email_key"), F.lit(" (Sentiment: "), F.col("sentiment"), F.lit(")")).alias("log_message"),
    )


# ---------------------------------------------------------------- runners


def read_events(spark: SparkSession, source_dir: str, kind: str = "rows", file_glob: str | None = None, stream: bool = True) -> DataFrame:
    """The delivery feed as it lands, with ``EVENT_COLUMNS``: ``rows`` (Parquet events), ``webhook`` (S14: text files, one JSON
    array of events per line) or ``hits`` (S15: JSON lines with ``request_url`` and, where it is known, ``ts``)."""
    none = F.lit(None).cast("string")
    if kind == "webhook":
        return parse_delivery_payloads(feeds.landed_lines(spark, source_dir, stream, file_glob), "value")
    if kind == "hits":
        lines = feeds.landed_lines(spark, source_dir, stream, file_glob)
        hits = parse_tracking_hits(lines.select(*feeds.PLACE, F.from_json("value", feeds.HIT).alias("h")).select(*feeds.PLACE, "h.*"))
        return hits.select(feeds.place_key().alias("event_key"), none.alias("event_id"), F.coalesce("ts", "arrived_at").alias("ts"), "arrived_at",
                           "author_id", none.alias("email"), "event", "source")
    if kind == "rows":
        rows = feeds.landed_rows(spark, source_dir, feeds.EVENT_ROWS, stream, file_glob).withColumn("event_id", feeds.text_id("event_id"))
        return rows.select(F.coalesce(F.concat(F.lit("id|"), F.col("event_id")), feeds.place_key()).alias("event_key"), "event_id",
                           F.coalesce(F.col("ts").cast("timestamp"), F.col("arrived_at")).alias("ts"), "arrived_at",
                           feeds.text_id("author_id").alias("author_id"), none.alias("email"), "event", "source")
    raise ValueError(f"unknown kind of feed: {kind}")


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream's checkpoint got when it was made."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first().id


def engagement_updates(events: DataFrame) -> DataFrame:
    """The engagement state of every (author, channel) that has events: points, opens and the last bounce / dropped
    event, in one aggregate (a streaming one keeps it in the state store)."""
    e = F.col("event")
    ev = events.filter(F.col("author_id").isNotNull() & e.isin("open", "click", "bounce", "dropped"))
    return ev.groupBy("author_id", "source").agg(
        F.sum(event_points(e)).cast("bigint").alias("lead_score"), F.max(F.when(e == "open", F.col("ts"))).alias("open_detected_at"),
        F.min(F.when(e == "open", F.col("ts"))).alias("first_open_at"), F.count_if(e == "open").alias("opens"),
        F.max(F.when(e.isin("bounce", "dropped"), F.struct("ts", "event_key", "event"))).alias("status"))


def _start(stream: DataFrame, checkpoint: str, available_now: bool, mode: str = "append"):
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")


def _to_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool):
    """Append a stream to a Parquet table; the sink's own log makes a replayed batch change nothing. With ``available_now`` what
    has landed is in the table on return, so that streams that read it start from all of it."""
    make_folder(stream.sparkSession, path)
    started = _start(stream, checkpoint, available_now).format("parquet").start(path)
    if available_now:
        started.awaitTermination()
    return started


def _to_state(stream: DataFrame, path: str, keys: list[str], checkpoint: str, available_now: bool):
    """Keep an aggregate's changed keys in ``ChangedKeys`` (update mode: a batch has only the keys that it changed)."""
    session = stream.sparkSession

    def put(changed: DataFrame, number: int) -> None:
        ChangedKeys(changed.sparkSession, path, keys).put(changed, number, checkpoint_id(changed.sparkSession, checkpoint))

    ChangedKeys(session, path, keys).check_owner(checkpoint)
    return _start(stream, checkpoint, available_now, "update").foreachBatch(put).start()


def _table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that another stream appends to, as a stream: only what its sink's log has committed."""
    return spark.readStream.schema(schema).parquet(path)


def run_event_stream(spark: SparkSession, source_dir: str, out_root: str, checkpoint_root: str,
                     available_now: bool = True, file_glob: str | None = None, kind: str = "rows", horizon: str = "7 days") -> list:
    """Run the delivery-event streams: the feed, once per event, is appended to ``events``; from that table one stream writes
    ``logs`` and one keeps the engagement state, whose changed keys are written per batch.

    What a batch costs follows its events and the keys that they change: the state itself lives in Spark's state store
    (RocksDB with a changelog, see ``session.STREAMING``).
    """
    events = stream_event_dedup(read_events(spark, source_dir, kind, file_glob), horizon)
    feed = _to_table(events, f"{out_root}/events", f"{checkpoint_root}/feed", available_now)
    table = _table_stream(spark, f"{out_root}/events", events.schema)
    logs = _to_table(stream_logs(route_events(table)), f"{out_root}/logs", f"{checkpoint_root}/logs", available_now)
    state = _to_state(engagement_updates(table), f"{out_root}/engagement", ["author_id", "source"], f"{checkpoint_root}/events", available_now)
    return [feed, logs, state]


def reply_updates(replies: DataFrame) -> DataFrame:
    """Reply state of an address: the latest label (ties by msg_id) with its time, and the number of messages."""
    known = replies.filter(F.col("email_key").isNotNull())
    return known.groupBy("email_key").agg(F.max(F.struct("ts", "msg_id", "sentiment")).alias("last"), F.count("*").alias("replies"))


def read_inbound(spark: SparkSession, source_dir: str, kind: str = "rows", file_glob: str | None = None, stream: bool = True) -> DataFrame:
    """The inbound feed with its place: ``rows`` (Parquet mail rows; S16 by mailbox) or ``posts`` (S16 by webhook: JSON lines)."""
    if kind == "posts":
        return inbound_posts(feeds.landed_lines(spark, source_dir, stream, file_glob))
    if kind == "rows":
        return feeds.landed_rows(spark, source_dir, feeds.MAIL_ROWS, stream, file_glob)
    raise ValueError(f"unknown kind of feed: {kind}")


def run_reply_stream(spark: SparkSession, source_dir: str, contacts: DataFrame, out_root: str, checkpoint_root: str,
                     available_now: bool = True, as_of=None, lookback_days: int = K.REPLY_LOOKBACK_DAYS, kind: str = "rows",
                     file_glob: str | None = None, horizon: str | None = None) -> list:
    """Reply detection: lookback (T5, when ``as_of`` is given), one row per message (D12: by its id, else by its place), sender ->
    author (D10) and label (T4) are appended to ``messages`` with their log text; the reply state per address follows from
    that table.

    A message id is remembered for ``horizon`` of processing time (the lookback period unless given); messages may be as
    late as they like.
    """
    landed = read_inbound(spark, source_dir, kind, file_glob)
    replies = stream_replies(landed, contacts, horizon or f"{lookback_days} days")
    if as_of is not None:
        replies = reply_lookback(replies, as_of, lookback_days)
    replies = replies.drop("known_main", "known_gmail")
    feed = _to_table(replies, f"{out_root}/messages", f"{checkpoint_root}/messages", available_now)
    table = _table_stream(spark, f"{out_root}/messages", replies.schema)
    state = _to_state(reply_updates(table), f"{out_root}/reply_state", ["email_key"], f"{checkpoint_root}/replies", available_now)
    return [feed, state]


def read_reply_state(spark: SparkSession, out_root: str) -> DataFrame:
    """The reply state that ``run_reply_stream`` keeps, with the columns of A12."""
    rows = ChangedKeys(spark, f"{out_root}/reply_state", ["email_key"]).read()
    return rows.select("email_key", F.lit(True).alias("replied"), F.col("last.sentiment").alias("reply_sentiment"),
                       F.col("last.ts").cast("timestamp_ntz").alias("last_reply_at"), "replies")


def read_engagement(spark: SparkSession, out_root: str) -> DataFrame:
    """The engagement state that ``run_event_stream`` keeps."""
    return ChangedKeys(spark, f"{out_root}/engagement", ["author_id", "source"]).read()


def engagement_differences(spark: SparkSession, out_root: str) -> DataFrame:
    """Reconciliation: the keys whose streamed state differs from a batch aggregate over the ``events`` table (none when the
    streams have caught up), with both."""
    keys = ["author_id", "source"]
    batch = engagement_updates(spark.read.parquet(f"{out_root}/events"))
    cols = [c for c in batch.columns if c not in keys]
    both = batch.select(*keys, F.struct(*cols).alias("batch")).join(read_engagement(spark, out_root).select(*keys, F.struct(*cols).alias("stream")), keys, "full_outer")
    return both.filter(~F.col("batch").eqNullSafe(F.col("stream")))
