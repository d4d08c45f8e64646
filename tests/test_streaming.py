"""Batch = stream: the streaming operators over availableNow micro-batches equal the batch operators."""

import os

import pytest
from pyspark.sql import functions as F

from outreach_spark.operators import engagement
from outreach_spark.operators.state import committed_versions
from outreach_spark.sources import fixtures as fx
from outreach_spark.streaming import events as ST
from tests.conftest import SF_SMALL

EV_SCHEMA = "event_id bigint, ts timestamp_ntz, author_id bigint, event string, source string"


def _land(spark, root, df, name):
    df.write.mode("overwrite").parquet(os.path.join(root, "landing", name))


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def _text_ids(ev):
    """The feed under text ids, as a batch reads it."""
    return ev.withColumn("author_id", fx.as_uuid(F.col("author_id"))).withColumn("event_id", F.col("event_id").cast("string"))


def _wait(queries):
    for q in queries:
        q.awaitTermination(300)


ENGAGED = ["author_id", "source", "lead_score", "open_detected_at", "opens", "status"]


def _state_rows(df):
    return sorted((r.author_id, r.source, r.lead_score, r.open_detected_at, r.opens, r.status and r.status.event) for r in df.collect())


def test_event_stream_equals_batch_and_survives_restart(spark, scratch):
    ev = _text_ids(fx.delivery_events(spark, SF_SMALL))
    # the second landing holds the first ten days of the feed: rows that are weeks late, and a re-delivery of clicks
    cut = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    _land(spark, scratch, ev.filter(F.col("ts") >= cut), "part-a")
    src, out, ckpt = os.path.join(scratch, "landing", "*"), os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    _wait(ST.run_event_stream(spark, src, out, ckpt))
    _land(spark, scratch, ev.filter(F.col("ts") < cut).unionByName(ev.filter((F.col("ts") >= cut) & (F.col("event") == "click"))), "part-b")
    _wait(ST.run_event_stream(spark, src, out, ckpt))
    want = ST.engagement_updates(ST.as_event_time(ev).withColumn("event_key", ST.event_key(ev)))
    assert _state_rows(ST.read_engagement(spark, out)) == _state_rows(want)
    assert ST.engagement_differences(spark, out).count() == 0
    table = spark.read.parquet(os.path.join(out, "events"))
    assert table.count() == table.select("event_key").distinct().count() == ev.count()
    logs = spark.read.parquet(os.path.join(out, "logs"))
    assert logs.count() == ST.route_events(ev).count() == logs.select("log_key").distinct().count()
    health = ST.feed_health(table).agg(F.sum("events"), F.sum("late")).first()
    assert tuple(health) == (ev.count(), ev.count())  # landed long after they happened: counted as late, none dropped
    # restart with no new input: nothing new is committed
    before = committed_versions(spark, os.path.join(out, "engagement", "delta"), "batch=")
    _wait(ST.run_event_stream(spark, src, out, ckpt))
    assert committed_versions(spark, os.path.join(out, "engagement", "delta"), "batch=") == before
    # a new checkpoint has an empty store: it is refused instead of being mixed in
    with pytest.raises(Exception, match="another stream checkpoint|log"):
        _wait(ST.run_event_stream(spark, src, out, os.path.join(scratch, "ckpt2")))


def test_bodies_as_the_application_posts_them(spark, scratch):
    """No id, no time, uuid authors; equal bodies are different requests; a file that is read again changes nothing."""
    a, b = "6b1f0a52-0a5e-4f0c-9d53-2f3f6f1f9f01", "6b1f0a52-0a5e-4f0c-9d53-2f3f6f1f9f02"
    opened = '[{"event": "open", "author_id": "%s", "email": "x@y.z"}]' % a
    src, out, ck = (os.path.join(scratch, x) for x in ("posts", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "one.json"), "w") as f:
        f.write("\n".join([opened, opened, "", "not json", '[{"event":"open","author_id":"%s"},{"event":"click","author_id":"%s"},{"event":"open"},'
                           '{"event":"bounce","author_id":"%s","email":"x@y.z"}]' % (a, b, b)]) + "\n")
    _wait(ST.run_event_stream(spark, src, out, ck, kind="webhook"))
    got = {r.author_id: r for r in ST.read_engagement(spark, out).collect()}
    assert (got[a].lead_score, got[a].opens) == (3, 3) and (got[b].lead_score, got[b].status.event) == (5, "bounce")
    arrived = os.path.getmtime(os.path.join(src, "one.json"))
    assert abs(got[a].open_detected_at.timestamp() - arrived) < 86400 and got[a].open_detected_at == got[a].first_open_at  # the arrival time
    table = spark.read.parquet(os.path.join(out, "events"))
    assert table.count() == 6 and table.select("event_key").distinct().count() == 6
    assert spark.read.parquet(os.path.join(out, "logs")).count() == 5  # the open without an author is in the table only
    os.utime(os.path.join(src, "one.json"), (arrived + 100, arrived + 100))
    with open(os.path.join(src, "two.json"), "w") as f:
        f.write(opened)
    _wait(ST.run_event_stream(spark, src, out, ck, kind="webhook"))
    assert {r.author_id: r.opens for r in ST.read_engagement(spark, out).collect()} == {a: 4, b: 0}
    # the streamed bounce reaches the snapshot
    contacts = spark.createDataFrame([(a, "main", "sent", False, None, 0), (b, "main", "sent", False, None, 0)],
                                     "id string, channel string, email_status string, open_detected boolean, open_detected_at timestamp_ntz, lead_score bigint")
    new = {r.id: (r.email_status, r.open_detected, r.lead_score) for r in engagement.apply_engagement_state(contacts, ST.read_engagement(spark, out)).collect()}
    assert new == {a: ("sent", True, 4), b: ("bounced", False, 5)}


def test_event_stream_from_webhook_bodies_and_hits(spark, scratch):
    cols = ["author_id", "source", "lead_score"]
    fx.delivery_payloads(spark, SF_SMALL).select("body").write.text(os.path.join(scratch, "bodies"))
    _wait(ST.run_event_stream(spark, os.path.join(scratch, "bodies"), os.path.join(scratch, "o1"), os.path.join(scratch, "c1"), kind="webhook"))
    got = ST.read_engagement(spark, os.path.join(scratch, "o1")).filter("lead_score > 0")
    bare = fx.bare_events(spark, SF_SMALL).withColumn("source", F.coalesce("source", F.lit("main")))
    assert _rows(got, cols) == _rows(engagement.lead_scores(bare, by_channel=True), cols)
    # the pixel's requests carry no id: every request counts
    hits = fx.tracking_hits(spark, SF_SMALL).select("ts", "request_url")
    both = hits.unionByName(hits.limit(50))
    both.write.json(os.path.join(scratch, "hits"))
    _wait(ST.run_event_stream(spark, os.path.join(scratch, "hits"), os.path.join(scratch, "o2"), os.path.join(scratch, "c2"), kind="hits"))
    got = ST.read_engagement(spark, os.path.join(scratch, "o2"))
    assert _rows(got, cols) == _rows(engagement.lead_scores(ST.parse_tracking_hits(both), by_channel=True), cols)


def test_what_a_batch_writes_follows_its_keys(spark, scratch):
    src, out, ck = (os.path.join(scratch, x) for x in ("in", "out", "ck"))
    rows = lambda n: spark.range(n).selectExpr("'e' || id || '-%d' as event_id" % n, "timestamp_ntz'2024-01-01 00:00:00' as ts",
                                               "uuid() as author_id" if n > 100 else "'author' || id as author_id", "'open' as event", "'main' as source")
    size = lambda n: sum(os.path.getsize(os.path.join(d, x)) for d, _, xs in os.walk(os.path.join(out, "engagement", "delta", f"batch={n}")) for x in xs)
    rows(100_000).write.parquet(os.path.join(src, "a"))
    _wait(ST.run_event_stream(spark, src + "/*", out, ck))
    rows(100).write.parquet(os.path.join(src, "b"))
    _wait(ST.run_event_stream(spark, src + "/*", out, ck))
    deltas = committed_versions(spark, os.path.join(out, "engagement", "delta"), "batch=")
    full = [n for n in deltas if spark.read.parquet(os.path.join(out, "engagement", "delta", f"batch={n}")).count()]
    assert len(full) == 2 and size(full[1]) * 50 < size(full[0])
    assert ST.read_engagement(spark, out).count() == 100_100


def test_events_without_an_id_are_kept(spark):
    t = "2024-01-01 00:00:0"
    rows = [(None, t + "1", 1, "open", "main"), (None, t + "2", 1, "open", "main"), (None, t + "2", 1, "open", "main"), (5, t + "2", 1, "open", "main"),
            (5, t + "3", 1, "open", "main"), (None, None, 1, "open", "main"), (None, None, 1, "open", "main"), (None, None, 1, "open", "main")]
    ev = spark.createDataFrame(rows, "event_id bigint, ts string, author_id bigint, event string, source string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert ST.stream_event_dedup(ev).count() == 6  # one time and content: one event; neither id nor time: one each


def test_daily_counts_stream_equals_batch(spark, scratch):
    ev = fx.delivery_events(spark, SF_SMALL)
    _land(spark, scratch, ev, "all")
    stream = ST.as_event_time(spark.readStream.schema(EV_SCHEMA).parquet(os.path.join(scratch, "landing", "all")))
    q = (ST.stream_daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("t7_counts")
         .option("checkpointLocation", os.path.join(scratch, "ck7")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("t7_counts")
    want = ST.stream_daily_counts(ST.as_event_time(ev))
    assert _rows(got, ["day", "event", "events"]) == _rows(want, ["day", "event", "events"])


def test_dedup_within_watermark_stream(spark, scratch):
    ev = fx.delivery_events(spark, SF_SMALL)
    _land(spark, scratch, ev.unionByName(ev.filter(F.col("event") == "click")), "dups")
    stream = ST.as_event_time(spark.readStream.schema(EV_SCHEMA).parquet(os.path.join(scratch, "landing", "dups")))
    q = (ST.stream_event_dedup(stream).writeStream.format("memory").queryName("t6_dedup")
         .option("checkpointLocation", os.path.join(scratch, "ck6")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert spark.table("t6_dedup").count() == ev.count()


def test_reply_stream_static_join(spark, scratch):
    rp = fx.inbound_replies(spark, SF_SMALL)
    rp.write.parquet(os.path.join(scratch, "landing", "rp"))
    stream = spark.readStream.schema(rp.schema).parquet(os.path.join(scratch, "landing", "rp"))
    q = (ST.stream_replies(stream, fx.contacts(spark, SF_SMALL)).writeStream.format("memory").queryName("t4_replies")
         .option("checkpointLocation", os.path.join(scratch, "ck4")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    want = {r.msg_id for r in ST.parse_inbound(rp).collect()}
    got = [r.msg_id for r in spark.table("t4_replies").collect()]
    assert set(got) == want and len(got) == len(want)


def test_reply_detection_counts_each_message_once(spark, scratch):
    rp = fx.inbound_replies(spark, SF_SMALL)
    stranger = rp.limit(1).select(F.lit("x1").alias("msg_id"), "ts", F.lit("Nobody <nobody@else.org>").alias("from_header"), "body", "model_output")
    landed = rp.unionByName(rp.limit(30)).unionByName(stranger)  # redelivered messages
    landed.write.parquet(os.path.join(scratch, "landing", "rp2"))
    c = fx.contacts(spark, SF_SMALL)
    out, ck = os.path.join(scratch, "rout"), os.path.join(scratch, "rck")
    for q in ST.run_reply_stream(spark, os.path.join(scratch, "landing", "rp2"), c, out, ck):
        q.awaitTermination(300)
    state = {r.email_key: (r.reply_sentiment, r.replies) for r in ST.read_reply_state(spark, out).collect()}
    # expectation from the messages themselves, row by row
    want = {}
    for r in sorted(ST.parse_inbound(rp.unionByName(stranger)).collect(), key=lambda r: (r.ts, r.msg_id)):
        want[r.sender] = (r.sentiment, want.get(r.sender, (None, 0))[1] + 1)
    assert state == want
    n = rp.select("msg_id").distinct().count() + 1
    msgs = spark.read.parquet(os.path.join(out, "messages"))
    assert sum(v[1] for v in state.values()) == msgs.count() == msgs.select("msg_id").distinct().count() == n
    by = {r.msg_id: r for r in msgs.collect()}
    ids = {}
    for r in c.select("id", "channel", "email_key").collect():
        ids.setdefault((r.email_key, r.channel), []).append(r.id)
    for r in by.values():
        assert r.author_id == (min(ids.get((r.email_key, "main")) or ids.get((r.email_key, "gmail")) or [0]) or None)
    assert by["x1"].author_id is None and "webhook" in by["x1"].log_message.lower()
    assert engagement.reply_state(ST.stream_replies(landed, c)).agg(F.sum("replies")).first()[0] == n


def test_form_posts_without_an_id_are_all_kept(spark, scratch):
    src, out, ck = (os.path.join(scratch, x) for x in ("posts", "out", "ck"))
    os.makedirs(src)
    post = '{"from": "Jane Roe <%s>", "text": "Yes.", "model_output": "%s"}'
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write("\n".join([post % ("Jane@X.org", "interested"), post % ("Jane@X.org", "interested"), post % ("joe@x.org", "other"), '{"text": "no sender"}', "broken",
                           '{"from": "joe@x.org"}']))
    contacts = spark.createDataFrame([("6b1f0a52-0a5e", "main", "jane@x.org")], "id string, channel string, email_key string")
    _wait(ST.run_reply_stream(spark, src, contacts, out, ck, kind="posts"))
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write(post % ("jane@x.org", "not_interested"))
    _wait(ST.run_reply_stream(spark, src, contacts, out, ck, kind="posts"))
    msgs = spark.read.parquet(os.path.join(out, "messages")).collect()
    assert len(msgs) == 5 == len({r.msg_id for r in msgs})
    assert {(r.email_key, r.author_id) for r in msgs} == {("jane@x.org", "6b1f0a52-0a5e"), ("joe@x.org", None)}
    state = {r.email_key: (r.reply_sentiment, r.replies) for r in ST.read_reply_state(spark, out).collect()}
    assert state == {"jane@x.org": ("not_interested", 3), "joe@x.org": ("unknown", 2)}


def test_batch_replies_without_an_id_count_each(spark):
    rows = [(None, "2024-01-01 00:00:00", "a", "other"), (None, "2024-01-01 00:00:00", "a", "other"), ("m", "2024-01-02 00:00:00", "a", "interested"),
            ("m", "2024-01-02 00:00:00", "a", "interested")]
    df = spark.createDataFrame(rows, "msg_id string, ts string, email_key string, sentiment string")
    r = engagement.reply_state(df).first()
    assert (r.replies, r.reply_sentiment) == (3, "interested")


def test_reply_lookback_in_the_stream(spark, scratch):
    rp = fx.inbound_replies(spark, SF_SMALL)
    rp.write.parquet(os.path.join(scratch, "landing", "rp3"))
    out, ck = os.path.join(scratch, "rout3"), os.path.join(scratch, "rck3")
    for q in ST.run_reply_stream(spark, os.path.join(scratch, "landing", "rp3"), fx.contacts(spark, SF_SMALL), out, ck, as_of=fx.EVENTS_AS_OF):
        q.awaitTermination(300)
    want = {r.msg_id for r in ST.reply_lookback(rp, fx.EVENTS_AS_OF).collect()}
    assert {r.msg_id for r in spark.read.parquet(os.path.join(out, "messages")).collect()} == want
    assert 0 < len(want) < rp.count()
