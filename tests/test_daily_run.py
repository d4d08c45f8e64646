"""The daily run and follow-up jobs end to end at sf0.001 (written outputs equal the lazy queries)."""

import os

from pyspark.sql import functions as F

from outreach_spark.operators import daily_run, dedupe, engagement, funnel
from outreach_spark.operators.state import read_latest
from outreach_spark.sources import fixtures as fx
from tests.conftest import SF_SMALL


def _existing(spark):
    # a valid contacts table: one row per address (the first attempt)
    before = fx.contacts(spark, SF_SMALL).filter(F.col("contacted_at") < F.lit(fx.RUN_CUTOFF).cast("timestamp_ntz"))
    return dedupe.first_per_email(before, ["contacted_at", "id"])


def test_run_daily_writes_outcomes_summary_and_contacts(spark, scratch):
    # the breaker would stop a run on this fixture (bounce rate ~50 %): all addresses count as sent here
    contacts = _existing(spark).withColumn("email_status", F.lit("sent"))
    cand = fx.with_send_results(fx.run_candidates(spark, SF_SMALL))
    paths = daily_run.run_daily(spark, cand, contacts, fx.mx_records(spark, SF_SMALL), as_of=fx.RUN_CUTOFF, run_root=scratch, run_id="r1")
    out = spark.read.parquet(paths["outcomes"])
    target = paths["gates"]["target"]
    assert paths["gates"]["open"] and target == min(50, 5 + 2 * max(1, contacts.filter("channel = 'main'").selectExpr(f"timestampdiff(DAY, min(contacted_at), TIMESTAMP_NTZ '{fx.RUN_CUTOFF}')").first()[0]))
    # the first candidates of the channel by seq are the discovered ones
    taken = [r.id for r in cand.filter("channel = 'main'").orderBy("seq").limit(target).collect()]
    assert sorted(r.id for r in out.select("id").collect()) == sorted(taken)
    summary = spark.read.parquet(paths["summary"]).collect()
    assert [(r.channel, r.discovered) for r in summary] == [("main", len(taken))]
    counts = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert summary[0].skipped == counts.get("no_email", 0) + counts.get("undeliverable", 0)
    snap = read_latest(spark, paths["contacts"])
    ready_ids = {r.id for r in out.filter(F.col("outcome") == "ready").select("id").collect()}
    assert ready_ids <= {r.id for r in snap.select("id").collect()}
    # unique keys hold in the snapshot
    assert snap.count() == snap.select("id").distinct().count() == snap.select("email_key").distinct().count()


def test_breaker_stops_a_bad_run_and_tells_why(spark, scratch):
    contacts = _existing(spark)
    cand = fx.with_send_results(fx.run_candidates(spark, SF_SMALL))
    mx = fx.mx_records(spark, SF_SMALL)
    paths = daily_run.run_daily(spark, cand, contacts, mx, as_of=fx.RUN_CUTOFF, run_root=scratch, run_id="r2")
    # nothing classified: no outcome partitions; the summary has the breaker's text
    assert not [d for d in os.listdir(paths["outcomes"]) if d.startswith("outcome=")]
    r = spark.read.parquet(paths["summary"]).collect()
    assert len(r) == 1 and r[0].discovered == 0 and r[0].errors.startswith("CIRCUIT BREAKER TRIPPED: Bounce rate (")
    # without warm-up neither breaker nor warm-up cap apply
    free = daily_run.run_daily(spark, cand, contacts, mx, as_of=fx.RUN_CUTOFF, run_root=scratch, run_id="r3", warmup=False, daily_cap=30)
    assert free["gates"]["target"] == 30 and spark.read.parquet(free["summary"]).first().discovered == 30


def test_send_window_pauses_a_run(spark, scratch):
    contacts = _existing(spark).withColumn("email_status", F.lit("sent"))
    cand = fx.with_send_results(fx.run_candidates(spark, SF_SMALL))
    mx = fx.mx_records(spark, SF_SMALL)
    out = daily_run.run_daily(spark, cand, contacts, mx, as_of="1998-01-01 12:59:00", run_root=scratch, run_id="w1", enforce_window=True)
    assert not out["gates"]["open"] and "outside the window (13-16)" in out["gates"]["log"]
    assert spark.read.parquet(out["summary"]).first().errors == ""
    assert daily_run.run_gates(spark, contacts, "1998-01-01 13:00:00", "main", enforce_window=True)["open"]


def test_run_approvals(spark, scratch):
    rows = [("main", 1, "a@x.org"), ("gmail", 1, "a1@x.org"), ("gmail", 2, "b@x.org"), ("main", 3, "c@x.org"), ("main", 4, "d@x.org")]
    from tests.test_golden import T0, contacts_df

    c = contacts_df(spark, [{"channel": ch, "id": i, "email": e, "full_name": e, "email_status": "pending_approval", "approval_status": "pending", "contacted_at": T0} for ch, i, e in rows])
    decisions = spark.createDataFrame([(1, "approved"), (2, "approved"), (3, "rejected"), (4, "approved"), (4, "approved")], "id bigint, decision string")
    drafts = spark.createDataFrame([(1, "S1"), (2, "S2"), (3, "S3")], "author_id bigint, subject string")  # 4 has no draft
    results = spark.createDataFrame([(1, "sent", T0, None), (2, "failed", None, "E"), (4, "sent", T0, None)], "id bigint, status string, sent_at timestamp_ntz, error string")
    paths = daily_run.run_approvals(spark, c, drafts, decisions, results, "2024-02-01 00:00:00", run_root=scratch)
    listed = {(r.id, r.channel): r.email_status for r in spark.read.parquet(paths["send_list"]).collect()}
    assert listed == {(1, "main"): "sent", (2, "gmail"): "failed"}
    snap = {(r.id, r.channel): (r.approval_status, r.email_status) for r in read_latest(spark, paths["contacts"]).collect()}
    assert snap == {(1, "main"): ("approved", "sent"), (1, "gmail"): ("pending", "pending_approval"), (2, "gmail"): ("approved", "pending_approval"),
                    (3, "main"): ("rejected", "pending_approval"), (4, "main"): ("approved", "pending_approval")}


def test_run_followups(spark, scratch):
    c = fx.contacts(spark, SF_SMALL)
    el = engagement.followup_eligible(c, fx.CONTACTS_AS_OF)
    res = el.select("id", F.when(F.col("lead_score") > 0, "sent").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("error"))
    paths = daily_run.run_followups(spark, c, res, fx.CONTACTS_AS_OF, run_root=scratch)
    snap = read_latest(spark, paths["contacts"])
    assert snap.filter("followup_sent").count() == c.filter("followup_sent").count() + res.filter(F.col("status") == "sent").count()
    got = {r.channel: (r.eligible_authors, r.sent) for r in spark.read.parquet(paths["summary"]).collect()}
    want = {r.channel: (r.eligible_authors, r.sent) for r in funnel.followup_summary(el, res).collect()}
    assert got == want
