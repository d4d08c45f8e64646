"""The daily run, the approval run and the follow-up run as jobs.

A run is one lazy plan up to a single write: classified candidates partitioned by outcome under a run folder.
Everything after (summary, contact upsert, exports) reads that written table, so the lineage is cut at the write
and nothing is recomputed or held in memory across actions. The run folder is ``run_root``, or lies in the
shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import constants as K
from .. import schemas as SC
from ..session import scratch_path
from ..sources.scans import conform_schema
from .dedupe import upsert_contacts
from .drafts import approval_send_list
from .engagement import followup_eligible, mark_followup_sent, set_approval
from .funnel import apply_send_results, circuit_breaker, classify_candidates, followup_summary, run_summary
from .metrics import days_since_start
from .state import write_snapshot
from .verify import verify_emails

SUMMARY_SCHEMA = "channel string, discovered bigint, valid_emails bigint, sent bigint, failed bigint, skipped bigint, sources string, errors string"


#: The contact columns with the run's order, by which the last row of an id or address wins.
_ORDERED = StructType([*SC.CONTACTS.fields, StructField("seq", LongType())])


def window_message(hour: int, start: int, end: int) -> str:
    return K.WINDOW_TEXT.format(hour=hour, start=start, end=end)


def run_gates(spark: SparkSession, contacts: DataFrame, as_of: str, channel: str, warmup: bool = True, enforce_window: bool = False,
              threshold: float = K.MAX_BOUNCE_RATE, daily_cap: int | None = None) -> dict:
    """The decisions before a run: ``open``, ``target`` (candidates to take), ``error`` (for the summary) and
    ``log`` (the event text, if any). The send window pauses a run without an error; in warm-up the circuit
    breaker stops it with one and the target grows with the days running. Two one-row facts reach the driver."""
    hour = spark.sql(f"SELECT hour(TIMESTAMP_NTZ '{as_of}') AS h").first().h
    if enforce_window and not K.SEND_WINDOW_START_UTC <= hour < K.SEND_WINDOW_END_UTC:
        return {"open": False, "target": 0, "error": "", "log": window_message(hour, K.SEND_WINDOW_START_UTC, K.SEND_WINDOW_END_UTC)}
    target = K.DAILY_CAP[channel] if daily_cap is None else daily_cap
    if not warmup:
        return {"open": True, "target": target, "error": "", "log": ""}
    breaker = circuit_breaker(contacts.filter(F.col("channel") == channel), threshold).first()
    if breaker is not None and breaker.tripped:
        return {"open": False, "target": 0, "error": breaker.error, "log": breaker.error}
    days = days_since_start(contacts, as_of, channel).first().days
    return {"open": True, "target": min(target, K.WARMUP_BASE[channel] + K.WARMUP_PER_DAY[channel] * days), "error": "", "log": ""}


def run_daily(spark: SparkSession, candidates: DataFrame, contacts: DataFrame, mx: DataFrame, as_of: str,
              results: DataFrame | None = None, approval_required: bool = False, channel: str = "main",
              run_root: str | None = None, run_id: str = "run", warmup: bool = True, enforce_window: bool = False,
              threshold: float = K.MAX_BOUNCE_RATE, daily_cap: int | None = None, scope: str | None = None) -> dict:
    """Gate, take, classify and send-merge one channel's run; write outcomes, summary and the new contacts snapshot.

    ``candidates``: seq, id, channel, full_name, source_platform, email, probe_code, ... ; the first
    ``target`` of the channel by seq are the discovered ones (top-k, no sort of the rest). ``results``: the
    sender's (id, status, sent_at, error), or None when the rows carry them. ``scope`` of "already contacted":
    the channel's own table for main, both for gmail, as the application has it. Returns the paths written,
    the gates' decision and the log text.
    """
    root = (run_root or scratch_path(spark, "daily_runs")).rstrip("/") + f"/{run_id}"
    gates = run_gates(spark, contacts, as_of, channel, warmup, enforce_window, threshold, daily_cap)
    taken = candidates.filter(F.col("channel") == channel).orderBy("seq").limit(gates["target"])
    classified = classify_candidates(verify_emails(taken, mx), contacts, approval_required=approval_required,
                                     scope=scope or ("main" if channel == "main" else "both"))
    run = apply_send_results(classified, results)
    outcomes = f"{root}/outcomes"
    run.write.mode("overwrite").partitionBy("outcome").parquet(outcomes)

    # read back with the run's schema (partition column last): an empty run writes no partition folders
    schema = StructType([f for f in run.schema.fields if f.name != "outcome"] + [run.schema["outcome"]])
    written = spark.read.schema(schema).parquet(outcomes)
    nothing = spark.createDataFrame([(channel, 0, 0, 0, 0, 0, "", gates["error"])], SUMMARY_SCHEMA)
    summary = run_summary(written)
    summary.unionByName(nothing.join(summary.select("channel"), "channel", "left_anti")).write.mode("overwrite").parquet(f"{root}/summary")
    stored = written.filter(F.col("outcome").isin("ready", "pending_approval")).withColumn(
        "email_status", F.coalesce(F.col("email_status"), F.lit("pending_approval"))).withColumn(
        "approval_status", F.when(F.col("outcome") == "pending_approval", "pending").otherwise("approved")).withColumn(
        "contacted_at", F.lit(as_of).cast("timestamp_ntz"))
    new_contacts = upsert_contacts(conform_schema(contacts), conform_schema(stored, _ORDERED))
    version = write_snapshot(new_contacts, f"{root}/contacts")
    return {"outcomes": outcomes, "summary": f"{root}/summary", "contacts": f"{root}/contacts", "contacts_version": version, "gates": gates}


def run_approvals(spark: SparkSession, contacts: DataFrame, drafts: DataFrame, decisions: DataFrame, results: DataFrame, as_of: str,
                  run_root: str | None = None, run_id: str = "approvals") -> dict:
    """Decisions (id, decision) -> approval status; approved contacts that wait and have a draft are the send
    list, whenever they were approved; the sender's results set the status of those that were sent, the others go on
    waiting and are taken up by the next run.

    Returns the paths of the send list (with the result of each row) and of the new contacts snapshot."""
    root = (run_root or scratch_path(spark, "approval_runs")).rstrip("/") + f"/{run_id}"
    # main rows win over gmail rows of an id, so an id is decided and sent once
    decided = set_approval(contacts, decisions)
    decided.write.mode("overwrite").parquet(f"{root}/decided")
    decided = spark.read.schema(decided.schema).parquet(f"{root}/decided")
    waiting = approval_send_list(decided, drafts).withColumn("outcome", F.lit("ready"))
    sent = apply_send_results(waiting.drop("outcome").withColumn("outcome", F.lit("ready")), results)
    sent.drop("outcome").write.mode("overwrite").parquet(f"{root}/send_list")
    done = spark.read.parquet(f"{root}/send_list").filter(F.col("email_status").isin("sent", "dry_run")).select("id", "channel", F.col("email_status").alias("_st"))
    at: Column = F.lit(as_of).cast("timestamp_ntz")
    j = decided.join(done, ["id", "channel"], "left")
    new = j.select(*[
        F.coalesce("_st", "email_status").alias(c) if c == "email_status" else
        F.when(F.col("_st").isNotNull(), at).otherwise(F.col(c)).alias(c) if c == "contacted_at" else F.col(c) for c in contacts.columns])
    version = write_snapshot(new, f"{root}/contacts")
    return {"send_list": f"{root}/send_list", "contacts": f"{root}/contacts", "contacts_version": version}


def run_followups(spark: SparkSession, contacts: DataFrame, results: DataFrame, as_of: str,
                  run_root: str | None = None, run_id: str = "followups") -> dict:
    """Eligible contacts -> (sender results, by id and, where they name one, channel) -> contacts with follow-up flags + follow-up
    summary."""
    root = (run_root or scratch_path(spark, "followup_runs")).rstrip("/") + f"/{run_id}"
    eligible = followup_eligible(contacts, as_of, K.FOLLOW_UP_DELAY_DAYS)
    followup_summary(eligible, results).write.mode("overwrite").parquet(f"{root}/summary")
    keys = ["id", "channel"] if "channel" in results.columns else ["id"]
    done = results.filter(F.col("status") == "sent").select(*keys).distinct()
    sent = eligible.select("id", "channel").join(done, keys).select("id", "channel", F.lit(as_of).cast("timestamp_ntz").alias("sent_at"))
    version = write_snapshot(mark_followup_sent(contacts, sent), f"{root}/contacts")
    return {"summary": f"{root}/summary", "contacts": f"{root}/contacts", "contacts_version": version}
