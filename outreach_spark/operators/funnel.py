"""The daily run as one lazy plan.

candidates -> (no email?) -> already contacted (anti join on email_key, and first-per-email within
the run) -> verification verdict (left join) -> approval queue or ready -> caps -> send results.
One-row facts (bounce rate, days running) enter as scalar subqueries, never as cross joins or
driver round trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.emails import email_key
from .dedupe import spread_key
from .metrics import _ts, bounce_rate
from .topn import top_n_per_group


def send_window(df: DataFrame, ts_col: str, start: int = K.SEND_WINDOW_START_UTC, end: int = K.SEND_WINDOW_END_UTC) -> DataFrame:
    """G1: rows whose UTC hour h satisfies start <= h < end."""
    h = F.hour(F.col(ts_col))
    return df.filter((h >= start) & (h < end))


def _rate_error(rate: Column, threshold: float) -> Column:
    return F.format_string(K.BREAKER_TEXT, rate * 100.0, F.lit(threshold * 100.0))


def circuit_breaker(contacts: DataFrame, threshold: float = K.MAX_BOUNCE_RATE) -> DataFrame:
    """Per channel, tripped when the bounce rate is strictly above the threshold, with the error text."""
    c = contacts.filter(F.col("email_status") != "pending")
    per = c.groupBy("channel").agg(
        F.count_if(F.col("email_status").isin("bounced", "dropped", "failed")).alias("bounces"), F.count("*").alias("total"))
    rate = F.when(F.col("total") > 0, F.col("bounces") / F.col("total")).otherwise(F.lit(0.0))
    per = per.select("channel", rate.alias("bounce_rate"))
    tripped = F.col("bounce_rate") > F.lit(threshold)
    return per.select("channel", "bounce_rate", F.lit(threshold).alias("threshold"), tripped.alias("tripped"),
                      F.when(tripped, _rate_error(F.col("bounce_rate"), threshold)).alias("error"))


def breaker_gate(candidates: DataFrame, contacts: DataFrame, channel: str = "main", threshold: float = K.MAX_BOUNCE_RATE) -> DataFrame:
    """Apply G2 to a run: keep the candidates only when the channel's breaker is not tripped (scalar subquery)."""
    rate = bounce_rate(contacts, channel).select("bounce_rate").scalar()
    return candidates.filter(rate <= F.lit(threshold))


def warmup_cap_expr(contacts: DataFrame, as_of, caps: dict = K.DAILY_CAP) -> Column:
    """W2 cap as a column: per channel of the fixed vocabulary, min(daily cap, base + per_day x days
    running), with days running as a scalar subquery per channel (no join, no broadcast)."""
    expr = None
    for ch, cap in caps.items():
        first = contacts.filter(F.col("channel") == ch).agg(F.min("contacted_at")).scalar()
        days = F.coalesce(F.greatest(F.lit(1).cast("bigint"), F.timestamp_diff("DAY", first, _ts(as_of))), F.lit(1).cast("bigint"))
        value = F.least(F.lit(cap).cast("bigint"), F.lit(K.WARMUP_BASE[ch]) + F.lit(K.WARMUP_PER_DAY[ch]) * days)
        expr = (F.when(F.col("channel") == ch, value) if expr is None else expr.when(F.col("channel") == ch, value))
    return expr.cast("bigint")


def daily_cap_expr(caps: dict = K.DAILY_CAP) -> Column:
    expr = None
    for ch, cap in caps.items():
        expr = F.when(F.col("channel") == ch, F.lit(cap)) if expr is None else expr.when(F.col("channel") == ch, F.lit(cap))
    return expr.cast("bigint")


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column], cap: Column, max_cap: int) -> DataFrame:
    """Keep the first ``cap`` rows per group; ``cap`` is a per-row column bounded by ``max_cap``.

    The ranking is bounded by ``max_cap`` (a fixed setting) so Spark applies a partial
    WindowGroupLimit before the shuffle; rows of a channel without a cap are dropped.
    """
    ranked = top_n_per_group(df, keys, order, max_cap, rank_col="rank_in_group")
    return ranked.withColumn("cap", cap).filter(F.col("rank_in_group") <= F.col("cap"))


def warmup_cap(candidates: DataFrame, contacts: DataFrame, as_of, caps: dict = K.DAILY_CAP) -> DataFrame:
    """The first cap(channel) candidates of each channel by seq."""
    return cap_per_group(candidates, ["channel"], [F.col("seq").asc()], warmup_cap_expr(contacts, as_of, caps), max(caps.values()))


def daily_send_cap(sends: DataFrame, ts_col: str = "contacted_at", caps: dict = K.DAILY_CAP, order_col: str = "id") -> DataFrame:
    """At most cap(channel) sends per channel and day."""
    s = sends.withColumn("day", F.to_date(F.col(ts_col)))
    return cap_per_group(s, ["channel", "day"], [F.col(ts_col).asc(), F.col(order_col).asc()], daily_cap_expr(caps), max(caps.values()))


def classify_candidates(candidates: DataFrame, contacts: DataFrame, verdicts: DataFrame | None = None,
                        approval_required: bool = False, scope: str = "both", verdict_key: str = "email_key") -> DataFrame:
    """Outcome per candidate (the funnel flagship).

    Candidates are taken in ``seq`` order: no_email -> already_contacted (seen in ``scope`` of
    ``contacts``, or an earlier deliverable row of the run went on with the address) -> undeliverable ->
    pending_approval | ready. An undeliverable row marks nothing, so a later deliverable row of its
    address still goes on.

    Verdict columns (smtp_result, is_deliverable) are either already on the candidate rows (the
    output of ``verify_emails``) or joined from ``verdicts`` on ``verdict_key``. "Seen before" and "first
    deliverable of this run" come from ONE aggregation over (previous addresses UNION run addresses), so
    a hot address is combined map-side and joined back once. Rows without an address are dealt by seq,
    under a key that no address has.
    """
    c = candidates.withColumn("email_key", email_key(F.col("email")))
    if verdicts is not None:
        one = verdicts.filter(F.col(verdict_key).isNotNull()).groupBy(verdict_key).agg(
            F.max(F.struct("is_deliverable", "smtp_result")).alias("_v")).select(verdict_key, "_v.smtp_result", "_v.is_deliverable")
        c = c.join(one, verdict_key, "left")
    deliverable = F.coalesce(F.col("is_deliverable"), F.lit(False))
    seen = contacts if scope == "both" else contacts.filter(F.col("channel") == scope)
    no_seq = F.lit(None).cast("bigint")
    keys = seen.filter(F.col("email_key").isNotNull()).select("email_key", F.lit(True).alias("_seen"), no_seq.alias("_seq")).unionByName(
        c.filter(F.col("email_key").isNotNull()).select("email_key", F.lit(False).alias("_seen"), F.when(deliverable, F.col("seq")).cast("bigint").alias("_seq")))
    stats = keys.groupBy("email_key").agg(F.max("_seen").alias("_seen"), F.min("_seq").alias("_first_seq"))
    outcome = (
        F.when(F.col("email_key").isNull(), "no_email")
        .when(F.coalesce(F.col("_seen"), F.lit(False)), "already_contacted")
        .when(F.col("seq") > F.col("_first_seq"), "already_contacted")
        .when(~deliverable, "undeliverable")
        .when(F.lit(approval_required), "pending_approval")
        .otherwise("ready")
    )
    dealt = c.withColumn("_k", spread_key(F.col("email_key"), F.col("seq")))
    j = dealt.join(stats.withColumnRenamed("email_key", "_k"), "_k", "left")
    return j.withColumn("outcome", outcome).drop("_k", "_seen", "_first_seq")


def apply_send_results(run: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Merge the sender's results (sent / failed / dry_run) into the run's ready rows.

    ``results`` (id, status, sent_at, error) is joined on id; without it the rows already carry
    ``status`` / ``sent_at`` / ``error`` (e.g. a sender that wrote its result next to each row).
    Ready rows without a result stay 'pending'; rows that were not ready get NULL.
    """
    if results is not None:
        # one result per id: the latest, a success before a failure at one time
        ok = F.col("status").isin("sent", "dry_run")
        last = results.groupBy("id").agg(F.max(F.struct("sent_at", ok.alias("_ok"), "status", "error")).alias("_r"))
        r = last.select("id", "_r.status", "_r.sent_at", "_r.error")
        run = run.drop(*[c for c in ("status", "sent_at", "error") if c in run.columns]).join(r, "id", "left")
    ready = F.col("outcome") == "ready"
    return (
        run.withColumn("email_status", F.when(ready, F.coalesce(F.col("status"), F.lit("pending"))))
        .withColumn("email_sent_at", F.when(ready & F.col("status").isin("sent", "dry_run"), F.col("sent_at")))
        .withColumn("send_error", F.when(ready, F.col("error")))
        .drop("status", "sent_at", "error")
    )


def funnel_counts(classified: DataFrame) -> DataFrame:
    """Candidates per channel and outcome."""
    return classified.groupBy("channel", "outcome").agg(F.count("*").alias("candidates"))


def _first_errors(errors: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    top = top_n_per_group(errors, keys, [F.col("seq").asc()], n)
    return top.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]), "; ").alias("errors"))


def run_summary(run: DataFrame) -> DataFrame:
    """Per channel: discovered, valid, sent, failed, skipped, sources and the first 5 errors.

    ``run`` is the classified run with the send results merged (G4 output). All counters come from
    one aggregation; the first errors are a bounded per-channel top-5 joined back on channel.
    """
    base = run.groupBy("channel").agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("outcome").isin("pending_approval", "ready")).alias("valid_emails"),
        F.count_if(F.col("email_status").isin("sent", "dry_run")).alias("sent"),
        F.count_if(F.col("email_status") == "failed").alias("failed"),
        F.count_if(F.col("outcome").isin("no_email", "undeliverable")).alias("skipped"),
        F.array_join(F.array_sort(F.collect_set("source_platform")), ", ").alias("sources"),
    )
    errs = run.filter(F.col("email_status") == "failed").select(
        "channel", "seq", F.concat(F.lit("Send failed for "), F.col("full_name"), F.lit(": "),
                                   F.coalesce(F.col("send_error"), F.lit("unknown error"))).alias("message"))
    out = base.join(_first_errors(errs, ["channel"]), "channel", "left")
    return out.select("channel", "discovered", "valid_emails", "sent", "failed", "skipped", "sources",
                      F.coalesce("errors", F.lit("")).alias("errors"))


def followup_summary(eligible: DataFrame, results: DataFrame) -> DataFrame:
    """Per channel: eligible authors, follow-ups sent and failed, first 5 errors. Results belong to the contact of their id
    and, where they name one, channel."""
    e = eligible.groupBy("channel").agg(F.count("*").alias("eligible_authors"))
    keys = ["id", "channel"] if "channel" in results.columns else ["id"]
    one = results.groupBy(*keys).agg(F.min(F.struct((F.col("status") != "sent").alias("_failed"), "status", "error")).alias("_r"))
    r = eligible.select("id", "channel", F.col("id").alias("seq")).join(one.select(*keys, "_r.status", "_r.error"), keys)
    s = r.groupBy("channel").agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") != "sent").alias("failed"))
    errs = r.filter(F.col("status") != "sent").select("channel", "seq", F.concat(F.lit("Follow-up failed for "), F.col("id").cast("string"), F.lit(": "), F.coalesce("error", F.lit("unknown error"))).alias("message"))
    out = e.join(s, "channel", "left").join(_first_errors(errs, ["channel"]), "channel", "left")
    return out.select("channel", "eligible_authors", F.coalesce("sent", F.lit(0).cast("bigint")).alias("sent"),
                      F.coalesce("failed", F.lit(0).cast("bigint")).alias("failed"), F.coalesce("errors", F.lit("")).alias("errors"))
