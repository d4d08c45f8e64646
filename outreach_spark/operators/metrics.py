"""Reporting aggregates over the contacts table.

All are single-pass aggregations: Spark runs a partial aggregate per map task and merges the
partials after the shuffle, so a hot key costs one row per task on the wire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.emails import email_key


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def overview_stats(contacts: DataFrame, channels: list[str] = K.CHANNELS) -> DataFrame:
    """A1: per channel total / sent / opens / replies / follow-ups, plus totals; one wide row, zeros when empty."""
    aggs = []
    for ch in channels:
        on = F.col("channel") == ch
        aggs += [
            F.count_if(on).alias(f"{ch}_total"),
            F.count_if(on & (F.col("email_status") == "sent")).alias(f"{ch}_sent"),
            F.count_if(on & F.col("open_detected")).alias(f"{ch}_opens"),
            F.count_if(on & F.col("replied")).alias(f"{ch}_replies"),
            F.count_if(on & F.col("followup_sent")).alias(f"{ch}_followups"),
        ]
    per = contacts.agg(*aggs)
    return per.select(
        "*",
        sum((F.col(f"{ch}_sent") for ch in channels), F.lit(0).cast("bigint")).alias("total_sent"),
        sum((F.col(f"{ch}_opens") for ch in channels), F.lit(0).cast("bigint")).alias("total_opens"),
        sum((F.col(f"{ch}_replies") for ch in channels), F.lit(0).cast("bigint")).alias("total_replies"),
    )


def daily_contact_counts(contacts: DataFrame, as_of, days: int = K.DAILY_COUNT_DAYS,
                         channels: list[str] = K.CHANNELS) -> DataFrame:
    """A2: contacts per day per channel since as_of - days (any status), one column per channel, ascending."""
    start = _ts(as_of) - F.make_dt_interval(F.lit(days))
    recent = contacts.filter(F.col("contacted_at") >= start)
    return (
        recent.groupBy(F.to_date("contacted_at").alias("day"))
        .agg(*[F.count_if(F.col("channel") == ch).alias(ch) for ch in channels])
        .orderBy("day")
    )


def genre_performance(contacts: DataFrame, n: int = K.TOP_GENRES_SIZE) -> DataFrame:
    """A3: explode genres (missing / empty -> Unknown); per genre total, opens, replies; top n by total."""
    g = contacts.select(F.explode_outer("genres").alias("g"), "open_detected", "replied")
    g = g.withColumn("genre", F.coalesce(F.nullif(F.trim("g"), F.lit("")), F.lit("Unknown")))
    return (
        g.groupBy("genre")
        .agg(F.count("*").alias("total"), F.count_if("open_detected").alias("opens"), F.count_if("replied").alias("replies"))
        .orderBy(F.col("total").desc(), F.col("genre").asc())
        .limit(n)
    )


def weekly_growth(contacts: DataFrame, as_of) -> DataFrame:
    """A4: contacts this week (Monday 00:00 up to as_of) vs last week; growth % rounded to 1; 100 when last is 0."""
    now = _ts(as_of)
    this_start = F.date_trunc("week", now).cast("timestamp_ntz")
    last_start = this_start - F.make_dt_interval(F.lit(7))
    t = F.col("contacted_at")
    counts = contacts.agg(
        F.count_if((t >= this_start) & (t < now)).alias("this_week"),
        F.count_if((t >= last_start) & (t < this_start)).alias("last_week"),
    )
    growth = F.when(
        F.col("last_week") > 0,
        F.round((F.col("this_week") - F.col("last_week")).cast("double") / F.col("last_week") * 100.0, 1),
    ).otherwise(F.lit(100.0))
    return counts.select("this_week", "last_week", growth.alias("growth"))


def ab_test_stats(contacts: DataFrame) -> DataFrame:
    """A5: per variant among sent rows with a variant: sent, opens, replies."""
    sent = contacts.filter((F.col("email_status") == "sent") & F.col("ab_variant").isNotNull())
    return sent.groupBy(F.col("ab_variant").alias("variant")).agg(
        F.count("*").alias("total_sent"), F.count_if("open_detected").alias("total_opens"),
        F.count_if("replied").alias("total_replies"),
    )


def ab_conversion_rates(contacts: DataFrame) -> DataFrame:
    """Open and reply rate per variant (NULL when nothing was sent)."""
    s = ab_test_stats(contacts)
    d = F.nullif(F.col("total_sent"), F.lit(0)).cast("double")
    return s.select("*", (F.col("total_opens") / d).alias("open_rate"), (F.col("total_replies") / d).alias("reply_rate"))


def status_breakdown(contacts: DataFrame) -> DataFrame:
    """Count by status; NULL or '' -> unknown."""
    st = F.coalesce(F.nullif(F.col("email_status"), F.lit("")), F.lit("unknown"))
    return contacts.groupBy(st.alias("email_status")).agg(F.count("*").alias("count"))


def _scope(contacts: DataFrame, channel: str | None) -> DataFrame:
    return contacts if channel is None else contacts.filter(F.col("channel") == channel)


def bounce_rate(contacts: DataFrame, channel: str | None = "main") -> DataFrame:
    """(bounced + dropped + failed) / rows whose status is not pending (NULL status excluded); 0.0 when empty."""
    c = _scope(contacts, channel).filter(F.col("email_status") != "pending")
    agg = c.agg(
        F.count_if(F.col("email_status").isin("bounced", "dropped", "failed")).alias("bounces"),
        F.count("*").alias("total"),
    )
    rate = F.when(F.col("total") > 0, F.col("bounces") / F.col("total")).otherwise(F.lit(0.0))
    return agg.select("bounces", "total", rate.alias("bounce_rate"))


def bounce_rates(contacts: DataFrame) -> DataFrame:
    """A8 for main, gmail and both together (scope 'all'), from one aggregate over contacts."""
    bad = F.col("email_status").isin("bounced", "dropped", "failed")
    scopes = {"main": F.col("channel") == "main", "gmail": F.col("channel") == "gmail", "all": F.lit(True)}
    sums = contacts.filter(F.col("email_status") != "pending").agg(F.array(*[
        F.struct(F.lit(k).alias("scope"), F.count_if(on & bad).alias("bounces"), F.count_if(on).alias("total")) for k, on in scopes.items()]).alias("s"))
    rate = F.when(F.col("total") > 0, F.col("bounces") / F.col("total")).otherwise(F.lit(0.0))
    return sums.select(F.explode("s").alias("s")).select("s.*").withColumn("bounce_rate", rate)


def days_since_start(contacts: DataFrame, as_of, channel: str | None = "main") -> DataFrame:
    """Whole elapsed days (not midnights) since the first contact; at least 1; 1 without rows."""
    first = _scope(contacts, channel).agg(F.min("contacted_at").alias("first_contact"))
    days = F.timestamp_diff("DAY", F.col("first_contact"), _ts(as_of))
    return first.select("first_contact", F.coalesce(F.greatest(F.lit(1).cast("bigint"), days), F.lit(1).cast("bigint")).alias("days"))


def day_activity(contacts: DataFrame, replies: DataFrame, day: str) -> DataFrame:
    """Per channel: contacts whose (last) open is of ``day``, and messages of ``day`` from its addresses (``replies``:
    msg_id, ts, sender)."""
    on = F.lit(day).cast("date")
    opens = contacts.groupBy("channel").agg(F.count_if(F.to_date("open_detected_at") == on).alias("opens"))
    sent = replies.filter(F.to_date("ts") == on).select("msg_id", email_key("sender").alias("email_key")).distinct()
    known = contacts.select("email_key", "channel").join(sent.select("email_key").distinct(), "email_key", "left_semi").distinct()
    got = known.join(sent, "email_key").groupBy("channel").agg(F.count("*").alias("replies"))
    return opens.join(got, "channel", "left").select("channel", "opens", F.coalesce("replies", F.lit(0).cast("bigint")).alias("replies"))


def llm_cost(usage: DataFrame, input_col: str = "input_tokens", output_col: str = "output_tokens") -> DataFrame:
    """sum(input x 0.59 + output x 0.79) / 1e6, from exact integer token sums."""
    s = usage.agg(F.sum(input_col).alias("input_tokens"), F.sum(output_col).alias("output_tokens"))
    cost = (F.coalesce(F.col("input_tokens"), F.lit(0)) * K.PRICE_INPUT_PER_M
            + F.coalesce(F.col("output_tokens"), F.lit(0)) * K.PRICE_OUTPUT_PER_M) / 1e6
    return s.select(F.coalesce("input_tokens", F.lit(0).cast("bigint")).alias("input_tokens"),
                    F.coalesce("output_tokens", F.lit(0).cast("bigint")).alias("output_tokens"), cost.alias("cost_usd"))


def source_counts(stubs: DataFrame) -> DataFrame:
    """Candidates per source."""
    return stubs.groupBy("source_platform").agg(F.count("*").alias("candidates"))
