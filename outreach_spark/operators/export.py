"""Spreadsheet-style exports as projections (K6-K10, J12); the sink is CSV / Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.emails import email_key
from .dedupe import absent_from, spread_key


def iso(ts: Column) -> Column:
    """ISO-8601 text like Python's isoformat(): seconds, plus .ffffff only when there are microseconds; '' for NULL."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.coalesce(F.when(frac == "000000", whole).otherwise(F.concat(whole, F.lit("."), frac)), F.lit(""))


def pybool(c: Column) -> Column:
    """str(bool) as the application writes it: 'True' / 'False' ('' for NULL)."""
    return F.coalesce(F.when(c, F.lit("True")).otherwise(F.lit("False")), F.lit(""))


def _txt(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


MAIN_EXPORT_COLUMNS = [
    "author_id", "full_name", "email", "email_source", "email_verified", "verification_result", "book_titles",
    "book_description", "genres", "website_url", "social_url", "source_platform", "date_collected", "email_status",
    "date_email_sent", "email_subject_used", "run_date", "open_detected", "open_detected_at", "reply_detected",
    "followup_sent", "followup_sent_at", "followup_status",
]


def export_contacts(profiles: DataFrame, run_date: str, channel: str = "main") -> DataFrame:
    """K6 (23 text columns) / K7 (gmail: an empty 'title 2' column and a channel tag, 25 columns)."""
    p = profiles
    titles = F.array_join(F.slice(F.coalesce(F.col("book_titles"), F.array().cast("array<string>")), 1, 2), ", ")
    desc = F.coalesce(F.substring(F.col("book_description"), 1, K.EXPORT_DESCRIPTION_CHARS), F.lit(""))
    genres = F.array_join(F.coalesce(F.col("genres"), F.array().cast("array<string>")), ", ")
    cols = [
        F.col("id").cast("string").alias("author_id"), _txt(p, "full_name").alias("full_name"), _txt(p, "email").alias("email"),
        _txt(p, "email_source").alias("email_source"),
        (pybool(F.col("email_verified")) if "email_verified" in p.columns else F.lit("")).alias("email_verified"),
        _txt(p, "verification_result").alias("verification_result"), titles.alias("book_titles"), desc.alias("book_description"),
    ]
    if channel == "gmail":
        cols.append(F.lit("").alias("book_title_2"))
    cols += [
        genres.alias("genres"), _txt(p, "website_url").alias("website_url"), _txt(p, "social_url").alias("social_url"),
        _txt(p, "source_platform").alias("source_platform"), iso(F.col("contacted_at")).alias("date_collected"),
        _txt(p, "email_status").alias("email_status"),
        (iso(F.col("email_sent_at")) if "email_sent_at" in p.columns else F.lit("")).alias("date_email_sent"),
        F.lit("").alias("email_subject_used"), F.lit(run_date).alias("run_date"),
        pybool(F.col("open_detected")).alias("open_detected"), iso(F.col("open_detected_at")).alias("open_detected_at"),
        pybool(F.col("replied")).alias("reply_detected"), pybool(F.col("followup_sent")).alias("followup_sent"),
        iso(F.col("followup_sent_at")).alias("followup_sent_at"), _txt(p, "followup_status").alias("followup_status"),
    ]
    if channel == "gmail":
        cols.append(F.lit("gmail").alias("channel"))
    return p.select(*cols)


def export_status_patch(export: DataFrame, patches: DataFrame) -> DataFrame:
    """K8: by-id patches (status + sent time, subject, open + time, follow-up status + time); NULL = unchanged.

    Several patches of one id are merged: per column the value of the latest patch by ``patch_seq`` that has
    one (without that column, the largest value)."""
    pcols = [c for c in ["email_status", "date_email_sent", "email_subject_used", "open_detected", "open_detected_at",
                         "followup_status", "followup_sent_at"] if c in patches.columns]
    if "patch_seq" in patches.columns:
        merged = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("patch_seq"))).alias("_p_" + c) for c in pcols]
    else:
        merged = [F.max(c).alias("_p_" + c) for c in pcols]
    p = patches.groupBy("author_id").agg(*merged)
    j = export.join(p, "author_id", "left")
    return j.select(*[F.coalesce(F.col("_p_" + c), F.col(c)).alias(c) if c in pcols else F.col(c) for c in export.columns])


def export_reply_patch(export: DataFrame, replied_emails: DataFrame | None = None, replied_ids: DataFrame | None = None) -> DataFrame:
    """K9: set reply_detected to 'True' for rows matched by email (normalised) or by id."""
    e = export.withColumn("_ek", email_key(F.col("email")))
    hit = F.lit(False)
    if replied_emails is not None:
        r = replied_emails.select(F.col("email_key").alias("_ek")).distinct().withColumn("_by_email", F.lit(True))
        e = e.withColumn("_ek", spread_key(F.col("_ek"), F.xxhash64("author_id", "email"))).join(r, "_ek", "left")
        hit = hit | F.coalesce(F.col("_by_email"), F.lit(False))
    if replied_ids is not None:
        r = replied_ids.select(F.col("id").cast("string").alias("author_id")).distinct().withColumn("_by_id", F.lit(True))
        e = e.join(r, "author_id", "left")
        hit = hit | F.coalesce(F.col("_by_id"), F.lit(False))
    return e.select(*[F.when(hit, F.lit("True")).otherwise(F.col(c)).alias(c) if c == "reply_detected" else F.col(c) for c in export.columns])


def export_daily_summary(summary: DataFrame, run_date: str) -> DataFrame:
    """The daily summary row: sources joined by ', ', at most the first 5 errors joined by '; '."""
    errs = F.array_join(F.slice(F.split(F.col("errors"), "; "), 1, 5), "; ")
    return summary.select(
        F.lit(run_date).alias("date"), "channel", "discovered", "valid_emails", "sent", "failed", "skipped",
        "followups_sent", "opens", "replies", "sources", F.round("cost", 6).alias("cost"),
        F.when(F.col("errors") == "", F.lit("")).otherwise(errs).alias("errors"),
    )


def export_unseen(contacts: DataFrame, export: DataFrame) -> DataFrame:
    """Contacts whose address is absent from an export."""
    return absent_from(contacts, export.select(email_key(F.col("email")).alias("email_key")), "email_key")


def write_export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Export sink: CSV with a header row (the spreadsheet form) or Parquet; a new folder per export."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("emptyValue", "").csv(path)
    else:
        w.parquet(path)


def read_export(spark, path: str, columns: list[str] = MAIN_EXPORT_COLUMNS) -> DataFrame:
    """Read a CSV export back (header row skipped); every column is text, as in the spreadsheet."""
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.schema(schema).option("header", True).csv(path)
