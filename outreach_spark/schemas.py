"""Target schemas (StructTypes) and column defaults."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B, D, TS = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType()
ARR = T.ArrayType(T.StringType())

CONTACTS = T.StructType([
    T.StructField("channel", S), T.StructField("id", S), T.StructField("full_name", S),
    T.StructField("email", S), T.StructField("email_key", S), T.StructField("source_platform", S),
    T.StructField("contacted_at", TS), T.StructField("email_status", S), T.StructField("book_titles", ARR),
    T.StructField("book_description", S), T.StructField("genres", ARR), T.StructField("open_detected", B),
    T.StructField("open_detected_at", TS), T.StructField("replied", B), T.StructField("reply_sentiment", S),
    T.StructField("followup_sent", B), T.StructField("followup_sent_at", TS), T.StructField("ab_variant", S),
    T.StructField("lead_score", L), T.StructField("approval_status", S),
])

# defaults used when a column is missing (schema evolution: add the column with a default)
CONTACT_DEFAULTS = {
    "email_status": "pending",
    "open_detected": False,
    "replied": False,
    "followup_sent": False,
    "lead_score": 0,
    "approval_status": "approved",
}

ENGAGEMENT_COLUMNS = [
    "open_detected", "open_detected_at", "replied", "reply_sentiment",
    "followup_sent", "followup_sent_at", "lead_score",
]

VERIFICATIONS = T.StructType([
    T.StructField("email", S), T.StructField("syntax_valid", B), T.StructField("mx_found", B),
    T.StructField("smtp_result", S), T.StructField("is_deliverable", B), T.StructField("verified_at", TS),
    T.StructField("failure_reason", S),
])

MESSAGES = T.StructType([
    T.StructField("msg_id", S), T.StructField("author_id", S), T.StructField("email", S),
    T.StructField("direction", S), T.StructField("subject", S), T.StructField("body", S),
    T.StructField("timestamp", TS), T.StructField("seq", L),
])

LOGS = T.StructType([
    T.StructField("timestamp", TS), T.StructField("level", S), T.StructField("category", S),
    T.StructField("message", S), T.StructField("details", S), T.StructField("log_key", S),
])

# one delivery / tracking event as it arrives in a webhook payload (JSON array of these); ids are text of any form
# (JSON numbers are read as text too), and the application's own bodies have neither an id nor a time
DELIVERY_EVENT = T.StructType([
    T.StructField("event_id", S), T.StructField("ts", T.TimestampType()), T.StructField("author_id", S),
    T.StructField("email", S), T.StructField("event", S), T.StructField("source", S),
])
DELIVERY_PAYLOAD = T.ArrayType(DELIVERY_EVENT)

# catalogue payload shapes (only the fields read)
GOOGLE_BOOKS_PAYLOAD = "struct<items: array<struct<volumeInfo: struct<authors: array<string>, title: string, description: string>>>>"
OPEN_LIBRARY_PAYLOAD = "struct<works: array<struct<authors: array<struct<name: string>>, title: string>>>"
LOC_PAYLOAD = "struct<results: array<struct<contributor: array<string>, title: string, subject: array<string>>>>"
GUTENDEX_PAYLOAD = "struct<results: array<struct<authors: array<struct<name: string>>, title: string>>>"

STUB_COLUMNS = ["name", "book_title", "description", "url", "source_platform"]
