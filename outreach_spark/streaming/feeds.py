"""The feeds as they land: what identifies a record, and when it arrived.

The application's own bodies carry neither ids nor times, so a landed record is stamped with the place it landed at: its
file, its line (or Parquet row) and the file's modification time. The place is the same whenever the file is read
again, so a record without an id is counted once and never merged with another one.

Text feeds are read a file at a time (lines are numbered within it): roll landing files at some ten megabytes. A path
is read once; write a file in one go (or move it in) under a path of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as SC

#: Where and when a record landed.
PLACE = ["file", "line", "arrived_at"]
#: One request per line; unknown fields are ignored, missing ones are null.
HIT = "ts timestamp, request_url string"
INBOUND_POST = "`from` string, text string, model_output string"
MAIL_ROWS = "msg_id string, ts timestamp_ntz, from_header string, body string, model_output string"
EVENT_ROWS = "event_id string, ts timestamp_ntz, author_id string, event string, source string"


def _reader(spark: SparkSession, stream: bool, file_glob: str | None):
    reader = spark.readStream if stream else spark.read
    return reader.option("pathGlobFilter", file_glob) if file_glob else reader


def landed_lines(spark: SparkSession, folder: str, stream: bool = True, file_glob: str | None = None) -> DataFrame:
    """``value`` (one non-blank line) with its ``PLACE``."""
    files = _reader(spark, stream, file_glob).text(folder, wholetext=True)
    files = files.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived_at"))
    lines = files.select("file", "arrived_at", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return lines.filter(F.trim("value") != "").select("value", "file", F.col("line").cast("bigint").alias("line"), "arrived_at")


def landed_rows(spark: SparkSession, folder: str, schema: str, stream: bool = True, file_glob: str | None = None) -> DataFrame:
    """Parquet rows with their ``PLACE``. Ids of any type are read as text."""
    rows = _reader(spark, stream, file_glob).schema(schema).parquet(folder)
    return rows.select(*rows.columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line"),
                       F.col("_metadata.file_modification_time").alias("arrived_at"))


def place_key(*more: Column | str) -> Column:
    """The identity of a record by its place (null without one), with the position inside it."""
    return F.concat(F.lit("at|"), *[x for c in ("file", "line", *more) for x in (F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("|"))])


def has_place(df: DataFrame) -> bool:
    return all(c in df.columns for c in PLACE)


def text_id(c: Column | str) -> Column:
    """An id as text; an empty one is no id."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def parsed_bodies(df: DataFrame, body_col: str, timestamp_format: str) -> DataFrame:
    """One row per element of a JSON array body, with the element's position ``pos``; malformed bodies give no rows."""
    parsed = F.from_json(F.col(body_col), SC.DELIVERY_PAYLOAD, {"timestampFormat": timestamp_format})
    place = [c for c in PLACE if c in df.columns]
    return df.select(*place, F.posexplode(parsed).alias("pos", "e")).filter(F.col("e").isNotNull())
