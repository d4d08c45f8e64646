"""Catalogue readers (S7-S10): landed API responses (JSON text) -> author stubs.

Each response is parsed with a declared schema (no inference), its record array exploded,
and the first author taken; records without authors are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as SC


def _stubs(df: DataFrame, name, title, description, source: str, keep=()) -> DataFrame:
    return df.filter(name.isNotNull()).select(
        *keep, name.alias("name"), title.alias("book_title"), description.alias("description"),
        F.lit(None).cast("string").alias("url"), F.lit(source).alias("source_platform"),
    )


def catalog_google_books(payloads: DataFrame, payload_col: str = "payload", keep: list[str] = ()) -> DataFrame:
    """items[].volumeInfo -> first author, title, description ('' when absent)."""
    doc = F.from_json(F.col(payload_col), SC.GOOGLE_BOOKS_PAYLOAD)
    rec = payloads.select(*keep, F.explode(doc["items"]).alias("r")).select(*keep, F.col("r.volumeInfo").alias("v"))
    return _stubs(rec, F.get(F.col("v.authors"), 0), F.col("v.title"),
                  F.coalesce(F.col("v.description"), F.lit("")), K.SOURCE_GOOGLE_BOOKS, keep)


def catalog_open_library(payloads: DataFrame, payload_col: str = "payload", keep: list[str] = ()) -> DataFrame:
    """works[].authors[0].name, title; no description."""
    doc = F.from_json(F.col(payload_col), SC.OPEN_LIBRARY_PAYLOAD)
    rec = payloads.select(*keep, F.explode(doc["works"]).alias("r"))
    return _stubs(rec, F.get(F.col("r.authors"), 0)["name"], F.col("r.title"), F.lit(""), K.SOURCE_OPEN_LIBRARY, keep)


def catalog_loc(payloads: DataFrame, payload_col: str = "payload", keep: list[str] = ()) -> DataFrame:
    """results[].contributor[0], title; description = subjects joined by '; '."""
    doc = F.from_json(F.col(payload_col), SC.LOC_PAYLOAD)
    rec = payloads.select(*keep, F.explode(doc["results"]).alias("r"))
    desc = F.array_join(F.coalesce(F.col("r.subject"), F.array().cast("array<string>")), "; ")
    return _stubs(rec, F.get(F.col("r.contributor"), 0), F.col("r.title"), desc, K.SOURCE_LOC, keep)


def catalog_gutendex(payloads: DataFrame, payload_col: str = "payload", keep: list[str] = ()) -> DataFrame:
    """results[].authors[0].name, title; fixed description."""
    doc = F.from_json(F.col(payload_col), SC.GUTENDEX_PAYLOAD)
    rec = payloads.select(*keep, F.explode(doc["results"]).alias("r"))
    return _stubs(rec, F.get(F.col("r.authors"), 0)["name"], F.col("r.title"), F.lit(K.GUTENDEX_DESCRIPTION), K.SOURCE_GUTENDEX, keep)


def search_stubs(hits: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Web-search hits -> stubs (name from the title; description = snippet)."""
    from ..functions.text import name_from_title

    return hits.select(
        *keep, name_from_title("title").alias("name"), F.lit(None).cast("string").alias("book_title"),
        F.coalesce(F.col("snippet"), F.lit("")).alias("description"), F.col("url"),
        F.lit(K.SOURCE_WEB_SEARCH).alias("source_platform"),
    )
