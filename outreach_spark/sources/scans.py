"""Scans of the funnel's tables (S1-S6, S11-S13, S17) and schema conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as SC
from ..functions.emails import email_key


def parse_genres(raw: Column) -> Column:
    """Genres stored as text: a JSON list, else comma-separated; entries trimmed, empty entries dropped.

    NULL or '' -> NULL (reported as Unknown by the genre report).
    """
    t = F.trim(raw)
    arr = F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.split(t, ","))
    cleaned = F.filter(F.transform(arr, lambda g: F.trim(g)), lambda g: g != "")
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("array<string>")).otherwise(cleaned)


def conform_schema(df: DataFrame, schema=SC.CONTACTS, defaults: dict | None = None) -> DataFrame:
    """Project onto the target schema; missing columns get their default (else NULL), all are cast but ids: they are
    text in the application's tables and keep their own type where a table has numbers."""
    defaults = SC.CONTACT_DEFAULTS if defaults is None else defaults
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]))
        elif f.name == "email_key" and "email" in df.columns:
            c = email_key("email")
        else:
            c = F.lit(defaults.get(f.name))
        keep = f.name in ("id", "author_id") and f.name in df.columns
        cols.append((c if keep else c.cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def scan_contacts(main: DataFrame, gmail: DataFrame) -> DataFrame:
    """Both channel tables as one relation tagged with its channel (UNION ALL by name)."""
    return (
        main.withColumn("channel", F.lit("main"))
        .unionByName(gmail.withColumn("channel", F.lit("gmail")), allowMissingColumns=True)
    )


def scan_verifications(cache: DataFrame) -> DataFrame:
    """S3: a cached verdict implies that syntax and MX were fine."""
    return cache.select(
        "email", F.lit(True).alias("syntax_valid"), F.lit(True).alias("mx_found"),
        "smtp_result", "is_deliverable", "verified_at", "failure_reason",
    )


def scan_drafts(main_drafts: DataFrame, gmail_drafts: DataFrame) -> DataFrame:
    """One draft per author: the main channel's, else the gmail channel's. A draft table has one row per
    author (K3's key), so the two are joined on it and no row is sorted for a choice."""
    cols = [c for c in main_drafts.columns if c != "author_id"]
    m = main_drafts.select("author_id", *[F.col(c).alias("_m_" + c) for c in cols], F.lit(True).alias("_main"))
    j = m.join(gmail_drafts, "author_id", "full_outer")
    in_main = F.coalesce("_main", F.lit(False))
    return j.select("author_id", *[F.when(in_main, F.col("_m_" + c)).otherwise(F.col(c)).alias(c) for c in cols],
                    F.when(in_main, "main").otherwise("gmail").alias("draft_channel"))


def scan_messages(messages: DataFrame, author_id=None, email: str | None = None) -> DataFrame:
    """Conversation rows of an author id or an email (without either, all rows), oldest first. The sort is by ranges
    of (time, seq, id), so neither a long thread nor messages without an author meet in one task."""
    out = messages
    if author_id is not None:
        out = out.filter(F.col("author_id") == F.lit(author_id))
    if email is not None:
        out = out.filter(email_key("email") == email_key(F.lit(email)))
    return out.orderBy("timestamp", "seq", "msg_id")


def scan_logs(logs: DataFrame, n: int) -> DataFrame:
    """Latest n log rows (top-k; no global sort)."""
    return logs.orderBy(F.col("timestamp").desc(), F.col("log_key").desc()).limit(n)


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def scan_search_hits(hits: DataFrame, max_per_query: int) -> DataFrame:
    """Hits with both a title and a url; scheme added when missing; at most N per query by position."""
    from ..operators.topn import top_n_per_group

    kept = hits.filter((F.coalesce(F.col("title"), F.lit("")) != "") & (F.coalesce(F.col("url"), F.lit("")) != ""))
    kept = kept.withColumn("url", with_scheme(F.col("url")))
    return top_n_per_group(kept, ["query"], [F.col("position").asc()], max_per_query, rank_col="rank")


def source_fallback(primary: DataFrame, secondary: DataFrame, key: str = "query") -> DataFrame:
    """Per query, the primary engine's hits; the secondary's only for queries the primary did not answer."""
    answered = primary.select(key).distinct()
    return primary.unionByName(secondary.join(answered, key, "left_anti"))


def url_key(url: Column) -> Column:
    """Scheme-less url for matching a hit to a landed page: the host in lower case, the rest as it is (paths differ by case)."""
    bare = F.regexp_replace(url, r"^(?i:https?)://", "")
    return F.concat(F.lower(F.regexp_extract(bare, r"^[^/?#]*", 0)), F.regexp_replace(bare, r"^[^/?#]*", ""))


def scan_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Page HTML for each hit's url (left join; NULL when the page was not landed), one row per hit: of
    pages with one key (http and https copies) the smallest id counts. The choice is made on narrow rows,
    so the html is joined once, by id, and only for pages that a hit asks for. Hits without a url or a landed page are
    dealt over all tasks."""
    from ..operators.dedupe import spread_key

    row = F.xxhash64(*hits.columns)
    keys = pages.select(url_key(F.col("url")).alias("_u"), "page_id")
    asked = hits.withColumn("_u", url_key(F.col("url")))
    one = keys.join(asked.select("_u").distinct(), "_u", "left_semi").groupBy("_u").agg(F.min("page_id").alias("page_id"))
    found = asked.withColumn("_u", spread_key(F.col("_u"), row)).join(one, "_u", "left").drop("_u")
    texts = pages.select(F.col("page_id").cast("string").alias("_p"), "html")
    return found.withColumn("_p", spread_key(F.col("page_id").cast("string"), row)).join(texts, "_p", "left").select(*hits.columns, "page_id", "html")


def scan_seen_emails(export: DataFrame, email_col: str = "email") -> DataFrame:
    """Set of addresses present in an export."""
    e = F.col(email_col)
    return export.filter(e.isNotNull() & (e != "")).select(e.alias("email")).distinct()
