"""Drafts as column expressions over the contacts table.

Writing the token values is the application's language-model step; here the values come from
columns (or a map column) and the model seam (``streaming``/``map_batches``) can fill the map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from .ranking import THREAD_CHUNK_MESSAGES


def _token_columns(token_map: str | None = None, description_chars: int = K.INVITATION_DESCRIPTION_CHARS, first_name: bool = False) -> dict[str, Column]:
    title = F.coalesce(F.get(F.col("book_titles"), 0), F.lit(K.FALLBACK_BOOK_TITLE))
    desc = F.coalesce(F.nullif(F.substring(F.col("book_description"), 1, description_chars), F.lit("")), F.lit(K.FALLBACK_TEXT))
    genre = F.coalesce(F.nullif(F.array_join(F.slice(F.coalesce(F.col("genres"), F.array().cast("array<string>")), 1, 2), ", "), F.lit("")), F.lit(K.FALLBACK_GENRE))
    tokens = {
        "AUTHOR_NAME": F.split_part(F.trim("full_name"), F.lit(" "), F.lit(1)) if first_name else F.col("full_name"),
        "BOOK_TITLE": title,
        "BOOK_DESCRIPTION": desc,
        "BOOK_GENRE_LABEL": genre,
    }
    if token_map:
        tokens = {k: F.coalesce(F.col(token_map)[k], v) for k, v in tokens.items()}
    return tokens


def bio_token() -> Column:
    """The author's bio cut at 300 characters, for contact tables that have one."""
    return F.coalesce(F.nullif(F.substring(F.col("bio"), 1, K.BIO_CHARS), F.lit("")), F.lit(K.FALLBACK_TEXT))


def default_tokens(contacts: DataFrame, token_map: str | None = None) -> dict[str, Column]:
    """Token values with the application's fallbacks: first title or 'their book', description cut at 400
    or 'Not available', first two genres or 'General Fiction'. A map column overrides / adds tokens."""
    return _token_columns(token_map if token_map and token_map in contacts.columns else None)


def _render(contacts: DataFrame, filled: Column, subject: Column, run_date: str, tracking_base: str | None, source: str | None) -> DataFrame:
    """One projection per step, so no text is computed twice: fill and strip, split, paragraphs, quality columns.
    ``subject`` is over ``_text`` (stripped) and the contact's columns."""
    out = contacts.select("*", TX.strip_ws(filled).alias("_text"))
    out = out.select("id", "channel", subject.alias("subject"), TX.draft_body("_text", stripped=True).alias("body_plain"))
    out = out.withColumn("_html", TX.paragraphs_html(F.col("body_plain")))
    html = F.col("_html")
    if tracking_base:
        src = F.lit(f"&source={source}") if source else F.when(F.col("channel") == "gmail", F.lit("&source=gmail")).otherwise(F.lit(""))
        pixel = F.concat(F.lit(f'<img src="{tracking_base}/track/open?author_id='), F.col("id").cast("string"),
                         F.lit(f"&run_date={run_date}"), src, F.lit('" width="1" height="1" style="display:none;" />'))
        html = TX.add_tracking_pixel(html, pixel)
    return out.select(
        F.col("id").alias("author_id"), "channel", "subject", "body_plain", html.alias("body_html"),
        TX.matched_phrases_text(F.concat_ws("\n", F.col("subject"), F.col("body_plain"))).alias("banned_phrases"),
        F.array_join(TX.unfilled_tokens(F.col("body_plain")), "|").alias("unfilled_tokens"),
        TX.word_count(F.col("body_plain")).alias("word_count"),
        TX.ab_variant(F.col("id")).alias("ab_variant"),
        TX.tone(F.col("id")).alias("tone"),
    )


def render_drafts(contacts: DataFrame, template: str, run_date: str, tracking_base: str | None = None,
                  default_subject: str = K.DEFAULT_INVITATION_SUBJECT, token_map: str | None = None,
                  source: str | None = None) -> DataFrame:
    """Fill -> split subject / body -> <p> paragraphs -> tracking pixel -> quality columns."""
    tm = token_map if token_map and token_map in contacts.columns else None
    tokens = _token_columns(tm) | ({"AUTHOR_BIO": bio_token()} if "bio" in contacts.columns else {})
    filled = TX.fill_template(template, tokens)
    return _render(contacts, filled, TX.draft_subject("_text", default_subject, stripped=True), run_date, tracking_base, source)


def render_followups(eligible: DataFrame, drafts: DataFrame, template: str, run_date: str, tracking_base: str | None = None,
                     token_map: str | None = None, source: str | None = None) -> DataFrame:
    """P18 for follow-ups: the subject is "Re: " + the original subject whatever the text's first line says
    (which is dropped when it is a subject line), the description is cut at 300 and the name is the first
    name. ``drafts``: ``author_id``, ``invitation_subject`` (one row per author)."""
    tm = token_map if token_map and token_map in eligible.columns else None
    original = drafts.select(F.col("author_id").alias("id"), F.col("invitation_subject").alias("_original"))
    filled = TX.fill_template(template, _token_columns(tm, K.FOLLOWUP_DESCRIPTION_CHARS, first_name=True))
    subject = F.concat(F.lit("Re: "), F.coalesce(F.col("_original"), F.lit(K.DEFAULT_ORIGINAL_SUBJECT)))
    return _render(eligible.join(original, "id", "left"), filled, subject, run_date, tracking_base, source)


DRAFT_INVITATION_COLS = ["invitation_subject", "invitation_body_html", "invitation_body_plain", "tokens_used", "saved_at"]
DRAFT_FOLLOWUP_COLS = ["followup_subject", "followup_body_html", "followup_body_plain"]


def draft_version(cols: list[str], ts: str = "saved_at") -> Column:
    """Time and, of drafts of one time, hash of a draft's columns as one number: the larger one wins."""
    at = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**62))).cast("decimal(38,0)") * F.lit(str(2**64)).cast("decimal(20,0)")
    return (at + F.xxhash64(*_ts_first(cols, ts)).cast("decimal(38,0)")).cast("decimal(38,0)")


def _ts_first(cols: list[str], ts: str) -> list[str]:
    return [ts] + [c for c in cols if c != ts]


def body_sizes(df: DataFrame, cols: list[str], versioned: bool = True) -> DataFrame:
    """Draft rows with their bodies' lengths in place of the bodies, and the version that the whole texts give: for
    results that need no more of a body, so that ``upsert_drafts`` chooses among the same drafts without moving texts
    (they compress some 40 times, so a shuffle's bytes don't show what its tasks must hold)."""
    sized = [F.length(c).alias(c) if "_body_" in c else F.col(c) for c in cols]
    return df.select("author_id", *sized, *([draft_version(cols).alias("version")] if versioned else []))


def _latest_per_author(df: DataFrame, cols: list[str], ts: str = "saved_at") -> DataFrame:
    """The draft of the largest version of every author. Rows are dealt and sorted by author once, as the join that
    follows needs them; nothing is computed twice. ``lag`` finds the first row: a row number would be preceded by a
    sort of whole drafts before they are dealt."""
    cols = _ts_first(cols, ts)
    version = F.col("version") if "version" in df.columns else draft_version(cols, ts)
    rows = df.filter(F.col("author_id").isNotNull()).select("author_id", *cols, version.alias("_at"))
    before = F.lag("author_id").over(Window.partitionBy("author_id").orderBy(F.desc("_at")))
    return rows.withColumn("_before", before).filter(F.col("_before").isNull()).drop("_at", "_before")


def upsert_drafts(existing: DataFrame, invitations: DataFrame | None = None, followups: DataFrame | None = None) -> DataFrame:
    """K3: invitations insert or update only the invitation columns; follow-ups update only the follow-up
    columns of rows that already exist. Within a batch the latest per author wins. Bodies may be texts or, in all three
    tables, lengths (``body_sizes``)."""
    out = existing
    all_cols = ["author_id"] + DRAFT_INVITATION_COLS + DRAFT_FOLLOWUP_COLS
    if invitations is not None:
        new = _latest_per_author(invitations, DRAFT_INVITATION_COLS).select("author_id", *[F.col(c).alias("_n_" + c) for c in DRAFT_INVITATION_COLS])
        j = out.join(new, "author_id", "full_outer")
        matched = F.col("_n_saved_at").isNotNull()
        out = j.select("author_id", *[F.when(matched, F.col("_n_" + c)).otherwise(F.col(c)).alias(c) for c in DRAFT_INVITATION_COLS],
                       *DRAFT_FOLLOWUP_COLS)
    if followups is not None:
        fu = _latest_per_author(followups, DRAFT_FOLLOWUP_COLS + ["saved_at"]).select(
            "author_id", *[F.col(c).alias("_f_" + c) for c in DRAFT_FOLLOWUP_COLS], F.lit(True).alias("_f"))
        j = out.join(fu, "author_id", "left")
        hit = F.coalesce(F.col("_f"), F.lit(False))
        out = j.select("author_id", *DRAFT_INVITATION_COLS, *[F.when(hit, F.col("_f_" + c)).otherwise(F.col(c)).alias(c) for c in DRAFT_FOLLOWUP_COLS])
    return out.select(*all_cols)


def contact_with_draft(contacts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Contact by id, main row over gmail row (an id is unique within a channel), with its draft (left join).
    The choice is a hash aggregate of one number per id; the row itself is joined once."""
    prio = F.when(F.col("channel") == "main", 0).otherwise(1)
    best = contacts.groupBy("id").agg(F.min(prio).alias("_p"))
    one = contacts.withColumn("_p", prio).join(best, ["id", "_p"]).drop("_p")
    return one.join(drafts.withColumnRenamed("author_id", "id"), "id", "left")


def followup_context(eligible: DataFrame, messages: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row per eligible contact: the size of its thread and the original subject. A thread makes it
    'smart', else 'template' with subject 'Re: <original subject or Invitation>'. The thread's text is read by
    (author, chunk) from ``thread_text`` (W8): ``n_chunks`` says how many."""
    chunk = F.floor(F.col("seq") / THREAD_CHUNK_MESSAGES)
    per_chunk = messages.groupBy(F.col("author_id").alias("id"), chunk.alias("chunk")).agg(F.count("*").alias("n"))
    th = per_chunk.groupBy("id").agg(F.sum("n").alias("n_messages"), F.count("*").alias("n_chunks"))
    subj = drafts.select(F.col("author_id").alias("id"), F.col("invitation_subject").alias("original_subject"))
    j = eligible.select("id", "channel", "full_name", "email").join(th, "id", "left").join(subj, "id", "left")
    smart = F.col("n_messages").isNotNull()
    orig = F.coalesce(F.col("original_subject"), F.lit(K.DEFAULT_ORIGINAL_SUBJECT))
    none = F.lit(0).cast("bigint")
    return j.select(
        "id", "channel", "full_name", "email", F.coalesce("n_messages", none).alias("n_messages"), F.coalesce("n_chunks", none).alias("n_chunks"),
        F.when(smart, "smart").otherwise("template").alias("mode"),
        F.when(smart, F.lit(K.DEFAULT_SMART_FOLLOWUP_SUBJECT)).otherwise(F.concat(F.lit("Re: "), orig)).alias("followup_subject"),
    )


def approval_send_list(contacts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Approved contacts still waiting to be sent that have a draft."""
    c = contacts.filter((F.col("approval_status") == "approved") & F.col("email_status").isin("pending", "pending_approval"))
    return c.select("id", "channel", "full_name", "email").join(drafts.withColumnRenamed("author_id", "id"), "id", "inner")
