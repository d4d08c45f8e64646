"""Registered queries: ``key -> (fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``.

Each query reads the landed tables through the adapters and runs one operator of the inventory
over the whole tables. Array results are returned as joined text so both engines hash them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import emails as EM
from ..functions import text as TX
from ..operators import dedupe, drafts, engagement, export, extract, funnel, incremental, metrics, positions, ranking, verify
from ..sources import catalog, fixtures as fx, scans
from ..streaming import events as ST
from .oracle import CONTACTS_AS_OF as SQL_C_ASOF, EVENTS_AS_OF as SQL_E_ASOF, RUN_CUTOFF as SQL_CUTOFF, uuid_sql, with_ctes

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


C_ASOF, E_ASOF, CUTOFF = fx.CONTACTS_AS_OF, fx.EVENTS_AS_OF, fx.RUN_CUTOFF

SCALAR_CONTACT_COLS = ["channel", "id", "full_name", "email", "email_key", "source_platform", "contacted_at",
                       "email_status", "open_detected", "open_detected_at", "replied", "reply_sentiment",
                       "followup_sent", "followup_sent_at", "ab_variant", "lead_score", "approval_status"]
_SCALAR_SQL = ", ".join(SCALAR_CONTACT_COLS)


# ---------------------------------------------------------------- scans / sources (2.1)

@query("scan_contacts", with_ctes(f"""
SELECT {_SCALAR_SQL}, array_to_string(book_titles, '|') AS book_titles, book_description,
       array_to_string(genres, '|') AS genres
FROM (SELECT * FROM contacts WHERE channel = 'main' UNION ALL SELECT * FROM contacts WHERE channel = 'gmail')""", "contacts"))
def q_scan_contacts(spark, sf):
    c = fx.contacts(spark, sf)
    u = scans.scan_contacts(c.filter(F.col("channel") == "main").drop("channel"), c.filter(F.col("channel") == "gmail").drop("channel"))
    return u.select(*SCALAR_CONTACT_COLS, F.array_join("book_titles", "|").alias("book_titles"), "book_description",
                    F.array_join("genres", "|").alias("genres"))


@query("conform_schema", with_ctes("""
SELECT id, CAST(NULL AS VARCHAR) AS channel, full_name, email, nullif(lower(trim(email)), '') AS email_key,
  coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE email_status END, 'pending') AS email_status,
  false AS open_detected, false AS replied, false AS followup_sent, CAST(0 AS BIGINT) AS lead_score,
  'approved' AS approval_status, CAST(NULL AS VARCHAR) AS ab_variant, CAST(NULL AS TIMESTAMP) AS open_detected_at
FROM contacts""", "contacts"))
def q_conform_schema(spark, sf):
    c = fx.contacts(spark, sf)
    partial = c.select("id", "full_name", "email", "contacted_at",
                       F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("email_status")).alias("email_status"))
    full = scans.conform_schema(partial)
    return full.select("id", "channel", "full_name", "email", "email_key", "email_status", "open_detected", "replied",
                       "followup_sent", "lead_score", "approval_status", "ab_variant", "open_detected_at")


# ---------------------------------------------------------------- aggregations (2.5)

@query("overview_stats", with_ctes("""
SELECT count(*) FILTER (WHERE channel='main') AS main_total,
  count(*) FILTER (WHERE channel='main' AND email_status='sent') AS main_sent,
  count(*) FILTER (WHERE channel='main' AND open_detected) AS main_opens,
  count(*) FILTER (WHERE channel='main' AND replied) AS main_replies,
  count(*) FILTER (WHERE channel='main' AND followup_sent) AS main_followups,
  count(*) FILTER (WHERE channel='gmail') AS gmail_total,
  count(*) FILTER (WHERE channel='gmail' AND email_status='sent') AS gmail_sent,
  count(*) FILTER (WHERE channel='gmail' AND open_detected) AS gmail_opens,
  count(*) FILTER (WHERE channel='gmail' AND replied) AS gmail_replies,
  count(*) FILTER (WHERE channel='gmail' AND followup_sent) AS gmail_followups,
  count(*) FILTER (WHERE email_status='sent') AS total_sent,
  count(*) FILTER (WHERE open_detected) AS total_opens,
  count(*) FILTER (WHERE replied) AS total_replies
FROM contacts""", "contacts"))
def q_overview_stats(spark, sf):
    return metrics.overview_stats(fx.contacts(spark, sf))


@query("daily_contact_counts", with_ctes(f"""
SELECT CAST(contacted_at AS DATE) AS day, count(*) FILTER (WHERE channel='main') AS main,
  count(*) FILTER (WHERE channel='gmail') AS gmail
FROM contacts WHERE contacted_at >= {SQL_C_ASOF} - INTERVAL 30 DAY GROUP BY 1 ORDER BY 1""", "contacts"))
def q_daily_contact_counts(spark, sf):
    return metrics.daily_contact_counts(fx.contacts(spark, sf), C_ASOF)


@query("genre_performance", with_ctes("""
SELECT genre, count(*) AS total, count(*) FILTER (WHERE open_detected) AS opens, count(*) FILTER (WHERE replied) AS replies
FROM (SELECT coalesce(nullif(trim(g), ''), 'Unknown') AS genre, open_detected, replied
      FROM (SELECT unnest(CASE WHEN genres IS NULL OR len(genres) = 0 THEN [NULL]::VARCHAR[] ELSE genres END) AS g,
                   open_detected, replied FROM contacts))
GROUP BY genre ORDER BY total DESC, genre ASC LIMIT 10""", "contacts"))
def q_genre_performance(spark, sf):
    return metrics.genre_performance(fx.contacts(spark, sf))


@query("weekly_growth", with_ctes(f"""
SELECT this_week, last_week,
  CASE WHEN last_week > 0 THEN round((this_week - last_week) / last_week * 100.0, 1) ELSE 100.0 END AS growth
FROM (SELECT count(*) FILTER (WHERE contacted_at >= date_trunc('week', {SQL_C_ASOF}) AND contacted_at < {SQL_C_ASOF}) AS this_week,
             count(*) FILTER (WHERE contacted_at >= date_trunc('week', {SQL_C_ASOF}) - INTERVAL 7 DAY
                              AND contacted_at < date_trunc('week', {SQL_C_ASOF})) AS last_week FROM contacts)""", "contacts"))
def q_weekly_growth(spark, sf):
    return metrics.weekly_growth(fx.contacts(spark, sf), C_ASOF)


@query("ab_test_stats", with_ctes("""
SELECT ab_variant AS variant, count(*) AS total_sent, count(*) FILTER (WHERE open_detected) AS total_opens,
  count(*) FILTER (WHERE replied) AS total_replies
FROM contacts WHERE email_status = 'sent' AND ab_variant IS NOT NULL GROUP BY ab_variant""", "contacts"))
def q_ab_test_stats(spark, sf):
    return metrics.ab_test_stats(fx.contacts(spark, sf))


@query("ab_conversion_rates", with_ctes("""
SELECT *, total_opens / CAST(nullif(total_sent, 0) AS DOUBLE) AS open_rate, total_replies / CAST(nullif(total_sent, 0) AS DOUBLE) AS reply_rate
FROM (SELECT ab_variant AS variant, count(*) AS total_sent, count(*) FILTER (WHERE open_detected) AS total_opens,
        count(*) FILTER (WHERE replied) AS total_replies
      FROM contacts WHERE email_status = 'sent' AND ab_variant IS NOT NULL GROUP BY ab_variant)""", "contacts"))
def q_ab_conversion_rates(spark, sf):
    return metrics.ab_conversion_rates(fx.contacts(spark, sf))


@query("status_breakdown", with_ctes("""
SELECT coalesce(nullif(email_status, ''), 'unknown') AS email_status, count(*) AS count FROM contacts GROUP BY 1""", "contacts"))
def q_status_breakdown(spark, sf):
    return metrics.status_breakdown(fx.contacts(spark, sf))


_VERSIONS = [
    ("new_version", "SELECT * FROM contacts WHERE id % 8 <> 0"),
    ("old_version", """SELECT * REPLACE (CASE WHEN id % 4 = 1 THEN 'pending' ELSE email_status END AS email_status,
                                         CASE WHEN id % 5 = 2 THEN contacted_at - INTERVAL 3 DAY ELSE contacted_at END AS contacted_at)
                       FROM contacts WHERE id % 7 <> 0""")]


def _versions(spark, sf):
    """Two versions of the contacts table: rows came, went, and were corrected in status and time."""
    c, i = fx.contacts(spark, sf), F.col("id")
    old = c.filter(i % 7 != 0).withColumn("email_status", F.when(i % 4 == 1, "pending").otherwise(F.col("email_status"))).withColumn(
        "contacted_at", F.when(i % 5 == 2, F.col("contacted_at") - F.expr("INTERVAL 3 DAYS")).otherwise(F.col("contacted_at")))
    return old, c.filter(i % 8 != 0)


@query("snapshot_changes", with_ctes("""
SELECT coalesce(n.id, o.id) AS id, coalesce(n.channel, o.channel) AS channel,
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'deleted' ELSE 'changed' END AS change, o.email_status AS old_status, n.email_status AS new_status
FROM old_version o FULL JOIN new_version n ON o.id = n.id AND o.channel = n.channel
WHERE o.id IS NULL OR n.id IS NULL OR o.email_status <> n.email_status OR o.contacted_at <> n.contacted_at""", "contacts", local=_VERSIONS))
def q_snapshot_changes(spark, sf):
    old, new = _versions(spark, sf)
    ch = incremental.snapshot_changes(old, new, ["id", "channel"], ["email_status", "contacted_at"])
    return ch.select("id", "channel", "change", F.col("old.email_status").alias("old_status"), F.col("new.email_status").alias("new_status"))


def _updated(spark, sf, name):
    old, new = _versions(spark, sf)
    r = incremental.REPORTS[name]
    return r.updated(r.full(old), incremental.snapshot_changes(old, new, ["id", "channel"], r.columns))


@query("status_breakdown_updated", with_ctes("""
SELECT coalesce(nullif(email_status, ''), 'unknown') AS email_status, count(*) AS count FROM new_version GROUP BY 1""", "contacts", local=_VERSIONS))
def q_status_breakdown_updated(spark, sf):
    """A7 of the new version from the old report and the changes."""
    return _updated(spark, sf, "status")


@query("daily_counts_updated", with_ctes("""
SELECT CAST(contacted_at AS DATE) AS day, count(*) FILTER (WHERE channel = 'main') AS main, count(*) FILTER (WHERE channel = 'gmail') AS gmail
FROM new_version GROUP BY 1""", "contacts", local=_VERSIONS))
def q_daily_counts_updated(spark, sf):
    """A2's daily sums of the new version from the old report and the changes."""
    return _updated(spark, sf, "days")


@query("bounce_rate", with_ctes("""
SELECT scope, bounces, total, CASE WHEN total > 0 THEN bounces / total ELSE 0.0 END AS bounce_rate FROM (
  SELECT coalesce(channel, 'all') AS scope, count(*) FILTER (WHERE email_status IN ('bounced','dropped','failed')) AS bounces, count(*) AS total
  FROM contacts WHERE email_status <> 'pending' GROUP BY ROLLUP (channel))""", "contacts"))
def q_bounce_rate(spark, sf):
    """A8 for the main channel (the application's breaker input), the gmail channel and both together."""
    return metrics.bounce_rates(fx.contacts(spark, sf))


@query("days_since_start", with_ctes(f"""
SELECT min(contacted_at) AS first_contact,
  coalesce(greatest(1, date_sub('day', min(contacted_at), {SQL_C_ASOF})), 1) AS days
FROM contacts WHERE channel = 'main'""", "contacts"))
def q_days_since_start(spark, sf):
    return metrics.days_since_start(fx.contacts(spark, sf), C_ASOF, "main")


@query("lead_scores", with_ctes("""
SELECT author_id, CAST(sum(CASE WHEN event = 'open' THEN 1 WHEN event = 'click' THEN 5 ELSE 0 END) AS BIGINT) AS lead_score
FROM ev WHERE author_id IS NOT NULL AND event IN ('open', 'click') GROUP BY author_id""", "ev"))
def q_lead_scores(spark, sf):
    return engagement.lead_scores(fx.delivery_events(spark, sf))


@query("open_state", with_ctes("""
SELECT author_id, true AS open_detected, max(ts) AS open_detected_at, min(ts) AS first_open_at, count(*) AS opens
FROM ev WHERE author_id IS NOT NULL AND event = 'open' GROUP BY author_id""", "ev"))
def q_open_state(spark, sf):
    return engagement.open_state(fx.delivery_events(spark, sf))


@query("reply_state", with_ctes("""
SELECT email_key, true AS replied, arg_max(sentiment, (ts, msg_id)) AS reply_sentiment, max(ts) AS last_reply_at, count(*) AS replies
FROM (SELECT *, nullif(lower(trim(sender)), '') AS email_key FROM inbound) GROUP BY email_key""", "inbound"))
def q_reply_state(spark, sf):
    r = ST.parse_inbound(fx.inbound_replies(spark, sf)).withColumn("email_key", EM.email_key("sender"))
    return engagement.reply_state(r)


def _usage(spark, sf):
    d = fx.read(spark, sf, "documents")
    return d.select(F.col("n_chars").alias("input_tokens"), TX.word_count(F.col("text")).cast("bigint").alias("output_tokens"))


@query("llm_cost", """
SELECT CAST(sum(n_chars) AS BIGINT) AS input_tokens, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))) AS BIGINT) AS output_tokens,
  (CAST(sum(n_chars) AS BIGINT) * 0.59 + CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))) AS BIGINT) * 0.79) / 1e6 AS cost_usd
FROM documents""")
def q_llm_cost(spark, sf):
    return metrics.llm_cost(_usage(spark, sf))


# ---------------------------------------------------------------- ranking, paging (2.6)

@query("pending_approvals", with_ctes("""
SELECT id, full_name, email, source_platform, contacted_at AS found_at, channel FROM contacts
WHERE approval_status = 'pending' ORDER BY found_at DESC NULLS LAST, id""", "contacts"))
def q_pending_approvals(spark, sf):
    return ranking.pending_approvals(fx.contacts(spark, sf))


@query("top_leads", with_ctes("""
SELECT id, full_name, email, lead_score, reply_sentiment, channel,
  CASE WHEN reply_sentiment = 'interested' THEN 1000 ELSE lead_score END AS rank_score
FROM contacts WHERE lead_score > 0 OR reply_sentiment = 'interested'
ORDER BY rank_score DESC, id LIMIT 10""", "contacts"))
def q_top_leads(spark, sf):
    return ranking.top_leads(fx.contacts(spark, sf))


LEADERBOARD_SQL = with_ctes("""
SELECT id, full_name, email, lead_score, reply_sentiment, channel,
  CASE WHEN reply_sentiment = 'interested' THEN 1000 ELSE lead_score END AS rank_score
FROM (SELECT c.id, c.full_name, c.email, c.reply_sentiment, c.channel, coalesce(s.lead_score, 0) AS lead_score
      FROM contacts c LEFT JOIN (SELECT author_id, source, CAST(sum(CASE WHEN event='open' THEN 1 WHEN event='click' THEN 5 ELSE 0 END) AS BIGINT) AS lead_score
                                 FROM ev WHERE author_id IS NOT NULL AND event IN ('open','click') GROUP BY author_id, source) s
      ON c.id = s.author_id AND c.channel = s.source)
WHERE lead_score > 0 OR reply_sentiment = 'interested'
ORDER BY rank_score DESC, id LIMIT 10""", "contacts", "ev")


@query("lead_leaderboard", LEADERBOARD_SQL)
def q_lead_leaderboard(spark, sf):
    """Flagship: contacts with their score recomputed from the event feed, top 10."""
    scores = engagement.lead_scores(fx.delivery_events(spark, sf), by_channel=True)
    return ranking.top_leads(fx.contacts(spark, sf), scores=scores)


@query("activity_feed", with_ctes("""
SELECT * FROM (
  SELECT 'email_sent' AS type, id, full_name, contacted_at AS timestamp, channel FROM contacts WHERE email_status = 'sent'
  UNION ALL
  SELECT 'open' AS type, id, full_name, open_detected_at AS timestamp, channel FROM contacts WHERE open_detected)
ORDER BY timestamp DESC NULLS LAST, type, id LIMIT 50""", "contacts"))
def q_activity_feed(spark, sf):
    return ranking.activity_feed(fx.contacts(spark, sf))


@query("contacts_page", with_ctes("""
SELECT *, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 20) AS BIGINT) AS pages, 2 AS current_page
FROM f ORDER BY contacted_at DESC NULLS LAST, id LIMIT 20 OFFSET 20""", "contacts", local=[("f", """
SELECT id, full_name, email, email_status, contacted_at, open_detected, replied, channel FROM contacts
WHERE email_status = 'sent' AND (full_name ILIKE '%customer#00000001%' OR email ILIKE '%customer#00000001%')""")]))
def q_contacts_page(spark, sf):
    return ranking.contacts_page(fx.contacts(spark, sf), page=2, status="sent", search="customer#00000001")


THREAD_SQL = """
SELECT c.author_id, c.chunk, n.n_messages, c.thread_text FROM (
  SELECT author_id, CAST(floor(seq / 64) AS BIGINT) AS chunk,
    string_agg(concat('[', upper(direction), '] Subject: ', coalesce(subject, ''), chr(10) || 'Body: ', coalesce(body, ''), chr(10) || '---' || chr(10)), '' ORDER BY timestamp, seq) AS thread_text
  FROM msgs GROUP BY author_id, CAST(floor(seq / 64) AS BIGINT)) c
JOIN (SELECT author_id, count(*) AS n_messages FROM msgs GROUP BY author_id) n ON c.author_id = n.author_id"""


KEYSET_AFTER = ("1998-06-01 00:00:00", 0)


@query("contacts_page_keyset", with_ctes(f"""
SELECT *, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 20) AS BIGINT) AS pages, 1 AS current_page
FROM f WHERE contacted_at < TIMESTAMP '{KEYSET_AFTER[0]}' OR (contacted_at = TIMESTAMP '{KEYSET_AFTER[0]}' AND id > {KEYSET_AFTER[1]})
ORDER BY contacted_at DESC NULLS LAST, id LIMIT 20""", "contacts", local=[("f", """
SELECT id, full_name, email, email_status, contacted_at, open_detected, replied, channel FROM contacts WHERE channel = 'gmail'""")]))
def q_contacts_page_keyset(spark, sf):
    """W4 keyset form: the gmail page after a given (contacted_at, id)."""
    return ranking.contacts_page(fx.contacts(spark, sf), channel="gmail", after=KEYSET_AFTER)


@query("thread_text", with_ctes(THREAD_SQL.replace("msgs", "lmsgs"), "lmsgs"))
def q_thread_text(spark, sf):
    """W8 over threads of up to some hundred messages, in chunks of 64."""
    return ranking.thread_text(fx.long_threads(spark, sf))


@query("thread_positions", with_ctes("""
SELECT msg_id, author_id, row_number() OVER (PARTITION BY author_id ORDER BY timestamp, msg_id) - 1 AS seq
FROM (SELECT msg_id, CASE WHEN author_id % 3 = 0 THEN NULL WHEN author_id % 3 = 1 THEN 1 ELSE author_id END AS author_id, timestamp FROM msgs)""", "msgs"))
def q_thread_positions(spark, sf):
    """Positions in threads that come without one; a third of all messages is one thread, a third has no author."""
    a = F.col("author_id")
    m = fx.messages(spark, sf).withColumn("author_id", F.when(a % 3 == 1, F.lit(1).cast("bigint")).when(a % 3 == 2, a))
    return positions.message_positions(m)


@query("scan_messages", with_ctes("SELECT * FROM msgs", "msgs"))
def q_scan_messages(spark, sf):
    return scans.scan_messages(fx.messages(spark, sf))


# ---------------------------------------------------------------- dedupe / joins (2.4, 2.7)

@query("first_per_email", with_ctes("""
SELECT email_key, id, contacted_at, channel, full_name FROM (
  SELECT *, row_number() OVER (PARTITION BY email_key ORDER BY contacted_at, id) AS rn FROM contacts WHERE email_key IS NOT NULL)
WHERE rn = 1""", "contacts"))
def q_first_per_email(spark, sf):
    c = fx.contacts(spark, sf).select("contacted_at", "id", "email_key", "channel", "full_name")
    return dedupe.first_per_email(c, ["contacted_at", "id"]).select("email_key", "id", "contacted_at", "channel", "full_name")


@query("not_contacted_main", with_ctes("""
SELECT id, email_key FROM contacts g WHERE channel = 'gmail'
AND NOT EXISTS (SELECT 1 FROM contacts m WHERE m.channel = 'main' AND m.email_key = g.email_key)""", "contacts"))
def q_not_contacted_main(spark, sf):
    c = fx.contacts(spark, sf)
    return dedupe.not_contacted(c.filter(F.col("channel") == "gmail").select("id", "email_key"), c, scope="main")


@query("not_contacted_anywhere", with_ctes("""
SELECT id, email, nullif(lower(trim(email)), '') AS email_key FROM vf
WHERE NOT EXISTS (SELECT 1 FROM contacts c WHERE c.email_key = nullif(lower(trim(vf.email)), ''))""", "vf"))
def q_not_contacted_anywhere(spark, sf):
    v = fx.verify_requests(spark, sf).select("id", "email")
    return dedupe.not_contacted(v, fx.contacts(spark, sf), scope="both").select("id", "email", "email_key")


BY_NAME_CANDIDATES_SQL = """
SELECT 'customer' AS kind, c_custkey AS candidate_id, concat('  ', upper(c_name), ' ') AS name FROM customer
UNION ALL SELECT 'brand' AS kind, min(p_partkey) AS candidate_id, p_brand AS name FROM part GROUP BY p_brand"""


@query("not_contacted_by_name", with_ctes("""
SELECT kind, candidate_id, name FROM cand
WHERE NOT EXISTS (SELECT 1 FROM contacts WHERE nullif(lower(trim(full_name)), '') = nullif(lower(trim(cand.name)), ''))""",
                                          "contacts", local=[("cand", BY_NAME_CANDIDATES_SQL)]))
def q_not_contacted_by_name(spark, sf):
    """J3 over customer names (upper-cased, padded) and catalogue author names (brands)."""
    cust = fx.read(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("candidate_id"),
                                                 F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("name"))
    brands = fx.read(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("candidate_id"))
    cand = cust.unionByName(brands.select(F.lit("brand").alias("kind"), "candidate_id", "name"))
    return dedupe.not_contacted_by_name(cand, fx.contacts(spark, sf))


@query("cross_channel_overlap", with_ctes("""
SELECT email_key, count(*) FILTER (WHERE channel='main') AS main_attempts, count(*) FILTER (WHERE channel='gmail') AS gmail_attempts
FROM contacts WHERE email_key IS NOT NULL GROUP BY email_key
HAVING count(*) FILTER (WHERE channel='main') > 0 AND count(*) FILTER (WHERE channel='gmail') > 0""", "contacts"))
def q_cross_channel_overlap(spark, sf):
    return dedupe.cross_channel_overlap(fx.contacts(spark, sf))


@query("union_channels", with_ctes("""
SELECT id, 'main' AS channel, email_status FROM contacts WHERE channel = 'main'
UNION ALL SELECT id, 'gmail' AS channel, email_status FROM contacts WHERE channel = 'gmail'""", "contacts"))
def q_union_channels(spark, sf):
    c = fx.contacts(spark, sf).select("id", "email_status", "channel")
    return scans.scan_contacts(c.filter(F.col("channel") == "main").drop("channel"),
                               c.filter(F.col("channel") == "gmail").drop("channel")).select("id", "channel", "email_status")


@query("known_sender_replies", with_ctes("""
SELECT i.msg_id, i.sender, k.email_key, k.channel FROM inbound i
JOIN (SELECT DISTINCT email_key, channel FROM contacts WHERE email_key IS NOT NULL) k ON nullif(lower(trim(i.sender)), '') = k.email_key""", "inbound", "contacts"))
def q_known_sender_replies(spark, sf):
    r = ST.parse_inbound(fx.inbound_replies(spark, sf))
    return dedupe.known_sender_replies(r, fx.contacts(spark, sf)).select("msg_id", "sender", "email_key", "channel")


# ---------------------------------------------------------------- verification

_SYNTAX_SQL = EM.SYNTAX_PATTERN.replace("'", "''")
_ROLE_SQL = "^(" + "|".join(p.replace(".", "\\.") for p in K.ROLE_PREFIXES) + ")"
_DOMAIN_SQL = "nullif(regexp_replace(lower(trim(split_part({e}, '@', 2))), '[./]+$', ''), '')"

def verdict_sql(src: str) -> str:
    return VERDICT_SQL.replace("FROM vf) v", f"FROM {src}) v")


VERDICT_SQL = f"""
SELECT v.*, m.mx_host,
  CASE WHEN NOT syntax_valid THEN 'INVALID_SYNTAX' WHEN is_role THEN 'ROLE_BASED' WHEN m.mx_host IS NULL THEN 'MX_NOT_FOUND'
       WHEN probe_code IS NULL THEN 'SMTP_BLOCK' WHEN probe_code = 250 THEN 'DELIVERABLE' WHEN probe_code = 550 THEN 'SMTP_550'
       ELSE concat('SMTP_', cast(probe_code as varchar)) END AS smtp_result
FROM (SELECT *, coalesce(regexp_matches(email, '{_SYNTAX_SQL}'), false) AS syntax_valid,
             regexp_matches(lower(email), '{_ROLE_SQL}') AS is_role, {_DOMAIN_SQL.format(e='email')} AS domain FROM vf) v
LEFT JOIN (SELECT domain, regexp_replace(arg_min(exchange, (preference, exchange)), '\\.+$', '') AS mx_host
           FROM (SELECT {_DOMAIN_SQL.format(e="concat('x@', domain)")} AS domain, preference, exchange FROM mx) GROUP BY domain) m
ON v.domain = m.domain"""

VERIFY_OUT_SQL = """
SELECT id, channel, full_name, contacted_at, email, probe_code, syntax_valid, (syntax_valid AND NOT is_role AND mx_host IS NOT NULL) AS mx_found,
  mx_host, smtp_result, smtp_result NOT IN ('INVALID_SYNTAX','ROLE_BASED','MX_NOT_FOUND','SMTP_550') AS is_deliverable,
  CASE smtp_result WHEN 'INVALID_SYNTAX' THEN 'Regex/Syntax failed' WHEN 'ROLE_BASED' THEN 'Role-based email'
       WHEN 'MX_NOT_FOUND' THEN 'No MX record' WHEN 'SMTP_550' THEN 'User does not exist'
       WHEN 'SMTP_BLOCK' THEN 'No answer from mail server' END AS failure_reason
FROM verdict"""


def _verdicts(spark, sf):
    return verify.verify_emails(fx.verify_requests(spark, sf), fx.mx_records(spark, sf))


@query("email_syntax", with_ctes(f"SELECT id, email, coalesce(regexp_matches(email, '{_SYNTAX_SQL}'), false) AS syntax_valid FROM vf", "vf"))
def q_email_syntax(spark, sf):
    return fx.verify_requests(spark, sf).select("id", "email", EM.email_syntax_ok(F.col("email")).alias("syntax_valid"))


@query("role_address", with_ctes(f"SELECT id, email, regexp_matches(lower(email), '{_ROLE_SQL}') AS is_role FROM vf", "vf"))
def q_role_address(spark, sf):
    return fx.verify_requests(spark, sf).select("id", "email", EM.is_role_address(F.col("email")).alias("is_role"))


@query("email_domain", with_ctes(f"SELECT id, email, {_DOMAIN_SQL.format(e='email')} AS domain FROM vf", "vf"))
def q_email_domain(spark, sf):
    return fx.verify_requests(spark, sf).select("id", "email", EM.email_domain(F.col("email")).alias("domain"))


@query("mx_lookup", with_ctes(f"""
SELECT domain, min(preference) AS preference, regexp_replace(arg_min(exchange, (preference, exchange)), '\\.+$', '') AS mx_host
FROM (SELECT {_DOMAIN_SQL.format(e="concat('x@', domain)")} AS domain, preference, exchange FROM mx) GROUP BY domain""", "mx"))
def q_mx_lookup(spark, sf):
    return verify.mx_lookup(fx.mx_records(spark, sf))


@query("verify_emails", with_ctes(VERIFY_OUT_SQL, "vf", "mx", local=[("verdict", VERDICT_SQL)]))
def q_verify_emails(spark, sf):
    return _verdicts(spark, sf)


@query("verify_emails_heavy", with_ctes(VERIFY_OUT_SQL, "vf", "mx", local=[("verdict", VERDICT_SQL)]))
def q_verify_emails_heavy(spark, sf):
    """J8 for an MX table that is too large to broadcast: the commonest mail domains are answered from a map."""
    return verify.verify_emails(fx.verify_requests(spark, sf), fx.mx_records(spark, sf), heavy_domains=8)


CACHE_SQL = """
SELECT email_key, v.email AS email, v.is_deliverable AS is_deliverable, v.smtp_result AS smtp_result, v.failure_reason AS failure_reason,
  v.verified_at AS verified_at
FROM (SELECT nullif(lower(trim(email)), '') AS email_key,
             max({'verified_at': contacted_at, 'tie': id, 'email': email, 'is_deliverable': is_deliverable, 'smtp_result': smtp_result,
                  'failure_reason': failure_reason}) AS v
      FROM vout WHERE nullif(lower(trim(email)), '') IS NOT NULL GROUP BY 1)"""


def _cache(spark, sf, before: str | None = None):
    v = _verdicts(spark, sf)
    if before:
        v = v.filter(F.col("contacted_at") < F.lit(before).cast("timestamp_ntz"))
    return verify.upsert_verifications(v.withColumnRenamed("contacted_at", "verified_at"))


@query("upsert_verifications", with_ctes("SELECT * FROM cache", "vf", "mx", local=[("verdict", VERDICT_SQL), ("vout", VERIFY_OUT_SQL), ("cache", CACHE_SQL)]))
def q_upsert_verifications(spark, sf):
    return _cache(spark, sf)


@query("scan_verifications", with_ctes("""
SELECT email, true AS syntax_valid, true AS mx_found, smtp_result, is_deliverable, verified_at, failure_reason FROM cache""",
                                       "vf", "mx", local=[("verdict", VERDICT_SQL), ("vout", VERIFY_OUT_SQL), ("cache", CACHE_SQL)]))
def q_scan_verifications(spark, sf):
    return scans.scan_verifications(_cache(spark, sf))


@query("verification_lookup", with_ctes(f"""
SELECT r.id, r.email, r.email_key, c.smtp_result AS cached_result, c.is_deliverable AS cached_deliverable,
  CASE WHEN c.smtp_result IS NOT NULL THEN 'cached' ELSE 'to_verify' END AS lookup
FROM (SELECT id, email, nullif(lower(trim(email)), '') AS email_key FROM vf WHERE contacted_at >= {SQL_CUTOFF}) r
LEFT JOIN (SELECT * FROM cache) c ON r.email_key = c.email_key""", "vf", "mx",
                                        local=[("verdict", VERDICT_SQL), ("vout", VERIFY_OUT_SQL.replace("FROM verdict", f"FROM verdict WHERE contacted_at < {SQL_CUTOFF}")), ("cache", CACHE_SQL)]))
def q_verification_lookup(spark, sf):
    """This run's requests against the cache written by earlier runs (verdicts before the cutoff)."""
    req = fx.verify_requests(spark, sf).filter(F.col("contacted_at") >= F.lit(CUTOFF).cast("timestamp_ntz")).select("id", "email")
    return verify.verification_lookup(req, _cache(spark, sf, before=CUTOFF)).select(
        "id", "email", "email_key", "cached_result", "cached_deliverable", "lookup")


# ---------------------------------------------------------------- text extraction

_EMAIL_SQL = K.EMAIL_PATTERN
_GENERIC_SQL = "^(" + "|".join(p.replace(".", "\\.") for p in K.GENERIC_PREFIXES) + ")"


@query("extract_emails", f"""
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, email, NOT regexp_matches(lower(email), '{_GENERIC_SQL}') AS is_personal
FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}')) AS email,
             generate_subscripts(regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}'), 1) AS pos FROM documents)""")
def q_extract_emails(spark, sf):
    return extract.document_emails(fx.read(spark, sf, "documents"))


@query("context_email", f"""
SELECT doc_id, email FROM (
  SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}'), lambda e: NOT regexp_matches(lower(e), '(support|info|noreply)'))[1] AS email
  FROM documents) WHERE email IS NOT NULL""")
def q_context_email(spark, sf):
    return extract.context_emails(fx.read(spark, sf, "documents"))


@query("personal_email_filter", f"""
SELECT doc_id, email FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}')) AS email FROM documents)
WHERE NOT regexp_matches(lower(email), '{_GENERIC_SQL}')""")
def q_personal_email_filter(spark, sf):
    m = extract.document_emails(fx.read(spark, sf, "documents"))
    return m.filter(EM.is_personal_email(F.col("email"))).select("doc_id", "email")


# links in the forms that the pages have: attributes quoted, unquoted or upper-case, the entities of the landed forms
_ATTR_SQL = r"""(?:\s+[a-z-]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+))*\s*"""
_LINK_SQL = rf"(?is)<a{_ATTR_SQL}>.*?</a>"
_OPEN_SQL = rf"(?is)^<a{_ATTR_SQL}>"


def _href_sql(x: str) -> str:
    attr = r"""(?is)\shref\s*=\s*(?:"([^"]*)|''([^'']*)|([^\s>"'']+))"""
    tag = f"regexp_extract({x}, '{_OPEN_SQL}', 0)"
    value = "concat(" + ", ".join(f"regexp_extract({tag}, '{attr}', {g})" for g in (1, 2, 3)) + ")"
    return f"trim(replace(replace(replace({value}, '&#109;', 'm'), '&#64;', '@'), '&amp;', '&'))"


_PAGE_EMAIL_SQL = f"""
  list_filter(list_transform(list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<a{_ATTR_SQL}>', 0), lambda x: {_href_sql('x')}),
                                         lambda h: starts_with(lower(h), 'mailto:')), lambda h: trim(split_part(substr(h, 8), '?', 1))),
              lambda e: e <> '' AND NOT regexp_matches(lower(e), '{_GENERIC_SQL}'))[1]"""
_PAGE_REGEX_SQL = f"list_filter(regexp_extract_all(coalesce(html, ''), '{_EMAIL_SQL}'), lambda e: NOT regexp_matches(lower(e), '{_GENERIC_SQL}'))[1]"


@query("page_mailto", with_ctes(f"SELECT page_id, url, {_PAGE_EMAIL_SQL} AS mailto_email FROM pg", "pg"))
def q_page_mailto(spark, sf):
    return fx.linked_pages(spark, sf).select("page_id", "url", EM.page_mailto(F.col("html")).alias("mailto_email"))


@query("page_email", with_ctes(f"SELECT page_id, url, {_PAGE_EMAIL_SQL} AS mailto_email, coalesce({_PAGE_EMAIL_SQL}, {_PAGE_REGEX_SQL}) AS page_email FROM pg", "pg"))
def q_page_email(spark, sf):
    return extract.page_emails(fx.linked_pages(spark, sf))


_SEL_SQL = " ".join(
    [f"WHEN contains(lower(a.text), '{t.lower()}') THEN {i}" for i, t in enumerate(K.CONTACT_LINK_TEXTS, 1)]
    + [f"WHEN contains(lower(a.href), '{h}') THEN {i}" for i, h in enumerate(K.CONTACT_LINK_HREFS, len(K.CONTACT_LINK_TEXTS) + 1)])


CONTACT_LINKS_SQL = f"""
SELECT page_id, url, b.selector_rank AS selector_rank, b.text AS link_text, b.href AS href,
  CASE WHEN regexp_matches(b.href, '^https?://') THEN b.href
       WHEN starts_with(b.href, '//') THEN concat(regexp_extract(url, '^(https?:)', 1), b.href)
       WHEN starts_with(b.href, '/') THEN concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), b.href)
       ELSE concat(CASE WHEN regexp_extract(url, '^(https?://[^?#]*/)', 1) = '' THEN concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/')
                        ELSE regexp_extract(url, '^(https?://[^?#]*/)', 1) END, b.href) END AS subpage_url
FROM (SELECT page_id, url, min({{'selector_rank': selector_rank, 'pos': pos, 'href': a.href, 'text': a.text}}) AS b FROM (
        SELECT page_id, url, pos, a, CASE {_SEL_SQL} END AS selector_rank FROM (
          SELECT page_id, url, pos, {{'href': {_href_sql('x')},
                 'text': trim(regexp_replace(replace(regexp_replace(regexp_replace(x, '{_OPEN_SQL}', ''), '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))}} AS a FROM (
            SELECT page_id, url, generate_subscripts(xs, 1) - 1 AS pos, unnest(xs) AS x FROM (
              SELECT page_id, url, regexp_extract_all(html, '{_LINK_SQL}', 0) AS xs FROM pg))))
      WHERE selector_rank IS NOT NULL AND a.href <> '' AND NOT starts_with(lower(a.href), 'mailto:') GROUP BY page_id, url)"""


@query("contact_subpage_links", with_ctes(CONTACT_LINKS_SQL, "pg"))
def q_contact_subpage_links(spark, sf):
    return extract.contact_subpage_links(fx.linked_pages(spark, sf))


_HIT_FILTER_SQL = "coalesce(title, '') <> '' AND coalesce(url, '') <> ''"
_BL_SQL = "|".join(t.lower().replace(".", "\\.") for t in K.BLACKLIST_TERMS)


@query("blacklist_filter", with_ctes(f"""
SELECT query, position, title, url, snippet FROM nhits
WHERE NOT (coalesce(regexp_matches(lower(url), '{_BL_SQL}'), false) OR coalesce(regexp_matches(lower(snippet), '{_BL_SQL}'), false)
           OR coalesce(regexp_matches(lower(title), '{_BL_SQL}'), false))""", "nhits"))
def q_blacklist_filter(spark, sf):
    return extract.blacklist_filter(fx.noted_hits(spark, sf)).select("query", "position", "title", "url", "snippet")


@query("name_from_title", with_ctes("""
SELECT position, title, trim(split_part(CASE WHEN regexp_matches(coalesce(title, ''), '\\bby\\b')
                                     THEN regexp_extract(coalesce(title, ''), '^.*\\bby\\b(.*)$', 1) ELSE coalesce(title, '') END, '|', 1)) AS name
FROM hits""", "hits"))
def q_name_from_title(spark, sf):
    return fx.search_hits(spark, sf).select("position", "title", TX.name_from_title(F.col("title")).alias("name"))


def _ukey(url: str) -> str:
    bare = f"regexp_replace({url}, '^https?://', '')"
    return f"concat(lower(regexp_extract({bare}, '^[^/?#]*', 0)), regexp_replace({bare}, '^[^/?#]*', ''))"


_SCHEME_SQL = "CASE WHEN starts_with(url, 'http') THEN url ELSE concat('https://', url) END"


@query("scan_search_hits", with_ctes(f"""
SELECT query, position, title, {_SCHEME_SQL} AS url, snippet, engine, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY position) AS rank FROM hits WHERE {_HIT_FILTER_SQL})
WHERE rank <= 10""", "hits"))
def q_scan_search_hits(spark, sf):
    return scans.scan_search_hits(fx.search_hits(spark, sf), 10).select("query", "position", "title", "url", "snippet", "engine", "rank")


@query("source_fallback", with_ctes("""
SELECT query, position, engine FROM hits WHERE engine = 'primary'
UNION ALL
SELECT query, position, 'secondary' AS engine FROM hits s WHERE NOT EXISTS (SELECT 1 FROM hits p WHERE p.engine = 'primary' AND p.query = s.query)""", "hits"))
def q_source_fallback(spark, sf):
    h = fx.search_hits(spark, sf)
    primary = h.filter(F.col("engine") == "primary").select("query", "position", "engine")
    secondary = h.select("query", "position", F.lit("secondary").alias("engine"))
    return scans.source_fallback(primary, secondary)


@query("scan_pages", with_ctes(f"""
SELECT h.query, h.position, h.url, p.page_id, length(p.html) AS html_chars
FROM (SELECT query, position, {_SCHEME_SQL} AS url FROM hits) h
LEFT JOIN (SELECT {_ukey('url')} AS k, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM pg GROUP BY 1) p
  ON {_ukey('h.url')} = p.k""", "hits", "pg"))
def q_scan_pages(spark, sf):
    h = fx.search_hits(spark, sf).select("query", "position", scans.with_scheme(F.col("url")).alias("url"))
    return scans.scan_pages(h, fx.linked_pages(spark, sf)).select("query", "position", "url", "page_id", F.length("html").cast("bigint").alias("html_chars"))


@query("resolve_email", with_ctes(f"""
SELECT s.position, s.name, s.url,
  coalesce(s.context_email, home.home_email, sub.subpage_email) AS email,
  CASE WHEN s.context_email IS NOT NULL THEN 'context' WHEN home.home_email IS NOT NULL THEN 'website_crawl_home'
       WHEN sub.subpage_email IS NOT NULL THEN 'website_crawl_subpage' ELSE 'not_found' END AS email_source
FROM (SELECT position, trim(split_part(CASE WHEN regexp_matches(coalesce(title, ''), '\\bby\\b')
                                            THEN regexp_extract(coalesce(title, ''), '^.*\\bby\\b(.*)$', 1) ELSE coalesce(title, '') END, '|', 1)) AS name,
             {_SCHEME_SQL} AS url,
             list_filter(regexp_extract_all(coalesce(snippet, ''), '{_EMAIL_SQL}'), lambda e: NOT regexp_matches(lower(e), '(support|info|noreply)'))[1] AS context_email
      FROM hits) s
LEFT JOIN (SELECT k, email AS home_email, sk FROM facts) home ON {_ukey('s.url')} = home.k
LEFT JOIN (SELECT k AS sk, email AS subpage_email FROM facts) sub ON home.sk = sub.sk""", "hits", "pg", local=[("links", CONTACT_LINKS_SQL), ("facts", f"""
SELECT * FROM (
  SELECT {_ukey('p.url')} AS k, coalesce({_PAGE_EMAIL_SQL}, {_PAGE_REGEX_SQL}) AS email,
    {_ukey('l.subpage_url')} AS sk,
    row_number() OVER (PARTITION BY {_ukey('p.url')} ORDER BY p.page_id) AS rn
  FROM pg p LEFT JOIN links l ON p.page_id = l.page_id) WHERE rn = 1""")]))
def q_resolve_email(spark, sf):
    """P9 over web-search stubs (description = snippet, url = hit url) and the landed pages."""
    h = fx.search_hits(spark, sf)
    stubs = h.select("position", TX.name_from_title(F.col("title")).alias("name"), F.coalesce(F.col("snippet"), F.lit("")).alias("description"),
                     scans.with_scheme(F.col("url")).alias("url"))
    r = extract.resolve_email(stubs, fx.linked_pages(spark, sf))
    return r.select("position", "name", "url", "email", "email_source")


# ---------------------------------------------------------------- catalogue

_CAT_WHERE = "WHERE p_size % 10 <> 0"


def _catalog(spark, sf, kind):
    readers = {"google_books": catalog.catalog_google_books, "open_library": catalog.catalog_open_library,
               "loc": catalog.catalog_loc, "gutendex": catalog.catalog_gutendex}
    return readers[kind](fx.catalogue_payloads(spark, sf, kind), keep=["response_id"])


@query("catalog_google_books", f"""
SELECT p_partkey AS response_id, p_brand AS name, p_name AS book_title, p_type AS description, NULL::VARCHAR AS url,
  '{K.SOURCE_GOOGLE_BOOKS}' AS source_platform FROM part {_CAT_WHERE}""")
def q_catalog_google_books(spark, sf):
    return _catalog(spark, sf, "google_books")


@query("catalog_open_library", f"""
SELECT p_partkey AS response_id, p_brand AS name, p_name AS book_title, '' AS description, NULL::VARCHAR AS url,
  '{K.SOURCE_OPEN_LIBRARY}' AS source_platform FROM part {_CAT_WHERE}""")
def q_catalog_open_library(spark, sf):
    return _catalog(spark, sf, "open_library")


@query("catalog_loc", f"""
SELECT p_partkey AS response_id, p_brand AS name, p_name AS book_title, concat(p_type, '; size ', cast(p_size as varchar)) AS description,
  NULL::VARCHAR AS url, '{K.SOURCE_LOC}' AS source_platform FROM part {_CAT_WHERE}""")
def q_catalog_loc(spark, sf):
    return _catalog(spark, sf, "loc")


@query("catalog_gutendex", f"""
SELECT p_partkey AS response_id, p_brand AS name, p_name AS book_title, '{K.GUTENDEX_DESCRIPTION}' AS description, NULL::VARCHAR AS url,
  '{K.SOURCE_GUTENDEX}' AS source_platform FROM part {_CAT_WHERE}""")
def q_catalog_gutendex(spark, sf):
    return _catalog(spark, sf, "gutendex")


SOURCE_ORDER = [K.SOURCE_GOOGLE_BOOKS, K.SOURCE_OPEN_LIBRARY, K.SOURCE_LOC, K.SOURCE_GUTENDEX, K.SOURCE_WEB_SEARCH]


def _all_stubs(spark, sf):
    parts = [_catalog(spark, sf, k).withColumnRenamed("response_id", "seq") for k in ["google_books", "open_library", "loc", "gutendex"]]
    h = fx.search_hits(spark, sf).withColumn("url", scans.with_scheme(F.col("url")))
    web = catalog.search_stubs(h, keep=["position"]).withColumnRenamed("position", "seq")
    out = parts[0]
    for p in parts[1:] + [web]:
        out = out.unionByName(p)
    return out


_ALL_STUBS_SQL = f"""
SELECT p_partkey AS seq, p_brand AS name, p_name AS book_title, src AS source_platform FROM part,
  (VALUES ('{K.SOURCE_GOOGLE_BOOKS}'), ('{K.SOURCE_OPEN_LIBRARY}'), ('{K.SOURCE_LOC}'), ('{K.SOURCE_GUTENDEX}')) t(src) {_CAT_WHERE}
UNION ALL SELECT page_id AS seq, NULL AS name, NULL AS book_title, '{K.SOURCE_WEB_SEARCH}' AS source_platform FROM pages"""


@query("source_counts", f"SELECT source_platform, count(*) AS candidates FROM ({_ALL_STUBS_SQL}) GROUP BY 1")
def q_source_counts(spark, sf):
    return metrics.source_counts(_all_stubs(spark, sf))


@query("fill_to_target", f"""
SELECT source_platform, seq, book_title, source_rank FROM (
  SELECT *, CAST(CASE source_platform {' '.join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SOURCE_ORDER, 1))} END AS BIGINT) AS source_rank
  FROM ({_ALL_STUBS_SQL}))
ORDER BY source_rank, seq LIMIT {K.AUTHORS_PER_DAY}""")
def q_fill_to_target(spark, sf):
    return ranking.fill_to_target(_all_stubs(spark, sf), K.AUTHORS_PER_DAY, SOURCE_ORDER).select("source_platform", "seq", "book_title", "source_rank")


# ---------------------------------------------------------------- the daily run

CAND_SQL = f"""
SELECT v.id AS seq, v.id, v.channel, v.full_name, c.source_platform, c.book_titles, v.contacted_at,
  CASE WHEN v.id % 17 = 0 THEN NULL ELSE v.email END AS email, v.probe_code
FROM vf v JOIN contacts c ON v.id = c.id WHERE v.contacted_at >= {SQL_CUTOFF}"""

CLASSIFIED_SQL = f"""
SELECT c.*, v.smtp_result, v.is_deliverable,
  CASE WHEN c.email_key IS NULL THEN 'no_email'
       WHEN s.email_key IS NOT NULL THEN 'already_contacted'
       WHEN EXISTS (SELECT 1 FROM cand e JOIN cverdict w ON e.id = w.id
                    WHERE nullif(lower(trim(e.email)), '') = c.email_key AND e.seq < c.seq
                      AND w.smtp_result NOT IN ('INVALID_SYNTAX','ROLE_BASED','MX_NOT_FOUND','SMTP_550')) THEN 'already_contacted'
       WHEN NOT coalesce(v.is_deliverable, false) THEN 'undeliverable'
       ELSE 'ready' END AS outcome
FROM (SELECT *, nullif(lower(trim(email)), '') AS email_key FROM cand) c
LEFT JOIN (SELECT DISTINCT email_key FROM contacts WHERE contacted_at < {SQL_CUTOFF} AND email_key IS NOT NULL) s ON c.email_key = s.email_key
LEFT JOIN (SELECT id, smtp_result, smtp_result NOT IN ('INVALID_SYNTAX','ROLE_BASED','MX_NOT_FOUND','SMTP_550') AS is_deliverable FROM cverdict) v
  ON c.id = v.id"""

SENT_SQL = """
SELECT r.*, CASE WHEN s.status IN ('sent', 'dry_run') THEN s.sent_at END AS email_sent_at, s.error AS send_error,
  coalesce(s.status, 'pending') AS email_status
FROM (SELECT * FROM classified WHERE outcome = 'ready') r
LEFT JOIN (SELECT id, CASE WHEN probe_code = 250 THEN 'sent' WHEN probe_code IS NULL THEN 'dry_run' ELSE 'failed' END AS status,
                  contacted_at + INTERVAL 1 HOUR AS sent_at,
                  CASE WHEN probe_code <> 250 THEN concat('SMTP ', cast(probe_code as varchar)) END AS error FROM cand) s ON r.id = s.id"""

RUN_LOCAL = [("cand", CAND_SQL), ("cverdict", verdict_sql("cand")), ("classified", CLASSIFIED_SQL)]
RUN_LOCAL_SENT = RUN_LOCAL + [("sent", SENT_SQL)]


def _run_existing(spark, sf):
    return fx.contacts(spark, sf).filter(F.col("contacted_at") < F.lit(CUTOFF).cast("timestamp_ntz"))


def _classified(spark, sf, approval_required=False):
    verified = verify.verify_emails(fx.run_candidates(spark, sf), fx.mx_records(spark, sf))
    return funnel.classify_candidates(verified, _run_existing(spark, sf), approval_required=approval_required)


def _run(spark, sf):
    """The classified run with the sender's results merged (all candidates)."""
    return funnel.apply_send_results(fx.with_send_results(_classified(spark, sf)))


def _sent(spark, sf):
    return _run(spark, sf).filter(F.col("outcome") == "ready")


@query("classify_candidates", with_ctes("SELECT seq, id, channel, email_key, smtp_result, outcome FROM classified", "vf", "contacts", "mx", local=RUN_LOCAL))
def q_classify_candidates(spark, sf):
    return _classified(spark, sf).select("seq", "id", "channel", "email_key", "smtp_result", "outcome")


@query("funnel_counts", with_ctes("SELECT channel, outcome, count(*) AS candidates FROM classified GROUP BY 1, 2", "vf", "contacts", "mx", local=RUN_LOCAL))
def q_funnel_counts(spark, sf):
    return funnel.funnel_counts(_classified(spark, sf))


@query("apply_send_results", with_ctes("SELECT seq, id, channel, email_status, email_sent_at, send_error FROM sent", "vf", "contacts", "mx", local=RUN_LOCAL_SENT))
def q_apply_send_results(spark, sf):
    return _sent(spark, sf).select("seq", "id", "channel", "email_status", "email_sent_at", "send_error")


RUN_SUMMARY_SQL = """
SELECT b.channel, b.discovered, b.valid_emails, coalesce(s.sent, 0) AS sent, coalesce(s.failed, 0) AS failed, b.skipped, b.sources,
  coalesce(e.errors, '') AS errors
FROM (SELECT channel, count(*) AS discovered, count(*) FILTER (WHERE outcome IN ('pending_approval', 'ready')) AS valid_emails,
             count(*) FILTER (WHERE outcome IN ('no_email', 'undeliverable')) AS skipped,
             string_agg(DISTINCT source_platform, ', ' ORDER BY source_platform) AS sources FROM classified GROUP BY channel) b
LEFT JOIN (SELECT channel, count(*) FILTER (WHERE email_status IN ('sent', 'dry_run')) AS sent,
                  count(*) FILTER (WHERE email_status = 'failed') AS failed FROM sent GROUP BY channel) s ON b.channel = s.channel
LEFT JOIN (SELECT channel, string_agg(msg, '; ' ORDER BY seq) AS errors FROM (
             SELECT channel, seq, concat('Send failed for ', full_name, ': ', coalesce(send_error, 'unknown error')) AS msg,
                    row_number() OVER (PARTITION BY channel ORDER BY seq) AS rn FROM sent WHERE email_status = 'failed') WHERE rn <= 5
           GROUP BY channel) e ON b.channel = e.channel"""


@query("run_summary", with_ctes(RUN_SUMMARY_SQL, "vf", "contacts", "mx", local=RUN_LOCAL_SENT))
def q_run_summary(spark, sf):
    return funnel.run_summary(_run(spark, sf))


@query("warmup_cap", with_ctes(f"""
SELECT channel, seq, id, rank_in_group, cap FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.channel ORDER BY seq) AS rank_in_group, k.cap
  FROM (SELECT * FROM classified WHERE outcome = 'ready') r JOIN (
    SELECT channel, CAST(least(CASE channel WHEN 'main' THEN {K.DAILY_CAP['main']} ELSE {K.DAILY_CAP['gmail']} END,
                               CASE channel WHEN 'main' THEN {K.WARMUP_BASE['main']} ELSE {K.WARMUP_BASE['gmail']} END
                               + CASE channel WHEN 'main' THEN {K.WARMUP_PER_DAY['main']} ELSE {K.WARMUP_PER_DAY['gmail']} END
                                 * coalesce(greatest(1, date_sub('day', min(contacted_at), {SQL_CUTOFF})), 1)) AS BIGINT) AS cap
    FROM contacts WHERE contacted_at < {SQL_CUTOFF} GROUP BY channel) k ON r.channel = k.channel)
WHERE rank_in_group <= cap""", "vf", "contacts", "mx", local=RUN_LOCAL))
def q_warmup_cap(spark, sf):
    ready = _classified(spark, sf).filter(F.col("outcome") == "ready")
    return funnel.warmup_cap(ready, _run_existing(spark, sf), CUTOFF).select("channel", "seq", "id", "rank_in_group", "cap")


@query("daily_send_cap", with_ctes(f"""
SELECT channel, day, id, rank_in_group, cap FROM (
  SELECT channel, CAST(contacted_at AS DATE) AS day, id,
         row_number() OVER (PARTITION BY channel, CAST(contacted_at AS DATE) ORDER BY contacted_at, id) AS rank_in_group,
         CAST(CASE channel WHEN 'main' THEN {K.DAILY_CAP['main']} ELSE {K.DAILY_CAP['gmail']} END AS BIGINT) AS cap
  FROM contacts WHERE email_status = 'sent') WHERE rank_in_group <= cap""", "contacts"))
def q_daily_send_cap(spark, sf):
    sends = fx.contacts(spark, sf).filter(F.col("email_status") == "sent")
    return funnel.daily_send_cap(sends).select("channel", "day", "id", "rank_in_group", "cap")


@query("top_contacted", with_ctes("""
SELECT row_number() OVER (ORDER BY seq) AS rank, full_name, coalesce(book_titles[1], 'N/A') AS first_title,
  CASE WHEN email IS NULL OR email = '' THEN 'N/A' ELSE concat(substr(email, 1, 1), '***@', split_part(email, '@', 2)) END AS masked_email
FROM (SELECT * FROM sent WHERE email_status IN ('sent', 'dry_run') ORDER BY seq LIMIT 5)""", "vf", "contacts", "mx", local=RUN_LOCAL_SENT))
def q_top_contacted(spark, sf):
    s = _sent(spark, sf).filter(F.col("email_status").isin("sent", "dry_run"))
    return ranking.top_contacted(s)


@query("send_window", with_ctes(f"""
SELECT event_id, ts, event FROM ev WHERE hour(ts) >= {K.SEND_WINDOW_START_UTC} AND hour(ts) < {K.SEND_WINDOW_END_UTC}""", "ev"))
def q_send_window(spark, sf):
    return funnel.send_window(fx.delivery_events(spark, sf), "ts").select("event_id", "ts", "event")


@query("circuit_breaker", with_ctes(f"""
SELECT channel, bounce_rate, CAST({K.MAX_BOUNCE_RATE} AS DOUBLE) AS threshold, bounce_rate > {K.MAX_BOUNCE_RATE} AS tripped,
  CASE WHEN bounce_rate > {K.MAX_BOUNCE_RATE} THEN printf('CIRCUIT BREAKER TRIPPED: Bounce rate (%.1f%%) exceeds threshold (%.1f%%).', bounce_rate * 100.0, {K.MAX_BOUNCE_RATE * 100.0}) END AS error
FROM (SELECT channel, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE email_status IN ('bounced','dropped','failed')) / count(*) ELSE 0.0 END AS bounce_rate
      FROM contacts WHERE email_status <> 'pending' GROUP BY channel)""", "contacts"))
def q_circuit_breaker(spark, sf):
    return funnel.circuit_breaker(fx.contacts(spark, sf))


@query("followup_eligible", with_ctes(f"""
SELECT id, channel, full_name, email, contacted_at FROM contacts
WHERE email_status = 'sent' AND open_detected AND NOT replied AND NOT followup_sent AND contacted_at <= {SQL_C_ASOF} - INTERVAL {K.FOLLOW_UP_DELAY_DAYS} DAY""", "contacts"))
def q_followup_eligible(spark, sf):
    return engagement.followup_eligible(fx.contacts(spark, sf), C_ASOF).select("id", "channel", "full_name", "email", "contacted_at")


@query("set_approval", with_ctes("""
SELECT c.id, c.channel, CASE WHEN d.decision IS NOT NULL THEN d.decision ELSE c.approval_status END AS approval_status,
  d.decision IS NOT NULL AS updated
FROM contacts c LEFT JOIN (SELECT id, CASE WHEN lead_score >= 2 THEN 'approved' ELSE 'rejected' END AS decision
                           FROM contacts WHERE approval_status = 'pending') d ON c.id = d.id""", "contacts"))
def q_set_approval(spark, sf):
    c = fx.contacts(spark, sf)
    decisions = ranking.pending_approvals(c).join(c.select("id", "lead_score"), "id").select(
        "id", F.when(F.col("lead_score") >= 2, "approved").otherwise("rejected").alias("decision"))
    return engagement.set_approval(c, decisions).select("id", "channel", "approval_status", "updated")


@query("mark_followup_sent", with_ctes(f"""
SELECT c.id, c.followup_sent OR e.id IS NOT NULL AS followup_sent, coalesce(e.sent_at, c.followup_sent_at) AS followup_sent_at
FROM contacts c LEFT JOIN (SELECT id, {SQL_C_ASOF} AS sent_at FROM contacts
  WHERE email_status = 'sent' AND open_detected AND NOT replied AND NOT followup_sent
    AND contacted_at <= {SQL_C_ASOF} - INTERVAL {K.FOLLOW_UP_DELAY_DAYS} DAY) e ON c.id = e.id""", "contacts"))
def q_mark_followup_sent(spark, sf):
    c = fx.contacts(spark, sf)
    sent = engagement.followup_eligible(c, C_ASOF).select("id", F.lit(C_ASOF).cast("timestamp_ntz").alias("sent_at"))
    return engagement.mark_followup_sent(c, sent).select("id", "followup_sent", "followup_sent_at")


def _followup_results(eligible):
    return eligible.select("id", F.when(F.col("lead_score") > 0, "sent").otherwise("failed").alias("status"),
                           F.when(F.col("lead_score") == 0, F.lit("mailbox unavailable")).alias("error"))


@query("followup_summary", with_ctes(f"""
SELECT e.channel, e.eligible_authors, coalesce(s.sent, 0) AS sent, coalesce(s.failed, 0) AS failed, coalesce(x.errors, '') AS errors
FROM (SELECT channel, count(*) AS eligible_authors FROM elig GROUP BY channel) e
LEFT JOIN (SELECT channel, count(*) FILTER (WHERE lead_score > 0) AS sent, count(*) FILTER (WHERE lead_score = 0) AS failed FROM elig GROUP BY channel) s
  ON e.channel = s.channel
LEFT JOIN (SELECT channel, string_agg(concat('Follow-up failed for ', cast(id as varchar), ': mailbox unavailable'), '; ' ORDER BY id) AS errors
           FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY id) AS rn FROM elig WHERE lead_score = 0) WHERE rn <= 5
           GROUP BY channel) x ON e.channel = x.channel""", "contacts", local=[("elig", f"""
SELECT * FROM contacts WHERE email_status = 'sent' AND open_detected AND NOT replied AND NOT followup_sent
  AND contacted_at <= {SQL_C_ASOF} - INTERVAL {K.FOLLOW_UP_DELAY_DAYS} DAY""")]))
def q_followup_summary(spark, sf):
    el = engagement.followup_eligible(fx.contacts(spark, sf), C_ASOF)
    return funnel.followup_summary(el, _followup_results(el))


# ---------------------------------------------------------------- drafts

RUN_DATE = "2001-08-02"
TRACKING_BASE = "https://track.example.org"
_WS_SQL = "[ \\t\\n\\r\\f]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS_SQL}+|{_WS_SQL}+$', '', 'g')"


_TOKENS_SQL = {
    "AUTHOR_NAME": "full_name",
    "BOOK_TITLE": f"coalesce(book_titles[1], {_lit(K.FALLBACK_BOOK_TITLE)})",
    "BOOK_DESCRIPTION": f"coalesce(nullif(substr(book_description, 1, {K.INVITATION_DESCRIPTION_CHARS}), ''), {_lit(K.FALLBACK_TEXT)})",
    "BOOK_GENRE_LABEL": f"coalesce(nullif(array_to_string(coalesce(genres, []::VARCHAR[])[1:2], ', '), ''), {_lit(K.FALLBACK_GENRE)})",
}


_FOLLOWUP_TOKENS_SQL = _TOKENS_SQL | {
    "AUTHOR_NAME": "split_part(trim(full_name), ' ', 1)",
    "BOOK_DESCRIPTION": f"coalesce(nullif(substr(book_description, 1, {K.FOLLOWUP_DESCRIPTION_CHARS}), ''), {_lit(K.FALLBACK_TEXT)})",
}


def filled_sql(template: str, tokens: dict = _TOKENS_SQL) -> str:
    parts = [_lit(v) if kind == "lit" else f"coalesce({tokens[v]}, '')" for kind, v in TX.template_parts(template, tokens)]
    return "concat(" + ", ".join(parts) + ")"


def _subject_sql(t: str, default: str) -> str:
    first = f"split_part({t}, chr(10), 1)"
    return f"CASE WHEN starts_with(upper({first}), 'SUBJECT:') THEN {_strip_sql(f'substr({first}, 9)')} ELSE {_lit(default)} END"


def _body_sql(t: str) -> str:
    first = f"split_part({t}, chr(10), 1)"
    rest = f"CASE WHEN instr({t}, chr(10)) > 0 THEN substr({t}, instr({t}, chr(10)) + 1) ELSE '' END"
    return _strip_sql(f"CASE WHEN starts_with(upper({first}), 'SUBJECT:') THEN {rest} ELSE {t} END")


_PHRASES_SQL = "[" + ", ".join(_lit(p) for p in K.BANNED_PHRASES) + "]"
_TONES_SQL = "[" + ", ".join(_lit(t) for t in K.TONES) + "]"
_HEXPOS = "(instr('0123456789abcdef', substr(md5(concat(cast(id as varchar), 'tone')), {i}, 1)) - 1)"


def render_sql(src: str, template: str, default_subject: str = K.DEFAULT_INVITATION_SUBJECT, tokens: dict = _TOKENS_SQL) -> str:
    """DuckDB form of ``operators.drafts.render_drafts`` over relation ``src``."""
    html = "array_to_string(list_transform(list_filter(string_split(body_plain, chr(10) || chr(10)), lambda p: p <> ''), lambda p: concat('<p>', p, '</p>')), '')"
    pixel = (f"concat('<img src=\"{TRACKING_BASE}/track/open?author_id=', cast(id as varchar), '&run_date={RUN_DATE}', "
             "CASE WHEN channel = 'gmail' THEN '&source=gmail' ELSE '' END, '\" width=\"1\" height=\"1\" style=\"display:none;\" />')")
    html_px = f"CASE WHEN contains({html}, '</body>') THEN replace({html}, '</body>', concat({pixel}, '</body>')) ELSE concat({html}, {pixel}) END"
    return f"""
SELECT id AS author_id, channel, subject, body_plain, {html_px} AS body_html,
  array_to_string(list_filter({_PHRASES_SQL}, lambda p: contains(lower(concat_ws(chr(10), subject, body_plain)), lower(p))), '|') AS banned_phrases,
  array_to_string(regexp_extract_all(body_plain, '\\{{\\{{([A-Z_]+)\\}}\\}}', 1), '|') AS unfilled_tokens,
  CAST(len(regexp_extract_all(body_plain, '[^ \\t\\n\\r\\f]+')) AS INTEGER) AS word_count,
  CASE WHEN substr(md5(cast(id as varchar)), 1, 1) < '8' THEN 'A' ELSE 'B' END AS ab_variant,
  {_TONES_SQL}[({_HEXPOS.format(i=1)} * 16 + {_HEXPOS.format(i=2)}) % {len(K.TONES)} + 1] AS tone
FROM (SELECT id, channel, {_subject_sql('t', default_subject)} AS subject, {_body_sql('t')} AS body_plain
      FROM (SELECT id, channel, {_strip_sql(filled_sql(template, tokens))} AS t FROM {src}))"""


def _render(df, template=fx.INVITATION_TEMPLATE, default_subject=K.DEFAULT_INVITATION_SUBJECT):
    return drafts.render_drafts(df, template, RUN_DATE, TRACKING_BASE, default_subject=default_subject)


@query("render_drafts", with_ctes(render_sql("contacts", fx.INVITATION_TEMPLATE), "contacts"))
def q_render_drafts(spark, sf):
    return _render(fx.contacts(spark, sf))


@query("fill_template", with_ctes(f"SELECT id, {filled_sql(fx.INVITATION_TEMPLATE)} AS filled FROM contacts", "contacts"))
def q_fill_template(spark, sf):
    c = fx.contacts(spark, sf)
    return c.select("id", TX.fill_template(fx.INVITATION_TEMPLATE, drafts.default_tokens(c)).alias("filled"))


@query("unfilled_tokens", with_ctes(f"SELECT author_id, unfilled_tokens FROM ({render_sql('contacts', fx.INVITATION_TEMPLATE)})", "contacts"))
def q_unfilled_tokens(spark, sf):
    return _render(fx.contacts(spark, sf)).select("author_id", "unfilled_tokens")


@query("split_draft", with_ctes(f"""
SELECT doc_id, {_subject_sql('t', K.DEFAULT_SMART_FOLLOWUP_SUBJECT)} AS subject, {_body_sql('t')} AS body
FROM (SELECT doc_id, {_strip_sql('text')} AS t FROM dtext)""", "dtext"))
def q_split_draft(spark, sf):
    d = fx.draft_texts(spark, sf)
    return d.select("doc_id", TX.draft_subject(F.col("text"), K.DEFAULT_SMART_FOLLOWUP_SUBJECT).alias("subject"), TX.draft_body(F.col("text")).alias("body"))


@query("word_count", "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS INTEGER) AS words FROM documents")
def q_word_count(spark, sf):
    return fx.read(spark, sf, "documents").select("doc_id", TX.word_count(F.col("text")).alias("words"))


@query("banned_phrases", with_ctes(f"""
SELECT doc_id, array_to_string(m, '|') AS banned_phrases, CAST(len(m) AS INTEGER) AS n_banned
FROM (SELECT doc_id, list_filter({_PHRASES_SQL}, lambda p: contains(lower(coalesce(text, '')), lower(p))) AS m FROM dtext)""", "dtext"))
def q_banned_phrases(spark, sf):
    d = fx.draft_texts(spark, sf)
    return d.select("doc_id", TX.matched_phrases_text(F.col("text")).alias("banned_phrases"),
                    TX.matched_phrase_count(F.col("text")).alias("n_banned"))


@query("ab_assign", with_ctes("SELECT id, CASE WHEN substr(md5(cast(id as varchar)), 1, 1) < '8' THEN 'A' ELSE 'B' END AS variant FROM contacts", "contacts"))
def q_ab_assign(spark, sf):
    return fx.contacts(spark, sf).select("id", TX.ab_variant(F.col("id")).alias("variant"))


@query("tone_assign", with_ctes(f"SELECT id, {_TONES_SQL}[({_HEXPOS.format(i=1)} * 16 + {_HEXPOS.format(i=2)}) % {len(K.TONES)} + 1] AS tone FROM contacts", "contacts"))
def q_tone_assign(spark, sf):
    return fx.contacts(spark, sf).select("id", TX.tone(F.col("id")).alias("tone"))


@query("mask_email", with_ctes("""
SELECT id, email, CASE WHEN email IS NULL OR email = '' THEN 'N/A' ELSE concat(substr(email, 1, 1), '***@', split_part(email, '@', 2)) END AS masked
FROM vf""", "vf"))
def q_mask_email(spark, sf):
    return fx.verify_requests(spark, sf).select("id", "email", EM.mask_email(F.col("email")).alias("masked"))


def _drafts_pair(spark, sf):
    """Main and gmail draft tables as the lookups need them (subject and html size; the html itself is not carried)."""
    c = fx.contacts(spark, sf)
    main = _render(c.filter(F.col("channel") == "main")).select("author_id", "subject", F.length("body_html").cast("bigint").alias("html_chars"))
    gmail = _render(c.filter(F.col("email_status") == "sent"), default_subject="Invitation").select(
        "author_id", "subject", F.length("body_html").cast("bigint").alias("html_chars"))
    return main, gmail


_DRAFT_PAIR_LOCAL = [
    ("dmain", render_sql("(SELECT * FROM contacts WHERE channel = 'main')", fx.INVITATION_TEMPLATE)),
    ("dgmail", render_sql("(SELECT * FROM contacts WHERE email_status = 'sent')", fx.INVITATION_TEMPLATE, "Invitation")),
    ("drafts", """
SELECT author_id, d.subject AS subject, d.body_html AS body_html, CASE WHEN d.p = 0 THEN 'main' ELSE 'gmail' END AS draft_channel
FROM (SELECT author_id, min({'p': p, 'subject': subject, 'body_html': body_html}) AS d FROM (
        SELECT author_id, 0 AS p, subject, body_html FROM dmain UNION ALL SELECT author_id, 1 AS p, subject, body_html FROM dgmail)
      GROUP BY author_id)"""),
]


def _scan_drafts(spark, sf):
    main, gmail = _drafts_pair(spark, sf)
    return scans.scan_drafts(main, gmail)


@query("scan_drafts", with_ctes("SELECT author_id, subject, length(body_html) AS html_chars, draft_channel FROM drafts", "contacts", local=_DRAFT_PAIR_LOCAL))
def q_scan_drafts(spark, sf):
    return _scan_drafts(spark, sf).select("author_id", "subject", "html_chars", "draft_channel")


@query("contact_with_draft", with_ctes("""
SELECT c.id, c.channel, c.full_name, d.subject, d.draft_channel FROM contacts c LEFT JOIN drafts d ON c.id = d.author_id""", "contacts", local=_DRAFT_PAIR_LOCAL))
def q_contact_with_draft(spark, sf):
    d = _scan_drafts(spark, sf).select("author_id", "subject", "draft_channel")
    return drafts.contact_with_draft(fx.contacts(spark, sf), d).select("id", "channel", "full_name", "subject", "draft_channel")


@query("approval_send_list", with_ctes("""
SELECT c.id, c.channel, c.full_name, c.email, d.subject, length(d.body_html) AS html_chars
FROM contacts c JOIN drafts d ON c.id = d.author_id
WHERE c.approval_status = 'approved' AND c.email_status IN ('pending', 'pending_approval')""", "contacts", local=_DRAFT_PAIR_LOCAL))
def q_approval_send_list(spark, sf):
    r = drafts.approval_send_list(fx.contacts(spark, sf), _scan_drafts(spark, sf))
    return r.select("id", "channel", "full_name", "email", "subject", "html_chars")


@query("followup_context", with_ctes(f"""
SELECT e.id, e.channel, e.full_name, e.email, coalesce(t.n_messages, 0) AS n_messages, coalesce(t.n_chunks, 0) AS n_chunks,
  CASE WHEN t.author_id IS NOT NULL THEN 'smart' ELSE 'template' END AS mode,
  CASE WHEN t.author_id IS NOT NULL THEN '{K.DEFAULT_SMART_FOLLOWUP_SUBJECT}' ELSE concat('Re: ', coalesce(d.subject, '{K.DEFAULT_ORIGINAL_SUBJECT}')) END AS followup_subject
FROM (SELECT * FROM contacts WHERE email_status = 'sent' AND open_detected AND NOT replied AND NOT followup_sent
        AND contacted_at <= {SQL_C_ASOF} - INTERVAL {K.FOLLOW_UP_DELAY_DAYS} DAY) e
LEFT JOIN (SELECT author_id, count(*) AS n_messages, count(DISTINCT seq // 64) AS n_chunks FROM msgs GROUP BY author_id) t ON e.id = t.author_id
LEFT JOIN drafts d ON e.id = d.author_id""", "contacts", "msgs", local=_DRAFT_PAIR_LOCAL))
def q_followup_context(spark, sf):
    el = engagement.followup_eligible(fx.contacts(spark, sf), C_ASOF)
    d = _scan_drafts(spark, sf).select("author_id", F.col("subject").alias("invitation_subject"))
    return drafts.followup_context(el, fx.messages(spark, sf), d)


_K3_LOCAL = [
    ("existing", f"""SELECT author_id, subject AS invitation_subject, body_html AS invitation_body_html, body_plain AS invitation_body_plain,
  '{{}}' AS tokens_used, c.contacted_at AS saved_at, NULL::VARCHAR AS followup_subject, NULL::VARCHAR AS followup_body_html,
  NULL::VARCHAR AS followup_body_plain
FROM ({render_sql("(SELECT * FROM contacts WHERE channel = 'main')", fx.INVITATION_TEMPLATE)}) r JOIN contacts c ON r.author_id = c.id"""),
    ("inv", f"SELECT author_id, subject, body_html, body_plain FROM ({render_sql(chr(40) + 'SELECT * FROM contacts WHERE email_status = ' + chr(39) + 'sent' + chr(39) + chr(41), fx.INVITATION_TEMPLATE)})"),
    ("fu", f"""SELECT r.author_id, concat('Re: ', coalesce(i.subject, '{K.DEFAULT_ORIGINAL_SUBJECT}')) AS subject, r.body_html, r.body_plain FROM ({render_sql(f'''(SELECT * FROM contacts WHERE email_status = 'sent' AND open_detected
  AND NOT replied AND NOT followup_sent AND contacted_at <= {SQL_C_ASOF} - INTERVAL {K.FOLLOW_UP_DELAY_DAYS} DAY)''', fx.FOLLOWUP_TEMPLATE, tokens=_FOLLOWUP_TOKENS_SQL)}) r LEFT JOIN inv i ON r.author_id = i.author_id"""),
    ("step1", f"""
SELECT coalesce(e.author_id, i.author_id) AS author_id,
  CASE WHEN i.author_id IS NOT NULL THEN i.subject ELSE e.invitation_subject END AS invitation_subject,
  CASE WHEN i.author_id IS NOT NULL THEN i.body_html ELSE e.invitation_body_html END AS invitation_body_html,
  CASE WHEN i.author_id IS NOT NULL THEN '{{}}' ELSE e.tokens_used END AS tokens_used,
  CASE WHEN i.author_id IS NOT NULL THEN {SQL_C_ASOF} ELSE e.saved_at END AS saved_at,
  e.followup_subject, e.followup_body_plain
FROM existing e FULL OUTER JOIN inv i ON e.author_id = i.author_id"""),
]


def _draft_rows(df, ts, prefix="invitation"):
    return df.select("author_id", F.col("subject").alias(f"{prefix}_subject"), F.col("body_html").alias(f"{prefix}_body_html"),
                     F.col("body_plain").alias(f"{prefix}_body_plain"), F.lit("{}").alias("tokens_used"), ts.alias("saved_at"))


@query("upsert_drafts", with_ctes("""
SELECT s.author_id, s.invitation_subject, length(s.invitation_body_html) AS inv_html_chars,
  CASE WHEN f.author_id IS NOT NULL THEN f.subject ELSE s.followup_subject END AS followup_subject,
  length(CASE WHEN f.author_id IS NOT NULL THEN f.body_plain ELSE s.followup_body_plain END) AS fu_plain_chars, s.saved_at
FROM step1 s LEFT JOIN fu f ON s.author_id = f.author_id""", "contacts", local=_K3_LOCAL))
def q_upsert_drafts(spark, sf):
    c = fx.contacts(spark, sf)
    asof = F.lit(C_ASOF).cast("timestamp_ntz")
    main = _draft_rows(_render(c.filter(F.col("channel") == "main")), F.lit(None).cast("timestamp_ntz"))
    main = drafts.body_sizes(main, drafts.DRAFT_INVITATION_COLS, versioned=False).drop("saved_at")
    existing = main.join(c.select(F.col("id").alias("author_id"), F.col("contacted_at").alias("saved_at")), "author_id").select(
        "*", *[F.lit(None).cast("int" if "_body_" in x else "string").alias(x) for x in drafts.DRAFT_FOLLOWUP_COLS])
    inv = _draft_rows(_render(c.filter(F.col("email_status") == "sent")), asof)
    el = engagement.followup_eligible(c, C_ASOF)
    fu = drafts.render_followups(el, inv.select("author_id", "invitation_subject"), fx.FOLLOWUP_TEMPLATE, RUN_DATE, TRACKING_BASE)
    fu = _draft_rows(fu, asof, prefix="followup").drop("tokens_used")
    out = drafts.upsert_drafts(existing, drafts.body_sizes(inv, drafts.DRAFT_INVITATION_COLS),
                               drafts.body_sizes(fu, [*drafts.DRAFT_FOLLOWUP_COLS, "saved_at"]))
    return out.select("author_id", "invitation_subject", F.col("invitation_body_html").cast("bigint").alias("inv_html_chars"), "followup_subject",
                      F.col("followup_body_plain").cast("bigint").alias("fu_plain_chars"), "saved_at")


# ---------------------------------------------------------------- exports

def _iso_sql(x: str) -> str:
    return (f"coalesce(CASE WHEN strftime({x}, '%f') = '000000' THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END, '')")


def _pybool_sql(x: str) -> str:
    return f"coalesce(CASE WHEN {x} THEN 'True' ELSE 'False' END, '')"


def export_sql(channel: str) -> str:
    title2 = "'' AS book_title_2," if channel == "gmail" else ""
    tag = ", 'gmail' AS channel" if channel == "gmail" else ""
    return f"""
SELECT cast(c.id as varchar) AS author_id, coalesce(c.full_name, '') AS full_name, coalesce(c.email, '') AS email, '' AS email_source,
  {_pybool_sql('v.is_deliverable')} AS email_verified, coalesce(v.smtp_result, '') AS verification_result,
  array_to_string(coalesce(c.book_titles, []::VARCHAR[])[1:2], ', ') AS book_titles,
  coalesce(substr(c.book_description, 1, {K.EXPORT_DESCRIPTION_CHARS}), '') AS book_description, {title2}
  array_to_string(coalesce(c.genres, []::VARCHAR[]), ', ') AS genres, '' AS website_url, '' AS social_url,
  coalesce(c.source_platform, '') AS source_platform, {_iso_sql('c.contacted_at')} AS date_collected, coalesce(c.email_status, '') AS email_status,
  '' AS date_email_sent, '' AS email_subject_used, '{RUN_DATE}' AS run_date, {_pybool_sql('c.open_detected')} AS open_detected,
  {_iso_sql('c.open_detected_at')} AS open_detected_at, {_pybool_sql('c.replied')} AS reply_detected,
  {_pybool_sql('c.followup_sent')} AS followup_sent, {_iso_sql('c.followup_sent_at')} AS followup_sent_at, '' AS followup_status{tag}
FROM (SELECT * FROM contacts WHERE channel = '{channel}') c LEFT JOIN vout v ON c.id = v.id"""


_EXPORT_LOCAL = [("verdict", VERDICT_SQL), ("vout", VERIFY_OUT_SQL)]


def _export(spark, sf, channel):
    """The channel's contacts with their verdict on the row (no join back by id)."""
    c = fx.probed_contacts(spark, sf).filter(F.col("channel") == channel)
    v = verify.verify_emails(c, fx.mx_records(spark, sf), email_col="request_email")
    return export.export_contacts(v.withColumnsRenamed({"is_deliverable": "email_verified", "smtp_result": "verification_result"}), RUN_DATE, channel)


@query("export_contacts_main", with_ctes(export_sql("main"), "vf", "mx", local=_EXPORT_LOCAL))
def q_export_contacts_main(spark, sf):
    return _export(spark, sf, "main")


@query("export_contacts_gmail", with_ctes(export_sql("gmail"), "vf", "mx", local=_EXPORT_LOCAL))
def q_export_contacts_gmail(spark, sf):
    return _export(spark, sf, "gmail")


@query("scan_seen_emails", with_ctes("SELECT DISTINCT email FROM exp WHERE email IS NOT NULL AND email <> ''", "vf", "mx",
                                     local=_EXPORT_LOCAL + [("exp", export_sql("main"))]))
def q_scan_seen_emails(spark, sf):
    return scans.scan_seen_emails(_export(spark, sf, "main"))


@query("export_unseen", with_ctes("""
SELECT id, email_key FROM contacts c WHERE NOT EXISTS (SELECT 1 FROM exp WHERE nullif(lower(trim(exp.email)), '') = c.email_key)""",
                                  "vf", "mx", local=_EXPORT_LOCAL + [("exp", export_sql("main"))]))
def q_export_unseen(spark, sf):
    return export.export_unseen(fx.contacts(spark, sf), _export(spark, sf, "main")).select("id", "email_key")


_DELIVERY_STATUS_SQL = """
SELECT author_id, CASE WHEN l.event = 'bounce' THEN 'bounced' ELSE 'dropped' END AS email_status FROM (
  SELECT author_id, max({'ts': ts, 'event_id': event_id, 'event': event}) AS l FROM ev
  WHERE author_id IS NOT NULL AND event IN ('bounce', 'dropped') GROUP BY author_id)"""


@query("export_status_patch", with_ctes(f"""
SELECT {', '.join(f'coalesce(p.{c}, x.{c}) AS {c}' if c in ('email_status', 'followup_status', 'followup_sent_at') else 'x.' + c for c in export.MAIN_EXPORT_COLUMNS)}
FROM exp x LEFT JOIN (
  SELECT cast(coalesce(d.author_id, f.id) as varchar) AS author_id, d.email_status, CASE WHEN f.id IS NOT NULL THEN 'sent' END AS followup_status,
         CASE WHEN f.id IS NOT NULL THEN {_iso_sql(SQL_C_ASOF)} END AS followup_sent_at
  FROM dstat d FULL OUTER JOIN (SELECT id FROM contacts WHERE email_status = 'sent' AND open_detected AND NOT replied AND NOT followup_sent
        AND contacted_at <= {SQL_C_ASOF} - INTERVAL {K.FOLLOW_UP_DELAY_DAYS} DAY) f ON d.author_id = f.id) p ON x.author_id = p.author_id""",
                                        "vf", "mx", "ev", local=_EXPORT_LOCAL + [("exp", export_sql("main")), ("dstat", _DELIVERY_STATUS_SQL)]))
def q_export_status_patch(spark, sf):
    """K8: bounce / dropped statuses from the event feed and follow-up sends patched into the main export."""
    d = engagement.delivery_status(fx.delivery_events(spark, sf)).select(F.col("author_id").cast("string").alias("author_id"), "email_status")
    el = engagement.followup_eligible(fx.contacts(spark, sf), C_ASOF).select(
        F.col("id").cast("string").alias("author_id"), F.lit("sent").alias("followup_status"),
        export.iso(F.lit(C_ASOF).cast("timestamp_ntz")).alias("followup_sent_at"))
    patches = d.join(el, "author_id", "full_outer")
    return export.export_status_patch(_export(spark, sf, "main"), patches)


@query("export_reply_patch", with_ctes(f"""
SELECT {', '.join("CASE WHEN r.k IS NOT NULL OR i.id IS NOT NULL THEN 'True' ELSE x.reply_detected END AS reply_detected" if c == 'reply_detected' else 'x.' + c for c in export.MAIN_EXPORT_COLUMNS)}
FROM exp x
LEFT JOIN (SELECT DISTINCT nullif(lower(trim(sender)), '') AS k FROM inbound) r ON nullif(lower(trim(x.email)), '') = r.k
LEFT JOIN (SELECT DISTINCT cast(author_id as varchar) AS id FROM ev WHERE event = 'reply') i ON x.author_id = i.id""",
                                       "vf", "mx", "ev", "inbound", local=_EXPORT_LOCAL + [("exp", export_sql("main"))]))
def q_export_reply_patch(spark, sf):
    """K9: replies matched by sender address (inbound mail) or by id (reply events)."""
    r = ST.parse_inbound(fx.inbound_replies(spark, sf)).select(EM.email_key(F.col("sender")).alias("email_key"))
    ids = fx.delivery_events(spark, sf).filter(F.col("event") == "reply").select(F.col("author_id").alias("id"))
    return export.export_reply_patch(_export(spark, sf, "main"), r, ids)


@query("export_daily_summary", with_ctes(f"""
SELECT '{RUN_DATE}' AS date, rs.channel, rs.discovered, rs.valid_emails, rs.sent, rs.failed, rs.skipped,
  coalesce(fs.sent, 0) AS followups_sent, coalesce(st.opens, 0) AS opens, coalesce(rep.replies, 0) AS replies, rs.sources, round(cost.c, 6) AS cost,
  CASE WHEN rs.errors = '' THEN '' ELSE array_to_string(string_split(rs.errors, '; ')[1:5], '; ') END AS errors
FROM rsum rs
LEFT JOIN (SELECT channel, count(*) FILTER (WHERE lead_score > 0) AS sent FROM elig GROUP BY channel) fs ON rs.channel = fs.channel
LEFT JOIN (SELECT channel, count(*) FILTER (WHERE CAST(open_detected_at AS DATE) = DATE '{RUN_DATE}') AS opens FROM contacts GROUP BY channel) st
  ON rs.channel = st.channel
LEFT JOIN (SELECT k.channel, count(DISTINCT i.msg_id) AS replies FROM inbound i JOIN contacts k ON nullif(lower(trim(i.sender)), '') = k.email_key
           WHERE CAST(i.ts AS DATE) = DATE '{RUN_DATE}' GROUP BY 1) rep ON rs.channel = rep.channel,
(SELECT (CAST(sum(n_chars) AS BIGINT) * 0.59 + CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))) AS BIGINT) * 0.79) / 1e6 AS c FROM documents) cost""",
                                         "vf", "contacts", "mx", "inbound", local=RUN_LOCAL_SENT + [("rsum", RUN_SUMMARY_SQL), ("elig", f"""
SELECT * FROM contacts WHERE email_status = 'sent' AND open_detected AND NOT replied AND NOT followup_sent
  AND contacted_at <= {SQL_C_ASOF} - INTERVAL {K.FOLLOW_UP_DELAY_DAYS} DAY""")]))
def q_export_daily_summary(spark, sf):
    c = fx.contacts(spark, sf)
    rs = funnel.run_summary(_run(spark, sf))
    el = engagement.followup_eligible(c, C_ASOF)
    fsum = funnel.followup_summary(el, _followup_results(el)).select("channel", F.col("sent").alias("followups_sent"))
    st = metrics.day_activity(c, ST.parse_inbound(fx.inbound_replies(spark, sf)), RUN_DATE)
    cost = metrics.llm_cost(_usage(spark, sf)).select("cost_usd").scalar()
    s = rs.join(fsum, "channel", "left").join(st, "channel", "left").select(
        *rs.columns, *[F.coalesce(x, F.lit(0).cast("bigint")).alias(x) for x in ("followups_sent", "opens", "replies")], cost.alias("cost"))
    return export.export_daily_summary(s, RUN_DATE)


# ---------------------------------------------------------------- keyed writes

_ENG = ["open_detected", "open_detected_at", "replied", "reply_sentiment", "followup_sent", "followup_sent_at", "lead_score"]
_K1_COLS = ["channel", "id", "full_name", "email", "email_key", "contacted_at", "email_status", "approval_status"] + _ENG


def _k1_inputs(spark, sf):
    c = fx.contacts(spark, sf).select(*_K1_COLS)
    before = F.col("contacted_at") < F.lit(CUTOFF).cast("timestamp_ntz")
    existing = dedupe.first_per_email(c.filter(before), ["contacted_at", "id"])
    new_attempts = c.filter(~before).withColumn("seq", F.col("id"))
    text = lambda df: df.withColumn("id", fx.as_uuid(F.col("id")))
    # approvals re-inserted by id with the application's defaults for the engagement columns (applied last)
    approvals = existing.filter(F.col("approval_status") == "pending").select(
        *[F.lit(False).alias(x) if x in ("open_detected", "replied", "followup_sent") else
          F.lit(0).cast("bigint").alias(x) if x == "lead_score" else
          F.lit(None).cast("timestamp_ntz").alias(x) if x.endswith("_at") and x != "contacted_at" else
          F.lit(None).cast("string").alias(x) if x == "reply_sentiment" else
          F.lit("approved").alias(x) if x == "approval_status" else F.col(x)
          for x in existing.columns],
        (F.lit(10 ** 12) + F.col("id")).alias("seq"))
    return text(existing), text(new_attempts.unionByName(approvals))


@query("upsert_contacts", with_ctes(f"""
SELECT {', '.join(f'CASE WHEN s.v > 0 AND o.id IS NOT NULL THEN o.{x} ELSE s.{x} END AS {x}' if x in _ENG else 's.' + x for x in _K1_COLS)}
FROM (SELECT *, max(v) OVER (PARTITION BY id) AS vid, max(v) OVER (PARTITION BY email_key) AS vem FROM allrows) s
LEFT JOIN existing o ON s.id = o.id
WHERE s.v = s.vid AND (s.email_key IS NULL OR s.v = s.vem)""", "contacts", local=[
    ("numbered", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email_key ORDER BY contacted_at, id) AS rn FROM contacts
                    WHERE contacted_at < {SQL_CUTOFF} AND email_key IS NOT NULL) WHERE rn = 1"""),
    ("existing", f"SELECT * REPLACE ({uuid_sql('id')} AS id) FROM numbered"),
    ("allrows", f"""
SELECT {', '.join(_K1_COLS)}, 0 AS v FROM existing
UNION ALL SELECT {', '.join(x if x != 'id' else uuid_sql('id') + ' AS id' for x in _K1_COLS)}, id + 1 AS v FROM contacts WHERE contacted_at >= {SQL_CUTOFF}
UNION ALL SELECT channel, {uuid_sql('id')} AS id, full_name, email, email_key, contacted_at, email_status, 'approved' AS approval_status, false, NULL::TIMESTAMP,
  false, NULL::VARCHAR, false, NULL::TIMESTAMP, CAST(0 AS BIGINT), 1000000000000 + id + 1 AS v FROM numbered WHERE approval_status = 'pending'""")]))
def q_upsert_contacts(spark, sf):
    existing, incoming = _k1_inputs(spark, sf)
    return dedupe.upsert_contacts(existing, incoming).select(*_K1_COLS)


def _feed(spark, sf):
    """The delivery feed as it lands: text ids, events without id, time or author, known by their place."""
    return _ntz(_ntz(ST.parse_delivery_payloads(fx.delivery_payloads(spark, sf))), "arrived_at")


def _logs(spark, sf, until: str | None = None):
    ev = _feed(spark, sf)
    if until:
        ev = ev.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    return ST.stream_logs(ST.route_events(ev))


_LOGS_SQL = """
SELECT ts AS timestamp, CASE WHEN action = 'log_warning' THEN 'WARNING' ELSE 'INFO' END AS level, 'WEBHOOK' AS category,
  CASE WHEN action = 'mark_open_and_score' THEN concat('Email opened by author ', author_id, CASE WHEN source = 'gmail' THEN ' (Gmail)' ELSE '' END)
       WHEN action = 'score' THEN concat('Link clicked by author ', author_id, CASE WHEN source = 'gmail' THEN ' (Gmail)' ELSE '' END)
       ELSE concat('Email ', event, ' for ', coalesce(email, author_id, 'unknown')) END AS message,
  NULL::VARCHAR AS details, concat('event:', event_key) AS log_key
FROM routed"""

_ROUTED_SQL = """
SELECT event_key, event_id, ts, author_id, email, source, event,
  CASE WHEN event = 'open' AND author_id IS NOT NULL THEN 'mark_open_and_score'
       WHEN event = 'click' AND author_id IS NOT NULL THEN 'score'
       WHEN event IN ('bounce', 'dropped') THEN 'log_warning' END AS action,
  CASE WHEN event = 'open' THEN 1 WHEN event = 'click' THEN 5 ELSE 0 END AS points
FROM feed WHERE (event = 'open' AND author_id IS NOT NULL) OR (event = 'click' AND author_id IS NOT NULL) OR event IN ('bounce', 'dropped')"""


@query("append_logs", with_ctes("SELECT timestamp, level, category, message, log_key FROM logs", "feed", local=[("routed", _ROUTED_SQL), ("logs", _LOGS_SQL)]))
def q_append_logs(spark, sf):
    """K4: the log table after appending a full replay onto the logs of the first two weeks (no duplicates)."""
    from ..operators.state import append_new

    existing = _logs(spark, sf, "2024-01-15 00:00:00")
    return existing.unionByName(append_new(existing, _logs(spark, sf), "log_key")).select("timestamp", "level", "category", "message", "log_key")


@query("scan_logs", with_ctes(f"SELECT timestamp, level, category, message, log_key FROM logs ORDER BY timestamp DESC, log_key DESC LIMIT {K.SYSTEM_LOG_SIZE}",
                              "feed", local=[("routed", _ROUTED_SQL), ("logs", _LOGS_SQL)]))
def q_scan_logs(spark, sf):
    return scans.scan_logs(_logs(spark, sf), K.SYSTEM_LOG_SIZE).select("timestamp", "level", "category", "message", "log_key")


@query("append_messages", with_ctes(f"""
SELECT msg_id, author_id, email, direction, subject FROM (
  SELECT msg_id, {uuid_sql('author_id')} AS author_id, NULL::VARCHAR AS email, direction, subject FROM msgs
  UNION ALL
  SELECT DISTINCT concat('in-', i.msg_id) AS msg_id, coalesce(k.main_id, k.gmail_id) AS author_id, i.ek AS email, 'incoming' AS direction,
    CASE WHEN k.email_key IS NULL THEN '{K.REPLY_SUBJECT_WEBHOOK}' ELSE '{K.REPLY_SUBJECT}' END AS subject
  FROM (SELECT *, nullif(lower(trim(sender)), '') AS ek FROM landed) i
  LEFT JOIN (SELECT email_key, min(id) FILTER (WHERE channel = 'main') AS main_id, min(id) FILTER (WHERE channel = 'gmail') AS gmail_id
             FROM tcontacts WHERE email_key IS NOT NULL GROUP BY 1) k ON i.ek = k.email_key)""", "msgs", "landed", "tcontacts"))
def q_append_messages(spark, sf):
    """K5: conversation rows plus inbound replies with their author, appended twice (a replay) and kept once."""
    from ..operators.state import append_new

    existing = fx.messages(spark, sf).select("msg_id", fx.as_uuid(F.col("author_id")).alias("author_id"), F.lit(None).cast("string").alias("email"), "direction", "subject")
    rep = ST.stream_replies(fx.landed_inbound(spark, sf), fx.text_id_contacts(spark, sf)).select(
        F.concat(F.lit("in-"), F.col("msg_id")).alias("msg_id"), "author_id", F.col("email_key").alias("email"), "direction", "subject")
    replayed = rep.withColumn("_twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_twice")
    return existing.unionByName(append_new(existing, replayed, "msg_id"))


# ---------------------------------------------------------------- streams as batch

def _ntz(df, col="ts"):
    return df.withColumn(col, F.col(col).cast("timestamp_ntz"))


@query("apply_engagement", with_ctes("""
SELECT c.id, c.channel, coalesce(st.email_status, c.email_status) AS email_status,
  c.open_detected OR o.open_at IS NOT NULL AS open_detected, greatest(o.open_at, c.open_detected_at) AS open_detected_at,
  c.lead_score + coalesce(s.add, 0) AS lead_score
FROM contacts c
LEFT JOIN (SELECT author_id, source, CAST(sum(CASE WHEN event = 'open' THEN 1 WHEN event = 'click' THEN 5 ELSE 0 END) AS BIGINT) AS add
           FROM ev WHERE author_id IS NOT NULL AND event IN ('open', 'click') GROUP BY 1, 2) s ON c.id = s.author_id AND c.channel = s.source
LEFT JOIN (SELECT author_id, source, max(ts) AS open_at FROM ev WHERE author_id IS NOT NULL AND event = 'open' GROUP BY 1, 2) o
  ON c.id = o.author_id AND c.channel = o.source
LEFT JOIN (SELECT author_id, source, CASE arg_max(event, (ts, event_id)) WHEN 'bounce' THEN 'bounced' ELSE 'dropped' END AS email_status
           FROM ev WHERE author_id IS NOT NULL AND event IN ('bounce', 'dropped') GROUP BY 1, 2) st
  ON c.id = st.author_id AND c.channel = st.source""", "contacts", "ev"))
def q_apply_engagement(spark, sf):
    """The event feed folded into the contacts snapshot: opens, last open, score, bounce / dropped status."""
    c = fx.contacts(spark, sf).select("id", "channel", "email_status", "open_detected", "open_detected_at", "lead_score")
    return engagement.apply_engagement(c, fx.delivery_events(spark, sf), base_scores=False)


@query("stream_delivery_events", with_ctes("SELECT * FROM feed", "feed"))
def q_stream_delivery_events(spark, sf):
    return _feed(spark, sf)


@query("stream_tracking_hits", with_ctes(f"""
SELECT event_id, ts, {uuid_sql('author_id')} AS author_id, source, event,
  CASE WHEN event = 'click' THEN concat('https://books.example.org/b/', event_id % 5) END AS target_url FROM ev WHERE event IN ('open', 'click')""", "ev"))
def q_stream_tracking_hits(spark, sf):
    return ST.parse_tracking_hits(fx.tracking_hits(spark, sf))


@query("stream_inbound_messages", with_ctes("SELECT * FROM landed", "landed"))
def q_stream_inbound_messages(spark, sf):
    return _ntz(ST.parse_inbound(fx.landed_inbound(spark, sf)))


@query("sender_address", with_ctes("""
SELECT msg_id, from_header, nullif(lower(trim(CASE WHEN contains(from_header, '<') THEN regexp_extract(from_header, '<([^>]*)>?', 1) ELSE from_header END)), '') AS sender
FROM rp""", "rp"))
def q_sender_address(spark, sf):
    return fx.inbound_replies(spark, sf).select("msg_id", "from_header", EM.sender_address(F.col("from_header")).alias("sender"))


@query("normalise_sentiment", with_ctes("""
SELECT r.msg_id, r.model_output, i.sentiment FROM rp r JOIN inbound i ON r.msg_id = i.msg_id""", "inbound"))
def q_normalise_sentiment(spark, sf):
    return fx.inbound_replies(spark, sf).select("msg_id", "model_output", TX.normalise_sentiment(F.col("model_output")).alias("sentiment"))


@query("stream_route_events", with_ctes("SELECT * FROM routed", "feed", local=[("routed", _ROUTED_SQL)]))
def q_stream_route_events(spark, sf):
    return ST.route_events(_feed(spark, sf))


@query("stream_lead_scores", with_ctes("""
SELECT author_id, source, CAST(sum(CASE WHEN event = 'open' THEN 1 WHEN event = 'click' THEN 5 ELSE 0 END) AS BIGINT) AS lead_score
FROM ev WHERE author_id IS NOT NULL AND event IN ('open', 'click') GROUP BY author_id, source""", "ev"))
def q_stream_lead_scores(spark, sf):
    return ST.stream_lead_scores(fx.delivery_events(spark, sf))


@query("stream_open_state", with_ctes("""
SELECT author_id, source, true AS open_detected, max(ts) AS open_detected_at FROM ev WHERE author_id IS NOT NULL AND event = 'open'
GROUP BY author_id, source""", "ev"))
def q_stream_open_state(spark, sf):
    return ST.stream_open_state(fx.delivery_events(spark, sf))


@query("stream_replies", with_ctes(f"""
SELECT i.msg_id, i.ts, i.ek AS email_key, coalesce(k.main_id, k.gmail_id) AS author_id, k.main_id IS NOT NULL AS known_main,
  k.gmail_id IS NOT NULL AS known_gmail, i.sentiment, 'incoming' AS direction,
  CASE WHEN k.email_key IS NULL THEN '{K.REPLY_SUBJECT_WEBHOOK}' ELSE '{K.REPLY_SUBJECT}' END AS subject, i.body,
  concat(CASE WHEN k.main_id IS NOT NULL THEN '{K.LOG_REPLY_MAIN}' WHEN k.gmail_id IS NOT NULL THEN '{K.LOG_REPLY_GMAIL}'
              ELSE '{K.LOG_REPLY_WEBHOOK}' END, i.ek, ' (Sentiment: ', i.sentiment, ')') AS log_message
FROM (SELECT *, nullif(lower(trim(sender)), '') AS ek FROM landed) i
LEFT JOIN (SELECT email_key, min(id) FILTER (WHERE channel = 'main') AS main_id, min(id) FILTER (WHERE channel = 'gmail') AS gmail_id
           FROM tcontacts WHERE email_key IS NOT NULL GROUP BY 1) k ON i.ek = k.email_key""", "landed", "tcontacts"))
def q_stream_replies(spark, sf):
    return _ntz(ST.stream_replies(fx.landed_inbound(spark, sf), fx.text_id_contacts(spark, sf)))


@query("reply_lookback", with_ctes(f"""
SELECT msg_id, ts, sender, sentiment FROM landed WHERE CAST(ts AS DATE) >= CAST({SQL_E_ASOF} AS DATE) - INTERVAL {K.REPLY_LOOKBACK_DAYS} DAY""", "landed"))
def q_reply_lookback(spark, sf):
    return ST.reply_lookback(_ntz(ST.parse_inbound(fx.landed_inbound(spark, sf))), E_ASOF).select("msg_id", "ts", "sender", "sentiment")


@query("stream_event_dedup", with_ctes("SELECT * FROM feed", "feed"))
def q_stream_event_dedup(spark, sf):
    """The feed with every click delivered twice; the de-duplicated feed equals the original, events without an id or a time
    included."""
    ev = _feed(spark, sf)
    replayed = ev.unionByName(ev.filter(F.col("event") == "click"))
    return ST.stream_event_dedup(replayed)


@query("feed_health", with_ctes("""
SELECT CAST(arrived_at AS DATE) AS day, event, count(*) AS events, count(*) FILTER (ts < arrived_at - INTERVAL 1 DAY) AS late,
  count(*) FILTER (event_id IS NULL) AS without_id, count(*) FILTER (author_id IS NULL) AS without_author FROM feed GROUP BY 1, 2""", "feed"))
def q_feed_health(spark, sf):
    """Late events and events without id or author, counted per arrival day and type."""
    return ST.feed_health(_feed(spark, sf))


@query("stream_daily_counts", with_ctes("SELECT CAST(ts AS DATE) AS day, event, count(*) AS events FROM ev GROUP BY 1, 2", "ev"))
def q_stream_daily_counts(spark, sf):
    return ST.stream_daily_counts(ST.as_event_time(fx.delivery_events(spark, sf)))


@query("stream_logs", with_ctes("SELECT * FROM logs", "feed", local=[("routed", _ROUTED_SQL), ("logs", _LOGS_SQL)]))
def q_stream_logs(spark, sf):
    return _logs(spark, sf)
