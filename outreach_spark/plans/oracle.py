"""DuckDB SQL for the adapters, used as CTEs in the oracle queries.

Each CTE states the same relation as the DataFrame adapter in ``sources/fixtures.py``.
``with_ctes(body, *names)`` prefixes a query with the CTEs it needs (dependencies first).
"""

from __future__ import annotations

from .. import constants as K

CONTACTS_AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
RUN_CUTOFF = "TIMESTAMP '1998-01-01 00:00:00'"

_EMAIL = "concat(lower(replace(c_name,'#','.')),'@mail',cast(o_custkey % 10 as varchar),'.example.com')"

CTES: dict[str, tuple[list[str], str]] = {
    "contacts": ([], f"""
SELECT CASE WHEN o_orderkey % 7 < 2 THEN 'gmail' ELSE 'main' END AS channel,
  o_orderkey AS id, c_name AS full_name, {_EMAIL} AS email, nullif(lower(trim({_EMAIL})), '') AS email_key,
  c_mktsegment AS source_platform, o_orderdate AS contacted_at,
  CASE WHEN o_orderstatus='F' THEN 'sent' WHEN o_orderstatus='O' THEN 'pending'
       WHEN o_orderkey % 3=0 THEN 'bounced' WHEN o_orderkey % 3=1 THEN 'failed' ELSE 'dropped' END AS email_status,
  CASE WHEN o_orderkey % 13 = 0 THEN []::VARCHAR[]
       ELSE [concat(c_mktsegment,' stories ',cast(o_orderkey % 100 as varchar)), concat('Volume ',cast(o_custkey % 7 as varchar))] END AS book_titles,
  repeat(concat(c_name,' writes about ',lower(c_mktsegment),' stories; priority ',o_orderpriority,'. '), 4) AS book_description,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL
       ELSE from_json(concat('["',o_orderpriority,'", "',c_mktsegment,'"]'), '["VARCHAR"]') END AS genres,
  o_orderkey % 2 = 1 AS open_detected,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderdate + INTERVAL 1 DAY END AS open_detected_at,
  o_orderkey % 6 = 1 AS replied,
  CASE WHEN o_orderkey % 6 <> 1 THEN NULL WHEN o_orderpriority='1-URGENT' THEN 'interested'
       WHEN o_orderpriority='2-HIGH' THEN 'asking_price' WHEN o_orderpriority='3-MEDIUM' THEN 'other'
       WHEN o_orderpriority='5-LOW' THEN 'not_interested' ELSE 'wrong_person' END AS reply_sentiment,
  o_orderkey % 9 = 1 AS followup_sent,
  CASE WHEN o_orderkey % 9 = 1 THEN o_orderdate + INTERVAL 5 DAY END AS followup_sent_at,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL
       WHEN substr(md5(cast(o_orderkey as varchar)),1,1) < '8' THEN 'A' ELSE 'B' END AS ab_variant,
  o_orderkey % 5 AS lead_score,
  CASE WHEN o_orderkey % 20 = 0 THEN 'pending' ELSE 'approved' END AS approval_status
FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "ev": ([], """
SELECT event_id, ts, user_id AS author_id,
  CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'click' WHEN 'error' THEN 'bounce'
                  WHEN 'purchase' THEN 'reply' ELSE event_type END AS event,
  CASE WHEN user_id % 7 < 2 THEN 'gmail' ELSE 'main' END AS source
FROM events"""),
    "rp": (["contacts"], """
SELECT cast(e.event_id as varchar) AS msg_id, e.ts,
  concat('"', c.full_name, '" <', upper(c.email), '>') AS from_header, e.props AS body,
  CASE e.event_id % 6 WHEN 0 THEN 'Interested.' WHEN 1 THEN 'NOT_INTERESTED' WHEN 2 THEN ' asking_price '
    WHEN 3 THEN 'category: wrong_person' WHEN 4 THEN 'maybe' ELSE NULL END AS model_output
FROM events e JOIN contacts c ON e.user_id = c.id WHERE e.event_type = 'purchase'"""),
    "inbound": (["rp"], """
SELECT msg_id, ts,
  nullif(lower(trim(CASE WHEN contains(from_header, '<') THEN regexp_extract(from_header, '<([^>]*)>?', 1) ELSE from_header END)), '') AS sender,
  body,
  CASE WHEN model_output IS NULL THEN 'unknown'
       WHEN contains(lower(trim(model_output)), 'not_interested') THEN 'not_interested'
       WHEN contains(lower(trim(model_output)), 'interested') THEN 'interested'
       WHEN contains(lower(trim(model_output)), 'asking_price') THEN 'asking_price'
       WHEN contains(lower(trim(model_output)), 'wrong_person') THEN 'wrong_person'
       ELSE 'other' END AS sentiment
FROM rp"""),
    "mx": ([], """
SELECT concat('mail', cast(s_suppkey % 10 as varchar), '.example.com') AS domain,
  cast(s_nationkey as bigint) AS preference, concat(lower(replace(s_name,'#','.')),'.') AS exchange
FROM supplier WHERE s_suppkey % 10 <> 3"""),
    "vf": (["contacts"], """
SELECT id, channel, full_name, contacted_at,
  CASE WHEN email LIKE 'customer.00000000%' THEN concat('info@mail', cast(id % 10 as varchar), '.example.com')
       WHEN id % 50 = 0 THEN replace(email, '@', '.at.') ELSE email END AS email,
  cast(CASE id % 5 WHEN 0 THEN 550 WHEN 1 THEN 450 WHEN 2 THEN NULL ELSE 250 END as integer) AS probe_code
FROM contacts"""),
    "msgs": ([], """
SELECT concat(cast(conv_id as varchar), '-', cast(turn as varchar)) AS msg_id, conv_id AS author_id,
  CASE WHEN role = 'user' THEN 'incoming' ELSE 'outgoing' END AS direction,
  CASE WHEN turn = 0 THEN 'Invitation' ELSE 'Re: Invitation' END AS subject, text AS body,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(cast(turn as integer)) AS timestamp, turn AS seq
FROM conversations WHERE role <> 'system'"""),
    "hits": ([], """
SELECT concat('authors ', regexp_extract(html, '<html lang="([a-z]+)"', 1), ' ', regexp_extract(url, '\\.(com|net|org)\\b', 1)) AS query,
  page_id AS position, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_replace(url, '^http://', '') AS url, array_to_string(list_transform(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), ' ') AS snippet,
  CASE WHEN starts_with(url, 'https://') THEN 'primary' ELSE 'secondary' END AS engine
FROM pages"""),
}


_LINKS = {
    1: "concat('<a href=\"mailto:writer', page_id, '@books.example?subject=Hi\">write</a>')",
    2: "concat('<A HREF=''mailto:Info@books.example''>info</A> <A class=\"m\" HREF=\"mailto:Jane', page_id, '@books.example\">Jane</A>')",
    3: "concat('<a class=\"x\" href=\"/contact/', page_id, '\"><span>Contact</span> us</a>')",
    4: "concat('<a href=''about-', page_id, '.html''>Who we are</a>')",
    5: "concat('<A HREF=\"https://other.example/c', page_id, '\">Get in <b>touch</b></A>')",
    6: "concat('<a class=m href=&#109;ailto:sam', page_id, '&#64;books.example>sam</a> <a title=\"a > b\" href=/reach?id=', page_id, '&amp;of=us>Reach', chr(10), 'us</a>')",
}
_BLACKLIST = "[" + ", ".join(f"'{t}'" for t in K.BLACKLIST_TERMS) + "]"
_PHRASES = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in K.BANNED_PHRASES) + "]"

CTES["pg"] = ([], f"""
SELECT page_id, url, concat(html, CASE page_id % 7 {' '.join(f'WHEN {k} THEN {v}' for k, v in _LINKS.items())} ELSE '' END) AS html FROM pages
UNION ALL SELECT page_id + 1000000000, concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/contact/', page_id),
  concat('<p>mail author', page_id, '@pen.example</p>') FROM pages WHERE page_id % 7 = 3
UNION ALL SELECT page_id + 2000000000, regexp_replace(url, '^https', 'http'), html FROM pages WHERE page_id % 20 = 0 AND starts_with(url, 'https://')""")
CTES["nhits"] = (["hits"], f"""
SELECT query, position, CASE WHEN position % 9 = 2 THEN concat(title, ' ', upper(term)) ELSE title END AS title,
  CASE WHEN position % 9 = 1 THEN concat(url, '/', term) ELSE url END AS url,
  CASE WHEN position % 9 = 3 THEN concat(snippet, ' ', term) ELSE snippet END AS snippet, engine
FROM (SELECT *, {_BLACKLIST}[(position // 9) % {len(K.BLACKLIST_TERMS)} + 1] AS term FROM hits)""")
CTES["dtext"] = ([], f"""
SELECT doc_id, concat(CASE WHEN doc_id % 6 = 0 THEN concat('SUBJECT: About ', doc_id, chr(10) || chr(10))
                           WHEN doc_id % 6 = 3 THEN concat('subject:About ', doc_id, chr(10) || chr(10)) ELSE '' END,
  text, CASE WHEN doc_id % 5 = 1 THEN concat(chr(10) || chr(10), upper({_PHRASES}[doc_id % {len(K.BANNED_PHRASES)} + 1])) ELSE '' END) AS text
FROM documents""")
CTES["lmsgs"] = (["msgs"], """
SELECT msg_id, author_id % 3 AS author_id, direction, subject, body, timestamp, (author_id // 3) * 16 + seq AS seq FROM msgs""")


def uuid_sql(number: str) -> str:
    """The id in the form of a uuid that ``fixtures.as_uuid`` makes of a number."""
    h = f"md5(cast({number} as varchar))"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"


_ARRIVED = "TIMESTAMP '2024-02-01 00:00:00' + to_minutes(cast({} as integer))"
CTES["feed"] = (["ev"], f"""
SELECT coalesce('id|' || event_id, concat('at|post-', post_id, '|0|', pos, '|')) AS event_key, event_id, coalesce(ts, arrived_at) AS ts, arrived_at,
  author_id, email, event, source
FROM (SELECT event_id // 8 AS post_id, row_number() OVER (PARTITION BY event_id // 8 ORDER BY event_id) - 1 AS pos,
        CASE WHEN event_id % 3 <> 0 THEN {uuid_sql('event_id')} END AS event_id, CASE WHEN event_id % 6 <> 0 THEN ts END AS ts,
        {_ARRIVED.format('event_id // 8')} AS arrived_at, CASE WHEN event_id % 11 <> 0 THEN {uuid_sql('author_id')} END AS author_id,
        CASE WHEN event = 'bounce' AND event_id % 2 = 0 THEN concat('reader', author_id, '@mail.example') END AS email, event, source FROM ev)""")
CTES["tcontacts"] = (["contacts"], f"SELECT * REPLACE ({uuid_sql('id')} AS id) FROM contacts")
CTES["landed"] = (["inbound"], f"""
SELECT CASE WHEN n % 4 <> 0 THEN concat(n, '@mail.example') ELSE concat('at|mail-', n % 100, '|', n, '|') END AS msg_id,
  CASE WHEN n % 4 <> 0 THEN ts ELSE {_ARRIVED.format('n % 100')} END AS ts, sender, body, sentiment
FROM (SELECT *, cast(msg_id AS bigint) AS n FROM inbound) WHERE sender IS NOT NULL""")


def with_ctes(body: str, *names: str, local: list[tuple[str, str]] | None = None) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in (local or [])]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
