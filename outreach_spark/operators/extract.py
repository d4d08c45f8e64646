"""Text extraction over documents, pages and search hits.

All rules are regular-expression and higher-order-function Column expressions over whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import emails as EM
from ..functions import text as TX
from ..functions.markup import links
from ..sources.scans import url_key


def blacklist_filter(hits: DataFrame) -> DataFrame:
    """Drop hits whose url, snippet or title contains a blacklist term."""
    return hits.filter(~TX.is_blacklisted(F.col("url"), F.col("snippet"), F.col("title")))


def document_emails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """P3 + P6: every match of the email pattern with its position and the personal-address flag."""
    m = docs.select(id_col, F.posexplode(EM.extract_emails(F.col(text_col))).alias("pos", "email"))
    return m.withColumn("is_personal", EM.is_personal_email(F.col("email")))


def context_emails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First acceptable email of each text (rows without one are dropped)."""
    return docs.select(id_col, EM.context_email(F.col(text_col)).alias("email")).filter(F.col("email").isNotNull())


def page_emails(pages: DataFrame) -> DataFrame:
    """Per page the first acceptable mailto target and the resolved page email."""
    return pages.select(
        "page_id", "url", EM.page_mailto(F.col("html")).alias("mailto_email"), EM.page_email(F.col("html")).alias("page_email"))


def _origin(url):
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def absolute_url(href, page_url):
    """Resolve a link against its page: absolute kept, '/x' against the origin, 'x' against the directory."""
    base_dir = F.regexp_extract(page_url, r"^(https?://[^?#]*/)", 1)
    return (
        F.when(href.rlike(r"^https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page_url, r"^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(_origin(page_url), href))
        .otherwise(F.concat(F.when(base_dir == "", F.concat(_origin(page_url), F.lit("/"))).otherwise(base_dir), href))
    )


def _contact_link(html):
    """The page's contact / about link by selector order (link text, then href), then position, or null:
    a struct (selector_rank, pos, href, text), found within the row. A link that leads nowhere is none."""

    def ranked(a, i):
        low_text, low_href = F.lower(a["text"]), F.lower(a["href"])
        rank = F.lit(None).cast("int")
        selectors = [(low_text, t.lower()) for t in K.CONTACT_LINK_TEXTS] + [(low_href, h) for h in K.CONTACT_LINK_HREFS]
        for n, (col, needle) in reversed(list(enumerate(selectors, start=1))):
            rank = F.when(F.contains(col, F.lit(needle)), F.lit(n)).otherwise(rank)
        leads = (a["href"] != "") & ~low_href.startswith("mailto:")
        return F.struct(F.when(leads, rank).alias("selector_rank"), i.alias("pos"), a["href"].alias("href"), a["text"].alias("text"))

    return F.array_min(F.filter(F.transform(links(html), ranked), lambda x: x["selector_rank"].isNotNull()))


def contact_subpage_links(pages: DataFrame) -> DataFrame:
    """Pages with a contact / about link: the link, its selector and the address it leads to."""
    b = pages.select("page_id", "url", _contact_link(F.col("html")).alias("b")).filter(F.col("b").isNotNull())
    return b.select("page_id", "url", F.col("b.selector_rank").alias("selector_rank"), F.col("b.text").alias("link_text"),
                    F.col("b.href").alias("href"), absolute_url(F.col("b.href"), F.col("url")).alias("subpage_url"))


def page_facts(pages: DataFrame) -> DataFrame:
    """Per url key what resolving needs (``_k``, ``email``, ``_sk``), in one pass over the page texts: the html
    doesn't leave the scan. Of pages with one key (http and https copies) the smallest id counts."""
    link = _contact_link(F.col("html"))
    facts = pages.select(url_key(F.col("url")).alias("_k"), "page_id", "url", EM.page_email(F.col("html")).alias("email"), link.alias("b"))
    facts = facts.select("_k", "page_id", "email", url_key(absolute_url(F.col("b.href"), F.col("url"))).alias("_sk"))
    one = facts.groupBy("_k").agg(F.min(F.struct("page_id", "email", "_sk")).alias("f"))
    return one.select("_k", "f.email", "f._sk")


def resolve_email(stubs: DataFrame, pages: DataFrame) -> DataFrame:
    """Context email -> home page email -> subpage email -> not_found, with provenance; one row per stub."""
    from .dedupe import spread_key

    facts = page_facts(pages)
    home = facts.select("_k", F.col("email").alias("home_email"), "_sk")
    sub = facts.select(F.col("_k").alias("_s"), F.col("email").alias("subpage_email"))
    row = F.xxhash64(*stubs.columns)
    s = stubs.withColumn("context_email", EM.context_email(F.col("description"))).withColumn("_k", spread_key(url_key(F.col("url")), row))
    # most rows have no subpage to look up: they are dealt over all tasks under keys that match nothing
    j = s.join(home, "_k", "left").withColumn("_s", spread_key(F.when(F.col("home_email").isNull(), F.col("_sk")), row)).join(sub, "_s", "left")
    email = F.coalesce("context_email", "home_email", "subpage_email")
    source = (F.when(F.col("context_email").isNotNull(), "context").when(F.col("home_email").isNotNull(), "website_crawl_home")
              .when(F.col("subpage_email").isNotNull(), "website_crawl_subpage").otherwise("not_found"))
    return j.select(*stubs.columns, email.alias("email"), source.alias("email_source"),
                    F.when(F.col("url").isNotNull() & F.col("context_email").isNull(), F.col("url")).alias("website_url"))
