"""Adapters from the landed tables to the funnel's relations.

Each adapter is plain DataFrame code over the Parquet tables; Catalyst prunes the columns
and pushes the filters into the scans. The same relations are written as SQL in
``plans/oracle.py`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.emails import email_key
from ..functions.text import ab_variant as _ab
from .scans import parse_genres

# as-of instants for the fixtures (every time rule takes "now" as a parameter)
CONTACTS_AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
# contacts before this instant are the "already contacted" table for a run's candidates
RUN_CUTOFF = "1998-01-01 00:00:00"


# declared schemas of the landed tables: reads skip footer-based schema inference
LANDED_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.read.schema(LANDED_SCHEMAS[name]) if name in LANDED_SCHEMAS else spark.read
    return reader.parquet(path)


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def as_uuid(number):
    """The id that the application would have given: text in the form of a uuid."""
    h = F.md5(number.cast("string"))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contact attempt: orders joined to customer (the driver's shapes for the funnel table)."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    day = F.expr("INTERVAL 1 DAY")
    raw_genres = F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('", "'), F.col("c_mktsegment"), F.lit('"]'))
    )
    email = F.concat(
        F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@mail"),
        (F.col("o_custkey") % 10).cast("string"), F.lit(".example.com"),
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", "sent")
        .when(F.col("o_orderstatus") == "O", "pending")
        .when(k % 3 == 0, "bounced")
        .when(k % 3 == 1, "failed")
        .otherwise("dropped")
    )
    sentiment = (
        F.when(k % 6 != 1, F.lit(None).cast("string"))
        .when(F.col("o_orderpriority") == "1-URGENT", "interested")
        .when(F.col("o_orderpriority") == "2-HIGH", "asking_price")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "other")
        .when(F.col("o_orderpriority") == "5-LOW", "not_interested")
        .otherwise("wrong_person")
    )
    titles = F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(
        F.array(
            F.concat(F.col("c_mktsegment"), F.lit(" stories "), (k % 100).cast("string")),
            F.concat(F.lit("Volume "), (F.col("o_custkey") % 7).cast("string")),
        )
    )
    description = F.repeat(
        F.concat(F.col("c_name"), F.lit(" writes about "), F.lower(F.col("c_mktsegment")),
                 F.lit(" stories; priority "), F.col("o_orderpriority"), F.lit(". ")),
        4,
    )
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.when(k % 7 < 2, "gmail").otherwise("main").alias("channel"),
            k.alias("id"),
            F.col("c_name").alias("full_name"),
            email.alias("email"),
            email_key(email).alias("email_key"),
            F.col("c_mktsegment").alias("source_platform"),
            F.col("o_orderdate").alias("contacted_at"),
            status.alias("email_status"),
            titles.alias("book_titles"),
            description.alias("book_description"),
            parse_genres(raw_genres).alias("genres"),
            (k % 2 == 1).alias("open_detected"),
            F.when(k % 2 == 1, F.col("o_orderdate") + day).alias("open_detected_at"),
            (k % 6 == 1).alias("replied"),
            sentiment.alias("reply_sentiment"),
            (k % 9 == 1).alias("followup_sent"),
            F.when(k % 9 == 1, F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("followup_sent_at"),
            F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(_ab(k)).alias("ab_variant"),
            (k % 5).alias("lead_score"),
            F.when(k % 20 == 0, "pending").otherwise("approved").alias("approval_status"),
        )
    )


def delivery_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery / tracking events: view -> open, click, error -> bounce, purchase -> reply; signup is not a delivery event."""
    e = read(spark, sf_dir, "events")
    et = F.col("event_type")
    event = (
        F.when(et == "view", "open").when(et == "click", "click").when(et == "error", "bounce")
        .when(et == "purchase", "reply").otherwise(et)
    )
    return e.select(
        "event_id", "ts", F.col("user_id").alias("author_id"), event.alias("event"),
        F.when(F.col("user_id") % 7 < 2, "gmail").otherwise("main").alias("source"),
    )


def inbound_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbound replies: purchase events of a contact, with a From header and the model's raw label text."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    c = contacts(spark, sf_dir).select("id", "full_name", "email")
    m = F.col("event_id") % 6
    output = (
        F.when(m == 0, "Interested.").when(m == 1, "NOT_INTERESTED").when(m == 2, " asking_price ")
        .when(m == 3, "category: wrong_person").when(m == 4, "maybe").otherwise(F.lit(None).cast("string"))
    )
    return e.join(c, e.user_id == c.id).select(
        F.col("event_id").cast("string").alias("msg_id"),
        "ts",
        F.concat(F.lit('"'), F.col("full_name"), F.lit('" <'), F.upper(F.col("email")), F.lit(">")).alias("from_header"),
        F.col("props").alias("body"),
        output.alias("model_output"),
    )


def mx_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed MX records per domain (domain mail3 has none; exchanges end in a dot)."""
    s = read(spark, sf_dir, "supplier")
    return s.filter(F.col("s_suppkey") % 10 != 3).select(
        F.concat(F.lit("mail"), (F.col("s_suppkey") % 10).cast("string"), F.lit(".example.com")).alias("domain"),
        F.col("s_nationkey").cast("bigint").alias("preference"),
        F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("."))), F.lit(".")).alias("exchange"),
    )


def _request_email():
    i = F.col("id")
    return (
        F.when(F.col("email").like("customer.00000000%"),
               F.concat(F.lit("info@mail"), (i % 10).cast("string"), F.lit(".example.com")))
        .when(i % 50 == 0, F.replace(F.col("email"), F.lit("@"), F.lit(".at.")))
        .otherwise(F.col("email"))
    )


def _probe_code():
    i = F.col("id")
    return F.when(i % 5 == 0, 550).when(i % 5 == 1, 450).when(i % 5 == 2, F.lit(None)).otherwise(250).cast("int")


def verify_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses to verify with their landed SMTP probe code (NULL = connection blocked)."""
    c = contacts(spark, sf_dir)
    return c.select("id", "channel", "full_name", "contacted_at", _request_email().alias("email"), _probe_code().alias("probe_code"))


def probed_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with the address that is verified and its probe code next to them."""
    return contacts(spark, sf_dir).withColumns({"request_email": _request_email(), "probe_code": _probe_code()})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows: system turns dropped; user = incoming, assistant = outgoing; ordered by turn."""
    cv = read(spark, sf_dir, "conversations").filter(F.col("role") != "system")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return cv.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("msg_id"),
        F.col("conv_id").alias("author_id"),
        F.when(F.col("role") == "user", "incoming").otherwise("outgoing").alias("direction"),
        F.when(F.col("turn") == 0, "Invitation").otherwise("Re: Invitation").alias("subject"),
        F.col("text").alias("body"),
        (base + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))).alias("timestamp"),
        F.col("turn").alias("seq"),
    )


# the links that some pages get, by page_id % 7
LINK_FORMS = {
    1: '<a href="mailto:writer{id}@books.example?subject=Hi">write</a>',
    2: """<A HREF='mailto:Info@books.example'>info</A> <A class="m" HREF="mailto:Jane{id}@books.example">Jane</A>""",
    3: '<a class="x" href="/contact/{id}"><span>Contact</span> us</a>',
    4: "<a href='about-{id}.html'>Who we are</a>",
    5: '<A HREF="https://other.example/c{id}">Get in <b>touch</b></A>',
    6: '<a class=m href=&#109;ailto:sam{id}&#64;books.example>sam</a> <a title="a > b" href=/reach?id={id}&amp;of=us>Reach\nus</a>',
}


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed pages with contact links in the forms that real pages use, the contact page that form 3
    leads to, and an http copy of every 20th page (same address but for the scheme)."""
    p = read(spark, sf_dir, "pages")
    i = F.col("page_id")
    extra = F.lit("")
    for k, form in LINK_FORMS.items():
        before, *parts = form.split("{id}")
        text = F.concat(F.lit(before), *[x for part in parts for x in (i.cast("string"), F.lit(part))])
        extra = F.when(i % 7 == k, text).otherwise(extra)
    base = p.select(i, "url", F.concat("html", extra).alias("html"))
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    contact = p.filter(i % 7 == 3).select(
        (i + F.lit(10**9)).alias("page_id"), F.concat(origin, F.lit("/contact/"), i.cast("string")).alias("url"),
        F.concat(F.lit("<p>mail author"), i.cast("string"), F.lit("@pen.example</p>")).alias("html"))
    copies = p.filter((i % 20 == 0) & F.col("url").startswith("https://")).select(
        (i + F.lit(2 * 10**9)).alias("page_id"), F.regexp_replace("url", "^https", "http").alias("url"), "html")
    return base.unionByName(contact).unionByName(copies)


def noted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits of which some lead to shops and directories (a blacklist term in url, title or snippet)."""
    h = search_hits(spark, sf_dir)
    n = F.col("position")
    terms = F.array(*[F.lit(t) for t in K.BLACKLIST_TERMS])
    term = F.element_at(terms, (F.floor(n / 9) % len(K.BLACKLIST_TERMS) + 1).cast("int"))
    return h.withColumns({
        "url": F.when(n % 9 == 1, F.concat("url", F.lit("/"), term)).otherwise(F.col("url")),
        "title": F.when(n % 9 == 2, F.concat("title", F.lit(" "), F.upper(term))).otherwise(F.col("title")),
        "snippet": F.when(n % 9 == 3, F.concat("snippet", F.lit(" "), term)).otherwise(F.col("snippet")),
    })


def draft_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as draft texts: every third starts with a subject line (in changing case), every fifth holds
    one of the banned phrases."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    phrases = F.array(*[F.lit(x) for x in K.BANNED_PHRASES])
    phrase = F.element_at(phrases, (i % len(K.BANNED_PHRASES) + 1).cast("int"))
    subject = F.when(i % 6 == 0, "SUBJECT: ").when(i % 6 == 3, "subject:")
    text = F.when(i % 5 == 1, F.concat("text", F.lit("\n\n"), F.upper(phrase))).otherwise(F.col("text"))
    return d.select("doc_id", F.when(i % 3 == 0, F.concat(subject, F.lit("About "), i.cast("string"), F.lit("\n\n"), text)).otherwise(text).alias("text"))


def long_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages gathered into threads of up to some hundred: every conversation of one residue is one thread."""
    return messages(spark, sf_dir).select(
        "msg_id", (F.col("author_id") % 3).alias("author_id"), "direction", "subject", "body", "timestamp",
        (F.floor(F.col("author_id") / 3) * 16 + F.col("seq")).alias("seq"))


def paragraphs(html: str):
    """The text of all paragraphs of a page, without markup, joined by blanks."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)
    return F.array_join(F.transform(found, lambda x: F.regexp_replace(x, "<[^>]*>", "")), " ")


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed search hits from the pages: query = page language + top-level domain, display url without http://."""
    p = read(spark, sf_dir, "pages")
    lang = F.regexp_extract(F.col("html"), r'<html lang="([a-z]+)"', 1)
    tld = F.regexp_extract(F.col("url"), r"\.(com|net|org)\b", 1)
    return p.select(
        F.concat(F.lit("authors "), lang, F.lit(" "), tld).alias("query"),
        F.col("page_id").alias("position"),
        F.regexp_extract(F.col("html"), r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_replace(F.col("url"), r"^http://", "").alias("url"),
        paragraphs("html").alias("snippet"),
        F.when(F.col("url").startswith("https://"), "primary").otherwise("secondary").alias("engine"),
    )


def catalogue_payloads(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Landed catalogue API responses, one JSON document per part row (authors empty when p_size % 10 = 0)."""
    p = read(spark, sf_dir, "part")
    has = F.col("p_size") % 10 != 0
    brand, title = F.col("p_brand"), F.col("p_name")
    if kind == "google_books":
        authors = F.when(has, F.array(brand)).otherwise(F.array().cast("array<string>"))
        item = F.struct(F.struct(authors.alias("authors"), title.alias("title"), F.col("p_type").alias("description")).alias("volumeInfo"))
        doc = F.struct(F.array(item).alias("items"))
    elif kind == "open_library":
        authors = F.when(has, F.array(F.struct(brand.alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
        doc = F.struct(F.array(F.struct(authors.alias("authors"), title.alias("title"))).alias("works"))
    elif kind == "loc":
        contributor = F.when(has, F.array(brand)).otherwise(F.array().cast("array<string>"))
        subject = F.array(F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string")))
        doc = F.struct(F.array(F.struct(contributor.alias("contributor"), title.alias("title"), subject.alias("subject"))).alias("results"))
    elif kind == "gutendex":
        authors = F.when(has, F.array(F.struct(brand.alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
        doc = F.struct(F.array(F.struct(authors.alias("authors"), title.alias("title"))).alias("results"))
    else:
        raise ValueError(f"unknown catalogue kind: {kind}")
    return p.select(F.col("p_partkey").alias("response_id"), F.to_json(doc).alias("payload"))


def bare_events(spark: SparkSession, sf_dir: str, batch_size: int = 8) -> DataFrame:
    """The delivery events as the application's senders post them: ids are text, a third has none, a sixth no time either, some
    have no author, the channel is named for gmail only. ``n`` numbers them; ``post_id`` is the request they came with."""
    ev = delivery_events(spark, sf_dir)
    n = F.col("event_id")
    return ev.select(
        n.alias("n"), F.floor(n / batch_size).alias("post_id"), F.when(n % 3 != 0, as_uuid(n)).alias("event_id"),
        F.when(n % 6 != 0, F.col("ts").cast("timestamp")).alias("ts"), F.when(n % 11 != 0, as_uuid(F.col("author_id"))).alias("author_id"),
        F.when((F.col("event") == "bounce") & (n % 2 == 0), F.concat(F.lit("reader"), F.col("author_id").cast("string"), F.lit("@mail.example"))).alias("email"),
        "event", F.when(F.col("source") == "gmail", "gmail").alias("source"))


def _arrival(number):
    """When a request arrived: one a minute."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), number.cast("int"))


def delivery_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook bodies: JSON arrays of at most 8 consecutive delivery events (fields that are not there are left out), with the
    place they landed at."""
    fields = ["event_id", "ts", "author_id", "email", "event", "source"]
    posts = bare_events(spark, sf_dir).groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("n", F.struct(*fields).alias("e")))).alias("es"))
    body = F.to_json(F.transform("es", lambda x: x["e"]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return posts.select("post_id", body.alias("body"), F.concat(F.lit("post-"), F.col("post_id").cast("string")).alias("file"),
                        F.lit(0).cast("bigint").alias("line"), _arrival(F.col("post_id")).alias("arrived_at"))


def tracking_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel / redirect hits as request URLs; the source parameter is present only for gmail contacts."""
    ev = delivery_events(spark, sf_dir).filter(F.col("event").isin("open", "click"))
    path = F.when(F.col("event") == "open", F.lit("open")).otherwise(F.lit("click"))
    src = F.when(F.col("source") == "gmail", F.lit("&source=gmail")).otherwise(F.lit(""))
    target = F.when(F.col("event") == "click", F.concat(F.lit("&url=https%3A%2F%2Fbooks.example.org%2Fb%2F"), (F.col("event_id") % 5).cast("string")))
    url = F.concat(F.lit("https://track.example.org/track/"), path, F.lit("?author_id="),
                   as_uuid(F.col("author_id")), F.lit("&run_date=2024-01-01"), src, F.coalesce(target, F.lit("")))
    return ev.select("event_id", "ts", url.alias("request_url"))


def landed_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbound replies with the place they landed at; a quarter came as form posts, without message id and time."""
    rp = inbound_replies(spark, sf_dir)
    n = F.col("msg_id").cast("bigint")
    post = n % 4 == 0
    return rp.select(F.when(~post, F.concat(F.col("msg_id"), F.lit("@mail.example"))).alias("msg_id"), F.when(~post, F.col("ts").cast("timestamp")).alias("ts"),
                     "from_header", "body", "model_output", F.concat(F.lit("mail-"), (n % 100).cast("string")).alias("file"), n.alias("line"), _arrival(n % 100).alias("arrived_at"))


def text_id_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contacts under the application's own ids."""
    return contacts(spark, sf_dir).withColumn("id", as_uuid(F.col("id")))


def run_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a run: the verification requests of contacts on or after the run cutoff, in id order
    (seq), with their titles; no address was found for every 17th id."""
    c = contacts(spark, sf_dir).filter(F.col("contacted_at") >= _ts(RUN_CUTOFF))
    return c.select(
        F.col("id").alias("seq"), "id", "channel", "full_name", "source_platform", "book_titles", "contacted_at",
        F.when(F.col("id") % 17 == 0, F.lit(None).cast("string")).otherwise(_request_email()).alias("email"),
        _probe_code().alias("probe_code"))


def with_send_results(candidates: DataFrame) -> DataFrame:
    """The sender's result next to each candidate: 250 -> sent, no answer -> dry_run, other codes -> failed."""
    code = F.col("probe_code")
    return candidates.withColumns({
        "status": F.when(code == 250, "sent").when(code.isNull(), "dry_run").otherwise("failed"),
        "sent_at": F.col("contacted_at") + F.expr("INTERVAL 1 HOUR"),
        "error": F.when((code != 250) & code.isNotNull(), F.concat(F.lit("SMTP "), code.cast("string"))),
    })


# two short letters that use the job's token names; a job passes its own template text
INVITATION_TEMPLATE = (
    "SUBJECT: {{BOOK_TITLE}} on next month's reading list?\n\n"
    "Dear {{AUTHOR_NAME}},\n\n"
    "We came across {{BOOK_TITLE}} while looking for new {{BOOK_GENRE_LABEL}}. From its description: {{BOOK_DESCRIPTION}}\n\n"
    "Would you answer a few questions from readers in writing? One of them would be about {{AUTHOR_JOURNEY_DETAIL}}.\n\n"
    "Yours,\nThe list editors"
)

FOLLOWUP_TEMPLATE = (
    "SUBJECT: Second note on {{BOOK_TITLE}}\n\n"
    "Dear {{AUTHOR_NAME}},\n\n"
    "Our earlier message may not have arrived. The question about {{FOLLOWUP_SPECIFIC_HOOK}} is still open.\n\n"
    "Yours,\nThe list editors"
)
