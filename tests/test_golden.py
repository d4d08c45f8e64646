"""Golden edge cases the landed fixtures cannot show (hand-made rows)."""

from datetime import datetime

from pyspark.sql import functions as F

from outreach_spark import schemas as SC
from outreach_spark.functions import emails as EM
from outreach_spark.functions import text as TX
from outreach_spark.operators import dedupe, engagement, extract, funnel, metrics, verify
from outreach_spark.sources.scans import conform_schema, parse_genres
from outreach_spark.streaming import events as ST

T0 = datetime(2024, 1, 10, 12, 0, 0)


def contacts_df(spark, rows):
    """rows: dicts with any subset of the contacts columns; the rest get defaults."""
    cols = ["channel", "id", "full_name", "email", "contacted_at", "email_status", "approval_status", "lead_score",
            "reply_sentiment", "open_detected", "replied", "followup_sent", "genres_raw", "ab_variant"]
    data = [tuple(r.get(c) for c in cols) for r in rows]
    df = spark.createDataFrame(data, "channel string, id bigint, full_name string, email string, contacted_at timestamp_ntz, "
                               "email_status string, approval_status string, lead_score bigint, reply_sentiment string, "
                               "open_detected boolean, replied boolean, followup_sent boolean, genres_raw string, ab_variant string")
    df = df.withColumn("genres", parse_genres(F.col("genres_raw"))).drop("genres_raw")
    return conform_schema(df, SC.CONTACTS)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


# ---- P2, P4-P8, P13, P22, P23: text rules

def test_name_from_title_word_boundary(spark):
    df = spark.createDataFrame([("Ruby Fox | Home",), ("A Novel by Jane Doe | Official Site",), ("Stand by me by Ann Lee",), (None,)], "title string")
    got = [r[0] for r in df.select(TX.name_from_title("title")).collect()]
    assert got == ["Ruby Fox", "Jane Doe", "Ann Lee", ""]


def test_page_mailto_query_part_and_generic_prefix(spark):
    html = ('<a href="mailto:info@x.org">x</a> <a href="mailto:Jane.Doe@x.org?subject=Hi">me</a>'
            ' text sales@x.org and writer@x.org')
    r = one(spark.createDataFrame([(html,)], "html string").select(
        EM.page_mailto("html").alias("m"), EM.page_email("html").alias("p"), EM.page_regex_email("html").alias("r")))
    assert r.m == "Jane.Doe@x.org" and r.p == "Jane.Doe@x.org" and r.r == "Jane.Doe@x.org"
    r2 = one(spark.createDataFrame([("write to support@x.org or writer@x.org",)], "html string").select(EM.page_email("html").alias("p")))
    assert r2.p == "writer@x.org"


def test_context_email_excludes_support_words(spark):
    r = one(spark.createDataFrame([("Contact info@books.com or jane@books.com",)], "t string").select(EM.context_email("t").alias("e")))
    assert r.e == "jane@books.com"
    r = one(spark.createDataFrame([("no address here",)], "t string").select(EM.context_email("t").alias("e")))
    assert r.e is None


def test_contact_subpage_links_order_and_resolution(spark):
    html = ('<a href="/blog">Blog</a><a href="/about-me">About me</a><a href="https://x.org/contact">Reach out</a>'
            '<a href="team.html">CONTACT</a>')
    pages = spark.createDataFrame([(1, "https://x.org/home/index.html", html)], "page_id bigint, url string, html string")
    r = one(extract.contact_subpage_links(pages))
    assert r.link_text == "CONTACT" and r.selector_rank == 1 and r.subpage_url == "https://x.org/home/team.html"


def test_links_in_real_markup(spark):
    forms = ['<a href="/contact"><span>Contact</span> us</a>', "<a href='/contact'>x</a>", '<A class="b" HREF="/contact">x</A>', '<a\nhref="/x">Get in\n<b>touch</b></a>',
             '<a href="mailto:a@x.org">Contact</a>', '<link href="/contact"><a name="contact">Contact</a>']
    pages = spark.createDataFrame([(i, "https://x.org/", h) for i, h in enumerate(forms)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.link_text, r.subpage_url) for r in extract.contact_subpage_links(pages).collect()}
    assert got == {0: ("Contact us", "https://x.org/contact"), 1: ("x", "https://x.org/contact"), 2: ("x", "https://x.org/contact"),
                   3: ("Get in touch", "https://x.org/x")}
    html = '<link href="mailto:no@x.org"><A HREF="mailto:Jane@x.org?subject=1">'
    assert one(spark.createDataFrame([(html,)], "html string").select(EM.page_mailto("html").alias("m"))).m == "Jane@x.org"


def test_one_page_per_address(spark):
    from outreach_spark.sources import scans

    pages = spark.createDataFrame([(2, "http://a.org/", "second b@a.org"), (1, "https://a.org/", "first a@a.org")], "page_id bigint, url string, html string")
    stubs = spark.createDataFrame([("A", "", "a.org/"), ("N", "", None), ("N", "", None)], "name string, description string, url string")
    assert sorted(str(r.email) for r in extract.resolve_email(stubs, pages).collect()) == ["None", "None", "a@a.org"]
    hits = spark.createDataFrame([("q", "https://a.org/"), ("q", "https://b.org/")], "query string, url string")
    assert sorted((r.url, r.page_id) for r in scans.scan_pages(hits, pages).collect() if r.page_id) == [("https://a.org/", 1)]
    assert scans.scan_pages(hits, pages).count() == 2


def test_new_files_are_seen_in_the_same_session(spark, scratch):
    from outreach_spark.sources import fixtures as fx

    ev = spark.createDataFrame([(i, T0, 1, "click", 0.0, None) for i in range(5)], fx.LANDED_SCHEMAS["events"])
    ev.write.parquet(f"{scratch}/events.parquet")
    assert fx.delivery_events(spark, scratch).count() == 5
    ev.withColumn("event_id", F.col("event_id") + 5).write.mode("append").parquet(f"{scratch}/events.parquet")
    assert fx.delivery_events(spark, scratch).count() == 10


def test_engagement_by_channel_and_folding_twice(spark):
    c = contacts_df(spark, [{"id": 1, "channel": "main", "lead_score": 2, "email_status": "sent"}, {"id": 1, "channel": "gmail", "lead_score": 0, "email_status": "sent"}])
    ev = spark.createDataFrame([(1, T0, 1, "open", "main"), (2, T0, 1, "click", "gmail"), (3, T0, 1, "bounce", "gmail")],
                               "event_id bigint, ts timestamp_ntz, author_id bigint, event string, source string")
    once = engagement.apply_engagement(c, ev)
    got = {r.channel: (r.lead_score, r.open_detected, r.email_status) for r in once.collect()}
    assert got == {"main": (3, True, "sent"), "gmail": (5, False, "bounced")}
    twice = engagement.apply_engagement(once, ev)
    assert sorted(map(str, twice.select(*once.columns).collect())) == sorted(map(str, once.collect()))
    older = ev.withColumn("ts", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    back = engagement.apply_engagement(once, older)
    assert {r.channel: r.open_detected_at for r in back.collect()}["main"] == T0


def test_messages_of_one_author_or_address(spark):
    from outreach_spark.sources.scans import scan_messages

    m = spark.createDataFrame([("b", 1, "A@x.org", T0, 1), ("a", 1, None, T0, 0), ("c", 2, "a@x.org ", datetime(2024, 1, 9), 0)],
                              "msg_id string, author_id bigint, email string, timestamp timestamp_ntz, seq bigint")
    assert [r.msg_id for r in scan_messages(m, author_id=1).collect()] == ["a", "b"]
    assert [r.msg_id for r in scan_messages(m, email="a@X.org").collect()] == ["c", "b"]
    assert scan_messages(m).count() == 3


def test_bio_token(spark):
    from outreach_spark.operators import drafts

    c = contacts_df(spark, [{"id": 1, "channel": "main", "full_name": "Ann"}]).withColumn("bio", F.lit("b" * 400))
    assert one(drafts.render_drafts(c, "{{AUTHOR_BIO}}", "2024-01-01")).body_plain == "b" * 300


def test_followup_drafts(spark):
    from outreach_spark.operators import drafts

    el = contacts_df(spark, [{"id": 1, "channel": "main", "full_name": "Ann Lee"}, {"id": 2, "channel": "main", "full_name": "Bo"}]).withColumn("book_description", F.lit("d" * 500))
    d = spark.createDataFrame([(1, "First note")], "author_id bigint, invitation_subject string")
    out = {r.author_id: r for r in drafts.render_followups(el, d, "SUBJECT: other\n\nHi {{AUTHOR_NAME}}: {{BOOK_DESCRIPTION}}", "2024-01-01").collect()}
    assert out[1].subject == "Re: First note" and out[2].subject == "Re: Invitation"
    assert out[1].body_plain == "Hi Ann: " + "d" * 300


def test_upsert_by_body_sizes_chooses_the_same_drafts(spark):
    from outreach_spark.operators import drafts

    inv_schema = "author_id bigint, invitation_subject string, invitation_body_html string, invitation_body_plain string, tokens_used string, saved_at timestamp_ntz"
    fu_schema = "author_id bigint, followup_subject string, followup_body_html string, followup_body_plain string"
    late = datetime(2024, 2, 1)
    rows = [(1, "old", "<p>a</p>", "a", "{}", T0), (1, "new", "<p>bb</p>", "bb", "{}", late), (1, "new", "<p>bb</p>", "bb", "{}", late),
            (2, "timeless", "x", "x", "{}", None), (None, "nobody", "y", "y", "{}", late), (5, None, None, None, None, late),
            *[(3, "one time", "h" * n, "p" * (20 - n), "{}", late) for n in range(20)]]
    inv = spark.createDataFrame(rows, inv_schema)
    fu = spark.createDataFrame([(1, "f", "f" * 5, "g" * n, late) for n in range(9)] + [(9, "none", "n", "n", late)], f"{fu_schema}, saved_at timestamp_ntz")
    old = spark.createDataFrame([(1, "first", "z" * 7, "z", "{}", T0), (2, "kept", "z" * 8, "z", "{}", T0), (None, "null id", "z", "z", "{}", T0)], inv_schema)
    cols, fu_cols = drafts.DRAFT_INVITATION_COLS, drafts.DRAFT_FOLLOWUP_COLS
    with_fu = lambda df, kind: df.select("*", *[F.lit(None).cast(kind if "_body_" in c else "string").alias(c) for c in fu_cols])
    whole = drafts.upsert_drafts(with_fu(old, "string"), inv, fu)
    sized = drafts.upsert_drafts(with_fu(drafts.body_sizes(old, cols, versioned=False), "int"),
                                 drafts.body_sizes(inv, cols), drafts.body_sizes(fu, [*fu_cols, "saved_at"]))
    got = sorted(map(str, sized.collect()))
    assert got == sorted(map(str, whole.select(*[F.length(c).alias(c) if "_body_" in c else F.col(c) for c in whole.columns]).collect()))
    texts = {r.author_id: r for r in whole.collect()}
    assert {k: (r.invitation_subject, r.followup_subject) for k, r in texts.items()} == {
        1: ("new", "f"), 2: ("kept", None), 3: ("one time", None), 5: (None, None), None: ("null id", None)}
    tied = inv.filter("author_id = 3").withColumn("h", F.xxhash64("saved_at", *cols[:-1])).orderBy(F.desc("h")).first()
    assert texts[3].invitation_body_html == tied.invitation_body_html


def test_resolve_email_home_then_subpage(spark):
    pages = spark.createDataFrame([
        (1, "https://a.org/", '<a href="/contact">Contact</a> nothing here'),
        (2, "https://a.org/contact", "mail me: author@a.org"),
        (3, "https://b.org/", "info@b.org only"),
    ], "page_id bigint, url string, html string")
    stubs = spark.createDataFrame([("A", "", "a.org/"), ("B", "", "https://b.org/"), ("C", "reach c@c.org", None)],
                                  "name string, description string, url string")
    got = {r.name: (r.email, r.email_source) for r in extract.resolve_email(stubs, pages).collect()}
    assert got == {"A": ("author@a.org", "website_crawl_subpage"), "B": (None, "not_found"), "C": ("c@c.org", "context")}


def test_sender_address_without_brackets(spark):
    df = spark.createDataFrame([('"Jane" <Jane@X.org>',), ("  Bob@Y.org ",), ("<>",), (None,)], "h string")
    assert [r[0] for r in df.select(EM.sender_address("h")).collect()] == ["jane@x.org", "bob@y.org", None, None]


def test_mask_email(spark):
    df = spark.createDataFrame([("jane@x.org",), (None,), ("",)], "e string")
    assert [r[0] for r in df.select(EM.mask_email("e")).collect()] == ["j***@x.org", "N/A", "N/A"]


def test_normalise_sentiment_not_interested_first(spark):
    df = spark.createDataFrame([("NOT_INTERESTED",), ("Interested!",), (None,), ("maybe",), ("wrong_person",)], "m string")
    assert [r[0] for r in df.select(TX.normalise_sentiment("m")).collect()] == [
        "not_interested", "interested", "unknown", "other", "wrong_person"]


# ---- P15-P17: templates and drafts

def test_template_unknown_token_and_missing_subject(spark):
    df = spark.createDataFrame([("Ann",)], "full_name string")
    filled = TX.fill_template("Hi {{AUTHOR_NAME}}, about {{MYSTERY}}.\n\nBye", {"AUTHOR_NAME": F.col("full_name")})
    r = one(df.select(filled.alias("t")).select(
        TX.draft_subject("t", "Default").alias("s"), TX.draft_body("t").alias("b"),
        F.array_join(TX.unfilled_tokens("t"), ",").alias("u"), TX.paragraphs_html(TX.draft_body("t")).alias("h")))
    assert r.s == "Default" and r.b == "Hi Ann, about {{MYSTERY}}.\n\nBye" and r.u == "MYSTERY"
    assert r.h == "<p>Hi Ann, about {{MYSTERY}}.</p><p>Bye</p>"


def test_subject_line_any_case(spark):
    df = spark.createDataFrame([("\n subject: Hello there \n\nBody line\n",)], "t string")
    r = one(df.select(TX.draft_subject("t", "D").alias("s"), TX.draft_body("t").alias("b")))
    assert r.s == "Hello there" and r.b == "Body line"


def test_banned_phrases_case_insensitive(spark):
    df = spark.createDataFrame([("i HOPE this email finds you well; let us Circle Back.",)], "t string")
    r = one(df.select(TX.matched_phrases_text("t").alias("m"), TX.matched_phrase_count("t").alias("n")))
    assert r.m == "I hope this email finds you well|circle back" and r.n == 2


def test_draft_texts_equal_plain_python(spark):
    import random
    import re

    from outreach_spark import constants as K

    rng, ws = random.Random(3), " \t\n\r\f"
    pieces = ["\n", "\n\n", "\n\n\n", "\n\n\n\n", " ", "\t", "\r", "\f", "\x0b", "\u00a0", "a", "Ünï", "\U0001f600", "Subject: s", "SUBJECT:", "<p></p>", "$1 \\", *K.BANNED_PHRASES, "I HOPE THIS EMAIL FINDS YOU WEL"]
    texts = [None, "", " \n", "subject:", *("".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(600))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", "t", TX.word_count("t").alias("n"), TX.matched_phrases_text("t").alias("m"), TX.draft_subject("t", "D").alias("s"), TX.draft_body("t").alias("b"))
    for r in rows.select("*", TX.paragraphs_html("b").alias("h")).collect():
        t = r.t or ""
        assert r.n == len(re.findall(f"[^{ws}]+", t))
        assert r.m == "|".join(p for p in K.BANNED_PHRASES if p.lower() in t.lower())
        first, _, rest = t.strip(ws).partition("\n")
        has = first.upper().startswith("SUBJECT:")
        assert r.s == (first[8:].strip(ws) if has else "D") and r.b == (rest if has else t).strip(ws)
        assert r.h == ("<p>" + re.sub("(?:\n\n)+", "</p><p>", r.b) + "</p>" if r.b else "")


# ---- A1-A9: reporting edge cases

def test_empty_contacts_table(spark):
    empty = contacts_df(spark, [])
    r = one(metrics.overview_stats(empty))
    assert all(v == 0 for v in r.asDict().values())
    assert one(metrics.bounce_rate(empty, "main")).bounce_rate == 0.0
    assert one(metrics.days_since_start(empty, "2024-01-01 00:00:00")).days == 1
    assert metrics.status_breakdown(empty).count() == 0


def test_status_null_and_empty_are_unknown(spark):
    c = contacts_df(spark, [{"id": 1, "email_status": None}, {"id": 2, "email_status": ""}, {"id": 3, "email_status": "sent"}])
    # conform_schema fills NULL status with 'pending'; '' stays and is reported as unknown
    got = {r.email_status: r["count"] for r in metrics.status_breakdown(c).collect()}
    assert got == {"pending": 1, "unknown": 1, "sent": 1}
    raw = spark.createDataFrame([(None,), ("",)], "email_status string")
    assert {r.email_status: r["count"] for r in metrics.status_breakdown(raw).collect()} == {"unknown": 2}


def test_weekly_growth_zero_last_week(spark):
    c = contacts_df(spark, [{"id": 1, "contacted_at": datetime(2024, 1, 9)}])  # Tuesday; as_of Wednesday
    r = one(metrics.weekly_growth(c, "2024-01-10 10:00:00"))
    assert (r.this_week, r.last_week, r.growth) == (1, 0, 100.0)
    r = one(metrics.weekly_growth(contacts_df(spark, []), "2024-01-10 10:00:00"))
    assert (r.this_week, r.last_week, r.growth) == (0, 0, 100.0)


def test_genres_json_comma_empty(spark):
    c = contacts_df(spark, [{"id": 1, "genres_raw": '["Poetry", " Memoir "]'}, {"id": 2, "genres_raw": "Poetry, History,"},
                            {"id": 3, "genres_raw": "[]"}, {"id": 4, "genres_raw": ""}, {"id": 5, "genres_raw": None}])
    got = {r.genre: r.total for r in metrics.genre_performance(c).collect()}
    assert got == {"Poetry": 2, "Memoir": 1, "History": 1, "Unknown": 3}


def test_days_since_start_counts_elapsed_days(spark):
    c = contacts_df(spark, [{"id": 1, "channel": "main", "contacted_at": datetime(2024, 1, 1, 23, 0)}])
    assert one(metrics.days_since_start(c, "2024-01-03 22:00:00")).days == 1   # 47 h, two midnights
    assert one(metrics.days_since_start(c, "2024-01-04 23:00:00")).days == 3


def test_bounce_rate_at_threshold_does_not_trip(spark):
    rows = [{"id": i, "channel": "main", "email_status": "sent"} for i in range(49)] + [{"id": 99, "channel": "main", "email_status": "bounced"}]
    c = contacts_df(spark, rows)
    r = one(funnel.circuit_breaker(c, threshold=0.02))
    assert r.bounce_rate == 0.02 and r.tripped is False and r.error is None
    cand = spark.createDataFrame([(1,)], "seq bigint")
    assert funnel.breaker_gate(cand, c, "main", 0.02).count() == 1
    assert funnel.breaker_gate(cand, c, "main", 0.019).count() == 0


def test_send_window_bounds(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, h, m),) for h, m in [(12, 59), (13, 0), (15, 59), (16, 0)]], "ts timestamp_ntz")
    assert [r.ts.hour for r in funnel.send_window(df, "ts").collect()] == [13, 15]


# ---- J/K/G: dedupe, upserts, approvals

def fid(n):
    """A text id like the application's."""
    import uuid

    return str(uuid.UUID(int=(n * 0x9E3779B97F4A7C15F39CC0605CEDC834) % 2**128))


def text_contacts(spark, rows):
    """``contacts_df`` with text ids."""
    numbered = contacts_df(spark, [{**r, "id": n} for n, r in enumerate(rows)])
    names = spark.createDataFrame([(n, r["id"]) for n, r in enumerate(rows)], "id bigint, _text string")
    return numbered.join(names, "id").withColumn("id", F.col("_text")).drop("_text")


def test_mixed_case_emails_match(spark):
    c = contacts_df(spark, [{"id": 1, "channel": "main", "email": "Jane.Doe@X.org "}])
    cand = spark.createDataFrame([(10, "jane.doe@x.org"), (11, "other@x.org")], "id bigint, email string")
    assert [r.id for r in dedupe.not_contacted(cand, c, "main").collect()] == [11]


def test_upsert_two_keys_chain(spark):
    existing = contacts_df(spark, [{"id": 1, "channel": "main", "email": "a@x.org", "lead_score": 7, "open_detected": True},
                                   {"id": 2, "channel": "main", "email": "b@x.org", "lead_score": 3}])
    # B replaces row 1 by id (new email); C replaces B by email (b2) and row 2 by its email (b@x.org) is replaced by D
    incoming = contacts_df(spark, [{"id": 1, "channel": "main", "email": "b2@x.org"},
                                   {"id": 5, "channel": "main", "email": "b2@x.org"},
                                   {"id": 6, "channel": "main", "email": "B@x.org"}]).withColumn("seq", F.col("id"))
    got = {r.id: (r.email, r.lead_score, r.open_detected) for r in dedupe.upsert_contacts(existing, incoming).collect()}
    assert got == {5: ("b2@x.org", 0, False), 6: ("B@x.org", 0, False)}
    # same id, new data: engagement columns are kept
    inc2 = contacts_df(spark, [{"id": 1, "channel": "main", "email": "a@x.org", "approval_status": "approved"}]).withColumn("seq", F.lit(1))
    got2 = {r.id: (r.lead_score, r.open_detected) for r in dedupe.upsert_contacts(existing, inc2).collect()}
    assert got2 == {1: (7, True), 2: (3, False)}


def test_upsert_with_text_ids_equals_a_row_loop(spark):
    import random

    rng = random.Random(3)
    ids = [fid(i) for i in range(12)]
    mails = [f"m{i}@x.org" for i in range(10)]
    for trial in range(3):
        start = rng.sample(ids, 6)
        existing = text_contacts(spark, [{"id": i, "channel": "main", "email": m, "lead_score": n} for n, (i, m) in enumerate(zip(start, rng.sample(mails, 6)))])
        rows = [(rng.choice(ids), rng.choice(mails), n) for n in rng.sample(range(-30, 300), 25)]
        incoming = text_contacts(spark, [{"id": i, "channel": "main", "email": m} for i, m, _ in rows]).withColumn("seq", F.lit(0))
        order = spark.createDataFrame(rows, "id string, email string, s bigint")
        incoming = incoming.drop("seq").join(order, ["id", "email"]).dropDuplicates(["s"]).withColumnRenamed("s", "seq")
        table = {r.id: r.email for r in existing.collect()}
        for i, m, _ in sorted(rows, key=lambda r: r[2]):
            table = {k: v for k, v in table.items() if k != i and v != m} | {i: m}
        assert {r.id: r.email for r in dedupe.upsert_contacts(existing, incoming).collect()} == table


def test_upsert_needs_an_order_and_breaks_ties(spark):
    import pytest

    existing = contacts_df(spark, [{"id": 1, "channel": "main", "email": "a@x.org"}])
    inc = contacts_df(spark, [{"id": 2, "channel": "main", "email": "b@x.org"}, {"id": 3, "channel": "main", "email": "b@x.org"}])
    with pytest.raises(ValueError):
        dedupe.upsert_contacts(existing, inc)
    got = dedupe.upsert_contacts(existing, inc.withColumn("seq", F.lit(1))).collect()
    assert sorted(r.id for r in got) == [1, 3]


def test_upsert_is_idempotent(spark):
    existing = contacts_df(spark, [{"id": 1, "channel": "main", "email": "a@x.org"}])
    inc = contacts_df(spark, [{"id": 2, "channel": "gmail", "email": "c@x.org"}]).withColumn("seq", F.lit(0))
    once = dedupe.upsert_contacts(existing, inc)
    twice = dedupe.upsert_contacts(once, inc)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_approve_id_on_gmail_only(spark):
    c = contacts_df(spark, [{"id": 1, "channel": "main", "approval_status": "pending"},
                            {"id": 2, "channel": "gmail", "approval_status": "pending"},
                            {"id": 3, "channel": "main", "approval_status": "pending"}, {"id": 3, "channel": "gmail", "approval_status": "pending"}])
    d = spark.createDataFrame([(2, "approved"), (3, "rejected")], "id bigint, decision string")
    got = {(r.id, r.channel): r.approval_status for r in engagement.set_approval(c, d).collect()}
    assert got == {(1, "main"): "pending", (2, "gmail"): "approved", (3, "main"): "rejected", (3, "gmail"): "pending"}


def test_patches_with_repeated_keys_make_no_rows(spark):
    from outreach_spark.operators import export

    c = contacts_df(spark, [{"id": 1, "channel": "main", "approval_status": "pending", "email": "a@x.org"}])
    d = spark.createDataFrame([(1, "approved"), (1, "rejected"), (1, "approved")], "id bigint, decision string")
    assert one(engagement.set_approval(c, d)).approval_status == "rejected"
    timed = spark.createDataFrame([(1, "rejected", 1), (1, "approved", 2)], "id bigint, decision string, decided_at int")
    assert one(engagement.set_approval(c, timed)).approval_status == "approved"
    sent = spark.createDataFrame([(1, T0), (1, T0), (1, datetime(2024, 1, 9))], "id bigint, sent_at timestamp_ntz")
    r = one(engagement.mark_followup_sent(c, sent))
    assert r.followup_sent and r.followup_sent_at == T0
    run = spark.createDataFrame([(1, 1, "main", "ready")], "seq bigint, id bigint, channel string, outcome string")
    res = spark.createDataFrame([(1, "failed", None, "E"), (1, "sent", T0, None)], "id bigint, status string, sent_at timestamp_ntz, error string")
    r = one(funnel.apply_send_results(run, res))
    assert (r.email_status, r.email_sent_at, r.send_error) == ("sent", T0, None)
    assert one(funnel.followup_summary(c, res)).sent == 1
    ex = export.export_contacts(c, "2024-01-01")
    p = spark.createDataFrame([("1", "sent", None, 1), ("1", "bounced", None, 2), ("1", None, "Hi", 3)],
                              "author_id string, email_status string, email_subject_used string, patch_seq int")
    r = one(export.export_status_patch(ex, p))
    assert (r.email_status, r.email_subject_used) == ("bounced", "Hi")


def test_classify_agrees_with_a_row_by_row_loop(spark):
    from outreach_spark.plans.registry import _run_existing
    from outreach_spark.sources import fixtures as fx

    from .conftest import SF_MED

    verified = verify.verify_emails(fx.run_candidates(spark, SF_MED), fx.mx_records(spark, SF_MED))
    existing = _run_existing(spark, SF_MED)
    contacted = {r.email_key for r in existing.select("email_key").collect()}
    want = {}
    for r in sorted(verified.select("seq", "id", "email", "is_deliverable").collect(), key=lambda r: r.seq):
        key = (r.email or "").strip().lower()
        if not key:
            want[r.id] = "no_email"
        elif key in contacted:
            want[r.id] = "already_contacted"
        elif not r.is_deliverable:
            want[r.id] = "undeliverable"
        else:
            want[r.id] = "ready"
            contacted.add(key)
    got = {r.id: r.outcome for r in funnel.classify_candidates(verified, existing).select("id", "outcome").collect()}
    assert got == want and "ready" in want.values()


def test_verify_chain(spark):
    req = spark.createDataFrame([(1, "not-an-email", 250), (2, "Info@ok.org", 250), (3, "a@nomx.org", 250),
                                 (4, "a@ok.org", 550), (5, "b@ok.org", 450), (6, "c@OK.org", None), (7, "d@ok.org", 250)],
                                "id bigint, email string, probe_code int")
    mx = spark.createDataFrame([("ok.org", 20, "mx2.ok.org."), ("ok.org", 10, "mx1.ok.org."), ("ok.org", 10, "mx0.ok.org.")],
                               "domain string, preference bigint, exchange string")
    got = {r.id: (r.smtp_result, r.is_deliverable) for r in verify.verify_emails(req, mx).collect()}
    assert got == {1: ("INVALID_SYNTAX", False), 2: ("ROLE_BASED", False), 3: ("MX_NOT_FOUND", False), 4: ("SMTP_550", False),
                   5: ("SMTP_450", True), 6: ("SMTP_BLOCK", True), 7: ("DELIVERABLE", True)}
    probes = spark.createDataFrame([(1, "a@ok.org", 451, "greylisted", None), (2, "b@ok.org", None, None, "boom"), (3, "c@ok.org", None, "timed out", None),
                                    (4, "d@ok.org", 250, "ok", None)], "id bigint, email string, probe_code int, probe_message string, probe_error string")
    got = {r.id: (r.smtp_result, r.is_deliverable, r.failure_reason) for r in verify.verify_emails(probes, mx).collect()}
    assert got == {1: ("SMTP_451", True, "greylisted"), 2: ("VERIFY_ERROR", True, "boom"), 3: ("SMTP_BLOCK", True, "timed out"), 4: ("DELIVERABLE", True, None)}
    assert one(verify.mx_lookup(mx)).mx_host == "mx0.ok.org"
    dom = spark.createDataFrame([("x@ OK.org./",), ("x@a.b",), ("nodomain",)], "e string").select(EM.email_domain("e").alias("d"))
    assert [r.d for r in dom.collect()] == ["ok.org", "a.b", None]


def test_classify_candidates_outcomes(spark):
    existing = contacts_df(spark, [{"id": 1, "channel": "main", "email": "old@x.org"}])
    cand = spark.createDataFrame([
        (1, 10, "main", None, True), (2, 11, "main", "old@x.org", True), (3, 12, "gmail", "new@x.org", True),
        (4, 13, "main", "NEW@x.org", True), (5, 14, "main", "bad@x.org", False), (6, 15, "gmail", "bad@x.org", False)],
        "seq bigint, id bigint, channel string, email string, is_deliverable boolean").withColumn("smtp_result", F.lit("X"))
    got = {r.id: r.outcome for r in funnel.classify_candidates(cand, existing).collect()}
    assert got == {10: "no_email", 11: "already_contacted", 12: "ready", 13: "already_contacted", 14: "undeliverable", 15: "undeliverable"}
    got2 = {r.id: r.outcome for r in funnel.classify_candidates(cand, existing, approval_required=True).collect()}
    assert got2[12] == "pending_approval"
    # an undeliverable row marks nothing: the next deliverable row of the address goes on
    rows = [(1, 20, "main", "a@x.org", False), (2, 21, "main", "a@x.org", True), (3, 22, "main", "b@x.org", True), (4, 23, "main", "b@x.org", False),
            (5, 24, "main", "a@x.org", True), (6, 25, "main", "", True)]
    order = spark.createDataFrame(rows, cand.drop("smtp_result").schema).withColumn("smtp_result", F.lit("X"))
    got3 = {r.id: r.outcome for r in funnel.classify_candidates(order, existing).collect()}
    assert got3 == {20: "undeliverable", 21: "ready", 22: "ready", 23: "already_contacted", 24: "already_contacted", 25: "no_email"}
    # every candidate gets exactly one outcome
    assert funnel.classify_candidates(cand, existing).count() == cand.count()


# ---- T1/T6: events

def test_route_unknown_and_authorless_events(spark):
    ev = spark.createDataFrame([(1, T0, 5, "open", "main"), (2, T0, None, "click", "main"), (3, T0, None, "bounce", "gmail"),
                                (4, T0, 6, "signup", "main"), (5, T0, 6, "dropped", "main")],
                               "event_id bigint, ts timestamp_ntz, author_id bigint, event string, source string")
    got = {r.event_id: r.action for r in ST.route_events(ev).collect()}
    assert got == {1: "mark_open_and_score", 3: "log_warning", 5: "log_warning"}
    st = {r.author_id: r.email_status for r in engagement.delivery_status(ev).collect()}
    assert st == {6: "dropped"}


def test_duplicate_events_counted_once(spark):
    ev = spark.createDataFrame([(1, T0, 5, "click", "main"), (1, T0, 5, "click", "main"), (2, T0, 5, "open", "main")],
                               "event_id bigint, ts timestamp_ntz, author_id bigint, event string, source string")
    assert one(engagement.lead_scores(ST.stream_event_dedup(ev))).lead_score == 6


def test_thread_text_chunks_reassemble(spark):
    from outreach_spark.operators.ranking import thread_text

    msgs = spark.createDataFrame(
        [(7, "outgoing", "Invitation", f"body {i}", datetime(2024, 1, 1, 0, i), i) for i in range(5)],
        "author_id bigint, direction string, subject string, body string, timestamp timestamp_ntz, seq bigint")
    whole = "".join(f"[OUTGOING] Subject: Invitation\nBody: body {i}\n---\n" for i in range(5))
    rows = sorted(thread_text(msgs, chunk_messages=2).collect(), key=lambda r: r.chunk)
    assert [r.chunk for r in rows] == [0, 1, 2] and {r.n_messages for r in rows} == {5}
    assert "".join(r.thread_text for r in rows) == whole


def test_tracking_hits_defaults_and_decoding(spark):
    df = spark.createDataFrame([
        (1, "https://t.example.org/track/open?author_id=42&run_date=2024-01-01"),
        (2, "https://t.example.org/track/click?author_id=7&source=gmail&url=https%3A%2F%2Fbooks.example.org%2Fa%3Fb%3D1"),
        (3, "https://t.example.org/track/open?run_date=2024-01-01"),
        (4, "https://t.example.org/track/open?author_id=abc"),
    ], "event_id bigint, request_url string")
    got = {r.event_id: (r.author_id, r.source, r.event, r.target_url) for r in ST.parse_tracking_hits(df).collect()}
    assert got == {1: ("42", "main", "open", None), 2: ("7", "gmail", "click", "https://books.example.org/a?b=1"), 4: ("abc", "main", "open", None)}


def test_unknown_channel_is_an_error(spark):
    import pytest

    from outreach_spark.operators import ranking

    with pytest.raises(ValueError):
        ranking.contacts_page(contacts_df(spark, []), channel="fax")
    with pytest.raises(ValueError):
        dedupe.not_contacted(contacts_df(spark, []), contacts_df(spark, []), scope="fax")


def test_upsert_keeps_both_keys_unique(spark):
    from hypothesis import given, settings, strategies as st

    row = st.tuples(st.integers(0, 5), st.sampled_from(["a@x.org", "b@x.org", "c@x.org", "d@x.org", "e@x.org"]))

    @settings(max_examples=8, deadline=None)
    @given(st.lists(row, min_size=1, max_size=6))
    def check(incoming_rows):
        existing = contacts_df(spark, [{"id": 100 + i, "channel": "main", "email": e}
                                       for i, e in enumerate(["a@x.org", "b@x.org", "c@x.org"])])
        ordered = spark.createDataFrame([(i, e, n) for n, (i, e) in enumerate(incoming_rows)], "id bigint, email string, seq bigint")
        inc = contacts_df(spark, [{"id": i, "channel": "main", "email": e} for i, e in incoming_rows]).join(
            ordered.select("id", "email", "seq"), ["id", "email"]).dropDuplicates(["seq"])
        out = dedupe.upsert_contacts(existing, inc).collect()
        assert len({r.id for r in out}) == len(out) == len({r.email_key for r in out})
        # the last incoming row always survives
        last_id, last_email = incoming_rows[-1]
        assert any(r.id == last_id and r.email == last_email for r in out)

    check()


def test_source_fallback_and_hit_scan(spark):
    from outreach_spark.sources.scans import scan_search_hits, source_fallback

    primary = spark.createDataFrame([("q1", 1, "A by X", "https://a.org", "s"), ("q1", 2, "", "b.org", "s")],
                                    "query string, position bigint, title string, url string, snippet string")
    secondary = spark.createDataFrame([("q1", 9, "Z", "z.org", "s"), ("q2", 1, "B by Y | Site", "b.org/x", "s"),
                                       ("q2", 2, "C", "c.org", "s"), ("q2", 3, "D", "d.org", "s")],
                                      "query string, position bigint, title string, url string, snippet string")
    hits = source_fallback(primary, secondary)
    assert sorted((r.query, r.position) for r in hits.collect()) == [("q1", 1), ("q1", 2), ("q2", 1), ("q2", 2), ("q2", 3)]
    got = sorted((r.query, r.position, r.url, r.rank) for r in scan_search_hits(hits, 2).collect())
    assert got == [("q1", 1, "https://a.org", 1), ("q2", 1, "https://b.org/x", 1), ("q2", 2, "https://c.org", 2)]
