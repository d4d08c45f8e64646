"""Links of a page: against the standard library's parser on random markup, hand cases, and linear time."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from outreach_spark.functions import emails as EM
from outreach_spark.functions.markup import decode_entities, links
from outreach_spark.operators import extract


class Reference(HTMLParser):
    """(href, shown text) of every link; a link ends at the next one, at its end tag or with the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            hrefs = [v for k, v in attrs if k == "href"]
            self.found.append([(hrefs[0] or "") if hrefs else "", ""])
            self.open = True

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = False

    def handle_data(self, data):
        if self.open and self.cdata_elem is None:
            self.found[-1][1] += data

    def links(self, html):
        self.feed(html)
        self.close()
        return [(h.strip(" "), re.sub("[\\s\u00a0]+", " ", t).strip(" ")) for h, t in self.found]


def found(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(8)
    got = {r.i: [(x.href, x.text) for x in r.links] for r in df.select("i", links("html").alias("links")).collect()}
    return [got[i] for i in range(len(pages))]


def random_page(rng):
    values = ["/contact", "x.html", "a&amp;b", "mailto:jo&#64;x.org", "&#x2F;about", "q?a=1&b=2", "A > B", "it's", "&unknown;", "&lt;i&gt;", "\u00e9t\u00e9"]

    def attribute():
        name = rng.choice(["href", "HREF", "class", "data-href", "title", "id"])
        value = rng.choice(values)
        form = rng.randrange(4)
        if form == 0:
            return f'{name}="{value}"'
        if form == 1 and "'" not in value:
            return f"{name} = '{value}'"
        if form == 2 and not re.search(r"[\s\"'=<>`&]", value):
            return f"{name}={value}"
        return rng.choice(["hidden", f'{name}="{value}"'])

    def piece(depth=0):
        kind = rng.randrange(9)
        if kind < 3:
            inner = "".join(piece(depth + 1) for _ in range(rng.randrange(3))) if depth < 2 else "t"
            tag = rng.choice(["a", "A"])
            return f"<{tag} {' '.join(attribute() for _ in range(rng.randrange(4)))}>{inner}" + rng.choice([f"</{tag}>", f"</{tag}>", ""])
        if kind == 3:
            return f"<{rng.choice(['p', 'abbr', 'B', 'article'])} {attribute()}>{rng.choice(values)}</p>"
        if kind == 4:
            return "<!-- <a href=no>no</a> -->"
        if kind == 5:
            return "<script>var x = '<a href=no>no</a>';</script>"
        return rng.choice(["Contact us ", "caf\u00e9 &amp; bar", " \n ", "1 < 2 ", "&nbsp;x"])

    return "".join(piece() for _ in range(rng.randrange(1, 8)))


def test_links_agree_with_the_standard_parser(spark):
    rng = random.Random(8)
    pages = [random_page(rng) for _ in range(1500)]
    got = found(spark, pages)
    for page, links_found in zip(pages, got):
        assert links_found == Reference().links(page), page
    assert sum(map(len, got)) > 2000


@pytest.mark.parametrize("html, want", [
    ("<a href=/contact>Contact", [("/contact", "Contact")]),
    ("<A HREF = /c?a=1&amp;b=2 >x</A>", [("/c?a=1&b=2", "x")]),
    ("<a title='<a href=no>' href=\"y\">x<b title='>'>y</b></a>", [("y", "xy")]),
    ("<a href=x href=y>t</a>", [("x", "t")]), ("<a href>t</a>", [("", "t")]), ("<a>t</a>", [("", "t")]),
    ("<abbr href=x>t</abbr><a/href=y>t</a>", [("y", "t")]),
    ("<a href='x", [("x", "")]), ("<a href=\"x>y</a><a href=z>", [("x>y</a><a href=z>", "")]),
    ("<!-- <a href=x>t</a>", []), ("<script><a href=x></script><a href=y>", [("y", "")]), ("<a href=1>one<a href=2>two", [("1", "one"), ("2", "two")]),
    ("", []), (None, [])])
def test_hand_cases(spark, html, want):
    assert found(spark, [html]) == [want]


def test_entities(spark):
    cases = {"a&amp;b&lt;c": "a&b<c", "&#64;&#x40;&#X40;&commat;": "@@@@", "&#128512;": "\U0001f600", "&": "&", "&&amp;&": "&&&", "&#0;&#1114112;&#xD800;": "&#0;&#1114112;&#xD800;",
             "&nope; &amp": "&nope; &amp", "&#65": "A", "x": "x"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", decode_entities(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == cases


def test_links_lead_to_addresses_and_subpages(spark):
    html = "<a href=&#109;ailto:Jane&#64;x.org?subject=1>me</a><a href=/contact>reach</a><a href=''>Contact</a>"
    pages = spark.createDataFrame([(1, "https://x.org/a/b.html", html)], "page_id bigint, url string, html string")
    assert pages.select(EM.page_mailto("html").alias("m")).first().m == "Jane@x.org"
    r = extract.contact_subpage_links(pages).first()
    assert (r.href, r.subpage_url) == ("/contact", "https://x.org/contact")  # the link that leads nowhere is none


@pytest.mark.parametrize("unit", ["<a href=x>t", "<a \"", "<a href=\"", "<a href='x' ", "<!--", "<script>", "<a href=x &amp;", "<p title='", "</a", "<a x=1 y=2 ", "<a><"])
def test_time_is_linear_in_the_page(spark, unit):
    def seconds(n):
        html = spark.range(1).select(F.repeat(F.lit(unit), n // len(unit)).alias("html"))
        t = time.time()
        html.select(F.size(links("html")).alias("n")).collect()
        return time.time() - t

    seconds(1000)
    assert seconds(4_000_000) < 20
