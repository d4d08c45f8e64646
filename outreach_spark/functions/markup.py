"""Links of a page as Column expressions: one pass of one pattern cuts the page into comments, raw-text elements, links
and other tags, so a link is found where a browser finds one.

Quoted, unquoted and upper-case attributes, ``>`` and ``<a`` inside quoted values, markup inside a link, entities, links that
nothing closes (the next link or the end of the page does), scripts and comments are read as HTML has it. Every loop is
possessive and every token may end with the page, so no place is tried twice: the time is linear in the page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between a tag's name and its end; only the values after ``=`` are quoted.
ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+|["'])*+"""
COMMENT = r"!--.*?(?:-->|\z)"
RAW_TEXT = rf"(?:script|style|textarea|title)(?=[\s/>]){ATTRIBUTES}(?:>|\z).*?(?:</(?:script|style|textarea|title)(?=[\s/>])|\z)"
TAG = rf"[a-z/!?]{ATTRIBUTES}(?:>|\z)"
#: A link's own tag and what follows up to the next link, its end tag or the end of the page.
LINK = rf"a(?=[\s/>]){ATTRIBUTES}(?:>|\z)(?:[^<]++|<(?:{COMMENT}|{RAW_TEXT}|(?!/?a(?:[\s/>]|\z)){TAG}|(?![a-z/!?])))*+"
#: Group 1: a link from behind its ``<``; empty for other tokens.
TOKEN = rf"(?is)<(?:{COMMENT}|{RAW_TEXT}|({LINK})|{TAG})"
#: Groups of a link: its attributes, what it holds.
LINK_PARTS = rf"(?is)^a({ATTRIBUTES})(?:>|\z)(.*)$"
#: What of a link is not shown.
ANY_TAG = rf"(?is)<(?:{COMMENT}|(?:script|style)(?=[\s/>]){ATTRIBUTES}(?:>|\z).*?(?:</(?:script|style)(?=[\s/>]){ATTRIBUTES}(?:>|\z)|\z)|{TAG})"
#: Group 1: the value of the first attribute named href, with the quote before it.
HREF = r"""(?is)^[\s/]*+(?:(?!href(?:[\s=/>]|\z))[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"?+|'[^']*+'?+|[^\s>"'][^\s>]*+)?+)?+[\s/]*+)*+""" \
       r"""href\s*+=\s*+("[^"]*+|'[^']*+|[^\s>"'][^\s>]*+)"""

#: The named entities that are read, beside all numeric ones: those of XML, and those that addresses and links are
#: written with.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "commat": "@", "period": ".", "sol": "/",
    "colon": ":", "num": "#", "quest": "?", "equals": "=", "hyphen": "\u2010", "lowbar": "_", "percnt": "%", "plus": "+",
}


def decode_entities(text: Column) -> Column:
    """Character references resolved; those that name nothing stay as they are."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(part: Column) -> Column:
        """What follows an ampersand."""
        digits = F.regexp_extract(part, r"^#([0-9]{1,7})", 1)
        hexes = F.regexp_extract(part, r"(?i)^#x([0-9a-f]{1,6})", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        name = F.regexp_extract(part, r"^([A-Za-z]+);", 1)
        return (F.when(good, F.concat(char, F.regexp_replace(part, r"(?i)^#(?:x[0-9a-f]{1,6}|[0-9]{1,7});?", "")))
                .when((name != "") & named[name].isNotNull(), F.concat(named[name], F.regexp_replace(part, r"^[A-Za-z]+;", "")))
                .otherwise(F.concat(F.lit("&"), part)))

    parts = F.split(text, "&", -1)
    decoded = F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def links(html: str | Column) -> Column:
    """The page's links in order: ``array<struct<href, text>>``. ``href`` is decoded and trimmed, empty without one; ``text`` is
    what the link shows, blanks collapsed."""
    page = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    found = F.filter(F.regexp_extract_all(page, F.lit(TOKEN), 1), lambda x: x != "")

    def link(x: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(F.regexp_extract(x, LINK_PARTS, 1), HREF, 1), "^[\"']", "")
        shown = decode_entities(F.regexp_replace(F.regexp_extract(x, LINK_PARTS, 2), ANY_TAG, ""))
        return F.struct(F.trim(decode_entities(value)).alias("href"), F.trim(F.regexp_replace(shown, r"[\s\u00a0]+", " ")).alias("text"))

    return F.transform(found, link)
