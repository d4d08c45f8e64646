"""Text rules as Column expressions: blacklist, names, phrases, templates, drafts, labels, hashing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(text: str | Column, terms: list[str]) -> Column:
    """Case-insensitive substring test against a fixed term list, as one literal alternation."""
    pattern = "|".join(re.escape(t.lower()) for t in terms)
    return F.coalesce(F.lower(_c(text)).rlike(pattern), F.lit(False))


def is_blacklisted(url: str | Column, snippet: str | Column, title: str | Column,
                   terms: list[str] = K.BLACKLIST_TERMS) -> Column:
    """Any term in lower(url), lower(snippet) or lower(title)."""
    return contains_any(url, terms) | contains_any(snippet, terms) | contains_any(title, terms)


def name_from_title(title: str | Column) -> Column:
    """Text after the last whole word 'by', then before the first '|', trimmed (D23: word boundary)."""
    t = F.coalesce(_c(title), F.lit(""))
    after_by = F.regexp_extract(t, r"^.*\bby\b(.*)$", 1)
    base = F.when(t.rlike(r"\bby\b"), after_by).otherwise(t)
    return F.trim(F.split_part(base, F.lit("|"), F.lit(1)))


def _phrase_hits(text: str | Column, phrases: list[str]) -> list[Column]:
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    return [F.when(low.rlike(re.escape(p.lower())), F.lit(p)) for p in phrases]


def matched_phrases_text(text: str | Column, phrases: list[str] = K.BANNED_PHRASES, sep: str = "|") -> Column:
    """The phrases (in list order) that occur case-insensitively in the text, joined by ``sep``. Each phrase is a
    literal pattern of its own over the lowered text: Java searches it by skipping ahead (Boyer-Moore), several times
    faster than ``contains``, which tries every position, and than one alternation of the phrases."""
    return F.concat_ws(sep, *_phrase_hits(text, phrases))


def matched_phrase_count(text: str | Column, phrases: list[str] = K.BANNED_PHRASES) -> Column:
    return sum((F.when(h.isNotNull(), 1).otherwise(0) for h in _phrase_hits(text, phrases)), F.lit(0))


def word_count(text: str | Column) -> Column:
    """Number of whitespace-separated words (runs of non-whitespace). The pattern finds only the rare whitespace
    other than blanks; cutting at one plain character needs none, and a pattern's match per word costs several times the cut."""
    blanks = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\t\n\r\f]+", " ")
    return F.size(F.array_remove(F.split(blanks, " "), ""))


TOKEN_PATTERN = r"\{\{([A-Z_]+)\}\}"


def unfilled_tokens(text: str | Column) -> Column:
    """Placeholder names still present in a draft, in order."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN_PATTERN), 1)


def template_parts(template: str, declared) -> list[tuple[str, str]]:
    """Split a template into ("lit", text) and ("tok", NAME) parts; undeclared tokens stay literal text."""
    parts: list[tuple[str, str]] = []
    for piece in re.split(r"(\{\{[A-Z_]+\}\})", template):
        m = re.fullmatch(r"\{\{([A-Z_]+)\}\}", piece)
        if m and m.group(1) in declared:
            parts.append(("tok", m.group(1)))
        elif piece:
            if parts and parts[-1][0] == "lit":
                parts[-1] = ("lit", parts[-1][1] + piece)
            else:
                parts.append(("lit", piece))
    return parts


def fill_template(template: str | Column, tokens: dict[str, Column]) -> Column:
    """Put each declared ``{{TOKEN}}``'s value in place; unknown tokens stay as they are.

    A template given as text is split once when the plan is built, so each row is one ``concat`` of
    literals and values (no search); values are inserted verbatim, never re-expanded. A template
    column is filled with one ``replace`` per declared token.
    """
    if isinstance(template, str):
        cols = [F.lit(v) if kind == "lit" else F.coalesce(tokens[v], F.lit("")) for kind, v in template_parts(template, tokens)]
        return F.concat(*cols) if cols else F.lit("")
    out = template
    for name, value in tokens.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


def _split_first_line(t: Column):
    """First line, the rest, and whether the first line is a subject line, of a whitespace-stripped text."""
    nl = F.instr(t, "\n")
    first = F.when(nl > 0, F.substring(t, F.lit(1), nl - 1)).otherwise(t)
    rest = F.when(nl > 0, F.substr(t, nl + 1)).otherwise(F.lit(""))
    has_subject = F.upper(F.substring(t, 1, 8)) == F.lit("SUBJECT:")
    return first, rest, has_subject


def draft_subject(text: str | Column, default: str, stripped: bool = False) -> Column:
    """Subject from a first line starting with 'SUBJECT:' (any case), else the default. ``stripped``: the text has
    been whitespace-stripped already (a column of its own, so that it isn't stripped again at each use)."""
    first, _, has_subject = _split_first_line(_c(text) if stripped else strip_ws(F.coalesce(_c(text), F.lit(""))))
    return F.when(has_subject, strip_ws(F.substr(first, F.lit(9)))).otherwise(F.lit(default))


def draft_body(text: str | Column, stripped: bool = False) -> Column:
    """The text after a 'SUBJECT:' first line (or the whole text), whitespace-stripped."""
    t = _c(text) if stripped else strip_ws(F.coalesce(_c(text), F.lit("")))
    _, rest, has_subject = _split_first_line(t)
    return F.when(has_subject, F.ltrim(rest, F.lit(WS_CHARS))).otherwise(t)  # the end is stripped already


def paragraphs_html(body: str | Column) -> Column:
    """The body (whitespace-stripped, as ``draft_body`` gives it) cut at blank lines, each part in <p>...</p>. Only
    runs of several blank lines need a pattern."""
    b = F.coalesce(_c(body), F.lit(""))
    gap = F.lit("</p><p>")
    joined = F.when(F.contains(b, F.lit("\n\n\n\n")), F.regexp_replace(b, F.lit("(?:\n\n)+"), gap)).otherwise(F.replace(b, F.lit("\n\n"), gap))
    return F.when(b == "", F.lit("")).otherwise(F.concat(F.lit("<p>"), joined, F.lit("</p>")))


def add_tracking_pixel(html: str | Column, pixel: Column) -> Column:
    """Put the pixel before </body> when present, else append it."""
    h = _c(html)
    return F.when(h.contains("</body>"), F.replace(h, F.lit("</body>"), F.concat(pixel, F.lit("</body>")))).otherwise(
        F.concat(h, pixel)
    )


def normalise_sentiment(model_output: str | Column) -> Column:
    """Model text -> label. NULL -> unknown; first label contained wins, not_interested tested first."""
    t = F.lower(F.trim(_c(model_output)))
    expr = F.lit("other")
    for label in reversed(K.REPLY_LABELS_IN_TEST_ORDER):
        expr = F.when(F.contains(t, F.lit(label)), F.lit(label)).otherwise(expr)
    return F.when(_c(model_output).isNull(), F.lit(K.REPLY_LABEL_UNKNOWN)).otherwise(expr)


def ab_variant(key: str | Column) -> Column:
    """P20: deterministic A/B split: first hex digit of md5(id) below '8' -> A."""
    return F.when(F.substring(F.md5(_c(key).cast("string")), 1, 1) < F.lit("8"), F.lit("A")).otherwise(F.lit("B"))


HEX = "0123456789abcdef"


def hash_byte(key: str | Column, salt: str) -> Column:
    """First byte (0..255) of md5(key || salt), from its two leading hex digits."""
    h = F.md5(F.concat(_c(key).cast("string"), F.lit(salt)))
    return (F.instr(F.lit(HEX), F.substring(h, 1, 1)) - 1) * 16 + (F.instr(F.lit(HEX), F.substring(h, 2, 1)) - 1)


def tone(key: str | Column, salt: str = "tone") -> Column:
    """One of the fixed tones by a hash bucket over md5(id || salt)."""
    bucket = hash_byte(key, salt) % len(K.TONES)
    return F.element_at(F.array(*[F.lit(t) for t in K.TONES]), (bucket + 1).cast("int"))


WS_CHARS = " \t\n\r\f"


def strip_ws(c: str | Column) -> Column:
    """Remove leading and trailing whitespace (space, tab, newline, carriage return, form feed)."""
    return F.trim(_c(c), F.lit(WS_CHARS))
