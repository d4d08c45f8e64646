"""Email rules as Column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .markup import links


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def email_key(email: str | Column) -> Column:
    """Normalised join key for an address: lower(trim(email)); '' becomes NULL."""
    return F.nullif(F.lower(F.trim(_c(email))), F.lit(""))


def extract_emails(text: str | Column, pattern: str = K.EMAIL_PATTERN) -> Column:
    """All matches of the email pattern in a text, in order (array<string>).

    Texts without an '@' cannot match; they skip the regex scan (a cheap byte search first).
    """
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(F.instr(t, "@") > 0, F.regexp_extract_all(t, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))


def _prefix_alternation(prefixes: list[str]) -> str:
    return "^(" + "|".join(re.escape(p) for p in prefixes) + ")"


def has_generic_prefix(email: str | Column, prefixes: list[str] = K.GENERIC_PREFIXES) -> Column:
    """True when lower(email) starts with one of the generic prefixes (support@, info@, ...)."""
    return F.lower(_c(email)).rlike(_prefix_alternation(prefixes))


def is_personal_email(email: str | Column, prefixes: list[str] = K.GENERIC_PREFIXES) -> Column:
    """The address is acceptable as a person's address."""
    return ~has_generic_prefix(email, prefixes)


def context_email(text: str | Column, excluded: list[str] = K.CONTEXT_EXCLUDED_WORDS) -> Column:
    """First email in the text whose lower-case form contains none of the excluded words."""
    ok = F.filter(
        extract_emails(text),
        lambda e: ~F.lower(e).rlike("(" + "|".join(re.escape(w) for w in excluded) + ")"),
    )
    return F.get(ok, 0)


def mailto_targets(html: str | Column) -> Column:
    """P5 helper: mailto targets of the page's links in document order, query part removed, trimmed."""
    hrefs = F.transform(links(html), lambda x: x["href"])
    mails = F.filter(hrefs, lambda h: F.lower(F.substring(h, 1, 7)) == "mailto:")
    return F.transform(mails, lambda h: F.trim(F.split_part(F.substring(h, F.lit(8), F.length(h)), F.lit("?"), F.lit(1))))


def page_mailto(html: str | Column) -> Column:
    """P5: first acceptable mailto target of a page."""
    return F.get(F.filter(mailto_targets(html), lambda e: (e != "") & is_personal_email(e)), 0)


def page_regex_email(html: str | Column) -> Column:
    """First acceptable email found anywhere in the page text."""
    return F.get(F.filter(extract_emails(html), lambda e: is_personal_email(e)), 0)


def page_email(html: str | Column) -> Column:
    """Mailto first, then the pattern over the page."""
    return F.coalesce(page_mailto(html), page_regex_email(html))


# P10: syntax check. A documented, portable pattern (one local part, one domain with a dot-separated TLD);
# the full RFC grammar of the application's library is not reproduced.
SYNTAX_PATTERN = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+$"


def email_syntax_ok(email: str | Column) -> Column:
    return F.coalesce(_c(email).rlike(SYNTAX_PATTERN), F.lit(False))


def is_role_address(email: str | Column, prefixes: list[str] = K.ROLE_PREFIXES) -> Column:
    """Role-based address (admin@, info@, ...)."""
    return F.lower(_c(email)).rlike(_prefix_alternation(prefixes))


def email_domain(email: str | Column) -> Column:
    """Domain after the first '@', lower-cased, trimmed, trailing dots / slashes removed."""
    dom = F.lower(F.trim(F.split_part(_c(email), F.lit("@"), F.lit(2))))
    return F.nullif(F.regexp_replace(dom, r"[./]+$", ""), F.lit(""))


def sender_address(from_header: str | Column) -> Column:
    """Address inside <...> when present, else the whole header; trimmed, lower-cased."""
    h = _c(from_header)
    inside = F.regexp_extract(h, r"<([^>]*)>?", 1)
    return F.nullif(F.lower(F.trim(F.when(h.contains("<"), inside).otherwise(h))), F.lit(""))


def mask_email(email: str | Column) -> Column:
    """First character, '***@', domain; 'N/A' without an address."""
    e = _c(email)
    return F.when(
        e.isNull() | (e == ""), F.lit("N/A")
    ).otherwise(F.concat(F.substring(e, 1, 1), F.lit("***@"), F.split_part(e, F.lit("@"), F.lit(2))))
