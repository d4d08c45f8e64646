"""Fixed values the operators must share with the application they re-implement.

Everything below is a fixed value (word lists, prefixes, patterns, defaults); the operators
read them from here so that a job can override them as parameters.
"""

# ---- fixed values: search-hit blacklist terms (matched as substrings of lower-cased url, snippet, title)
BLACKLIST_TERMS = [
    "blogpost", "how-to", "guide", "article", "listing", "directory",
    "review", "roundup", "tips", "tricks", "rontar.com", "langfaq.com",
    "englishsumup.com", "grammarsir.com", "englishoverview.com",
]

# ---- fixed values: phrases a draft must not contain (case-insensitive substrings)
BANNED_PHRASES = [
    "I hope this email finds you well", "I came across your work",
    "thrilled to reach out", "exciting opportunity", "leverage", "synergy",
    "touch base", "circle back", "as per my last email", "I wanted to reach out",
    "please don't hesitate", "at your earliest convenience", "going forward",
    "hope you're doing well", "I am writing to", "I would like to",
    "Dear Author", "To Whom It May Concern", "Just following up",
    "Circling back", "Bumping this", "Wanted to check in",
]

# ---- fixed values: email pattern used for extraction from free text and pages
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# ---- fixed values: generic address prefixes rejected for a page / author email
GENERIC_PREFIXES = [
    "support@", "info@", "noreply@", "webmaster@", "sales@", "service@",
    "admin@", "office@", "help@", "press@", "media@",
]

# ---- fixed values: words that disqualify an email found in context text
CONTEXT_EXCLUDED_WORDS = ["support", "info", "noreply"]

# ---- fixed values: role-based prefixes rejected by verification
ROLE_PREFIXES = [
    "admin@", "info@", "noreply@", "support@", "team@", "sales@", "marketing@", "webmaster@",
]

# ---- fixed values: contact / about link choices, in order of preference
# (link text contains ...; then href contains ...)
CONTACT_LINK_TEXTS = ["Contact", "About", "Reach", "Get in touch"]
CONTACT_LINK_HREFS = ["contact", "about"]

# ---- fixed values: reply labels; not_interested is tested before interested (it contains it)
REPLY_LABELS_IN_TEST_ORDER = ["not_interested", "interested", "asking_price", "wrong_person", "other"]
REPLY_LABEL_UNKNOWN = "unknown"

# ---- fixed values: tones for invitation drafts
TONES = [
    "warm_professional", "genuinely_curious", "quietly_enthusiastic",
    "matter_of_fact_warm", "respectfully_admiring",
]

# ---- fixed values: vocabularies
CHANNELS = ["main", "gmail"]

# ---- fixed values: engagement points
OPEN_POINTS = 1
CLICK_POINTS = 5
INTERESTED_RANK_SCORE = 1000

# ---- fixed values: run settings (defaults of the application)
AUTHORS_PER_DAY = 50
GMAIL_AUTHORS_PER_DAY = 20
WARMUP_BASE = {"main": 5, "gmail": 2}
WARMUP_PER_DAY = {"main": 2, "gmail": 1}
DAILY_CAP = {"main": AUTHORS_PER_DAY, "gmail": GMAIL_AUTHORS_PER_DAY}
MAX_BOUNCE_RATE = 0.02
SEND_WINDOW_START_UTC = 13
SEND_WINDOW_END_UTC = 16
FOLLOW_UP_DELAY_DAYS = 4
REPLY_LOOKBACK_DAYS = 7

# ---- fixed values: language-model prices, USD per 1M tokens
PRICE_INPUT_PER_M = 0.59
PRICE_OUTPUT_PER_M = 0.79

# ---- fixed values: dashboard sizes
PAGE_SIZE = 20
ACTIVITY_FEED_SIZE = 50
SYSTEM_LOG_SIZE = 100
TOP_LEADS_SIZE = 10
TOP_GENRES_SIZE = 10
TOP_CONTACTED_SIZE = 5
DAILY_COUNT_DAYS = 30

# ---- fixed values: draft defaults and fallbacks
DEFAULT_INVITATION_SUBJECT = "Invitation to Feature Your Book"
DEFAULT_SMART_FOLLOWUP_SUBJECT = "Following up"
DEFAULT_ORIGINAL_SUBJECT = "Invitation"
FALLBACK_BOOK_TITLE = "their book"
FALLBACK_TEXT = "Not available"
FALLBACK_GENRE = "General Fiction"
INVITATION_DESCRIPTION_CHARS = 400
FOLLOWUP_DESCRIPTION_CHARS = 300
BIO_CHARS = 300
EXPORT_DESCRIPTION_CHARS = 200

# ---- fixed values: catalogue source names and the fixed public-domain description
SOURCE_GOOGLE_BOOKS = "Google Books"
SOURCE_OPEN_LIBRARY = "Open Library"
SOURCE_LOC = "Library of Congress"
SOURCE_GUTENDEX = "Project Gutenberg"
SOURCE_WEB_SEARCH = "Web Search"
GUTENDEX_DESCRIPTION = "Classic/Public Domain seed"

# log and message texts (fixed values)
LOG_OPENED = "Email opened by author "
LOG_CLICKED = "Link clicked by author "
LOG_GMAIL_SUFFIX = " (Gmail)"
LOG_REPLY_MAIN = "Reply from main channel author: "
LOG_REPLY_GMAIL = "Reply from Gmail channel author: "
LOG_REPLY_WEBHOOK = "Reply received via webhook from: "
REPLY_SUBJECT = "Re: Invitation"
REPLY_SUBJECT_WEBHOOK = "Re: Invitation (Webhook)"

# reasons of the verifier, by its verdict (fixed values)
VERIFY_REASONS = {
    "INVALID_SYNTAX": "Regex/Syntax failed",
    "ROLE_BASED": "Role-based email",
    "MX_NOT_FOUND": "No MX record",
    "SMTP_550": "User does not exist",
}
NO_ANSWER_REASON = "No answer from mail server"

# texts of the run's gates (fixed values)
BREAKER_TEXT = "CIRCUIT BREAKER TRIPPED: Bounce rate (%.1f%%) exceeds threshold (%.1f%%)."
WINDOW_TEXT = "Smart Scheduling: Current hour {hour} UTC is outside the window ({start}-{end}). Pausing pipeline."
