"""Word lists, patterns, limits and formats that results depend on."""

# --- job rows -----------------------------------------------------------------------------------
JOB_FIELDS = [
    "company", "title", "location", "department", "posted", "employment_type", "job_id", "apply_url",
]

# Sheet columns, in order: key -> label.
SHEET_COLUMNS = {
    "company": "Company",
    "title": "Title",
    "location": "Location",
    "department": "Department",
    "posted": "Posted",
    "employment_type": "Employment Type",
    "score": "Score",
    "ai_fit": "AI Fit",
    "ai_score": "AI Score",
    "ai_reason": "AI Reason",
    "job_id": "Job ID",
    "apply_url": "Apply URL",
}
SHEET_CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

# --- text and urls ------------------------------------------------------------------------------
LABEL_PREFIX = (
    r"^(location|locations|department|team|category|posted( on)?|date posted|job id|req(uisition)? id)"
    r"\s*[:\-–]?\s+"
)
TRACKING_PARAMS = r"^(utm_.*|gh_src|source|src|ref|lever-source.*|trk.*)$"
MAX_QUERY_CHARS = 120

# --- scoring ------------------------------------------------------------------------------------
TITLE_KEYWORDS = {
    r"software": 5,
    r"engineer(ing)?": 5,
    r"developer": 4,
    r"sde|swe": 4,
    r"back[- ]?end": 3,
    r"front[- ]?end": 3,
    r"full[- ]?stack": 3,
    r"intern(ship)?": 2,
    r"senior|sr\.?": -10,
    r"staff|principal|director|manager|head": -8,
}
LOCATION_KEYWORDS = {
    r"india|bengaluru|bangalore|hyderabad|pune|gurugram|gurgaon|noida|mumbai|chennai|delhi": 3,
    r"remote": 2,
}
MIN_SCORE = 5

# --- block pages --------------------------------------------------------------------------------
BLOCK_STATUSES = [403, 429, 503]
CHALLENGE_MARKERS = [
    "challenges.cloudflare.com",
    "cf-chl",
    "just a moment...",
    "attention required! | cloudflare",
    "px-captcha",
    "captcha-delivery.com",
    "_incapsula_resource",
    "request unsuccessful. incapsula",
    "access denied</title>",
    "are you a robot",
    "unusual traffic from your computer",
]

# --- capture log --------------------------------------------------------------------------------
# Content type needle -> body file extension, first match wins.
BODY_EXTENSIONS = {
    "json": ".json",
    "html": ".html",
    "javascript": ".js",
    "css": ".css",
    "xml": ".xml",
    "text/plain": ".txt",
}
BODY_SKIP_TYPES = ["image", "media", "font"]
BODY_DATA_TYPES = ["xhr", "fetch", "document"]
BODY_MAX_BYTES = 15 * 1024 * 1024

# --- sites --------------------------------------------------------------------------------------
SUBMIT_KINDS = ["enter", "click", "none"]
PAGINATION_KINDS = ["none", "next", "page_number", "load_more", "scroll"]
SCHEMA_VERSION = 2
DEFAULT_MAX_PAGES = 5
DEGRADED_SHARE = 0.5

# --- pagination controls ------------------------------------------------------------------------
DISABLED_CLASS = r"(?i)(^|[\s_-])disabled($|[\s_-])"
LOAD_MORE = r"\b(load|show|view|see)\s*(more|all)\b|\bmore (jobs|results|roles|positions)\b"

# --- selector building blocks -------------------------------------------------------------------
STATE_CLASS = (
    r"(?i)^(is-|has-|js-)|^(active|selected|hover|hovered|focus|focused|open|opened|visible|hidden|current"
    r"|disabled|expanded|collapsed|odd|even|first|last|clicked|asc|desc|ascending|descending|sorted|sorting)$"
    r"|^sort(ed)?-"
)
CSS_IN_JS_CLASS = r"(?i)^(css|sc|jsx|emotion|styled|svelte|tw)-"
ITEM_ATTRS = r"^(role|itemprop|type|data-.*)$"
SINGLE_ATTRS = r"^(name|aria-label|placeholder|title|rel)$"
INLINE_TAGS = ["span", "a", "b", "strong", "em", "small", "i", "label", "time", "abbr"]

# --- field vocabularies -------------------------------------------------------------------------
LOCATION_WORDS = (
    r"(?i)\b(remote|hybrid|on-?site|in-?office|anywhere|worldwide|india|bengaluru|bangalore|hyderabad|pune|mumbai"
    r"|delhi|gurugram|gurgaon|noida|chennai|kolkata|united states|usa|u\.s\.|united kingdom|uk|london|san francisco"
    r"|new york|seattle|austin|boston|chicago|los angeles|mountain view|palo alto|sunnyvale|san jose|toronto"
    r"|vancouver|dublin|berlin|munich|amsterdam|paris|zurich|singapore|sydney|melbourne|tokyo|tel aviv|warsaw|madrid"
    r"|barcelona|lisbon|stockholm|canada|germany|ireland|france|japan|australia|netherlands|spain|poland|israel"
    r"|brazil|mexico|emea|apac|americas)\b|,\s*[A-Z]{2}\b"
)
DATE_WORDS = (
    r"(?i)\b(\d+\+?\s*(minute|hour|day|week|month|year)s?\s+ago|today|yesterday|just posted|posted"
    r"|\d{4}-\d{2}-\d{2}|\d{1,2}\/\d{1,2}\/\d{2,4}"
    r"|(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(,\s*\d{4})?)\b"
)
DEPARTMENT_WORDS = (
    r"(?i)\b(engineering|software|product|design|data|research|science|machine learning|ai|infrastructure|platform"
    r"|security|it|sales|marketing|finance|legal|operations|people|hr|human resources|recruiting|support|customer"
    r"|success|business|analytics|hardware|devops|sre|mobile|quality|qa|program|communications|g&a)\b"
)
ID_ATTR_SKIP = r"^(class|style|href|src|srcset|alt|title|aria-.*)$"
ID_ATTR_VALUE = r"^[\w.:-]{2,80}$"
ID_ATTR_NAME = r"(?i)id|req|job|posting"
CARD_ATTR_SKIP = r"^(class|style|src|srcset)$"

# --- model verdicts -----------------------------------------------------------------------------
FITS = ["Yes", "Maybe", "No"]
CANDIDATE_PROFILE = """\
- Software engineer looking for Software Engineering roles (Backend / Fullstack / AI)
- Prefers locations in India or remote
- GOOD roles: Software Engineer, SDE, Backend, Fullstack, AI/ML Engineer
- BAD roles: Manager, Sales, HR, Operations, non-technical roles
"""
PROMPT = """You are evaluating how relevant a job posting is for this candidate.

Candidate:
{profile}
Job:
Title: {title}
Company: {company}
Location: {location}
Department: {department}

Reply with JSON only: {{"fit": "Yes" | "Maybe" | "No", "score": 0-10, "reason": "one short sentence"}}"""
