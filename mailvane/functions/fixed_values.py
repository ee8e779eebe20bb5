"""Fixed values.

Word lists, phrases, weights and thresholds that define the results of the
featurizers and the risk rules.  They are data, not logic: a corpus vectorized
with other values would not be comparable.  List order is significant for
``BRAND_DOMAINS`` and ``MALWARE_PHRASES`` (first match wins).
"""

# --- feature hashing -------------------------------------------------------
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
ENHANCED_DIM = 256
COUNTS_DIM = 128
BIGRAM_WEIGHT = 0.7
TRIGRAM_WEIGHT = 0.3
LEET_PASS_WEIGHT = 0.5

LEET_FROM = "01345@$!"
LEET_TO = "oleasasi"

ATTACK_BOOST = {
    "urgent": 2.0, "immediately": 2.0, "expire": 2.0, "suspend": 2.0,
    "locked": 2.0, "unauthorized": 2.0, "compromised": 2.0,
    "password": 1.8, "credential": 1.8, "verify": 1.8, "confirm": 1.8,
    "ssn": 2.0, "social": 1.5, "security": 1.5,
    "wire": 2.0, "transfer": 1.8, "payment": 1.5, "invoice": 1.5,
    "bank": 1.5, "account": 1.3,
    "click": 1.5, "download": 1.5, "attachment": 1.5, "open": 1.3,
}

SPAM_BOOST = {
    "congratulations": 1.8, "winner": 2.0, "lottery": 2.0, "prize": 2.0,
    "free": 1.8, "discount": 1.5, "offer": 1.3, "limited": 1.5,
    "guaranteed": 1.8, "miracle": 2.0, "amazing": 1.5,
    "unsubscribe": 1.5, "buy": 1.3, "cheap": 1.5, "deal": 1.3,
}

STOP_WORDS = """
the a an is are was were be been being
have has had do does did will would could should
may might shall can
it its this that these those
i me my we our you your
he she they them their his her
of in to for on with at by from as into
and or but not no if then than so very
just about up out all also
subject body
""".split()

# --- risk rules ------------------------------------------------------------
BRAND_DOMAINS = [
    "paypal.com", "google.com", "microsoft.com", "apple.com",
    "amazon.com", "facebook.com", "netflix.com", "linkedin.com",
    "chase.com", "wellsfargo.com", "bankofamerica.com", "citibank.com",
    "dropbox.com", "docusign.com", "adobe.com", "zoom.us",
]
TYPOSQUAT_MIN_SIMILARITY = 0.7

URGENCY_TERMS = [
    "urgent", "immediately", "asap", "right away",
    "expire", "expires", "expiring", "expired",
    "suspend", "suspended", "terminate", "terminated",
    "lock", "locked", "block", "blocked",
    "restricted", "limit", "deadline",
    "within 24 hours", "within 48 hours", "act now",
    "final notice", "last chance", "warning",
    "critical", "alert",
]
URGENCY_STRIP = ".,!?;:\"'"

CREDENTIAL_PHRASES = [
    "password", "passwd", "credential", "login",
    "verify your", "confirm your", "update your",
    "social security", "ssn", "date of birth",
    "credit card", "card number", "cvv", "expiry",
    "bank account", "routing number", "account number",
    "sign in", "log in", "reset your password",
]

FINANCIAL_PHRASES = [
    "wire transfer", "bank transfer", "send money",
    "payment", "invoice attached", "overdue payment",
    "process this transfer", "routing number",
    "bitcoin", "cryptocurrency", "gift card",
]

LINK_PHRASES = ["click here", "click below", "click the link", "http://"]

MALWARE_PHRASES = [
    "attachment", "attached document", "attached file",
    "download", "open the document", "enable macros",
    "enable content", ".exe", ".zip", ".scr", ".bat",
]

RISK_WEIGHTS = {
    "reply_to_mismatch": 0.2,
    "return_path_mismatch": 0.1,
    "spf": 0.15,
    "dkim": 0.15,
    "dmarc": 0.1,
    "typosquat": 0.25,
    "urgency": 0.15,
    "credential": 0.15,
    "financial": 0.15,
    "links": 0.1,
    "malware": 0.1,
}
URGENCY_SIGNAL_ABOVE = 0.3
CEO_FRAUD_URGENCY_ABOVE = 0.2
RISK_HIGH_ABOVE = 0.6
RISK_MEDIUM_ABOVE = 0.3

# --- classification --------------------------------------------------------
CATEGORIES = ["safe", "spam", "attack"]  # also the tie-break order
VOTE_K = 5
DEFAULT_TOP_K = 10
MIN_SECOND_SCORE = 0.0001

# --- vector tables ---------------------------------------------------------
COSINE_EPS = 1e-30
SIMILARITY_EPS = 1e-9

# --- character classes -----------------------------------------------------
# Unicode White_Space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
URL_PREFIXES = ["https://", "http://", "www."]
URL_END_CHARS = " \t\n\r<>\"'"
URL_TRAILING = ".,;!?()[]"
URL_MIN_BYTES = 5
