"""Fixed values of the data model: enumerations, name lists and limits that results depend on."""

# Fixed values.
FETCH_REASONS = [
    "ok", "skipped_no_url", "empty_paywall", "empty_js_required", "empty_not_article", "error_dns", "error_timeout", "error_tls", "error_blocked", "error_not_found", "error_server", "error_unsupported_type", "error_too_large", "error_other",
]
PAYWALL_MARKERS = [
    "subscribe to continue", "subscribe to read", "subscription-required", "piano-paywall", "data-paywall", 'id="paywall"', 'class="paywall"', "this article is for subscribers", "become a subscriber", "already a subscriber", "metered_paywall",
]
HTML_TYPES = ["text/html", "application/xhtml+xml"]
MIN_BODY_CHARS = 80
RAN = ["ok", "empty", "error"]
STATUS_RANK = ["ok", "empty", "error", "skipped_no_key", "skipped_out_of_range"]
MERGE_REASONS = ["same_wire", "same_owner", "reprint", "none"]
LABELS = ["fact", "opinion", "unclear"]
STANCE_LABELS = ["entailment", "contradiction", "neutral"]
BACKED = ["corroborated_coverage", "event_corroborated"]
CONTESTED = ["contested_reporting", "contested"]
SAME_ARTICLE = ["exact_url", "title_match", "near_duplicate", "syndicated"]
WIRES = ["Agence France-Presse", "Associated Press", "PA Media", "Bloomberg", "Reuters", "AFP", "ANI", "PTI", "AP"]
TRACKING = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "s", "spm"]
REDIRECTORS = ["news.google.com", "t.co", "lnkd.in", "bit.ly"]
REDIRECT_KEYS = ["url", "u", "q", "redirect"]
PLATFORMS = {"substack.com": "subdomain", "medium.com": "first_path_segment", "wordpress.com": "subdomain", "blogspot.com": "subdomain", "github.io": "subdomain", "x.com": "first_path_segment"}
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "co.in", "com.br", "com.my", "com.sg"]
FAMILIES = {
    "bbc.co.uk": "bbc", "bbc.com": "bbc", "theguardian.com": "guardian", "guardian.co.uk": "guardian", "nytimes.com": "nyt", "reuters.com": "reuters", "apnews.com": "ap", "ap.org": "ap",
    "abc.net.au": "abc_au", "smh.com.au": "nine_au", "theage.com.au": "nine_au", "afr.com": "nine_au", "cnn.com": "cnn", "edition.cnn.com": "cnn", "washingtonpost.com": "wapo", "wsj.com": "wsj",
    "ft.com": "ft", "aljazeera.com": "aljazeera", "theage.com": "nine_au", "news.com.au": "news_corp_au", "theaustralian.com.au": "news_corp_au", "foxnews.com": "fox", "nbcnews.com": "nbc",
    "cbsnews.com": "cbs", "abcnews.go.com": "abc_us", "npr.org": "npr", "politico.com": "politico", "bloomberg.com": "bloomberg",
}
LEGACY = ["bbc", "guardian", "nyt", "reuters", "ap", "abc_au", "wapo", "wsj", "ft", "aljazeera", "npr", "bloomberg", "abc_us", "nbc", "cbs"]
AGGREGATORS = ["news.google.com", "news.yahoo.com", "msn.com", "apple.news", "flipboard.com"]
NEGATIONS = ["not", "never", "false", "denied", "hoax", "untrue", "no"]
_NUMBER_WORDS = [
    "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec", "monday|tuesday|wednesday|thursday|friday|saturday|sunday",
    "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|dozen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|trillion",
]
NUMERIC = r"(?i)\d|" + "|".join(rf"\b(?:{w})\b" for w in _NUMBER_WORDS) + r"|\bper\s+cent\b|\bpercent\b"
# What NUMERIC finds, by first letters, so that a word is tried against fourteen of them and not against all words.
_BY_LETTER = {w[0]: [x[1:] for x in "|".join(_NUMBER_WORDS).split("|") if x[0] == w[0]] for w in "|".join(_NUMBER_WORDS).split("|")} | {"p": [r"er\s+cent", "ercent"]}
NUMERIC_BY_LETTER = r"(?i)\d|\b(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in _BY_LETTER.items()) + r")\b"
SHINGLE_WORDS, SAME_WIRE, REPRINT, DUPLICATE = 5, 0.8, 0.9, 0.9
MAX_EVIDENCE, MAX_CLAIMS, STANCE_THRESHOLD, MAX_BYTES = 12, 5, 0.6, 5_000_000
OVERLAP, PASS_CLAIMS = 0.5, 8
# Quotation marks, primes and dashes, and what they count as.
LIKE_ASCII = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u00ab": '"', "\u00bb": '"', "\u2032": "'", "\u2033": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-",
}
KEYWORDS = 6
LOOKED_UP = ["PERSON", "ORG", "GPE"]
VERB_ENDS = ["ed", "ing", "ises", "izes", "ise", "ize", "ates", "ate", "s"]
NON_VERBS = [
    "is", "was", "are", "were", "be", "been", "being", "has", "have", "had", "does", "did", "this", "his", "its", "as", "us", "news", "press", "series", "process", "business", "access", "analysis", "crisis",
]
SLOTS = ["date", "place", "number", "actor", "other"]
