"""Patterns and constants that the native and the Python functions share."""

from __future__ import annotations

# Grammar of typed values.  NUM has no right bound, so 1234.567 gives 1234.56.
CURRENCY = r"(?:€|EUR|&euro;|\$|USD|CHF|£|GBP)"
NUM = r"\d{1,3}(?:[.,'  ]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"
TYPED = {
    "price": rf"(?i)(?:{CURRENCY}\s?(?:{NUM})|(?:{NUM})\s?{CURRENCY})",
    "area": rf"(?i)(?:{NUM})\s?(?:m²|m2|qm|sqm|㎡)",
    "number": rf"-?(?:{NUM})",
    "integer": r"-?\d+",
    "date": r"\b(?:\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}-\d{2}-\d{2})\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?\d[\d ()/\-]{5,}\d",
    "url": r"https?://[^\s\"'<>]+",
}
FIELD_TYPES = frozenset({"text", *TYPED})
NUMERIC = frozenset({"price", "area", "number", "integer"})
#: White space as HTML source may write it, and typed values as they stand in source.
SOURCE_WS = r"(?:\s|&nbsp;|&#160;|&#xa0;)"
CAPTURES = {
    "price": rf"(?:{CURRENCY}{SOURCE_WS}*(?:{NUM})|(?:{NUM}){SOURCE_WS}*{CURRENCY})",
    "area": rf"(?:{NUM}){SOURCE_WS}*(?:m²|m2|qm|sqm|m&sup2;|㎡)",
    "date": r"(?:\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}-\d{2}-\d{2})",
    **{t: TYPED[t] for t in ("number", "integer", "email", "phone", "url")},
}
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
LABEL_CHARS, LOOK_AHEAD, TEXT_CHARS, MAX_CHARS = 60, 8, 300, 500
REPEATS = 3
PROVENANCE = ("AGENT_TAUGHT", "ENGINE_OBSERVED", "CROSS_CONFIRMED")
ROLES = ("primary", "fallback", "candidate", "retired")
KIND_RANK = {"json": 3, "regex": 2, "label": 1}
STALE_AFTER, MAX_ALTERNATIVES, KEEP_RETIRED, PROMOTE_HITS = 2, 3, 16, 2
SHELL_SCORE = 0.6
# Words of page controls, after folding.
LAST_WORDS = ["last", "lastpage", "letzte", "letzter", "letzte seite", "ende", ">>", ">>>", "»»", "››", "≫", "⏭"]
NEXT_WORDS = ["next", "nextpage", "weiter", "naechste", ">", "›", "→", "»"]
PREV_WORDS = ["prev", "previous", "zurueck", "<", "‹", "←", "«"]
FIRST_WORDS = ["first", "erste", "erste seite", "<<", "<<<", "««", "‹‹", "≪"]
# Signs of a page that asks for a human.
TECHNICAL_MARKERS = ["g-recaptcha", "grecaptcha", "h-captcha", "hcaptcha.com", "cf-chl-", "challenge-platform", "cf_chl_opt", "cf-turnstile", "captcha-delivery", "datadome", "px-captcha", "_incapsula_"]
PHRASE_MARKERS = ["are you a robot", "are you human", "verify you are human", "unusual traffic", "access denied", "bitte bestätigen sie, dass sie kein roboter sind"]
CHALLENGE_STATUSES = [202, 401, 403, 503]
THIN_CHARS = 600
#: White space as Unicode has it, for Java's and RE2's classes.
UNI_WS = r"[\x{9}-\x{d} \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
