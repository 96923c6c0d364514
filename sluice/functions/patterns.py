"""Java regular expressions of the text detectors, and the fixed values of entity types.

ASCII word boundaries and the wider set of white space are spelled out, as Java's own differ.
"""

from __future__ import annotations

from dataclasses import dataclass

#: An ASCII word boundary, one-sided ones, and white space that includes no-break and typographic spaces.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"
_BLANK = r"\s   -     　﻿"
SPACE, NOT_SPACE = f"[{_BLANK}]", f"[^{_BLANK}]"


@dataclass(frozen=True)
class Detector:
    """Type, confidence, priority among overlaps, pattern, group of the value, cheap tests that any match passes, and a validator's name. The tests: one of `words`
    lies in the lower-case text, the text has four digits (`FOUR_DIGITS`), and the pattern `hint` is found."""

    type: str
    confidence: float
    priority: int
    pattern: str
    group: int = 0
    hint: str = ""
    words: tuple[str, ...] = ()
    digits: bool = False
    validator: str | None = None


#: Four digits, of a card, too; and the letters beyond ASCII that a pattern which ignores case takes for i, k or s, though lower case leaves them or makes them two.
FOUR_DIGITS = r"\d[ -]?\d[ -]?\d[ -]?\d"
FOLDED = "\u0130\u0131\u017f\u212a"


def _keyed(words: str, tail: str) -> str:
    return rf"(?iu){EDGE}(?:{words}){tail}"


# The types, confidences, priorities and shapes that results must agree on.
DETECTORS: tuple[Detector, ...] = (
    Detector("EMAIL", 0.99, 96, rf"(?iu){EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{EDGE}", words=("@",)),
    Detector("PHONE", 0.96, 91, rf"(?<!\d)(?:\+?91(?:{SPACE}|-)?)?[6-9]\d{{4}}(?:{SPACE}|-)?\d{{5}}(?!\d)", hint=r"[6-9]\d{4}", digits=True),
    Detector("PAN", 0.98, 94, rf"{EDGE}[A-Z]{{5}}\d{{4}}[A-Z]{EDGE}", hint=r"[A-Z]{5}\d{4}", digits=True),
    Detector("GSTIN", 0.99, 95, rf"{EDGE}\d{{2}}[A-Z]{{5}}\d{{4}}[A-Z][1-9A-Z]Z[0-9A-Z]{EDGE}", hint=r"[A-Z]{5}\d{4}", digits=True, validator="gstin"),
    Detector("IFSC", 0.97, 93, rf"{EDGE}[A-Z]{{4}}0[A-Z0-9]{{6}}{EDGE}", hint=r"[A-Z]{4}0", words=("0",)),
    Detector("UPI_ID", 0.94, 92, rf"(?iu){EDGE}[A-Z0-9][A-Z0-9._-]{{1,}}@[A-Z]{{2,}}{EDGE}", words=("@",)),
    Detector("PAYMENT_CARD", 0.99, 98, r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)", digits=True, validator="luhn"),
    # A card beside other digits, as of an address, which the pattern above takes with it: the checksum of both fails.
    Detector("PAYMENT_CARD", 0.99, 98, rf"{EDGE}(?:\d{{4}}[ -]){{3}}\d{{4}}{EDGE}|{EDGE}\d{{13,19}}{EDGE}", hint=r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d", digits=True, validator="luhn"),
    Detector("AADHAAR_LIKE", 0.99, 97, r"(?<!\d)(?:\d{4}[ -]?){2}\d{4}(?!\d)", hint=r"\d{4}[ -]?\d{4}", digits=True, validator="verhoeff"),
    Detector("OTP", 0.98, 101, _keyed("otp|one[ -]?time password|verification code|security code", rf"{EDGE}\D{{0,12}}(\d{{4,8}})"), 1, r"\d{4}", digits=True),
    Detector("PASSWORD", 0.99, 100, _keyed("password|passcode|pin", rf"{SPACE}*[:=]{SPACE}*([^{_BLANK},;]+)"), 1, words=("password", "passcode", "pin")),
    Detector("ACCOUNT_ID", 0.88, 90, _keyed("account|customer|employee|patient", rf"{SPACE}*(?:id|number|no\.?|code){SPACE}*[:#-]?{SPACE}*([A-Z0-9][A-Z0-9-]{{4,24}}){EDGE}"), 1, words=("account", "customer", "employee", "patient")),
    Detector("PERSON_NAME", 0.79, 80, _keyed("name|patient|account holder|employee", rf"{SPACE}*[:=-]{SPACE}*([A-Z][\p{{L}}'-]+(?:{SPACE}+[A-Z][\p{{L}}'-]+){{1,3}})"), 1, words=("name", "patient", "holder", "employee")),
    Detector("ADDRESS", 0.82, 79, _keyed("address|residing at|located at", rf"{SPACE}*[:=-]{SPACE}*([^\n]{{8,160}})"), 1, words=("address", "residing", "located")),
    Detector("MEDICAL", 0.86, 78, _keyed("diagnosis|medical condition|patient history", rf"{SPACE}*[:=-]{SPACE}*([^\n]{{3,120}})"), 1, words=("diagnosis", "condition", "history")),
)
TYPES = (*(d.type for d in DETECTORS), "FACE", "PRIVATE_DOCUMENT", "OTHER")
DROPPED_TYPES = ("PASSWORD", "OTP", "PAYMENT_CARD", "AADHAAR_LIKE", "PRIVATE_DOCUMENT")
# The tables of Verhoeff's check digit.
VERHOEFF_PRODUCT = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 2, 3, 4, 0, 6, 7, 8, 9, 5), (2, 3, 4, 0, 1, 7, 8, 9, 5, 6), (3, 4, 0, 1, 2, 8, 9, 5, 6, 7), (4, 0, 1, 2, 3, 9, 5, 6, 7, 8),
    (5, 9, 8, 7, 6, 0, 4, 3, 2, 1), (6, 5, 9, 8, 7, 1, 0, 4, 3, 2), (7, 6, 5, 9, 8, 2, 1, 0, 4, 3), (8, 7, 6, 5, 9, 3, 2, 1, 0, 4), (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
VERHOEFF_PERMUTATION = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2), (8, 9, 1, 6, 0, 4, 3, 5, 2, 7),
    (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1), (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Patterns of the outbound guards, forbidden keys, and words of claims and comparisons.
#: Their card shape has no checksum, unlike the detector's.
OBVIOUS_SECRETS = (
    rf"(?i){EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{EDGE}",
    rf"{EDGE}[A-Z]{{5}}\d{{4}}[A-Z]{EDGE}",
    rf"(?i){EDGE}[A-Z0-9][A-Z0-9._-]{{1,}}@[A-Z]{{2,}}{EDGE}",
    rf"(?<!\d)(?:\+?91(?:{SPACE}|-)?)?[6-9]\d{{4}}(?:{SPACE}|-)?\d{{5}}(?!\d)",
    rf"{EDGE}(?:\d[ -]*?){{13,19}}{EDGE}",
    rf"(?i){EDGE}(?:password|otp){SPACE}*[:=]{SPACE}*{NOT_SPACE}+",
)
#: A cheap test for each that any match passes: "@", or a pattern without edges.
SECRET_HINTS = ("@", r"[A-Z]{5}\d{4}", "@", r"[6-9]\d{4}", r"\d[ -]*\d[ -]*\d[ -]*\d", "(?i)password|otp")
FORBIDDEN_PROPERTY = "(?i)(?:raw_dom|raw_screenshot|cookie|authorization|password|otp|token)"
FORBIDDEN_LOG_KEY = "(?i)(password|secret|token|cookie|authorization|otp|raw|value)"
BLOCKED_FINISH = (
    rf"(?i){EDGE}(?:cannot|can't|could not|couldn't|unable|failed|failure|not possible|not completed|incomplete|blocked|no actionable elements?|no further safe action|"
    rf"no (?:matching|requested|eligible|available|relevant|safe) (?:element|action|control|target|option)s?(?: (?:was|were))? found){EDGE}"
)
COMPARISON = rf"(?i){EDGE}(?:lowest|highest|cheapest|shortest|longest|fastest|slowest|earliest|latest|least expensive|most expensive){EDGE}"
