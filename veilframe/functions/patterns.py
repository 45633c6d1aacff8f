"""Fixed values of the detection rules: patterns, word lists, severities and tokens.

Patterns are written once and rendered for either engine: ``<S>`` stands for the members of a white
space class and ``<B>`` for a boundary of ASCII words, which Java's own boundary is not; ``<L>`` is one
before a word and ``<R>`` one after it, which are quicker to test.
"""

from __future__ import annotations

import re

SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(pattern: str) -> str:
    return pattern.replace("<S>", SPACE).replace("<L>", f"(?<!{_WORD})").replace("<R>", f"(?!{_WORD})").replace("<B>", BOUNDARY)


def re2(pattern: str) -> str:
    """For DuckDB. Patterns that look ahead have no such form."""
    return re.sub("<[LRB]>", r"\\b", pattern.replace("<S>", SPACE))


#: Identifier kinds in order of precedence.
ID_PATTERNS = {
    "gstin": r"<L>\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z][\dA-Z]<R>",
    "ifsc": r"<L>[A-Z]{4}0[A-Z\d]{6}<R>",
    "card": r"<L>\d{4}[<S>-]?\d{4}[<S>-]?\d{4}[<S>-]?\d{1,7}<R>",
    "aadhaar": r"<L>[2-9]\d{3}[<S>-]?\d{4}[<S>-]?\d{4}<R>(?![<S>-]?\d)",
    "pan": r"<L>[A-Z]{5}\d{4}[A-Z]<R>",
    "driving_licence": r"<L>[A-Z]{2}[<S>-]?\d{2}[<S>-]?(?:19|20)\d{2}[<S>-]?\d{7}<R>",
    "voter_id": r"<L>[A-Z]{3}\d{7}<R>",
    "passport": r"<L>[A-PR-WY][<S>-]?\d{7}<R>",
    "upi": r"(?i)<B>[\w.-]{3,}@[a-z]{3,}<R>(?!\.)",
    "bank_account": r"<L>\d{9,18}<R>",
}
ID_SEVERITY = {"ifsc": 1, "upi": 2, "bank_account": 3, "voter_id": 4, "driving_licence": 5, "passport": 6, "gstin": 7, "pan": 8, "aadhaar": 9, "card": 10}
ID_LABEL = {"aadhaar": "Aadhaar number", "pan": "PAN", "passport": "passport number", "driving_licence": "driving licence number", "voter_id": "voter ID", "gstin": "GSTIN", "ifsc": "IFSC code", "upi": "UPI ID", "bank_account": "bank account number", "card": "payment card number"}
CHECKED_IDS = ("aadhaar", "card", "pan", "gstin")
HOLDER_TYPES = "ABCFGHJLPT"

#: Content categories in order of precedence.
CONTENT_PATTERNS = {
    "password": r"(?i)<L>(?:password|passcode|passwd|pwd|pin|otp|one[- ]time password)[<S>]*[:=][<S>]*[^<S>]+",
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "id_number": r"(?i)<L>(?:[A-Z]{5}\d{4}[A-Z]|\d{9,})<R>",
    "phone": r"(?:\+\d{1,3}[<S>-]?)?(?:\(\d{2,4}\)[<S>-]?)?\d{3,5}[<S>-]\d{3,5}(?:[<S>-]\d{3,5})?",
    "address": r"<L>\d{1,4}[A-Za-z]?,?[<S>]+(?:[A-Z][A-Za-z.]*[<S>]+){1,3}(?:Street|St\.?|Road|Rd\.?|Lane|Marg|Nagar|Colony|Avenue|Layout|Sector|Block|Cross|Chowk|Bazaar|Enclave|Vihar|Society)<B>|<L>[A-Z][a-z]+(?:[<S>][A-Z][a-z]+)?[,<S>]+[1-9]\d{2}[<S>]?\d{3}<R>",
    "other": r"(?i)(?:₹|<L>Rs\.?|<L>INR<R>)[<S>]?\d[\d,]*(?:\.\d{1,2})?",
}
#: What a text must hold for a pattern to have a chance: quick tests that skip most texts.
CUES = {"password": "[:=]", "email": "@", "id_number": r"\d{4}", "phone": r"\d{3}[<S>-]\d{3}", "address": r"\d[A-Za-z]?,?[<S>]+[A-Z]|\d{3}[<S>]?\d{3}", "other": r"\d"}
PHONE_DIGITS_WITH_CODE, PHONE_DIGITS = 8, 10

SEVERITY = {"other": 0, "name": 1, "address": 2, "phone": 3, "email": 4, "face": 5, "id_number": 6, "password": 7}
PLACEHOLDER = {"password": "[PASSWORD]", "name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "address": "[ADDRESS]", "id_number": "[ID_NUMBER]", "face": "[FACE]", "other": "[REDACTED]"}
HAS_VALUE = "[has value]"
CONFIDENCE = {"declared_password": 1.0, "autocomplete": 0.9, "input_type": 0.8, "pattern": 0.6, "checksum": 0.95, "unidentified": 0.3}

AUTOCOMPLETE = {
    "password": ("current-password", "new-password", "one-time-code"),
    "name": ("name", "given-name", "family-name", "additional-name", "nickname", "honorific-prefix", "honorific-suffix", "username"),
    "email": ("email",),
    "phone": ("tel", "tel-country-code", "tel-national", "tel-area-code", "tel-local", "tel-extension"),
    "address": ("street-address", "address-line1", "address-line2", "address-line3", "address-level1", "address-level2", "address-level3", "address-level4", "postal-code", "country", "country-name"),
    "id_number": ("cc-number", "cc-csc", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-name"),
}
INPUT_TYPES = {"email": "email", "tel": "phone"}
FIELD_TEXT = {
    "email": r"e[-_<S>]?mail",
    "id_number": r"<L>(?:ssn|social[-_<S>]?security|aadhaar|aadhar|passport|licen[cs]e|national[-_<S>]?id|tax[-_<S>]?id|pan[-_<S>]?(?:no|number|card)|account[-_<S>]?(?:no|number)|card[-_<S>]?(?:no|number)|cvv|cvc|pin)<R>",
    "phone": r"<L>(?:phone|mobile|telephone|tel|contact[-_<S>]?(?:no|number)|whatsapp)<R>",
    "address": r"<L>(?:address|street|city|town|state|province|district|zip|postcode|postal|pincode|country)<R>",
    "name": r"<L>(?:name|surname|forename|user)<R>",
    "password": r"<L>(?:password|passwd|pwd|passphrase|secret|otp)<R>",
}
VALUELESS = ("button", "checkbox", "color", "file", "hidden", "image", "radio", "range", "reset", "submit")
AUTHOR_SUPPLIED = ("select-one", "select-multiple")
COLUMN_HEADERS = {
    "email": r"<L>e[-_<S>]?mail<R>",
    "phone": r"<L>(?:phone|mobile|telephone|contact[-_<S>]?(?:no|number)|whatsapp)<R>",
    "id_number": r"<L>(?:aadhaar|aadhar|pan|ssn|social[-_<S>]?security|passport|account[-_<S>]?(?:no|number)|card[-_<S>]?(?:no|number)|iban|national[-_<S>]?id|tax[-_<S>]?id)<R>",
    "address": r"<L>(?:address|street|pincode|postcode|zip[-_<S>]?code)<R>",
    "name": r"^(?:name|full name|first name|last name|given name|family name|middle name|surname|forename|customer|customer name|applicant|applicant name|employee|employee name|patient|patient name|student|student name|client|client name|candidate|holder|account holder|contact|contact name|parent|guardian|father'?s name|mother'?s name)$",
}
