"""Entity types, thresholds and other fixed values of the detection model."""

from __future__ import annotations

from dataclasses import dataclass

SPAN = "struct<start:int,end:int,entity_type:string,score:double,text:string,source:string>"
#: The span that operators pass on: character offsets and the order of detection beside the above.
INNER = "struct<start:int,end:int,entity_type:string,score:double,text:string,source:string,cs:int,ce:int,seq:int>"

# Recognizers in their order, (type, pattern, score). Patterns are read with Unicode classes.
DATE_PATTERN = (
    r"(?:\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b"
    r"|\b\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}\b"
    r"|\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},?\s+\d{4}\b)"
)
PHONE_PATTERN = (
    r"(?:\+\d{1,3}[\s\-.]?\(?\d{1,4}\)?[\s\-.]?\d{1,4}[\s\-.]?\d{1,9}"
    r"|\(\d{2,5}\)[\s\-.]?\d{2,4}[\s\-.]?\d{2,9}"
    r"|\b\d{2,4}[\s\-.]\d{2,4}[\s\-.]\d{2,9}\b"
    r"|\b\d{2,5}[\s\-.]\d{6,12}\b)"
)
RECOGNIZERS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.95),
    ("PHONE", PHONE_PATTERN, 0.70),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.80),
    ("CREDIT_CARD", r"\b(?:\d{4}[\s\-]?){3}\d{4}\b", 0.75),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0.85),
    ("IBAN", r"\b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?(?:[\dA-Z]{4}[\s]?){1,7}[\dA-Z]{1,4}\b", 0.80),
    ("DATE", DATE_PATTERN, 0.60),
)

# Words that support a type when they stand near a span.
KEYWORDS = {
    "PERSON": ("name", "named", "called", "mr", "mrs", "ms", "dr", "prof", "author", "patient", "client", "employee", "contact", "person", "user", "owner", "recipient", "sender"),
    "EMAIL": ("email", "e-mail", "mail", "contact", "send", "write", "reach", "address"),
    "PHONE": ("phone", "call", "tel", "telephone", "mobile", "cell", "fax", "number", "dial", "reach"),
    "LOCATION": ("address", "street", "city", "state", "country", "zip", "postal", "live", "lives", "located", "from", "born", "based"),
    "ADDRESS": ("address", "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "zip", "postal"),
    "URL": ("url", "link", "website", "web", "site", "homepage", "profile"),
    "USERNAME": ("username", "user", "handle", "login", "account", "profile"),
    "PASSWORD": ("password", "passcode", "secret", "credential", "token"),
    "SSN": ("ssn", "social", "security", "tax", "identification", "id"),
    "CREDIT_CARD": ("card", "credit", "debit", "visa", "mastercard", "amex", "payment", "cc"),
    "IBAN": ("iban", "bank", "account", "transfer", "wire", "routing"),
    "BANK_ACCOUNT": ("bank", "account", "routing", "transfer", "wire", "swift", "bic"),
    "DATE": ("born", "birthday", "dob", "date", "birth", "issued", "expires", "expiry"),
}

# Type, group, sensitivity baseline and delta, least NER score, size of the synthetic pool.
TYPES = (
    ("PERSON", "Identity", 0.50, 0.20, 0.55, 24),
    ("EMAIL", "Contact", 0.40, 0.20, 0.80, 24),
    ("PHONE", "Contact", 0.40, 0.20, 0.80, 6),
    ("CREDIT_CARD", "Financial", 0.50, 0.15, 0.80, 4),
    ("SSN", "Financial", 0.50, 0.15, 0.80, 5),
    ("IBAN", "Financial", 0.50, 0.15, 0.80, 3),
    ("IP_ADDRESS", "Network", 0.50, 0.20, 0.80, 6),
    ("LOCATION", "Location", 0.50, 0.20, 0.55, 16),
    ("ORGANIZATION", "Organization", 0.50, 0.20, 0.50, 16),
    ("ADDRESS", "Contact", 0.50, 0.20, 0.55, 12),
    ("URL", "Low-signal", 0.50, 0.30, 0.60, 0),
    ("USERNAME", "Identity", 0.50, 0.20, 0.60, 10),
    ("PASSWORD", "Password", 0.70, 0.05, 0.60, 0),
    ("BANK_ACCOUNT", "Financial", 0.50, 0.15, 0.50, 3),
    ("DATE", "Low-signal", 0.40, 0.30, 0.80, 0),
    ("MISC", "Low-signal", 0.50, 0.20, 0.70, 6),
)
GROUP_OF = {t[0]: t[1] for t in TYPES}
GROUPS_ON = {g: g != "Low-signal" for g in dict.fromkeys(GROUP_OF.values())}
STRUCTURED = ("CREDIT_CARD", "IBAN", "SSN", "EMAIL", "PHONE", "IP_ADDRESS", "DATE")


@dataclass(frozen=True)
class DetectionConfig:
    """Core options; ``context_window`` 5 admits six tokens a side (distances 0 to 5)."""

    min_confidence: float = 0.5
    context_boost: float = 0.15
    context_window: int = 5


@dataclass(frozen=True)
class Sensitivity:
    """Slider positions; ``groups`` override ``position`` in individual mode."""

    position: float = 0.5
    individual: bool = False
    groups: tuple[tuple[str, float], ...] = ()

    def threshold(self, entity_type: str) -> float:
        """Between baseline + delta at slider 0 and baseline - delta at 1, both within 0 and 1."""
        _, group, baseline, delta, _, _ = next(t for t in TYPES if t[0] == entity_type)
        at = dict(self.groups).get(group, self.position) if self.individual else self.position
        low, high = max(0.0, baseline - delta), min(1.0, baseline + delta)
        return high - at * (high - low)

    def lowest(self) -> float:
        return min(self.threshold(t[0]) for t in TYPES)
