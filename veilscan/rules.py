"""Rule data: every fixed value the detection, classification, tagging and
masking semantics depend on, kept in one place as plain data.

Nothing here touches Spark; ``veilscan.functions`` compiles these tables into
Column expressions on the driver.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the studied tool's for identical results).
# Order matters where noted: type lists come out in this order.
# ---------------------------------------------------------------------------

# Column-name profile: lower-cased *substring* patterns per PII type, in rule
# order (EMAIL first, AGE last). A name may hit several types.
COLUMN_NAME_PATTERNS: dict[str, list[str]] = {
    "EMAIL": ["email", "mail", "e_mail", "email_address"],
    "SSN": ["ssn", "social_security", "social_security_number", "tax_id"],
    "PHONE": ["phone", "telephone", "mobile", "cell", "phone_number", "phone-no"],
    "NAME": ["first_name", "last_name", "full_name", "name", "fname", "lname", "first name", "last name"],
    "ADDRESS": ["address", "street", "city", "state", "zip", "postal_code"],
    "CREDIT_CARD": ["cc_num", "credit_card", "card_number", "payment_card"],
    "DATE_OF_BIRTH": ["dob", "birth_date", "date_of_birth", "birthday"],
    "SALARY": ["salary", "wage", "income", "compensation", "pay", "earnings"],
    "AGE": ["age", "birth_year", "years_old"],
}

# Content profile: regular expressions in Python ``re`` syntax, rule order.
CONTENT_PATTERNS: dict[str, str] = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "PHONE": r"\b(?:\(\d{3}\)\s?|\d{3}[-.]?)\d{3}[-.]?\d{4}\b",
    "CREDIT_CARD": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "DATE_OF_BIRTH": r"\b(0[1-9]|1[0-2])[/-](0[1-9]|[12]\d|3[01])[/-]\d{4}\b",
}

# The "simple" content profile of the direct-scan tools: EMAIL, SSN and a
# strict ddd-ddd-dddd phone number.
SIMPLE_PATTERNS: dict[str, str] = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "PHONE": r"\b\d{3}-\d{3}-\d{4}\b",
}

# Constant confidences.
NAME_CONFIDENCE = 0.8
PATTERN_CONFIDENCE = 0.7
ITEM_TABLE_CONFIDENCE = 0.8

# External entity-recogniser type -> our type; all other entity types dropped.
ENTITY_TYPE_MAP: dict[str, str] = {
    "EMAIL": "EMAIL",
    "SSN": "SSN",
    "PHONE": "PHONE",
    "CREDIT_DEBIT_NUMBER": "CREDIT_CARD",
    "DATE_TIME": "DATE_OF_BIRTH",
}

# Column/content profile classification, checked top-down.
RISK_TIERS: list[tuple[str, list[str]]] = [
    ("CRITICAL_RISK", ["SSN", "CREDIT_CARD"]),
    ("HIGH_RISK", ["DATE_OF_BIRTH", "SALARY"]),
    ("MEDIUM_RISK", ["EMAIL", "PHONE", "NAME"]),
    ("LOW_RISK", ["ADDRESS", "AGE"]),
]
NO_RISK = "NO_RISK"

# Classification -> access level; anything else maps to DEFAULT_ACCESS_LEVEL.
ACCESS_LEVELS: dict[str, str] = {
    "NO_RISK": "PUBLIC",
    "LOW_RISK": "INTERNAL",
    "MEDIUM_RISK": "CONFIDENTIAL",
    "HIGH_RISK": "RESTRICTED",
    "CRITICAL_RISK": "TOP_SECRET",
}
DEFAULT_ACCESS_LEVEL = "INTERNAL"

# Tag vocabulary of the column profile.
COLUMN_TAG_DEFINITIONS: dict[str, list[str]] = {
    "PIIType": ["EMAIL", "SSN", "PHONE", "NAME", "ADDRESS", "CREDIT_CARD", "DATE_OF_BIRTH", "SALARY", "AGE", "NONE"],
    "PIIClassification": ["SENSITIVE", "HIGHLY_SENSITIVE", "CONFIDENTIAL"],
    "DataGovernance": ["PII_DETECTED", "REQUIRES_MASKING", "ACCESS_RESTRICTED", "PUBLIC"],
    "DataClassification": ["NO_RISK", "LOW_RISK", "MEDIUM_RISK", "HIGH_RISK", "CRITICAL_RISK"],
    "AccessLevel": ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED", "TOP_SECRET"],
}

# Tag vocabulary of the source profile.
SOURCE_TAG_DEFINITIONS: dict[str, list[str]] = {
    "PIIType": ["EMAIL", "SSN", "PHONE", "NAME", "ADDRESS", "CREDIT_CARD", "MEDICAL_RECORD", "SALARY", "NONE"],
    "DataClassification": ["NO_RISK", "LOW_RISK", "MEDIUM_RISK", "HIGH_RISK", "CRITICAL_RISK"],
    "AccessLevel": ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED", "TOP_SECRET"],
    "DataGovernance": ["PII_DETECTED", "REQUIRES_MASKING", "ACCESS_RESTRICTED", "PUBLIC"],
}

SOURCE_TAG_KEYS = ["DataClassification", "AccessLevel", "PIIType", "DataGovernance"]

# Source-name profile: keyword group -> types appended (cumulative, duplicates kept).
SOURCE_NAME_RULES: list[tuple[list[str], list[str]]] = [
    (["user", "customer", "profile", "person"], ["EMAIL", "PHONE", "NAME"]),
    (["transaction", "payment", "billing"], ["CREDIT_CARD", "SSN"]),
    (["medical", "health", "patient"], ["MEDICAL_RECORD", "SSN"]),
    (["employee", "hr", "payroll"], ["SSN", "SALARY", "NAME"]),
]
# More than this many (possibly duplicated) types makes a source HIGH, else MEDIUM.
SOURCE_HIGH_RISK_MIN_TYPES = 3

# Suffixes of objects that the direct scan reads as text.
DIRECT_SCAN_SUFFIXES = (".txt", ".csv", ".json")

# Catalog registration naming.
FILE_DATABASE_SUFFIX = "_db"
ITEM_TABLE_DATABASE = "dynamodb_catalog"
CATALOGED = "cataloged"
CATALOG_ERROR = "error"

# Masking strategies (names as users pass them).
FULL_MASK = "full_mask"
PARTIAL_MASK = "partial_mask"
HASH = "hash"
TOKENIZE = "tokenize"
REDACT = "redact"
FORMAT_PRESERVE = "format_preserve"
STRATEGIES = (FULL_MASK, PARTIAL_MASK, HASH, TOKENIZE, REDACT, FORMAT_PRESERVE)

# Default masking rules: type -> (strategy, show_first, show_last).
DEFAULT_MASKING: dict[str, tuple[str, int, int]] = {
    "EMAIL": (PARTIAL_MASK, 2, 0),
    "SSN": (FORMAT_PRESERVE, 0, 0),
    "PHONE": (PARTIAL_MASK, 3, 2),
    "NAME": (PARTIAL_MASK, 1, 1),
    "ADDRESS": (PARTIAL_MASK, 3, 0),
    "CREDIT_CARD": (PARTIAL_MASK, 0, 4),
    "DATE_OF_BIRTH": (REDACT, 0, 0),
    "SALARY": (REDACT, 0, 0),
    "AGE": (REDACT, 0, 0),
}
DEFAULT_REPLACEMENT_CHAR = "*"
HASH_HEX_CHARS = 16
TOKEN_HEX_CHARS = 8

# Per-class tag PIIClassification of the column profile.
HIGHLY_SENSITIVE_CLASSES = ("HIGH_RISK", "CRITICAL_RISK")
SENSITIVE_CLASSES = ("MEDIUM_RISK",)

# ---------------------------------------------------------------------------
# Derived helpers (pure Python).
# ---------------------------------------------------------------------------

CONTENT_TYPES = list(CONTENT_PATTERNS)
COLUMN_TYPES = list(COLUMN_NAME_PATTERNS)


def classify_types(types: list[str]) -> str:
    """Reference semantics of the column/content classification, in Python.

    Used by tests as a brute-force oracle; Spark code uses the Column form.
    """
    for name, members in RISK_TIERS:
        if any(t in members for t in types):
            return name
    return NO_RISK
