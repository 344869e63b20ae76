"""Redaction of personal data and secrets by ordered patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, label), replaced in this order.
PII = (
    (r"\b[\w.-]+@[\w.-]+\.\w+\b", "[EMAIL]"),
    (r"\b\d{3}[-. ]?\d{3}[-. ]?\d{4}\b", "[PHONE]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b(?:\d{4}[- ]?){3}\d{4}\b", "[CREDIT_CARD]"),
    (r"\b(?:\d[- ]*){16}\b", "[CREDIT_CARD]"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[IP_ADDRESS]"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "[IPV6_ADDRESS]"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){1,6}::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}?\b", "[IPV6_ADDRESS]"),
    (r"\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}?\b", "[IPV6_ADDRESS]"),
    (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b", "[DATE]"),
    (r"\b[A-Z]{2}\d{6,9}\b", "[PASSPORT]"),
    (r"\b(?:sk|pk)-[a-zA-Z0-9]{20,}\b", "[API_KEY]"),
    (r"https?://(?:[^ \t\n\r/$.?#]+\.)*(?:bit\.ly|tinyurl\.com|short\.link|t\.co)/[^ \t\n\r]+", "[SHORT_URL]"),
)
# Fixed values: (name, severity, pattern, label) of secrets.
SECRETS = (
    ("aws_access_key", "critical", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[AWS_KEY]"),
    ("github_token", "critical", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "[GH_TOKEN]"),
    ("jwt", "high", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[JWT]"),
    ("private_key", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "[PRIVATE_KEY]"),
    ("stripe_key", "critical", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b", "[STRIPE_KEY]"),
    ("slack_token", "high", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "[SLACK_TOKEN]"),
    ("database_url", "high", r"\b(?:postgres|postgresql|mysql|mongodb|redis)://[^ \t\n\r\"']+", "[DB_URL]"),
    ("hex_secret", "medium", r"\b[0-9a-f]{40,}\b", "[HEX_SECRET]"),
)


def redact_pii(text: Column) -> Column:
    """Text with e-mail addresses, numbers of phones and cards, addresses, dates and keys replaced by labels."""
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1].replace("$", r"\$")), PII, text)


def redact_secrets(text: Column) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[2], s[3]), SECRETS, text)


def redact_fields(text: Column, fields: list[str]) -> Column:
    """``field: value`` with the value replaced, for each of ``fields``."""
    return reduce(lambda c, f: F.regexp_replace(c, rf"(?i)\b({f})\b[ \t]*[:=][ \t]*[^\n,;]+", "$1: [REDACTED]"), fields, text)


def secret_counts(text: Column) -> list[Column]:
    """How often each secret occurs."""
    return [F.regexp_count(text, F.lit(p)).cast("bigint").alias(name) for name, _, p, _ in SECRETS]
