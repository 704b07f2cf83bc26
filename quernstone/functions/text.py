"""Scalar functions over text and JSON, as Column expressions without Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# Patterns, marks and words that results depend on.
SENTENCE_END = r"(?<=[.!?])\s+|[;\n]+"
AMOUNT = r"\$\s*([0-9][0-9,]*(?:\.\d{2})?)"
SECRET_TOKEN, SECRET_MARK = r"sk-[A-Za-z0-9_-]{8,}", "sk-<redacted>"
SECRET_FIELD, FIELD_MARK = r"(?i)(api[_ -]?key\s*[:=]\s*)[^\s,;}]+", "$1<redacted>"
SECRET_CHARS = 1_000
CUT_MARK = "\n...[MIDDLE TRUNCATED; SOURCE HASH PRESERVED]...\n"
CUT_LIMIT, CUT_HEAD = 6_000, 1_200
#: Kinds of failures in the order of their tests: (kind, statuses, words, can be tried again).
FAILURES = (
    ("INVALID_RESPONSE", (), ("empty response", "returned no choices"), False),
    ("AUTHENTICATION_FAILED", (401, 403), ("authentication", "unauthorized", "invalid api key"), False),
    ("QUOTA_OR_BALANCE_EXHAUSTED", (402,), ("insufficient balance", "insufficient quota", "payment required"), False),
    ("RATE_LIMITED", (429,), ("rate limit", "ratelimit"), True),
    ("UPSTREAM_SERVER_ERROR", (500,), (), True),  # and above
    ("UPSTREAM_NETWORK_ERROR", (), ("timeout", "timed out", "connection", "temporarily unavailable"), True),
)
OTHER_FAILURE = "UPSTREAM_REQUEST_FAILED"
ITEM_SEGMENT = r"(?=#W[0-9]{7})|(?<!#)(?=W[0-9]{7})"


def normalise_space(c: str | Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def alnum(c: str | Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def order_id(c: str | Column) -> Column:
    """Upper case with a leading hash sign."""
    u = F.upper(F.trim(c))
    return F.when(u.startswith("#"), u).otherwise(F.concat(F.lit("#"), u))


def sentences(c: str | Column) -> Column:
    """Parts between sentence ends, semicolons and line breaks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda x: F.trim(x)), lambda x: x != "")


def excerpt(c: Column, limit: int = CUT_LIMIT) -> Column:
    """The text; of a longer one than the limit the head, a third of the limit but CUT_HEAD at most, a mark and the tail that fills the limit."""
    head = limit // 3 if limit < 3 * CUT_HEAD else CUT_HEAD
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(CUT_MARK), F.right(c, F.lit(limit - head))))


def amount(c: str | Column) -> Column:
    """The first amount of dollars in a text, as a number; null if there is none."""
    found = F.regexp_extract(c, AMOUNT, 1)
    return F.when(found != "", F.regexp_replace(found, ",", "").cast("double"))


def occurrences(c: Column, literal: str) -> Column:
    """Times that a literal occurs in the text, bounded by non-words, without regard to case."""
    return F.regexp_count(c, F.lit(r"(?i)(?<![\w])" + re.escape(literal) + r"(?![\w])"))


def is_json_object(c: str | Column) -> Column:
    """True if the whole trimmed text is one JSON object."""
    kind = F.schema_of_variant(F.try_parse_json(F.trim(c)))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def rule_code(c: str | Column) -> Column:
    """Upper case with an underscore for each run of other characters than letters and digits."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_")


def redact_secrets(c: str | Column) -> Column:
    """Keys, and values of key fields up to a delimiter, replaced; the first SECRET_CHARS characters of that."""
    tokens = F.regexp_replace(c, SECRET_TOKEN, SECRET_MARK)
    return F.left(F.regexp_replace(tokens, SECRET_FIELD, FIELD_MARK), F.lit(SECRET_CHARS))


def failure_kind(status: Column, message: Column) -> Column:
    """(kind, retryable) of a failed request by its status and message: the first of FAILURES that fits."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.struct(F.lit(OTHER_FAILURE).alias("kind"), F.lit(False).alias("retryable"))
    for kind, statuses, words, again in reversed(FAILURES):
        hit = F.coalesce(status >= 500 if 500 in statuses else status.isin(*statuses) if statuses else F.lit(False), F.lit(False))
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        out = F.when(hit, F.struct(F.lit(kind).alias("kind"), F.lit(again).alias("retryable"))).otherwise(out)
    return out


def segments(c: str | Column) -> Column:
    """Parts of a text, each from one order id to the next; the part before the first id is left out."""
    return F.filter(F.split(c, ITEM_SEGMENT), lambda part: F.rlike(part, F.lit("^#?W[0-9]{7}")))


def first_filled(*columns: str | Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, c) for c in columns])


def number_or(c: str | Column, default: float, kind: str = "double") -> Column:
    """The value as a number, or the default for what is none."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast(kind), F.lit(default).cast(kind))


def is_zoned_timestamp(c: str | Column) -> Column:
    """True for an ISO-8601 time with a zone, Z or an offset."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.rlike(col, F.lit(r"^\d{4}-\d{2}-\d{2}T.*(?:Z|[+-]\d{2}:?\d{2})$")) & col.try_cast("timestamp").isNotNull(), F.lit(False))


def fill(template: str | Column, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced."""
    out = F.col(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def remap(path: str | Column, prefixes: dict[str, str]) -> Column:
    """A path with the first of the prefixes that it has replaced."""
    col = F.col(path) if isinstance(path, str) else path
    out = col
    for old, new in reversed(list(prefixes.items())):
        out = F.when(F.startswith(col, F.lit(old)), F.concat(F.lit(new), F.substring(col, F.lit(len(old) + 1), F.length(col)))).otherwise(out)
    return out


def escapes(path: str | Column) -> Column:
    """True for a path that leaves its folder: absolute, or with a step upwards."""
    return F.rlike(path, F.lit(r"^(?:[/\\]|[A-Za-z]:)|(?:^|[/\\])\.\.(?:[/\\]|$)"))


def mask_identifiers(c: str | Column) -> Column:
    """Order, payment and user ids and addresses of mail replaced by typed marks."""
    out = F.regexp_replace(c, r"#W[0-9]{7}", "[ORDER]")
    out = F.regexp_replace(out, r"(credit_card|gift_card|paypal)_[0-9]+", "[PAYMENT]")
    return F.regexp_replace(out, r"usr_[0-9]+", "[USER]")
