"""Character and substring counting with built-in string expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(text: str) -> str:
    """``text`` as an SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def count_token(sql: str, token: str) -> str:
    """Non-overlapping occurrences of an ASCII token, as SQL.

    The byte-length difference costs one substring search and no regex.
    """
    removed = f"(octet_length({sql}) - octet_length(replace({sql}, {literal(token)}, '')))"
    return removed if len(token) == 1 else f"{removed} div {len(token)}"


def count_chars(sql: str, chars: str) -> str:
    """How many characters belong to a set of ASCII characters, as SQL."""
    pattern = literal("[" + re.escape(chars) + "]")
    return f"(octet_length({sql}) - octet_length(regexp_replace({sql}, {pattern}, '')))"


@lru_cache(maxsize=None)
def _digit_class() -> str:
    """Regex class of every character that Python's ``str.isdigit`` accepts."""
    extra = [c for c in map(chr, range(0x80, sys.maxunicode + 1))
             if c.isdigit() and unicodedata.category(c) != "Nd"]
    return "[\\p{Nd}" + "".join("\\x{%x}" % ord(c) for c in extra) + "]"


def count_digits(sql: str) -> str:
    """Digit characters, as SQL.  Pure-ASCII text (the usual case) takes the short class."""
    return (f"CASE WHEN octet_length({sql}) = length({sql}) THEN {count_chars(sql, '0123456789')} "
            f"ELSE regexp_count({sql}, {literal(_digit_class())}) END")


@lru_cache(maxsize=None)
def _decimal_digits() -> tuple[str, str]:
    chars = [chr(i) for i in range(0x80, sys.maxunicode + 1)
             if unicodedata.decimal(chr(i), None) is not None]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


def ascii_decimal(col: Column) -> Column:
    """Rewrite decimal digits of any script to 0-9; leave everything else."""
    source, target = _decimal_digits()
    return F.when(F.octet_length(col) == F.length(col), col).otherwise(F.translate(col, source, target))


def entropy(sql: str) -> str:
    """Shannon entropy in bits per character, as SQL.

    Uses H = log2(n) - sum(k * log2(k)) / n over the distinct characters, so a
    character seen once contributes nothing and needs no logarithm.
    """
    n = f"length({sql})"
    counts = f"transform(array_distinct(split({sql}, '')), ch -> {n} - length(replace({sql}, ch, '')))"
    repeated = f"aggregate({counts}, 0D, (total, k) -> CASE WHEN k > 1 THEN total + k * log2(k) ELSE total END)"
    return f"CASE WHEN {n} > 0 THEN log2({n}) - {repeated} / {n} ELSE 0D END"


# HTML entities in the order in which they must be replaced.
HTML_ENTITIES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#39;"),
]

# Fragments that a report marks as suspicious in an escaped query.
MARKED_FRAGMENTS = (
    r"&lt;|&gt;|&#39;|&quot;|script|alert|onerror|onload|svg|iframe|union|select|insert|drop"
    r"|--|or |1=1|\.\.\/|etc\/passwd|cmd=|exec|%3c|%3e|%27|%20"
)


def html_escape(col: Column) -> Column:
    escaped = F.coalesce(col, F.lit(""))
    for char, entity in HTML_ENTITIES:
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    return escaped


def mark_fragments(col: Column) -> Column:
    """HTML-escape, then wrap suspicious fragments in ``<mark>``."""
    return F.regexp_replace(html_escape(col), f"(?i)({MARKED_FRAGMENTS})", "<mark>$1</mark>")
