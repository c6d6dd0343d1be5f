"""Combined / Common Log Format as column expressions.

One regex pass matches a line and rewrites it into a form that plain separators
can cut, instead of one extraction per field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from accesslens.functions.text import ascii_decimal

# Unicode white space and the four ASCII separators.  Listed, because
# the JVM's own class omits the separators and is slower.
_SPACES = r" \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = rf"[^{_SPACES}]++"

# Anchored at the start only: trailing text is allowed, and the referer and agent
# pair is optional, so Common Log Format matches too.  No part can give
# characters back, hence the possessive quantifiers.
LINE_PATTERN = (
    rf'^({_WORD}) ({_WORD}) ({_WORD}) \[([^\]]++)\] "([^"]*+)" (\p{{Nd}}{{3}}) ({_WORD})'
    r'(?: "([^"]*+)" "([^"]*+)")?+'
)

# ip ident user status bytes time]request"referer"agent
_REORDERED = '$1 $2 $3 $6 $7 $4]$5"$8"$9'

# day/mon/year:h:m:s offset, where the offset is +hhmm, +hh:mm, +hhmmss or +hh:mm:ss
_TIME_PATTERN = (
    r"^([ 0-9]?[0-9])/([A-Za-z]{3})/((?!0000)[0-9]{4}):([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})"
    rf"[{_SPACES}]+"
    r"([+-][0-9]{2}):?([0-5][0-9])(?:(?<=:[0-9][0-9]):([0-5][0-9])|(?<!:[0-9][0-9])([0-5][0-9]))?$"
)

# The same parts in one layout; a bracket cannot occur in the text of a log time,
# so only text that the pattern has rewritten can pass the format below.
_TIME_REORDERED = "$1]$2]$3]$4]$5]$6]$7$8$9$10"
_TIME_FORMAT = "d']'MMM']'yyyy']'H']'m']'s']'xxxx"

# Leading controls and spaces, tabs and line ends: not part of a URL.
_UNSAFE_PATTERN = r"^[\x00-\x20]+|[\t\r\n]"

# A fragment, or a scheme and an authority in front of the path.
_NOT_PATH_PATTERN = r"#[\s\S]*+|^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"


def strip_line_end(col: Column) -> Column:
    """Trimming visits every character, so only a line that has an end is trimmed."""
    return F.when(col.endswith("\n") | col.endswith("\r"), F.rtrim(col, F.lit("\r\n"))).otherwise(col)


def is_parseable(col: Column) -> Column:
    return col.rlike(LINE_PATTERN)


def has_text(col: Column) -> Column:
    """Whether anything but white space is there."""
    return col.rlike(f"[^{_SPACES}]")


def reordered(col: Column) -> Column:
    """Fields of a matching line behind separators that they cannot contain.

    A line that does not match comes back as it is; one that does never equals
    its input, for its bracket moves.
    """
    return F.regexp_replace(col, LINE_PATTERN + r"[\s\S]*+", _REORDERED)


def number_or_zero(col: Column) -> Column:
    """Byte count: digits as a number (saturating), anything else 0."""
    digits = ascii_decimal(col)
    return F.when(digits.rlike("^[0-9]+$"),
                  F.coalesce(digits.try_cast("bigint"), F.lit(2**63 - 1))).otherwise(F.lit(0))


def uniform_time(col: Column) -> Column:
    """A log timestamp in one fixed layout; other text comes back as it is."""
    numeric = F.when(col.endswith("Z"), F.concat(F.substr(col, F.lit(1), F.length(col) - 1), F.lit("+0000"))).otherwise(col)
    return F.regexp_replace(numeric, _TIME_PATTERN, _TIME_REORDERED)


def instant(uniform: Column) -> Column:
    """The moment that a log timestamp names, or null where it names none."""
    return F.try_to_timestamp(F.ltrim(uniform), F.lit(_TIME_FORMAT))


def iso_offset(uniform: Column) -> Column:
    """The UTC offset of a log timestamp as ``+hh:mm``, or ``+hh:mm:ss`` if it has seconds."""
    offset = F.substring_index(uniform, "]", -1)
    seconds = F.substring(offset, 6, 2)
    text = F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, 4, 2),
                    F.when(seconds.isin("", "00"), "").otherwise(F.concat(F.lit(":"), seconds)))
    return F.when(text == "-00:00", "+00:00").otherwise(text)


def iso_timestamp(ts: Column, tz_offset: Column) -> Column:
    """ISO-8601 text of an instant at its original offset, session-zone independent."""
    digits = F.rpad(F.regexp_replace(tz_offset, "[^0-9]", ""), 6, "0")
    seconds = (F.substring(digits, 1, 2).cast("int") * 3600
               + F.substring(digits, 3, 2).cast("int") * 60
               + F.substring(digits, 5, 2).cast("int"))
    local = F.unix_seconds(ts) + F.when(tz_offset.startswith("-"), -seconds).otherwise(seconds)
    wall = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=local.cast("decimal(18,6)"))
    return F.concat(F.replace(wall.cast("string"), F.lit(" "), F.lit("T")), tz_offset)


def path_and_query(target: Column) -> Column:
    """A request target from its path on: no scheme, authority or fragment."""
    return F.regexp_replace(F.regexp_replace(target, _UNSAFE_PATTERN, ""), _NOT_PATH_PATTERN, "")
