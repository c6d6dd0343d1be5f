"""Raw lines to structured requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.functions import log_format as lf
from accesslens.operators.settling import settle
from accesslens.schemas import REQUEST_COLUMNS


def split_target(df: DataFrame, target: str = "target") -> DataFrame:
    """Add ``path`` and ``query`` of a request target; scheme, host and fragment go."""
    keep = df.columns
    out = df.select(*keep, lf.path_and_query(F.col(target)).alias("_rest"))
    path = F.substring_index("_rest", "?", 1)
    return out.select(
        *keep,
        F.when(path == "", F.col(target)).otherwise(path).alias("path"),
        F.substr("_rest", F.length(path) + 2).alias("query"),
    )


def parse_requests(df: DataFrame, column: str = "value", keep: Sequence[str] = (),
                   unparsed: bool = False) -> DataFrame:
    """Parse combined or common log lines; lines that do not match are dropped.

    ``keep`` names columns carried along (a line number, an offset, a label).
    With ``unparsed`` all lines stay, a ``parsed`` flag tells them apart, and the
    other columns of an unparsed line mean nothing: one pass can then count both.
    Values that several fields share are computed once per projection.
    """
    keep = list(keep)
    out = df.select(*keep, lf.strip_line_end(F.col(column)).alias("raw"))
    out = settle(out.select(*keep, "raw", lf.reordered(F.col("raw")).alias("_line")), [*keep, "raw"], "_line")
    matched = F.col("_line") != F.col("raw")
    if unparsed:
        out = out.select("*", F.coalesce(matched, F.lit(False)).alias("parsed"))
        keep.append("parsed")
    else:
        out = out.filter(matched)
    out = out.select(*keep, "raw", F.split("_line", " ", 6).alias("_fields"))

    def field(i):
        return F.get("_fields", F.lit(i))
    timed = F.split(field(5), "]", 2)
    quoted = F.split(F.get(timed, F.lit(1)), '"')
    request = F.split(F.get(quoted, F.lit(0)), " ")
    out = out.select(
        *keep, "raw",
        field(0).alias("ip"),
        field(1).alias("ident"),
        field(2).alias("user"),
        lf.ascii_decimal(field(3)).try_cast("int").alias("status"),
        lf.number_or_zero(field(4)).alias("bytes"),
        lf.uniform_time(F.get(timed, F.lit(0))).alias("_time"),
        F.get(request, F.lit(0)).alias("method"),
        F.coalesce(F.get(request, F.lit(1)), F.lit("")).alias("target"),
        F.when(F.size(request) >= 3, F.element_at(request, -1)).otherwise(F.lit("")).alias("protocol"),
        F.get(quoted, F.lit(1)).alias("referer"),
        F.get(quoted, F.lit(2)).alias("user_agent"),
    )
    ts = lf.instant(F.col("_time"))
    columns = {"ts": ts, "tz_offset": F.when(ts.isNotNull(), lf.iso_offset(F.col("_time")))}
    return split_target(out).select(*keep, *[columns.get(c, F.col(c)).alias(c) for c in REQUEST_COLUMNS])


def parse_quality(df: DataFrame, column: str = "value") -> DataFrame:
    """Non-blank lines, how many of them parse and how many do not (one row)."""
    value = F.col(column)
    shown = df.filter(lf.has_text(value))
    return (shown.agg(F.count("*").alias("total"), F.count_if(lf.is_parseable(value)).alias("parsed"))
            .select("total", "parsed", (F.col("total") - F.col("parsed")).alias("failed")))


def parse_samples(df: DataFrame, order: str, column: str = "value", n: int = 3) -> DataFrame:
    """The first ``n`` parsed records, without their raw text."""
    columns = [c for c in REQUEST_COLUMNS if c != "raw"]
    return parse_requests(df, column, [order]).orderBy(order).limit(n).select(order, *columns)
