"""Structured requests to numeric features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.functions import request_features as rf
from accesslens.operators.settling import settle
from accesslens.schemas import FEATURE_NAMES


def add_features(df: DataFrame) -> DataFrame:
    """Add the twenty feature columns.  Null inputs count as empty or zero.

    Unused features cost nothing: Catalyst prunes them column by column.
    """
    columns = rf.features("coalesce(path, '')", "coalesce(query, '')", "coalesce(method, '')",
                          "coalesce(status, 0)", "coalesce(bytes, 0)", "coalesce(user_agent, '')")
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()])


def add_feature_array(df: DataFrame) -> DataFrame:
    """Add ``features``, the twenty columns in their fixed order.

    The array is settled: Catalyst filters what a generator explodes by its size, which would else compute every
    feature a second time in a condition, uncompiled.
    """
    return settle(df.select("*", rf.feature_array().alias("features")), [f"`{c}`" for c in df.columns], "features")


def feature_preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows, features rounded to three decimals."""
    return df.orderBy(order).limit(n).select(order, *[F.round(c, 3).alias(c) for c in FEATURE_NAMES])
