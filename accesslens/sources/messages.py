"""Decode the JSON messages between pipeline stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.operators.settling import settle
from accesslens.schemas import PARSED_MESSAGE, VERDICT_MESSAGE


def _decode(df: DataFrame, column: str, schema: T.StructType, logs: bool) -> DataFrame:
    """The text is settled before it is parsed: the parser is not compiled, nor is what stands inside its call."""
    fields = T.StructType([*schema.fields, *[T.StructField("file", T.StringType())] * logs])
    text = settle(df.select(F.col(column).alias("_text")), [], "_text")
    return settle(text.select(F.from_json("_text", fields).alias("_m")), [], "_m").select("_m.*")


def decode_parsed(df: DataFrame, column: str = "value", logs: bool = False, schema: T.StructType = PARSED_MESSAGE) -> DataFrame:
    """``offset, raw, record, features`` of parsed-request messages, and ``file`` of those that come from logs.

    ``schema`` may name fewer fields: those that the reader needs.
    """
    return _decode(df, column, schema, logs)


def decode_verdicts(df: DataFrame, column: str = "value", logs: bool = False) -> DataFrame:
    """The fields of verdict messages, and ``file`` of those that come from logs; absent ones are null."""
    return _decode(df, column, VERDICT_MESSAGE, logs)
