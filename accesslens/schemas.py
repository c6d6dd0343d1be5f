"""Column contracts shared by the batch, streaming and training paths."""

from __future__ import annotations

from pyspark.sql import types as T

REQUEST_COLUMNS = [
    "ip", "ident", "user", "ts", "tz_offset", "method", "path", "query",
    "protocol", "status", "bytes", "referer", "user_agent", "raw",
]

# Feature order, which is also the order of the model's inputs.
FEATURE_NAMES = [
    "path_len", "query_len", "n_path_segments",
    "n_special", "special_ratio", "n_percent", "n_digits",
    "path_entropy", "query_entropy",
    "n_suspicious_tokens",
    "is_get", "is_post", "is_other_method",
    "is_2xx", "is_3xx", "is_4xx", "is_5xx",
    "log_bytes", "ua_len", "ua_is_tool",
]

REQUESTS = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("ident", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("tz_offset", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("referer", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("raw", T.StringType()),
])

# A parsed-request message: the stage boundary between parsing and scoring.
PARSED_MESSAGE = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("raw", T.StringType()),
    T.StructField("record", T.StructType([
        T.StructField("ip", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("referer", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("raw", T.StringType()),
    ])),
    T.StructField("features", T.ArrayType(T.DoubleType())),
])

# What scoring reads of a parsed-request message.
SCORED_MESSAGE = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("raw", T.StringType()),
    T.StructField("record", T.StructType([
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("status", T.IntegerType()),
    ])),
    T.StructField("features", T.ArrayType(T.DoubleType())),
])

# A verdict message: the stage boundary between scoring and storage.
VERDICT_MESSAGE = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("raw", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("drivers", T.ArrayType(T.StringType())),
])

# The stored verdict table.  batch_id and is_anomaly are directory columns.
VERDICT_TABLE = T.StructType([
    T.StructField("id", T.DecimalType(38, 0)),
    T.StructField("ts", T.TimestampType()),
    T.StructField("file", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("raw", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("drivers", T.ArrayType(T.StringType())),
    T.StructField("batch_id", T.LongType()),
    T.StructField("is_anomaly", T.BooleanType()),
])

# Verdicts for a store without binary floats: decimals, and all digits as text.
DECIMAL_TABLE = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("raw", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("score", T.DecimalType(38, 17)),
    T.StructField("threshold", T.DecimalType(38, 17)),
    T.StructField("score_text", T.StringType()),
    T.StructField("threshold_text", T.StringType()),
    T.StructField("drivers", T.ArrayType(T.StringType())),
    T.StructField("batch_id", T.LongType()),
    T.StructField("is_anomaly", T.BooleanType()),
])

# One row per published attempt of a batch.  block is a directory column.
MANIFEST = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("attempt", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("anomalies", T.LongType()),
    T.StructField("greatest_id", T.DecimalType(38, 0)),
    T.StructField("block", T.LongType()),
])

LABELS = T.StructType([
    T.StructField("line_no", T.LongType()),
    T.StructField("label", T.IntegerType()),
])

# Labels of a folder of logs.
FILE_LABELS = T.StructType([T.StructField("file", T.StringType()), *LABELS.fields])

# What a day or a batch of usage rows adds up to; visitors is a mergeable sketch.
USAGE_SKETCHES = T.StructType([
    T.StructField("part", T.StringType()),
    T.StructField("scans", T.LongType()),
    T.StructField("lines", T.LongType()),
    T.StructField("anomalies", T.LongType()),
    T.StructField("visitors", T.BinaryType()),
])

SCAN_EVENTS = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("lines", T.LongType()),
    T.StructField("anomalies", T.LongType()),
    T.StructField("visitor_hash", T.StringType()),
])

_MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
_VECTOR = T.ArrayType(T.DoubleType())

BUNDLE = T.StructType([
    T.StructField("weights", T.ArrayType(_MATRIX)),
    T.StructField("biases", T.ArrayType(_VECTOR)),
    T.StructField("mean", _VECTOR),
    T.StructField("std", _VECTOR),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("n_features", T.IntegerType()),
    T.StructField("hidden", T.IntegerType()),
    T.StructField("latent", T.IntegerType()),
])
