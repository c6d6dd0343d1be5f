"""The continuous pipeline: parse, score, store.  Every stage is stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from accesslens.models.bundle import Bundle
from accesslens.operators import messages
from accesslens.schemas import SCORED_MESSAGE
from accesslens.sinks.publish import publish_once
from accesslens.sinks.stores import store_verdicts
from accesslens.sources.logs import number_lines
from accesslens.sources.messages import decode_parsed, decode_verdicts


def ingest_stage(lines: DataFrame) -> DataFrame:
    """Raw lines (``value, offset``) to parsed-request messages."""
    every = messages.parsed_records(lines, unparsed=True)
    counted = every.observe("ingest", F.count("*").alias("consumed"), F.count_if("parsed").alias("parsed"))
    return messages.encode_parsed(counted.filter("parsed"))


def start_log_ingest(logs: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Logs that arrive in a folder (``stream_logs``) to parsed-request messages that name their file and line.

    Each micro-batch is numbered by itself and published once, as a folder of ``path``; the next stage reads
    ``path/batch-*``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = number_lines(batch)
        publish_once(messages.encode_parsed(messages.parsed_records(numbered, offset="line_no", keep=["file"])), path, batch_id)
    return _start(logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), once)


def score_stage(parsed: DataFrame, bundle: Bundle, logs: bool = False) -> DataFrame:
    """Parsed-request messages to verdict messages; ``logs`` says that they name their file."""
    scored = messages.verdicts(decode_parsed(parsed, logs=logs, schema=SCORED_MESSAGE), bundle, keep=["file"] if logs else [])
    counted = scored.observe("score", F.count("*").alias("scored"), F.count_if("is_anomaly").alias("anomalies"))
    return messages.encode_verdicts(counted)


def fused_verdicts(lines: DataFrame, bundle: Bundle) -> DataFrame:
    """Raw lines to verdict rows without a message in between."""
    return messages.verdicts(messages.parsed_records(lines), bundle)


def _start(writer, once: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_messages(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append ``value`` rows to text files, each exactly once."""
    return _start(df.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint), once)


def start_topic(df: DataFrame, servers: str, topic: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append ``value`` rows to a topic (Spark's Kafka connector must be on the class path)."""
    writer = (df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("topic", topic).option("checkpointLocation", checkpoint))
    return _start(writer, once)


def start_store(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append verdict rows to the verdict table, one replaceable folder per micro-batch."""
    counted = rows.observe("store", F.count("*").alias("stored"), F.count_if("is_anomaly").alias("anomalies"))

    def write(batch: DataFrame, batch_id: int) -> None:
        store_verdicts(batch, path, batch_id)
    return _start(counted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), once)


def store_stage(messages_in: DataFrame, logs: bool = False) -> DataFrame:
    """Verdict messages to verdict rows, ready for ``start_store``; ``logs`` says that they name their file."""
    return decode_verdicts(messages_in, logs=logs)
