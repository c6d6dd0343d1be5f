"""Access-log lines derived from the ``events`` table, for queries and checks.

The same text is built in Spark SQL and in the checking engine's SQL; only the
names of types, of the time format and of integer division differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accesslens.operators.settling import settle

SPARK = {
    "S": "STRING",
    "TIME": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
    "TWENTIETH": "(event_id div 20)",
}
ANSI = {
    "S": "VARCHAR",
    "TIME": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
    "TWENTIETH": "(event_id // 20)",
}

ATTACK = "event_id % 20 = 0"

# Attacks in three kinds, each far out in other features: special characters,
# suspicious tokens, and digits with percent signs.
_TARGET = """CASE
    WHEN event_id % 20 = 0 AND {TWENTIETH} % 3 = 0 THEN concat('/q?v=', repeat('<>;|', 6))
    WHEN event_id % 20 = 0 AND {TWENTIETH} % 3 = 1 THEN concat('/q?v=', repeat('exec--drop--', 3))
    WHEN event_id % 20 = 0 AND {TWENTIETH} % 3 = 2 THEN concat('/q/', repeat('%31', 9), repeat('7', 30))
    WHEN event_id % 97 = 0 THEN ''
    ELSE concat('/', event_type, '/', CAST(user_id AS {S}), '?k=', CAST(event_id % 100 AS {S})) END"""

_IP = "concat('10.', CAST(user_id % 256 AS {S}), '.', CAST(event_id % 256 AS {S}), '.1')"
_METHOD = "CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END"
_STATUS = "CASE WHEN event_type = 'error' THEN '500' ELSE '200' END"
_BYTES = "CAST(CAST(floor(value * 10) AS BIGINT) AS {S})"
_AGENT = "CASE WHEN event_id % 40 = 0 THEN 'nmap probe' ELSE 'Mozilla/5.0 (X11; Linux x86_64)' END"

_LINES = f"""SELECT event_id, CASE WHEN {ATTACK} THEN 1 ELSE 0 END AS label, concat(
    {_IP}, ' - - [', {{TIME}}, ' +0000] "', {_METHOD}, ' ', {_TARGET}, ' HTTP/1.1" ',
    {_STATUS}, ' ', {_BYTES}, ' "-" "', {_AGENT}, '"') AS line
  FROM events"""

# The same requests with the irregularities of real logs: blank and cut lines,
# other offsets, times that are none, missing bytes, common format, text after the
# line, short request lines, absolute targets and fragments.
_MESSY = f"""SELECT event_id, CASE
    WHEN event_id % 37 = 0 THEN ''
    WHEN event_id % 31 = 0 THEN concat({_IP}, ' - - [', {{TIME}}, ' +0000] "GET /cut')
    ELSE concat(
      {_IP}, ' - ', CASE WHEN event_id % 7 = 0 THEN concat('user', CAST(user_id AS {{S}})) ELSE '-' END, ' [',
      CASE WHEN event_id % 53 = 0 THEN 'no time' ELSE {{TIME}} END,
      CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 29 = 0 THEN ' +0530' WHEN event_id % 23 = 0 THEN ' -03:00'
           WHEN event_id % 19 = 0 THEN ' Z' ELSE ' +0000' END, '] "',
      CASE WHEN event_id % 61 = 0 THEN '' WHEN event_id % 59 = 0 THEN 'HEAD' WHEN event_id % 47 = 0 THEN 'GET /short'
           ELSE concat({_METHOD}, ' ', CASE WHEN event_id % 13 = 0 THEN 'http://example.org' ELSE '' END, {_TARGET},
                       CASE WHEN event_id % 11 = 0 THEN '#part' ELSE '' END,
                       CASE WHEN event_id % 43 = 0 THEN ' two words' ELSE '' END, ' HTTP/1.1') END,
      '" ', {_STATUS}, ' ', CASE WHEN event_id % 17 = 0 THEN '-' ELSE {_BYTES} END,
      CASE WHEN event_id % 41 = 0 THEN '' ELSE concat(' "http://ref.example/', event_type, '" "', {_AGENT}, '"') END,
      CASE WHEN event_id % 67 = 0 THEN ' upstream=3' ELSE '' END) END AS line
  FROM events"""


def lines_sql(dialect: dict[str, str]) -> str:
    return _LINES.format(**dialect)


def messy_sql(dialect: dict[str, str]) -> str:
    return _MESSY.format(**dialect)


def _derive(spark: SparkSession, sf_dir: str, text: str, stream: bool = False) -> DataFrame:
    """Lines of all events, dealt out by the hash of the row before any work: a file may have fewer row groups than
    there are cores, and a range of ids lies in few of them."""
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    if stream:
        events = (spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet")
                  .parquet(sf_dir)).select(*columns).repartition(spark.sparkContext.defaultParallelism, *columns)
    else:
        events = events.select(*columns).repartition(*columns)
    lines = spark.sql(text.replace("FROM events", "FROM {events}"), events=events)
    return settle(lines, lines.columns[:-1], "line")


def event_lines(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """``event_id, label, line``: regular lines, one in twenty an attack."""
    return _derive(spark, sf_dir, lines_sql(SPARK), stream)


def messy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, line``: lines with the irregularities of real logs."""
    return _derive(spark, sf_dir, messy_sql(SPARK))
