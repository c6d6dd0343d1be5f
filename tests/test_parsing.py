import random
import re
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pytest
from conftest import LOUD, CALM, lines_frame
from pyspark.sql import functions as F

from accesslens.functions.log_format import iso_timestamp
from accesslens.operators.parsing import parse_quality, parse_requests, parse_samples, split_target


def parse(spark, *lines):
    rows = parse_requests(lines_frame(spark, lines), keep=["line_no"]).orderBy("line_no").collect()
    return rows


def test_fields_of_a_plain_line(spark):
    (r,) = parse(spark, CALM)
    assert (r.ip, r.ident, r.user, r.method, r.path, r.query) == ("203.0.113.5", "-", "-", "GET", "/k1/p2", "")
    assert (r.protocol, r.status, r.bytes) == ("HTTP/1.1", 200, 512)
    assert (r.referer, r.user_agent, r.tz_offset, r.raw) == ("https://from.example/", "agent a", "+00:00", CALM)


def test_attack_target_splits(spark):
    (r,) = parse(spark, LOUD)
    assert r.path == "/loud" and r.query.startswith("z=script<") and r.user_agent == "nmap"


def test_lines_without_a_match_are_dropped(spark):
    assert parse(spark, "free text", "", "203.0.113.5 - - [x]") == []


@pytest.mark.parametrize("request_line, expected", [
    ("", ("", "", "", "")),
    ("HEAD", ("HEAD", "", "", "")),
    ("GET /a?b=1", ("GET", "/a", "b=1", "")),
    ("GET  HTTP/1.1", ("GET", "", "", "HTTP/1.1")),
    ("GET /a b c HTTP/1.0", ("GET", "/a", "", "HTTP/1.0")),
    ("GET /p?id=1 UNION SELECT HTTP/1.1", ("GET", "/p", "id=1", "HTTP/1.1")),
    (" ", ("", "", "", "")),
])
def test_request_lines(spark, request_line, expected):
    (r,) = parse(spark, f'a b c [01/Jun/2026:08:00:10 +0000] "{request_line}" 200 1')
    assert (r.method, r.path, r.query, r.protocol) == expected


@pytest.mark.parametrize("text, expected", [("-", 0), ("12", 12), ("1x", 0), ("١٢", 12), ("²", 0), ("9" * 30, 2**63 - 1)])
def test_bytes(spark, text, expected):
    (r,) = parse(spark, f'a b c [01/Jun/2026:08:00:10 +0000] "GET / HTTP/1.1" 304 {text} "-" "agent"')
    assert r.bytes == expected


def test_common_format_and_trailing_text(spark):
    rows = parse(spark, 'a b c [x] "GET / HTTP/1.1" 200 5', 'a b c [x] "GET / HTTP/1.1" 200 5 "r" "u" more "x"',
                 'a b c [x] "GET / HTTP/1.1" 200 5"6 "r" "u"', 'a b c [x] "GET / HTTP/1.1" 200 5 "r" "u"\r\n')
    assert [(r.bytes, r.referer, r.user_agent, r.ts) for r in rows] == [
        (5, "", "", None), (5, "r", "u", None), (0, "r", "u", None), (5, "r", "u", None)]
    assert not rows[3].raw.endswith("\n")


TIMES = [
    "01/Jun/2026:08:00:10 +0000", "1/jun/2026:8:0:1 -0130", "31/Dec/2026:23:59:59 +05:30", "02/Feb/2024:00:00:00 Z",
    "30/Feb/2024:00:00:00 +0000", "01/Jun/2026:24:00:00 +0000", "01/Jun/2026:10:60:00 +0000", "01/Jun/2026:10:00:60 +0000",
    "01/Jun/2026 10:00:00 +0000", "01/Foo/2026:10:00:00 +0000", "01/Jun/2026:10:00:00", "01/Jun/2026:10:00:00 ZZ",
    "01/Jun/2026:10:00:00 +053015", "01/Jun/2026:10:00:00 -05:30:15", "01/Jun/2026:10:00:00 +05:3015", "bad",
    " 1/Jun/2026:10:00:00 -0000", "01/Jun/0000:10:00:00 +0000", "01/Jun/2026:10:00:00  +0000", "01]Jun",
]


def test_times_match_the_standard_library(spark):
    times = [t for t in TIMES if "]" not in t]
    rows = parse_requests(lines_frame(spark, [f'a b c [{t}] "GET / HTTP/1.1" 200 1' for t in times]), keep=["line_no"])
    got = rows.select("line_no", F.unix_seconds("ts").alias("s"),
                      iso_timestamp(F.col("ts"), F.col("tz_offset")).alias("iso")).orderBy("line_no").collect()
    for t, r in zip(times, got):
        try:
            want = datetime.strptime(t, "%d/%b/%Y:%H:%M:%S %z")
        except ValueError:
            want = None
        assert (r.s, r.iso) == ((None, None) if want is None else
                                (int(want.astimezone(timezone.utc).timestamp()), want.isoformat())), t


def urlsplit_reference(target):
    try:
        parts = urlsplit(target)
    except ValueError:
        return None
    return (parts.path or target), parts.query


def test_targets_match_the_standard_library(spark):
    rng = random.Random(7)
    targets = ["", "*", "?q=1", "//host/p", "http://host", "http://host?x#y", "a:b", "/a#b?c", "#f", "/a?b?c#d#e",
               "host:443", "/a\tb", "\x01/x", "://x", "1a:b", "/a//b", "///x", "http:/x", "//", "/é?ü=1"]
    targets += ["".join(rng.choice("ab:/?#.%=&<'\t1+") for _ in range(rng.randrange(12))) for _ in range(600)]
    rows = split_target(spark.createDataFrame([(t,) for t in targets], "target string")).collect()
    for r in rows:
        want = urlsplit_reference(r.target)
        if want is not None:
            assert (r.path, r.query) == want, r.target


def test_a_hostile_target_does_not_fail(spark):
    (r,) = parse(spark, 'a b c [x] "GET //[x HTTP/1.1" 200 1')
    assert r.path == "//[x"


def test_quality_and_samples(spark):
    df = lines_frame(spark, [CALM, "  ", "", "junk", LOUD])
    assert parse_quality(df).first().asDict() == {"total": 3, "parsed": 2, "failed": 1}
    samples = parse_samples(df, "line_no").collect()
    assert [r.line_no for r in samples] == [1, 5] and "raw" not in samples[0].asDict()


def test_random_lines_match_one_regex(spark):
    pattern = re.compile(r'(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?')
    rng = random.Random(3)
    lines = []
    for _ in range(400):
        line = list(LOUD)
        for _ in range(rng.randrange(4)):
            line[rng.randrange(len(line))] = rng.choice(' "[]-x\t\x1d é')
        lines.append("".join(line))
    got = {r.line_no: r for r in parse_requests(lines_frame(spark, lines), keep=["line_no"]).collect()}
    for i, line in enumerate(lines, 1):
        m = pattern.match(line)
        assert (i in got) == (m is not None), line
        if m:
            assert (got[i].ip, got[i].ident, got[i].user, got[i].referer, got[i].user_agent) == (
                m[1], m[2], m[3], m[8] or "", m[9] or ""), line
