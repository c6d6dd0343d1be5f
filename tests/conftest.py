import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from accesslens.functions.request_features import SPECIAL_CHARS, SUSPICIOUS_TOKENS, TOOL_AGENTS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from accesslens.session import tune
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "America/New_York")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


def log_line(target="/", method="GET", status=200, size=512, agent="agent a", referer="-", ip="203.0.113.5", second=0):
    """One line of the combined format from the fields that a test is about."""
    time = f"07/Mar/2027:{second // 3600 % 24:02d}:{second // 60 % 60:02d}:{second % 60:02d} +0000"
    return f'{ip} - - [{time}] "{method} {target} HTTP/1.1" {status} {size} "{referer}" "{agent}"'


# One line without any signal, and three that each push other features far out:
# tokens and a tool's agent, special characters, path segments and digits.
CALM = log_line("/k1/p2", referer="https://from.example/")
LOUD = log_line("/loud?z=" + "<".join(SUSPICIOUS_TOKENS[:6]), agent=TOOL_AGENTS[2], ip="203.0.113.77")
DENSE = log_line("/dense?z=" + 2 * SPECIAL_CHARS.replace('"', ""), status=403, ip="203.0.113.78")
DEEP = log_line("/deep" + "/4096" * 30, status=403)


def calm_lines(n=3000):
    """Ordinary traffic, with every combination of method, depth, query, status and agent."""
    return [log_line(f"/k{i % 8}/p{i % 31}" + (f"?n={i % 60}" if i % 3 else ""), "POST" if i % 9 == 0 else "GET",
                     (200, 200, 204, 302, 200, 404, 500)[i // 9 % 7], 37 * i % 6000, f"agent {'abc'[i % 5 % 3]}", ip=f"10.1.{i % 200}.{i % 251}", second=i)
            for i in range(n)]


def lines_frame(spark, lines):
    return spark.createDataFrame([(i + 1, line) for i, line in enumerate(lines)], "line_no bigint, value string")


@pytest.fixture(scope="session")
def trained(spark):
    from accesslens.operators.featurizing import add_features
    from accesslens.operators.parsing import parse_requests
    from accesslens.operators.training import train_detector
    features = add_features(parse_requests(lines_frame(spark, calm_lines()), keep=["line_no"]))
    bundle, losses = train_detector(features.persist(), "line_no", rounds=25, batch=64, local_epochs=3)
    return bundle, losses
