import math
import random
from collections import Counter

from conftest import LOUD, CALM, lines_frame
from pyspark.sql import functions as F

from accesslens.functions.request_features import SPECIAL_CHARS, SUSPICIOUS_TOKENS
from accesslens.operators.featurizing import add_feature_array, add_features, feature_preview
from accesslens.operators.parsing import parse_requests
from accesslens.schemas import FEATURE_NAMES


def features(spark, *lines):
    return add_features(parse_requests(lines_frame(spark, lines), keep=["line_no"])).orderBy("line_no").collect()


def test_vector_has_all_features_in_order(spark):
    df = add_feature_array(add_features(parse_requests(lines_frame(spark, [CALM]))))
    row = df.first()
    assert row.features == [row[n] for n in FEATURE_NAMES] and len(row.features) == 20


def test_attack_stands_out(spark):
    normal, attack = features(spark, CALM, LOUD)
    assert attack.n_special > normal.n_special and attack.n_suspicious_tokens > normal.n_suspicious_tokens
    assert (attack.ua_is_tool, normal.ua_is_tool) == (1.0, 0.0)


def test_method_and_status(spark):
    (f,) = features(spark, 'a b c [x] "POST /in HTTP/1.1" 404 10 "-" "agent"')
    assert (f.is_post, f.is_get, f.is_other_method, f.is_4xx, f.is_2xx) == (1.0, 0.0, 0.0, 1.0, 0.0)


def test_null_fields_count_as_empty(spark):
    row = add_features(spark.sql("""SELECT CAST(NULL AS STRING) path, CAST(NULL AS STRING) query,
        CAST(NULL AS STRING) method, CAST(NULL AS INT) status, CAST(NULL AS BIGINT) bytes,
        CAST(NULL AS STRING) user_agent""")).first()
    assert row.path_len == 0 and row.special_ratio == 0 and row.path_entropy == 0 and row.is_other_method == 1


def entropy(s):
    return -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values()) if s else 0.0


def test_random_text_matches_plain_python(spark):
    rng = random.Random(11)
    alphabet = list("ab/%<>'\"\\-=1.") + ["--", "---", "select", "SCRIPT", "' or", "1=1", "../", "..\\", "é", "²", "٣", "😀"]
    rows = [("".join(rng.choices(alphabet, k=rng.randrange(20))), "".join(rng.choices(alphabet, k=rng.randrange(20))))
            for _ in range(500)]
    df = spark.createDataFrame(rows, "path string, query string").selectExpr(
        "*", "'Get' method", "299 status", "-5L bytes", "'İ Nikto' user_agent")
    for r in add_features(df).collect():
        both = r.path + r.query
        special = sum(c in SPECIAL_CHARS for c in both)
        assert r.path_len == len(r.path) and r.n_special == special
        assert r.special_ratio == special / (len(both) or 1)
        assert r.n_digits == sum(c.isdigit() for c in both)
        assert r.n_suspicious_tokens == sum(both.lower().count(t) for t in SUSPICIOUS_TOKENS), both
        assert abs(r.path_entropy - entropy(r.path)) < 1e-12 and abs(r.query_entropy - entropy(r.query)) < 1e-12
        assert (r.n_percent, r.n_path_segments) == (both.count("%"), r.path.count("/"))
        assert (r.is_get, r.is_2xx, r.log_bytes, r.ua_len, r.ua_is_tool) == (1, 1, 0, len("İ Nikto".lower()), 1)


def test_preview(spark):
    df = add_features(parse_requests(lines_frame(spark, [CALM] * 7), keep=["line_no"]))
    rows = feature_preview(df, "line_no").collect()
    assert len(rows) == 5 and rows[0].path_entropy == round(rows[0].path_entropy, 3)


def test_exploding_the_vector_computes_no_feature_twice(spark):
    df = add_feature_array(add_features(parse_requests(lines_frame(spark, [CALM, LOUD]), keep=["line_no"])))
    rows = df.select("line_no", F.posexplode("features").alias("position", "value"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == df.select("line_no", "features")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert rows.count() == 40
