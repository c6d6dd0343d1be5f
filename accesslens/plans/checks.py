"""The queries again as plain SQL for a second engine, written independently of the operators."""

from __future__ import annotations

from accesslens.functions.request_features import SPECIAL_CHARS, SUSPICIOUS_TOKENS, TOOL_AGENTS
from accesslens.functions.text import HTML_ENTITIES, MARKED_FRAGMENTS
from accesslens.models.bundle import packaged
from accesslens.plans.event_lines import ANSI, lines_sql, messy_sql
from accesslens.schemas import FEATURE_NAMES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LINE = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?'
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PARTS = "['ip', 'ident', 'usr', 'tm', 'request', 'status', 'bytes', 'referer', 'ua']"


def _lines(messy: bool) -> str:
    text = messy_sql(ANSI) if messy else lines_sql(ANSI)
    return f"lines AS ({text})"


def _requests(messy: bool) -> str:
    label = "" if messy else ", label"
    off = "regexp_extract(g.tm, ' ([^ ]*)$', 1)"
    hours, minutes = f"TRY_CAST(substr({off}, 2, 2) AS INTEGER)", f"TRY_CAST(right({off}, 2) AS INTEGER)"
    return f"""{_lines(messy)},
matched AS (SELECT *, regexp_extract(line, {_quoted(_LINE)}, {_PARTS}) AS g FROM lines
            WHERE regexp_matches(line, {_quoted(_LINE)})),
cut AS (SELECT *, string_split(g.request, ' ') AS p,
          try_strptime(substr(g.tm, 1, 20), '%d/%b/%Y:%H:%M:%S') AS wall,
          CASE WHEN {off} IN ('Z', '') THEN 0
               ELSE (CASE WHEN {off} LIKE '-%' THEN -1 ELSE 1 END) * ({hours} * 3600 + {minutes} * 60) END AS off_s
        FROM matched),
aimed AS (SELECT *, CASE WHEN len(p) >= 2 THEN p[2] ELSE '' END AS target FROM cut),
requests AS (SELECT event_id{label}, line AS raw, g.ip AS ip, g.ident AS ident, g.usr AS user_name,
    coalesce(CAST(epoch(wall) AS BIGINT) - off_s, -1) AS epoch,
    CASE WHEN wall IS NULL THEN NULL ELSE concat(CASE WHEN off_s < 0 THEN '-' ELSE '+' END,
         lpad(CAST(abs(off_s) // 3600 AS VARCHAR), 2, '0'), ':',
         lpad(CAST(abs(off_s) // 60 % 60 AS VARCHAR), 2, '0')) END AS tz_offset,
    wall, p[1] AS method,
    CASE WHEN regexp_extract(target, {_quoted(_URL)}, 3) = '' THEN target
         ELSE regexp_extract(target, {_quoted(_URL)}, 3) END AS path,
    regexp_extract(target, {_quoted(_URL)}, 4) AS query,
    CASE WHEN len(p) >= 3 THEN p[-1] ELSE '' END AS protocol,
    CAST(g.status AS INTEGER) AS status,
    CASE WHEN regexp_full_match(g.bytes, '[0-9]+') THEN TRY_CAST(g.bytes AS BIGINT) ELSE 0 END AS bytes,
    g.referer AS referer, g.ua AS user_agent FROM aimed)"""


def _class(chars: str) -> str:
    return "".join("\\" + c for c in chars)


def _features(messy: bool) -> str:
    label = "" if messy else ", label"
    tokens = " + ".join(
        f"(length(blob) - length(replace(blob, {_quoted(t)}, ''))) // {len(t)}" for t in SUSPICIOUS_TOKENS)
    special = f"length(regexp_replace(pq, {_quoted('[^' + _class(SPECIAL_CHARS) + ']')}, '', 'g'))"
    tools = " OR ".join(f"contains(agent, {_quoted(t)})" for t in TOOL_AGENTS)
    values = {
        "path_len": "length(path)",
        "query_len": "length(query)",
        "n_path_segments": "length(regexp_replace(path, '[^/]', '', 'g'))",
        "n_special": special,
        "special_ratio": f"{special} / greatest(length(pq), 1)",
        "n_percent": "length(regexp_replace(pq, '[^%]', '', 'g'))",
        "n_digits": "length(regexp_replace(pq, '[^0-9]', '', 'g'))",
        "path_entropy": "coalesce(list_entropy(string_split(path, '')), 0)",
        "query_entropy": "coalesce(list_entropy(string_split(query, '')), 0)",
        "n_suspicious_tokens": tokens,
        "is_get": "upper(method) = 'GET'",
        "is_post": "upper(method) = 'POST'",
        "is_other_method": "upper(method) NOT IN ('GET', 'POST')",
        "is_2xx": "status BETWEEN 200 AND 299",
        "is_3xx": "status BETWEEN 300 AND 399",
        "is_4xx": "status BETWEEN 400 AND 499",
        "is_5xx": "status BETWEEN 500 AND 599",
        "log_bytes": "ln(1 + greatest(bytes, 0))",
        "ua_len": "length(agent)",
        "ua_is_tool": tools,
    }
    columns = ",\n    ".join(f"CAST({values[n]} AS DOUBLE) AS {n}" for n in FEATURE_NAMES)
    return f"""{_requests(messy)},
prepared AS (SELECT *, concat(path, query) AS pq, lower(concat(path, query)) AS blob,
    lower(user_agent) AS agent FROM requests),
features AS (SELECT event_id{label}, raw, method, path, query, status,
    {columns} FROM prepared)"""


def _vector(values) -> str:
    return "[" + ", ".join(f"{float(x)!r}" for x in values) + "]::DOUBLE[]"


def _x() -> str:
    b = packaged()
    return ", ".join(f"({n} - ({m!r}::DOUBLE)) / ({s!r}::DOUBLE)" for n, m, s in zip(b.feature_names, b.mean, b.std))


def _recon(messy: bool) -> str:
    """Layers as dot products of weight rows with the bias behind them and an input ending in 1."""
    b, text, previous = packaged(), "", "x"
    for depth, (w, bias) in enumerate(zip(b.weights, b.biases)):
        rows = "[" + ", ".join("[" + ", ".join(f"{v!r}" for v in [*r, c]) + "]" for r, c in zip(w, bias)) + "]::DOUBLE[][]"
        dot = f"list_dot_product(w, list_append({previous}, 1.0::DOUBLE))"
        unit = dot if depth == 3 else f"greatest({dot}, 0.0)"
        source = "standard" if depth == 0 else f"layer{depth - 1}"
        name = f"layer{depth}"
        text += f",\n{name} AS (SELECT *, list_transform({rows}, lambda w: {unit}) AS h{depth} FROM {source})"
        previous = f"h{depth}"
    return f"""{_features(messy)},
standard AS (SELECT *, [{_x()}]::DOUBLE[] AS x FROM features){text}"""


def _scores(messy: bool = False) -> str:
    b = packaged()
    names = "[" + ", ".join(_quoted(n) for n in FEATURE_NAMES) + "]"
    return f"""{_recon(messy)},
errors AS (SELECT *, list_transform(range(1, 21), lambda i: (h3[i] - x[i]) ** 2) AS errs FROM layer3),
ranked AS (SELECT *, list_sum(errs) / 20 AS error,
    list_slice(list_reverse_sort(list_transform(range(1, 21), lambda i: {{'e': errs[i], 'i': i}})), 1, 3) AS top
  FROM errors),
scores AS (SELECT *, round(error, 5) AS score, error > {b.threshold!r}::DOUBLE AS is_anomaly,
    {b.threshold!r}::DOUBLE AS threshold,
    array_to_string(list_transform(top, lambda t: {names}[t.i]), ',') AS drivers FROM ranked)"""


def _labelled() -> str:
    return f"""{_scores()},
labelled AS (SELECT s.event_id, s.raw, s.error, s.is_anomaly, l.toxic AS label
             FROM scores s JOIN labels l ON s.event_id = l.doc_id)"""


def _round(names, digits=6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _report() -> str:
    return f"""{_scores()},
report AS (SELECT event_id, score, method, path, query, status, drivers FROM scores
           WHERE is_anomaly ORDER BY score DESC, event_id LIMIT 200)"""


def _escaped(column: str) -> str:
    for char, entity in HTML_ENTITIES:
        column = f"replace({column}, {_quoted(char)}, {_quoted(entity)})"
    return column


_ISO = "concat(replace(CAST(wall AS VARCHAR), ' ', 'T'), tz_offset)"
_ISO = f"CASE WHEN wall IS NULL THEN NULL ELSE {_ISO} END"

_SCANS = """ips AS (SELECT user_id, count(*) AS lines, count(*) FILTER (WHERE event_id % 20 = 0) AS anomalies,
    concat('10.', CAST(user_id % 256 AS VARCHAR), '.0.1') AS ip FROM events GROUP BY user_id),
scans AS (SELECT CAST(user_id AS VARCHAR) AS scan_id, lines, anomalies,
    substr(sha256(concat('query-salt|', CASE WHEN user_id % 3 = 0 OR user_id % 7 <> 0 THEN ip ELSE 'unknown' END)), 1, 32)
      AS visitor_hash FROM ips)"""


# The log file of an event, of 16 of consecutive events each.
_PART = "event_id * 16 // (SELECT max(event_id) + 1 FROM events)"


def all_checks() -> dict[str, str]:
    from accesslens.plans.queries import ONE_HOT, STRUCTURAL
    b = packaged()
    verdict = f"""WITH {_scores()} SELECT event_id AS "offset", method, path, query, status, score, is_anomaly,
        threshold, drivers FROM scores"""
    key = f"CASE WHEN regexp_matches(line, {_quoted(_LINE)}) THEN regexp_extract(line, '^([^ ]+)', 1) ELSE 'unknown' END"
    metrics = f"""WITH {_labelled()}, c AS (SELECT count(*) AS n,
            count(*) FILTER (WHERE is_anomaly AND label = 1) AS tp, count(*) FILTER (WHERE is_anomaly AND label <> 1) AS fp,
            count(*) FILTER (WHERE NOT is_anomaly AND label = 1) AS fn,
            count(*) FILTER (WHERE NOT is_anomaly AND label <> 1) AS tn FROM labelled)
            SELECT *, coalesce(round(tp / nullif(tp + fp, 0), 6), 0.0) AS precision,
            coalesce(round(tp / nullif(tp + fn, 0), 6), 0.0) AS recall,
            coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0.0) AS f1 FROM c"""
    normal_scores = f"WITH {_scores()}"
    return {
        "suspicious_by_status": f"""WITH {_features(False)} SELECT status, count(*) AS n_requests,
            CAST(sum(n_suspicious_tokens) AS BIGINT) AS n_tokens, CAST(sum(ua_is_tool) AS BIGINT) AS n_tool_agents
            FROM features GROUP BY status""",
        "parsed_requests": f"""WITH {_requests(True)} SELECT event_id, ip, ident, user_name, epoch, tz_offset, method,
            path, query, protocol, status, bytes, referer, user_agent FROM requests""",
        "parse_quality_report": f"""WITH {_lines(True)} SELECT count(*) AS total,
            count(*) FILTER (WHERE regexp_matches(line, {_quoted(_LINE)})) AS parsed,
            count(*) FILTER (WHERE NOT regexp_matches(line, {_quoted(_LINE)})) AS failed
            FROM lines WHERE trim(line) <> ''""",
        "parse_quality_samples": f"""WITH {_requests(True)} SELECT event_id, ip, method, path, query, status, bytes
            FROM requests ORDER BY event_id LIMIT 3""",
        "target_split": f"""SELECT page_id, CASE WHEN regexp_extract(url, {_quoted(_URL)}, 3) = '' THEN url
            ELSE regexp_extract(url, {_quoted(_URL)}, 3) END AS path,
            regexp_extract(url, {_quoted(_URL)}, 4) AS query FROM pages""",
        "iso_timestamps": f"WITH {_requests(True)} SELECT event_id, {_ISO} AS iso_time FROM requests",
        "features_structural": f"WITH {_features(True)} SELECT event_id, {_round(STRUCTURAL)} FROM features",
        "features_entropy": f"""WITH {_features(True)} SELECT event_id,
            {_round(['path_entropy', 'query_entropy'])} FROM features""",
        "features_tokens": f"WITH {_features(True)} SELECT event_id, n_suspicious_tokens, ua_is_tool FROM features",
        "features_onehot": f"WITH {_features(True)} SELECT event_id, {', '.join(ONE_HOT)} FROM features",
        "feature_vectors": f"""WITH {_features(True)}, v AS (SELECT event_id, [{', '.join(FEATURE_NAMES)}] AS f FROM features)
            SELECT event_id, CAST(i - 1 AS INTEGER) AS position, round(f[i], 6) AS value
            FROM v, (SELECT unnest(range(1, 21)) AS i)""",
        "features_preview": f"""WITH {_features(True)} SELECT event_id, {_round(FEATURE_NAMES, 3)}
            FROM features ORDER BY event_id LIMIT 5""",
        "fit_scaler": f"WITH {_features(False)} " + " UNION ALL ".join(
            f"""SELECT '{n}' AS feature, round(avg({n}), 6) AS mean,
            round(CASE WHEN stddev_pop({n}) = 0 THEN 1 ELSE stddev_pop({n}) END, 6) AS std
            FROM features WHERE label = 0""" for n in FEATURE_NAMES),
        "standardized_features": f"""WITH {_features(False)},
            s AS (SELECT event_id, [{_x()}]::DOUBLE[] AS x FROM features) SELECT event_id, """
            + ", ".join(f"round(x[{i + 1}], 6) AS {n}" for i, n in enumerate(FEATURE_NAMES)) + " FROM s",
        "reconstructions": f"""WITH {_recon(False)} SELECT event_id, CAST(i - 1 AS INTEGER) AS position,
            round(h3[i], 4) + 0.0 AS value FROM layer3, (SELECT unnest(range(1, 21)) AS i)""",
        "score_requests": f"""WITH {_scores()} SELECT event_id, method, path, query, status, score, is_anomaly,
            threshold FROM scores""",
        "top_drivers": f"""WITH {_scores()}, t AS (SELECT event_id, i, top[i + 1] AS d FROM scores,
            (SELECT unnest(range(0, 3)) AS i)) SELECT event_id, CAST(i AS INTEGER) AS rank,
            [{', '.join(_quoted(n) for n in FEATURE_NAMES)}][d.i] AS feature, round(d.e, 4) AS contribution FROM t""",
        "score_feature_vectors": f"WITH {_scores()} SELECT event_id, score, is_anomaly, drivers FROM scores",
        "error_threshold": f"""{normal_scores} SELECT round(quantile_cont(error, 0.99), 6) AS threshold
            FROM scores WHERE label = 0""",
        "error_summary": f"""{normal_scores} SELECT CAST(count(*) AS INTEGER) AS n_rows, round(avg(error), 5) AS error_mean,
            round(quantile_cont(error, 0.99), 5) AS error_percentile, round(max(error), 5) AS error_max
            FROM scores WHERE label = 0""",
        "parity": f"""WITH {_requests(False)} SELECT count(*) AS n_rows, true AS scores_agree,
            CAST(0 AS BIGINT) AS n_driver_mismatches FROM requests""",
        "anomaly_listing": f"""WITH {_scores()} SELECT event_id, score, method, path, substr(query, 1, 50) AS query,
            array_to_string(list_transform(top, lambda t: concat([{', '.join(_quoted(n) for n in FEATURE_NAMES)}][t.i],
            '=', CAST(round(t.e, 4) AS VARCHAR))), ', ') AS drivers FROM scores WHERE is_anomaly
            ORDER BY event_id LIMIT 8""",
        "listing_totals": f"""WITH {_scores(True)} SELECT count(*) FILTER (WHERE is_anomaly) AS anomalies,
            (SELECT count(*) FROM lines) AS total_lines FROM scores""",
        "scan_summary": f"""WITH {_scores(True)} SELECT (SELECT count(*) FROM lines) AS total_lines, count(*) AS parsed,
            count(*) FILTER (WHERE is_anomaly) AS anomalies,
            round(count(*) FILTER (WHERE is_anomaly) / count(*), 4) AS anomaly_rate,
            {b.threshold!r}::DOUBLE AS threshold, count(*) FILTER (WHERE is_anomaly) > 200 AS truncated FROM scores""",
        "ranked_anomalies": f"""WITH {_scores()} SELECT event_id, score, path FROM scores WHERE is_anomaly
            ORDER BY score DESC, event_id""",
        "anomaly_report": f"WITH {_report()} SELECT * FROM report",
        "severity": f"""WITH {_report()} SELECT event_id, score, round(score / {b.threshold!r}::DOUBLE, 1) AS times_over,
            CAST(round(greatest(6.0, score / (max(score) OVER ()) * 100), 0) AS INTEGER) AS bar_width FROM report""",
        "report_markup": f"""WITH {_requests(True)} SELECT event_id, CASE WHEN status >= 500 THEN 's5'
            WHEN status >= 400 THEN 's4' WHEN status >= 300 THEN 's3' ELSE 's2' END AS status_class,
            {_escaped('path')} AS path_html, regexp_replace({_escaped('query')},
            {_quoted('(' + MARKED_FRAGMENTS + ')')}, '<mark>\\1</mark>', 'gi') AS query_html FROM requests""",
        "label_join": f"WITH {_labelled()} SELECT event_id, label, is_anomaly FROM labelled",
        "eval_metrics": metrics,
        "eval_files": metrics,
        "eval_misses": f"""WITH {_labelled()} SELECT * FROM (SELECT 'false_negative' AS kind, round(error, 5) AS error,
            substr(raw, 1, 120) AS raw FROM (SELECT * FROM labelled WHERE label = 1 AND NOT is_anomaly
            ORDER BY labelled.error, labelled.raw LIMIT 5)) UNION ALL
            SELECT * FROM (SELECT 'false_positive' AS kind, round(error, 5) AS error, substr(raw, 1, 120) AS raw
            FROM (SELECT * FROM labelled WHERE label = 0 AND is_anomaly
            ORDER BY labelled.error DESC, labelled.raw DESC LIMIT 5))""",
        "misclassified": f"""WITH {_labelled()} SELECT event_id,
            CASE WHEN label = 1 THEN 'false_negative' ELSE 'false_positive' END AS kind FROM labelled
            WHERE (label = 1 AND NOT is_anomaly) OR (label = 0 AND is_anomaly)""",
        "parsed_messages": f"""WITH {_features(True)} SELECT f.event_id AS "offset", f.raw, {_ISO} AS iso_time, f.method,
            f.path, f.query, f.status, r.bytes, round(f.path_entropy, 6) AS path_entropy,
            CAST(20 AS INTEGER) AS n_features FROM features f JOIN requests r ON f.event_id = r.event_id""",
        "verdict_messages": f"""WITH {_scores()} SELECT event_id AS "offset", raw, method, path, query, status, score, is_anomaly,
            threshold, drivers FROM scores""",
        "keyed_lines": f"WITH {_lines(True)} SELECT {key} AS key, line AS value FROM lines WHERE line <> ''",
        "sharded_lines": f"""WITH {_lines(True)} SELECT {key} AS key, count(*) AS n_lines, CAST(1 AS BIGINT) AS n_shards
            FROM lines WHERE line <> '' GROUP BY 1""",
        "verdict_stats": f"""WITH {_scores()} SELECT count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomalies,
            round(count(*) FILTER (WHERE is_anomaly) / count(*), 4) AS anomaly_rate FROM scores""",
        "recent_anomalies": f"""WITH {_scores()} SELECT event_id AS "offset", path, status, score, drivers FROM scores
            WHERE is_anomaly ORDER BY event_id DESC LIMIT 50""",
        "decimal_verdicts": f"""WITH {_scores()} SELECT event_id AS "offset",
            CAST(CAST(CAST(score AS VARCHAR) AS DECIMAL(38, 17)) AS VARCHAR) AS score,
            CAST(CAST(CAST(threshold AS VARCHAR) AS DECIMAL(38, 17)) AS VARCHAR) AS threshold, is_anomaly FROM scores""",
        "replayed_batch": verdict,
        "bundle_round_trip": f"WITH {_scores()} SELECT event_id, score, is_anomaly, threshold FROM scores",
        "published_lines": f"WITH {_lines(True)} SELECT line AS value FROM lines WHERE line <> ''",
        "upload_scan": f"""WITH {_scores(True)} SELECT 'upload' AS filename, (SELECT count(*) FROM lines) AS total_lines, count(*) AS parsed,
            count(*) FILTER (WHERE is_anomaly) AS anomalies,
            round(count(*) FILTER (WHERE is_anomaly) / count(*), 4) AS anomaly_rate,
            {b.threshold!r}::DOUBLE AS threshold, count(*) FILTER (WHERE is_anomaly) > 200 AS truncated FROM scores""",
        "label_csv": "SELECT doc_id AS line_no, toxic AS label FROM labels",
        "recorded_usage": """WITH scans AS (SELECT user_id % 256 AS visitor, count(*) AS lines,
            count(*) FILTER (WHERE event_id % 20 = 0) AS anomalies FROM events GROUP BY user_id)
            SELECT count(*) AS scans_run, CAST(sum(lines) AS BIGINT) AS lines_processed,
            CAST(sum(anomalies) AS BIGINT) AS anomalies_flagged, count(DISTINCT visitor) AS unique_visitors FROM scans""",
        "train_detector": f"""WITH {_lines(False)} SELECT CAST(60 AS BIGINT) AS rounds, count(*) AS n_rows, true AS loss_fell,
            CAST(0 AS BIGINT) AS missed_attacks, count(*) - 1 - CAST(floor(0.99 * (count(*) - 1)) AS BIGINT) AS flagged_normals
            FROM lines WHERE label = 0""",
        "visitor_hashes": f"WITH {_SCANS} SELECT scan_id, visitor_hash FROM scans",
        "usage_totals": f"""WITH {_SCANS} SELECT count(*) AS scans_run, CAST(sum(lines) AS BIGINT) AS lines_processed,
            CAST(sum(anomalies) AS BIGINT) AS anomalies_flagged, count(DISTINCT visitor_hash) AS unique_visitors
            FROM scans""",
        "numbered_lines": f"""WITH {_lines(False)} SELECT {_PART} AS part,
            row_number() OVER (PARTITION BY {_PART} ORDER BY event_id) AS line_no, line FROM lines""",
        "sketched_visitors": """SELECT count(*) AS scans_run, count(DISTINCT user_id) AS unique_visitors,
            true AS estimate_holds, true AS days_add_up FROM events""",
        "sketched_threshold": f"WITH {_lines(False)} SELECT count(*) AS n_rows, true AS rank_holds FROM lines WHERE label = 0",
        "stream_pipeline": verdict,
        "stream_stages": f"""WITH {_scores()} SELECT {_PART} AS part,
            row_number() OVER (PARTITION BY {_PART} ORDER BY event_id) AS "offset", method, path, query, status, score,
            is_anomaly, threshold, drivers FROM scores""",
        "stream_progress": f"""WITH {_scores()}, c AS (SELECT count(*) AS n,
            count(*) FILTER (WHERE is_anomaly) AS a FROM scores) SELECT n AS ingest_consumed, n AS ingest_parsed,
            CAST(0 AS BIGINT) AS ingest_skipped, n AS score_scored, a AS score_anomalies, n AS store_stored,
            a AS store_anomalies FROM c""",
    }
