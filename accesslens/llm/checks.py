"""The queries of this package in SQL, for those that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: crc32 of blobs as lists of byte values: `steps` is the table of single bytes.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS steps
  FROM range(256) r(n))"""


def _crc32(code: str) -> str:
    """Of a text's bytes in hexadecimal."""
    bytes_ = f"list_transform(range(1, length({code}), 2), lambda i: ('0x' || substr({code}, i, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295] || {bytes_}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


_COMPONENTS = """reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)"""

OP1 = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
half AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
{_COMPONENTS}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a
"""


def _hilbert(bits: int) -> tuple[str, str]:
    """Common table expressions that turn the axes x0 to x3 of `axes` into `curve`, one step of the loop each."""
    text, last = "", "axes"
    for step in [1 << b for b in range(bits - 1, 0, -1)]:
        for i in range(4):
            swap = f"(xor(x0, x{i}) & {step - 1})"
            first = f"CASE WHEN x{i} & {step} > 0 THEN xor(x0, {step - 1}) ELSE xor(x0, {swap}) END"
            own = f"CASE WHEN x{i} & {step} > 0 THEN x{i} ELSE xor(x{i}, {swap}) END"
            changed = f"{first} AS x0" if i == 0 else f"{first} AS x0, {own} AS x{i}"
            if i == 0:
                changed = f"CASE WHEN x0 & {step} > 0 THEN xor(x0, {step - 1}) ELSE x0 END AS x0"
            text += f",\nturn{step}_{i} AS (SELECT * REPLACE ({changed}) FROM {last})"
            last = f"turn{step}_{i}"
    text += f",\ngray1 AS (SELECT * REPLACE (xor(x1, x0) AS x1) FROM {last}),\ngray2 AS (SELECT * REPLACE (xor(x2, x1) AS x2) FROM gray1)"
    text += ",\ngray3 AS (SELECT * REPLACE (xor(x3, x2) AS x3) FROM gray2)"
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x3 & {1 << b} > 0 THEN {(1 << b) - 1} ELSE 0 END)"
    text += f",\nflipped AS (SELECT *, {flip} AS flip FROM gray3)"
    terms = [f"(((xor(x{i}, flip) >> {b}) & 1) << {4 * b + 3 - i})" for b in range(bits) for i in range(4)]
    return text, " + ".join(terms)


_TURNS, _CURVE = _hilbert(6)

OP2 = f"""
WITH {_CRC_TABLE},
rows AS (
  SELECT doc_id, source, lang, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS code FROM documents),
sources AS (SELECT source, (row_number() OVER (ORDER BY source NULLS LAST) - 1) * 64 // count(*) OVER () AS x0 FROM (SELECT DISTINCT source FROM rows)),
langs AS (SELECT lang, (row_number() OVER (ORDER BY lang NULLS LAST) - 1) * 64 // count(*) OVER () AS x1 FROM (SELECT DISTINCT lang FROM rows)),
axes AS (
  SELECT doc_id, size, {_crc32("code")} AS text_crc32, x0, x1, least(floor(2 * (ln(size) / ln(2))), 63)::BIGINT AS x2,
         coalesce(floor((doc_id - min(doc_id) OVER ())::DOUBLE / greatest(1, max(doc_id) OVER () - min(doc_id) OVER ()) * 63), 0)::BIGINT AS x3
  FROM rows, crc_table JOIN sources ON rows.source IS NOT DISTINCT FROM sources.source JOIN langs ON rows.lang IS NOT DISTINCT FROM langs.lang){_TURNS},
curved AS (SELECT doc_id, size, text_crc32, {_CURVE} AS curve FROM flipped),
placed AS (
  SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM curved)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (number * 40 // n)::INTEGER AS shard,
       number - ((number * 40 // n) * n + 39) // 40 AS slot, NULL::INTEGER AS grown_shard, curve::BIGINT AS curve
FROM placed
"""

OP8 = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
half AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes o ON o.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, m.n, o.n HAVING 100 * count(*) >= 85 * (m.n + o.n - count(*))),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
{_COMPONENTS}
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, least(t.doc_id, coalesce(b, t.doc_id)) AS component_id, coalesce(counted.n, 0) AS n_links
FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN least ON t.doc_id = least.a LEFT JOIN counted ON t.doc_id = counted.a
"""

OP7 = f"""
WITH signed AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM signed WINDOW g AS (PARTITION BY text_sha256)
"""

OP10 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, coalesce(k.doc_id < r.keeper, false) AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-zÀ-ÿ]{{6,}}')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (SELECT *, hex(encode(doc_id || ':' || run)) AS code FROM runs),
hashed AS (SELECT run, times, {_crc32("code")} AS h FROM bytes, crc_table),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS (
  SELECT word, n, i, left(word, i - 1) || chr(1) || substr(word, i + 1) AS masked, left(word, i - 1) || substr(word, i + 1) AS shorter
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.shorter = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, CASE WHEN other_n >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
paths AS (
  SELECT word, coalesce(form, word) AS at FROM forms
  UNION SELECT p.word, f.form FROM paths p JOIN forms f ON p.at = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT p.word, p.at AS root FROM paths p JOIN forms f ON p.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

OP12 = f"""
WITH RECURSIVE rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '(?s)^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rest),
marks AS (
  SELECT doc_id, max((coalesce(toxic = 1, false) OR coalesce(quality = 0, false))::INT) AS bad FROM labels
  WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT host, count(doc_id)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
  FROM parted LEFT JOIN marks ON doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT) GROUP BY host),
labelled AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '.') AS labels FROM counts),
hosts AS (SELECT host, n, k, array_to_string(labels[-2:], '.') AS domain, labels[-1] AS suffix FROM labelled),
level1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM hosts) AS mean FROM hosts GROUP BY suffix),
strength1 AS (SELECT {"{strength}"} AS s FROM level1),
mean1 AS (SELECT suffix, (k + s * mean) / (n + s) AS mean FROM level1, strength1),
level2 AS (SELECT domain, suffix, mean, sum(n) AS n, sum(k) AS k FROM hosts JOIN mean1 USING (suffix) GROUP BY ALL),
strength2 AS (SELECT {"{strength}"} AS s FROM level2),
mean2 AS (SELECT domain, (k + s * mean) / (n + s) AS mean FROM level2, strength2),
level3 AS (SELECT host, n, k, mean FROM hosts JOIN mean2 USING (domain)),
strength3 AS (SELECT {"{strength}"} AS s FROM level3),
posterior AS (SELECT host, n::BIGINT AS n_outcomes, greatest(k + s * mean, 0.5) AS a, greatest(n - k + s * (1 - mean), 0.5) AS b FROM level3, strength3),
turned AS (
  SELECT host, n_outcomes, 0.3 >= (a + 1) / (a + b + 2) AS swap, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(0.3) + b * ln(0.7)) AS front,
         CASE WHEN swap THEN b ELSE a END AS p, CASE WHEN swap THEN a ELSE b END AS q, CASE WHEN swap THEN 0.7 ELSE 0.3 END AS x FROM posterior),
fraction AS (
  SELECT host, 1 AS m, p, q, x, 1.0::DOUBLE AS c, 1 / (1 - (p + q) * x / (p + 1)) AS d, 1 / (1 - (p + q) * x / (p + 1)) AS h FROM turned
  UNION ALL
  SELECT host, m + 1, p, q, x, 1 + odd / c1, 1 / (1 + odd * d1), h * d1 * c1 * (1 + odd / c1) / (1 + odd * d1)
  FROM (SELECT *, 1 / (1 + even * d) AS d1, 1 + even / c AS c1 FROM (
          SELECT *, m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)) AS even, -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1)) AS odd FROM fraction))
  WHERE m <= 100 + 5 * sqrt(greatest(p, q))),
tails AS (
  SELECT t.host, n_outcomes, CASE WHEN swap THEN front * h / t.p ELSE 1 - front * h / t.p END AS tail
  FROM turned t JOIN (SELECT host, arg_max(h, m) AS h FROM fraction GROUP BY host) USING (host)),
ruled AS (
  SELECT page_id, host, path, CASE
      WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
      WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
      WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM parted)
SELECT page_id, host, path, rule, n_outcomes, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN tail >= 0.95 AND (SELECT sum(n) FROM hosts) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN tails USING (host)
""".replace("{strength}", """CASE WHEN sum(n * (n - 1)) > 0 AND sum(CASE WHEN mean * (1 - mean) > 0 THEN (k - n * mean) ** 2 / (mean * (1 - mean)) - n ELSE 0 END) > 0
    THEN greatest(1.0, least(10000.0, sum(n * (n - 1)) / sum(CASE WHEN mean * (1 - mean) > 0 THEN (k - n * mean) ** 2 / (mean * (1 - mean)) - n ELSE 0 END) - 1))
    ELSE 10000.0 END""")

OP13 = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
facts AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(words) < 100, 'B': 100 * list_unique(words) < 80 * len(words),
          'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
          'E': doc_id > min(doc_id) OVER (PARTITION BY text)} AS fails
  FROM texts LEFT JOIN marks USING (doc_id)),
groups AS (
  SELECT part, fails.A::INT || fails.B::INT || fails.C::INT || fails.D::INT || fails.E::INT AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM facts GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
steps AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS f FROM orders, range(1, 6) r(step)),
met AS (
  SELECT g.part, s.filter_order, s.step, s.f, g.n, g.good, g.toxic, substr(g.fails, ascii(s.f) - 64, 1) = '1' AS fails,
         len(list_filter(range(1, s.step), lambda i: substr(g.fails, ascii(substr(s.filter_order, i, 1)) - 64, 1) = '1')) > 0 AS before,
         length(replace(g.fails, '0', '')) = 1 AS only_one
  FROM groups g, steps s),
summed AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT before), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE fails AND NOT before), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE fails AND before), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails AND only_one), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails AND NOT before), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT before), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM summed
"""


def llm_checks() -> dict[str, str]:
    return {"op1_lattice_dedup": OP1, "op2_hilbert_shards": OP2, "op7_exact_dedup": OP7, "op8_jaccard_join": OP8, "op10_line_dedup": OP10, "op11_spelling_variants": OP11, "op12_host_reputation": OP12,
            "op13_filter_audit": OP13}
