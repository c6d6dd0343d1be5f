"""URL filters with empirical-Bayes host reputation.

Rules settle the pages that they fit.  For all others the labelled outcomes of a host are shrunk towards those of its
registered domain, these towards those of its suffix, and these towards the rate of all pages.  At each level the
outcomes are beta-binomial about the level above; the strength of the prior is the one that explains how much the
level's rates scatter (moments, all groups at once).  A host is blocked when its posterior puts enough weight on rates
above a limit, so a host with few outcomes is judged by its domain and not by chance.

Everything is a column expression, the incomplete beta function included (Lentz's continued fraction inside
`aggregate`), and it is computed once for each host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.support import LOWER, UPPER, broadcast_if_small, settled
from accesslens.session import cut_lineage

#: (verdict, host and path); the longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A host is blocked when its rate of bad pages is above LIMIT with a posterior probability of CONFIDENCE or more.
LIMIT, CONFIDENCE = 0.3, 0.95
#: Bounds of a prior's strength, in outcomes.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
_TINY = 1e-300
#: Lanczos coefficients for g = 7 (fixed values).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
            -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ://."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def levels(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port.

    The suffix is the last label, or the longest of the given suffixes of several labels (like co.uk); the domain has
    one label more, or is the whole host if it has none.
    """
    labels = F.split(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.")
    bare = F.array_join(labels, ".")
    depth = F.lit(1)
    for known in sorted(suffixes, key=lambda s: s.count(".")):
        fits = (bare == known) | bare.endswith(f".{known}")
        depth = F.when(fits, F.lit(known.count(".") + 1)).otherwise(depth)
    size = F.size(labels)

    def last(n: Column) -> Column:
        return F.array_join(F.slice(labels, F.greatest(size - n + 1, F.lit(1)), n), ".")

    return last(depth + 1), last(depth)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, begin = text.split("/", 1)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{begin}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5 (Lanczos)."""
    y = x - 1
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(0.9189385332046727) + (y + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function for x < (a + 1) / (a + b + 2).

    It converges in a number of steps that grows with the root of the larger parameter, so a host of many outcomes takes more.
    """
    def off_zero(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def turn(state: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.transform(
            F.transform(F.array(state), lambda s: F.struct((1 / off_zero(1 + even * s["d"])).alias("d"), off_zero(1 + even / s["c"]).alias("c"), s["h"].alias("h"))),
            lambda s: F.struct(s["d"].alias("e"), s["c"].alias("f"), (s["h"] * s["d"] * s["c"]).alias("h"),
                               (1 / off_zero(1 + odd * s["d"])).alias("d"), off_zero(1 + odd / s["c"]).alias("c")))[0]

    def step(state: Column, m: Column) -> Column:
        return F.transform(F.array(turn(state, m)), lambda s: F.struct(s["d"].alias("d"), s["c"].alias("c"), (s["h"] * s["d"] * s["c"]).alias("h")))[0]

    first = 1 / off_zero(1 - (a + b) * x / (a + 1))
    steps = (100 + 5 * F.sqrt(F.greatest(a, b))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h")), step, lambda s: s["h"])


def beta_tail(a: Column, b: Column, x: float) -> Column:
    """Probability that a beta variable with parameters a, b >= 0.5 exceeds x.

    The parameters should be columns already computed: they are used many times.
    """
    limit = F.lit(float(x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(limit) + b * F.log(1 - limit))
    swap = limit >= (a + 1) / (a + b + 2)
    p, q = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    part = front * _fraction(p, q, F.when(swap, 1 - limit).otherwise(limit)) / p
    return F.when(swap, part).otherwise(1 - part)


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pages and bad ones for each host: (host, n, k), from pages (host, doc) and labels (doc_id, bad).

    Pages are first counted by host and document, so that neither a hot host nor a hot document meets the join row by row.
    """
    counted = pages.filter("doc IS NOT NULL").groupBy("host", "doc").agg(F.count("*").alias("times"))
    return (counted.join(labels, F.col("doc") == F.col("doc_id")).groupBy("host")
            .agg(F.sum("times").alias("n"), F.sum(F.when(F.col("bad"), F.col("times")).otherwise(0)).alias("k")))


def _strength(groups: DataFrame) -> float:
    """Strength of the beta prior about `mean` that explains the scatter of k out of n over groups.

    With overdispersion r, (k - n m)^2 is n m (1 - m) (1 + (n - 1) r) on average, and the strength is 1 / r - 1.  Sums
    are decimals, so they do not depend on the order of the rows.
    """
    spread = F.col("mean") * (1 - F.col("mean"))
    off = F.when(spread > 0, (F.col("k") - F.col("n") * F.col("mean")) ** 2 / spread - F.col("n")).otherwise(0.0)
    sums = groups.agg(F.sum(off.cast("decimal(38,9)")).cast("double").alias("over"),
                      F.sum((F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)")).cast("double").alias("pairs"))
    excess = F.when(F.col("pairs") > 0, F.col("over") / F.col("pairs"))
    found = sums.select(F.when(excess > 0, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), 1 / excess - 1)))
                       .otherwise(F.lit(MOST_STRENGTH)).alias("strength"))
    return float(found.first()["strength"])


def reputations(counts: DataFrame, hosts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """For each host of hosts (host, domain, suffix) its posterior: a, b, rate, tail (probability of a rate above limit).

    counts is outcomes' table.  Levels above the host are sums of it, and a level's mean is its posterior mean.  Only the
    overall rate and a strength for each level, four numbers, come to the driver.
    """
    known = cut_lineage(hosts.join(counts, "host", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("double") for c in ("n", "k")}))
    bad, of = known.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    every = (bad + 0.5) / (of + 1)

    def shrunk(groups: DataFrame) -> DataFrame:
        strength = _strength(groups)
        return groups.withColumn("a", F.col("k") + strength * F.col("mean")).withColumn("b", F.col("n") - F.col("k") + strength * (1 - F.col("mean")))

    def means(groups: DataFrame, key: str) -> DataFrame:
        return cut_lineage(shrunk(groups).select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")))

    def level(keys: list[str]) -> DataFrame:
        return known.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    suffixes = means(level(["suffix"]).withColumn("mean", F.lit(every)), "suffix")
    domains = means(level(["suffix", "domain"]).join(suffixes, "suffix"), "domain")
    posterior = cut_lineage(shrunk(known.join(domains, "domain")).select(
        "host", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), F.greatest("a", F.lit(0.5)).alias("a"), F.greatest("b", F.lit(0.5)).alias("b")))
    return posterior.select("*", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), (beta_tail(F.col("a"), F.col("b"), limit) if of else F.lit(0.0)).alias("tail"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """One row per labelled document: bad if a label says toxic, or low quality."""
    bad = F.coalesce(F.max(F.greatest(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)),
                                      F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0)))) == 1, F.lit(False))
    return labels.filter("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)").groupBy("doc_id").agg(bad.alias("bad"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
          limit: float = LIMIT, confidence: float = CONFIDENCE, suffixes: Sequence[str] = ()) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, and the host's reputation (n_outcomes, rate, tail).

    A page's document is the number that follows the language in its path; its outcome is that document's label.  A page
    that a rule fits has the rule's verdict (the longest rule's), others are blocked if tail >= confidence.

    Null urls and urls without :// have an empty host and path; all of them together are one host.  A host without
    outcomes is judged by its domain's, a domain by its suffix's; without any outcome nothing is known, each rate is one
    half, tail is 0, and only rules block.  Pages may repeat; each counts.  Several label rows of a document are one outcome, bad if one of
    them is.  An empty table gives no rows.  Other columns of pages and labels are not read.
    """
    host, path = host_and_path(F.col(url_col))
    parted = settled(pages, F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    doc = F.expr("try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS bigint)")
    counts = cut_lineage(outcomes(parted.select("host", doc.alias("doc")), page_outcomes(labels)))
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = parted.select("host").distinct().select("host", domain.alias("domain"), suffix.alias("suffix"))
    judged = cut_lineage(reputations(counts, hosts, limit).select("host", F.col("n").alias("n_outcomes"), "rate", "tail"))
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(says, F.when(F.col("tail") >= confidence, F.lit("block")).otherwise(F.lit("allow")))
    return parted.join(broadcast_if_small(judged), "host").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n_outcomes", "rate", "tail")
