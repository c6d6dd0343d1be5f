"""Spelling variants, host reputation and the filter audit against brute force."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslens.llm import filter_audit, host_reputation, spelling_variants

#: Columns with names that the operators use inside.
CLASH = ["n", "word", "key", "home", "part", "mask", "digest", "host", "doc", "rank", "step", "best", "_rows", "_row", "id", "run"]
DOCS = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)


def documents(spark, rows):
    return spark.createDataFrame([(*row, *CLASH) for row in rows], DOCS).repartition(3)


def smaller(a, b):
    """Null is smaller than any other id."""
    return b is not None and (a is None or a < b)


# ---- spelling variants


def words_by_hand(rows, least_chars, least_count, drop_every):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(words, ratio):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def misspelled_rows(seed=3):
    r = random.Random(seed)
    stems = ["".join(r.choice("aeinrst") for _ in range(r.randrange(6, 11))) for _ in range(40)]
    stems += ["über" + s for s in stems[:8]] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = stems[int(len(stems) * r.random() ** 3)]
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1:], w[:at] + r.choice("aé÷x") + w[at:], w[:at] + r.choice("äxz") + w[at + 1:]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "_1"]).join(words), "en"))
    rows += [(600 + i, " ".join(["abcdefg"] * 60 + ["abcdefgh"] * 15 + ["abcdefghi"] * 4), "en") for i in range(4)]
    rows += [(None, rows[0][1], None), (None, rows[0][1], None), (7, rows[7][1], "en"), (500, None, "en"), (501, "", None), (502, "É ÑANDÚ ñandú", "es")]
    return rows


@pytest.mark.parametrize(("list_rows", "grams", "drop_every"), [(20_000, 50_000, 7), (3, 60, 0), (3, 2000, 199)])
def test_variants(spark, list_rows, grams, drop_every):
    rows = misspelled_rows()
    words = words_by_hand(rows, 6, 3, drop_every)
    want = variants_by_hand(words, 2)
    assert sum(w[1] is not None for w in want) > 50 and any(w[2] != w[1] and w[1] for w in want), "some roots are two forms away"
    got = spelling_variants.variants(documents(spark, rows), least_count=3, ratio=2, drop_every=drop_every, list_rows=list_rows, grams=grams)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_rarest_grams_of_near_words_meet(seed):
    r = random.Random(seed)
    letters = "abc"[:2 + seed % 2]
    pool = ["".join(r.choice(letters) for _ in range(r.randrange(6, 14))) for _ in range(300)]
    counts = Counter(m[p:p + q] for w in pool for m in [f"\u0001{w}\u0002"] for q in (2, 3, 4) for p in range(len(m) - q + 1))
    index = spelling_variants.GramIndex({g: n for g, n in counts.items() if n > r.choice([5, 40, 200])})
    for _ in range(4000):
        w = "".join(r.choice(letters) for _ in range(r.randrange(6, 14)))
        at = r.randrange(len(w) + 1)
        other = w[:at] + r.choice(letters + "z") + w[at + r.randrange(2):]
        if other == w or len(other) < 6:
            continue
        short, long = sorted([w, other], key=len)
        at_home = {k for k, home in index.keys(short) if home}
        met = {k for k, home in index.keys(long) if home == (len(short) == len(long))}
        assert at_home & met, (w, other)


def test_gram_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(w, 5) for w in words_by_hand(misspelled_rows(), 6, 3, 0)], "word string, n long")
    found = spelling_variants.frequent_grams(words, grams=50)
    every = Counter(m[p:p + q] for r in words.collect() for m in [f"\u0001{r['word']}\u0002"] for q in (2, 3, 4) for p in range(len(m) - q + 1))
    limit = sum(len(r["word"]) + 2 for r in words.collect()) // 50
    assert found == {g: n for g, n in every.items() if n > limit}
    assert all(sum(len(g) == q for g in found) <= 50 for q in (2, 3, 4))


def test_variants_of_very_long_words(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh") for _ in range(30_000))
    rows = [(i, f"{long} {long[:100]}x{long[101:]} {'a' * 20_000} short", "en") for i in range(5)]
    start = time.time()
    got = {len(x["word"]): x["n_near"] for x in spelling_variants.variants(documents(spark, rows), drop_every=0).collect()}
    assert got == {30_000: 1, 20_000: 0} and time.time() - start < 120


def test_variants_of_nothing(spark):
    assert spelling_variants.variants(documents(spark, [(1, None, None), (2, "", "en")])).count() == 0
    assert spelling_variants.variants(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="at least"):
        spelling_variants.variants(spark.createDataFrame([], DOCS), least_chars=5)


# ---- host reputation

PAGES = "page_id long, url string, " + ", ".join(f"{c} string" for c in CLASH)
LABELS = "doc_id long, quality int, toxic int, " + ", ".join(f"{c} string" for c in CLASH)


def pages_frame(spark, urls):
    return spark.createDataFrame([(i, u, *CLASH) for i, u in enumerate(urls)], PAGES).repartition(3)


def labels_frame(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], LABELS)


URLS = {
    "http://a.example.com/fr/1?x=/de/": ("a.example.com", "/fr/1", "com/fr/", "allow"),
    "HTTP://A.EXAMPLE.com/DE/1": ("a.example.com", "/DE/1", None, None),
    "http://COM/de/1#://": ("com", "/de/1", "com/de/", "block"),
    "http://xcom/de/1": ("xcom", "/de/1", None, None),
    "https://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
    "https://m.example.org/en/12": ("m.example.org", "/en/12", "example.org/en/1", "block"),
    "https://m.example.org/en/21": ("m.example.org", "/en/21", "org/", "allow"),
    "https://badexample.org/es/1": ("badexample.org", "/es/1", "org/", "allow"),
    "https://example.org": ("example.org", "", None, None),
    "https://example.org?a=/es/": ("example.org", "", None, None),
    "https://example.org:80/es/1": ("example.org:80", "/es/1", None, None),
    "x://é.ÄB.org#/": ("é.Äb.org", "", None, None),
    "a/b://c.com/fr/2://d": ("c.com", "/fr/2://d", "com/fr/", "allow"),
    "no scheme.com/fr/": ("", "", None, None),
    "://": ("", "", None, None),
    "http://\nline.org/a\nb?c": ("\nline.org", "/a\nb", "org/", "allow"),
    "": ("", "", None, None),
    None: ("", "", None, None),
}


def test_hosts_paths_and_rules(spark):
    got = host_reputation.judge(pages_frame(spark, list(URLS)), labels_frame(spark, [])).orderBy("page_id").collect()
    for row, (url, want) in zip(got, URLS.items(), strict=True):
        assert (row["host"], row["path"], row["rule"]) == want[:3], url
        assert row["verdict"] == (want[3] or "allow"), url
        assert (row["n_outcomes"], row["rate"]) == (0, 0.5)


def test_levels(spark):
    hosts = ["a.b.co.uk", "co.uk", "b.example.com", "com", "", "u:p@x.example.com:8080", "1.2.3.4"]
    domain, suffix = host_reputation.levels(F.col("h"), ("co.uk",))
    got = {r["h"]: (r["d"], r["s"]) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.example.com": ("example.com", "com"), "com": ("com", "com"),
                   "": ("", ""), "u:p@x.example.com:8080": ("example.com", "com"), "1.2.3.4": ("3.4", "4")}


def test_beta_tail_against_integration(spark):
    grid = [(a, b, x) for a in (0.5, 1.0, 3.25, 40.0, 9e4) for b in (0.5, 2.0, 17.5, 2.1e5) for x in (0.05, 0.3, 0.8)]
    u = (np.arange(400_000) + 0.5) / 400_000 * np.pi / 2
    sine, cosine = np.log(np.sin(u)), np.log(np.cos(u))
    for x in (0.05, 0.3, 0.8):
        frame = spark.createDataFrame([(a, b) for a, b, at in grid if at == x], "a double, b double")
        for r in frame.select("a", "b", host_reputation.beta_tail(F.col("a"), F.col("b"), x).alias("tail")).collect():
            density = (2 * r["a"] - 1) * sine + (2 * r["b"] - 1) * cosine
            density = np.exp(density - density.max())
            assert r["tail"] == pytest.approx(density[np.sin(u) ** 2 > x].sum() / density.sum(), abs=1e-4), r


def reputation_by_hand(counts):
    """counts: host -> (n, k); hosts have three labels.  Returns host -> (a, b)."""
    def strength(groups):
        over = sum((k - n * m) ** 2 / (m * (1 - m)) - n for n, k, m in groups if 0 < m < 1)
        pairs = sum(n * (n - 1) for n, _, _ in groups)
        return max(1.0, min(1e4, pairs / over - 1)) if pairs and over > 0 else 1e4

    def summed(at):
        out = defaultdict(lambda: [0, 0])
        for h, (n, k) in counts.items():
            out[".".join(h.split(".")[-at:])][0] += n
            out[".".join(h.split(".")[-at:])][1] += k
        return out

    top = (sum(k for _, k in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 1)
    mean = {"": top}
    for at in (1, 2, 3):
        above = {h: mean[".".join(h.split(".")[-(at - 1):]) if at > 1 else ""] for h in summed(at)}
        s = strength([(n, k, above[h]) for h, (n, k) in summed(at).items()])
        posterior = {h: (k + s * above[h], n - k + s * (1 - above[h])) for h, (n, k) in summed(at).items()}
        mean = {h: a / (a + b) for h, (a, b) in posterior.items()}
    return posterior


def test_reputation(spark):
    r = random.Random(2)
    urls, labels, counts = [], [], {}
    for s, suffix in enumerate(["com", "net", "org", "info"]):
        for d in range(3):
            for h in range(4):
                host = f"h{h}.d{d}.{suffix}"
                bad = 0.9 if (s, d) == (1, 2) else 0.1
                n = 0 if h == 3 else 400 if (s, d, h) == (0, 0, 0) else 15
                k = sum(r.random() < bad for _ in range(n))
                for i in range(n):
                    labels.append((len(labels), int(i >= k), None if i % 2 else 0))
                    urls.append(f"https://{host}/en/{len(labels) - 1}")
                urls.append(f"https://{host}/about")
                counts[host] = (n, k)
    # a label that says nothing, one that repeats, one without id, a page that repeats
    labels += [(10 ** 6, None, None), (None, 0, 1), labels[0]]
    urls += ["https://h0.d0.com/en/1000000", "https://h3.d0.com/en/notanumber", "https://h3.d0.com/en/99999999999999999999"]
    by_hand = reputation_by_hand(counts)
    got = {x["host"]: x for x in host_reputation.judge(pages_frame(spark, urls), labels_frame(spark, labels), rules=()).collect()}
    for host, (a, b) in by_hand.items():
        assert got[host]["n_outcomes"] == counts[host][0]
        assert got[host]["rate"] == pytest.approx(a / (a + b), rel=1e-9)
    assert {h for h in got if got[h]["verdict"] == "block"} == {h for h in got if h.endswith("d2.net")}, "a host without outcomes follows its domain"


def test_reputation_of_nothing(spark):
    assert host_reputation.judge(pages_frame(spark, []), labels_frame(spark, [(1, 0, 1)])).count() == 0


# ---- filter audit


def audit_by_hand(rows, labels):
    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        marks[i][0] |= quality == 1
        marks[i][1] |= toxic == 1
    texts = defaultdict(list)
    for i, text, *_ in rows:
        texts[text or ""].append(i)
    docs = []
    for i, text, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text or "")) > 10 * len(text or ""),
                 "D": bool(re.search("[#$%&*|]", text or "")), "E": any(smaller(j, i) for j in texts[text or ""])}
        docs.append((lang or "", {f for f, x in fails.items() if x}, marks[i] if i is not None else [0, 0]))
    out, shapley = [], Counter()
    for order in permutations("ABCDE"):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in failing),
                            sum(d[2][0] for d in gone), sum(d[2][1] for d in gone)])
    return sorted([*row, shapley[row[0], row[1][row[2] - 1]]] for row in out)


def audited_rows():
    r = random.Random(8)
    rows = []
    for i in range(120):
        words = [f"w{r.randrange(60 if i % 4 == 0 else 10 ** 6)}" for _ in range(r.choice([99, 100, 130, 300]))]
        text = r.choice([" ", "\n", " \t"]).join(words)
        text = text.upper() if i % 5 == 0 else text
        rows.append((i, text + r.choice(["", "", " #tag", " a&b", "|"]), r.choice(["en", "de", "", None])))
    rows += [(200 + i, rows[i % 7][1], "en") for i in range(30)]
    rows += [(3, rows[3][1], "en"), (3, rows[3][1], "en"), (None, rows[4][1], "fr"), (None, rows[4][1], "fr"), (300, None, None), (301, "", "fr"), (302, "É" * 9 + "A", "de"),
             (303, "AÉÉÉÉÉÉÉÉÉ" * 5000, "xx"), (304, "w " * 200_000, "xx")]
    return rows


def test_audit(spark):
    rows = audited_rows()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 300, 3)] + [(3, 1, 0), (3, 0, 1), (6, None, None), (None, 1, 1)]
    want = audit_by_hand(rows, labels)
    got = filter_audit.audit(documents(spark, rows), labels_frame(spark, labels))
    assert [c for c, _ in got.dtypes] == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(list, got.collect())) == want
    assert len(want) == 600 * len({r[2] or "" for r in rows})


def test_ranks_and_intervals():
    assert [filter_audit.lehmer_rank("".join(p)) for p in permutations("ABCDE")] == list(range(math.factorial(5)))
    spans = filter_audit.intervals()
    for mask in range(1, 32):
        covered = Counter(rank for m, _, first, after in spans if m == mask for rank in range(first, after))
        assert covered == Counter(range(120)), "each order removes a mask at exactly one step"


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(empty, labels_frame(spark, [(1, 1, 1)])).count() == 0
    only = filter_audit.audit(documents(spark, [(None, None, None)]), labels_frame(spark, []))
    assert {(r["part"], r["unique_fails"]) for r in only.collect() if r["filter_order"][r["step"] - 1] == "A"} == {("", 1)}
