"""Spelling variant grouping with a variable-length gram index.

Words are counted over all texts.  The gram dictionary holds every gram of LEAST_GRAM code points and, of longer ones,
those whose beginnings are all frequent; only the frequent grams have to be known for that, and at most GRAMS of each
length are (the frequency that counts as frequent grows with the vocabulary).  A word, between two marks, is decomposed
into the longest dictionary gram at each place, without those inside the one before.

For each word and each place of an edit one can tell which of its grams an edit there may touch.  The most that any
single edit touches, its affected-gram bound, says how many of its grams a near word must share; hence a near word is
already on one of the lists of its rarest grams, one more than the bound.  Only these lists are merged.  A word of
LEAST_CHARS code points always keeps a gram, because its first and last gram are apart.  Lists are cut by length and by
the gram's place, which an edit moves by at most one.  Inside a list words are compared by hashes with one place left
out, so a list takes time in proportion to its length; lists of more than LIST_ROWS words are first cut by such a hash.
Every pair is then verified code point by code point.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.support import ascii_lower, broadcast_if_small, settled
from accesslens.session import cut_lineage

RUN = r"[a-zÀ-ÿ]"
LEAST_CHARS, LEAST_COUNT, RATIO, DROP_EVERY = 6, 5, 5, 199
LEAST_GRAM, MOST_GRAM = 2, 4
GRAMS = 50_000
LIST_ROWS = 20_000
CHUNK_ROWS = 50_000
HELD_GRAMS = 500_000
_MARKS = "\u0001", "\u0002"
_KEYS = "key string, home boolean, word string, n long"


def spelled_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
                  least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least least_chars code points and least_count occurrences.

    Where drop_every (0: never) divides the checksum h of `<id>:<run>`, the run loses its code point h % length.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(
        F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(f"{RUN}{{{least_chars},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if drop_every:
        hashed = settled(runs, F.col("run"), F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
        at = (F.col("h") % F.char_length("run")).cast("int")
        runs = hashed
        word = F.when(F.col("h") % drop_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
            .filter((F.col("n") >= least_count) & (F.char_length("word") >= least_chars)))


def _cut_grams(least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])

        counts: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                marked = _MARKS[0] + word + _MARKS[1]
                for q in range(least, most + 1):
                    counts.update(marked[p:p + q] for p in range(len(marked) - q + 1))
                if len(counts) > HELD_GRAMS:
                    yield counted(counts)
                    counts = Counter()
        yield counted(counts)
    return run


def frequent_grams(words: DataFrame, least: int = LEAST_GRAM, most: int = MOST_GRAM, grams: int = GRAMS) -> dict[str, int]:
    """Grams of least to most code points that occur in words more often than a threshold, with their counts.

    The threshold is the number of places in all words divided by `grams`, so at most `grams` of each length pass it.
    """
    places = words.agg(F.sum((F.char_length("word") + 2).cast("long"))).first()[0] or 0
    counted = (words.select("word").mapInArrow(_cut_grams(least, most), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
               .filter(F.col("n") > max(1, places // grams)))
    return {r["gram"]: r["n"] for r in counted.collect()}


class GramIndex:
    """Decomposition of words by a dictionary of frequent grams, and their affected-gram bounds."""

    def __init__(self, frequent: dict[str, int], least: int = LEAST_GRAM, most: int = MOST_GRAM):
        self.frequent, self.least, self.most = frequent, least, most
        self.tails = {g[i:] for g in frequent for i in range(1, len(g))}

    def decompose(self, marked: str) -> list[tuple[int, int]]:
        """(first, last) places of the grams: the longest at each place, without those inside the one before."""
        found, reach = [], -1
        for p in range(len(marked) - self.least + 1):
            e = p + self.least
            while e < len(marked) and e - p < self.most and marked[p:e] in self.frequent:
                e += 1
            if e - 1 > reach:
                reach = e - 1
                found.append((p, reach))
        return found

    def affected(self, marked: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one inserted, deleted or replaced code point between the marks can touch.

        Grams over the place are touched.  Grams before it stay: what ended them lies before it too.  A gram behind it
        goes only if a new gram from before the place reaches its end, which takes a frequent gram that ends like the
        text from the place to one short of that end.
        """
        replaced, inserted = [0] * (len(marked) + 1), [0] * (len(marked) + 1)
        for p, e in grams:
            for i in range(p, e + 1):
                replaced[i] += 1
                inserted[i] += i > p
            for i in range(max(1, e - self.most + 1), p):
                replaced[i] += e - 1 <= i or marked[i + 1:e] in self.tails
            for i in range(max(1, e - self.most + 2), p + 1):
                inserted[i] += e <= i or marked[i:e] in self.tails
        return max(*replaced[1:len(marked) - 1], *inserted[1:len(marked)])

    def rarest(self, marked: str) -> list[tuple[int, int]]:
        """The grams among which each near word shares one: one more than the bound, rarest first, equal ones by place.

        Grams that an edit leaves alone keep their order of places, so both words put them in the same order; the first
        of them in that order has, in each word, no more grams before it than the edit touched.
        """
        grams = self.decompose(marked)
        order = sorted((self.frequent.get(marked[p:e + 1], 0), marked[p:e + 1], p, e) for p, e in grams)
        return [(p, e) for _, _, p, e in order[:self.affected(marked, grams) + 1]]

    def keys(self, word: str) -> Iterator[tuple[str, bool]]:
        """List keys (gram, place, length) of a word, at home and as a visitor among words one shorter."""
        marked = _MARKS[0] + word + _MARKS[1]
        visits = set()
        for p, e in self.rarest(marked):
            gram = marked[p:e + 1]
            yield f"{gram} {p} {len(word)}", True
            visits |= {f"{gram} {p} {len(word) - 1}", f"{gram} {p - 1} {len(word) - 1}"}
        for key in visits:
            yield key, False


def _lists(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            rows = [(key, home, w, n) for w, n in zip(words, counts, strict=True) for key, home in index.value.keys(w)]
            for start in range(0, len(rows), CHUNK_ROWS):
                columns = list(zip(*rows[start:start + CHUNK_ROWS], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()),
                                                  pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], ["key", "home", "word", "n"])
    return run


def _points(words: np.ndarray, width: int) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width).astype(np.uint64)


def _weights(width: int) -> np.ndarray:
    return np.random.default_rng(width).integers(1, 1 << 63, size=width, dtype=np.uint64) | np.uint64(1)


def _one_out(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hash of each row with each column deleted: what follows moves one place forward."""
    ahead = np.cumsum(points * weights, axis=1)
    moved = points[:, 1:] * weights[:-1]
    behind = np.cumsum(moved[:, ::-1], axis=1)[:, ::-1]
    out = np.zeros(points.shape, dtype=np.uint64)
    out[:, 1:] += ahead[:, :-1]
    out[:, :-1] += behind
    return out


def _pairs_of_equal(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with own[i] == other[j]."""
    order = np.argsort(other, kind="stable")
    low, high = np.searchsorted(other[order], own, "left"), np.searchsorted(other[order], own, "right")
    count = high - low
    i = np.repeat(np.arange(len(own)), count)
    j = order[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    return i, j


def near_in_lists(keys: np.ndarray, home: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of words one edit apart among the rows of each key; keys end with the home length."""
    lengths = np.char.str_len(words.astype(str))
    _, lists = np.unique(keys, return_inverse=True)
    salt = (lists.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    found = []
    for width in np.unique(lengths[home]):
        rows = np.flatnonzero(home & (lengths == width))
        points, weights = _points(words[rows], width), _weights(int(width))
        whole = (points * weights).sum(axis=1, dtype=np.uint64)
        for place in range(width if len(rows) > 1 else 0):
            left = (whole - points[:, place] * weights[place]) ^ salt[rows]
            order = np.argsort(left, kind="stable")
            runs = np.flatnonzero(np.diff(left[order]) == 0)
            if not len(runs):
                continue
            same = np.concatenate([runs, runs + 1])
            part = order[np.unique(same)]
            i, j = _pairs_of_equal(left[part], left[part])
            found += [(rows[part[a]], rows[part[b]]) for a, b in zip(i, j, strict=True) if a < b
                      and lists[rows[part[a]]] == lists[rows[part[b]]] and (points[part[a]] != points[part[b]]).sum() == 1]
        guests = np.flatnonzero(~home & (lengths == width + 1))
        if len(guests):
            out = _one_out(_points(words[guests], width + 1), np.append(weights, np.uint64(0))) ^ salt[guests][:, None]
            i, j = _pairs_of_equal(out.ravel(), whole ^ salt[rows])
            for a, b in sorted(set(zip(i.tolist(), j.tolist(), strict=True))):
                guest, place = divmod(a, int(width) + 1)
                long, short = words[guests[guest]], words[rows[b]]
                if long[:place] + long[place + 1:] == short and lists[guests[guest]] == lists[rows[b]]:
                    found.append((guests[guest], rows[b]))
    return found


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near pairs of the lists in sorted batches; whole lists are taken together up to CHUNK_ROWS rows."""
    held: list[pd.DataFrame] = []

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = near_in_lists(rows["key"].to_numpy(), rows["home"].to_numpy(bool), rows["word"].to_numpy())
        a, b = (rows.iloc[[p[k] for p in pairs]] for k in (0, 1))
        return pd.DataFrame({"a": a["word"].to_numpy(), "a_n": a["n"].to_numpy(), "b": b["word"].to_numpy(), "b_n": b["n"].to_numpy()}).drop_duplicates()

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < CHUNK_ROWS:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = int(rows["key"].searchsorted(rows["key"].iloc[-1]))
        if last:
            yield settle(rows.iloc[:last])
        held = [rows.iloc[last:]]
    if held and sum(map(len, held)):
        yield settle(pd.concat(held, ignore_index=True))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut long lists: a row goes to one list for each place that may differ, keyed by the word without that place."""
    for batch in batches:
        rows = []
        for key, home, word, n in batch.itertuples(index=False):
            if home:
                rows += [(f"{key} ={i} {word[:i]}\u0003{word[i + 1:]}", True, word, n) for i in range(len(word))]
                rows.append((f"{key} - {word}", True, word, n))
            else:
                rows += [(f"{key} - {left}", False, word, n) for left in {word[:i] + word[i + 1:] for i in range(len(word))}]
        yield pd.DataFrame(rows, columns=["key", "home", "word", "n"])


def near_pairs(words: DataFrame, list_rows: int = LIST_ROWS, grams: int = GRAMS) -> DataFrame:
    """All pairs (a, a_n, b, b_n) of words (word, n) one inserted, deleted or replaced code point apart, each once.

    Words have at least 2 * MOST_GRAM - 2 code points, so that their first and last gram are apart.
    """
    index = words.sparkSession.sparkContext.broadcast(GramIndex(frequent_grams(words, grams=grams)))
    listed = cut_lineage(words.select("word", "n").mapInArrow(_lists(index), _KEYS))
    sizes = cut_lineage(listed.groupBy("key").agg(F.count("*").alias("_rows"), F.bool_or("home").alias("_homes")).filter("_rows > 1 AND _homes"))
    long = sizes.filter(F.col("_rows") > list_rows).select("key")
    short = listed.join(sizes.filter(F.col("_rows") <= list_rows).select("key"), "key", "left_semi")
    cut = listed.join(broadcast_if_small(cut_lineage(long)), "key", "left_semi").mapInPandas(_cut, _KEYS)
    return (short.unionByName(cut).repartition("key").sortWithinPartitions("key")
            .mapInPandas(_verify, "a string, a_n long, b string, b_n long")
            .select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"),
                    F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n")).distinct())


def with_roots(forms: DataFrame) -> DataFrame:
    """Add root to (word, form): follow forms to the last.  Each round doubles the length of the paths followed."""
    at = cut_lineage(forms.select("word", F.coalesce("form", F.col("word")).alias("root")))
    while True:
        ahead = at.filter("word <> root").select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = cut_lineage(at.join(ahead, "root", "left").select("word", F.coalesce("_next", F.col("root")).alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = now.drop("_moved")
        if not now.filter("_moved").head(1):
            return forms.join(at, "word")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
             ratio: int = RATIO, drop_every: int = DROP_EVERY, list_rows: int = LIST_ROWS, grams: int = GRAMS) -> DataFrame:
    """One row per word of spelled_words: word, form, root, n, n_near, form_n.

    form is the near word of the largest n (ties: the smallest in code-point order) if that n is at least ratio times
    the word's, else null; root follows forms to the last and is the word itself if it has none.  n grows along a form,
    so there are no circles.

    Null and empty texts have no words; a null id counts as an empty string in the checksum; every row of docs counts,
    also one that repeats another; an empty table gives no rows.  Other columns of docs are not read.
    """
    if least_chars < 2 * MOST_GRAM - 2:
        raise ValueError(f"words need at least {2 * MOST_GRAM - 2} code points")
    words = cut_lineage(spelled_words(docs, id_col, text_col, least_chars, least_count, drop_every))
    pairs = cut_lineage(near_pairs(words, list_rows, grams))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    forms = cut_lineage(words.join(best, "word", "left").select(
        "word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.n")).alias("form_n")))
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
