"""Toxicity: a Levenshtein automaton over a lexicon trie finds terms and misspelled terms; their context weighs them.

The lexicon is learned: words and stems that labelled toxic texts use far more often than others.  Its trie is
intersected with Levenshtein automata: a state is the set of (trie node, edits so far), made on demand and kept, so that
a word is read by one table look-up per letter and most words die after a few letters.  A hit counts as quoted if
quotation marks enclose it or a reporting word stands within WINDOW words, else as abuse; words of address near it
count beside.  A logistic model over these sums, fitted on rows that taught no lexicon, gives the score.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.language_id import held_out
from accesslens.session import cut_lineage

WINDOW = 4
#: Bounds: labelled rows that teach, and states and words that a task keeps before it starts anew.
TRAINING_ROWS, TABLE_ROWS = 100_000, 300_000
#: Letters of the words that a task keeps; longer ones are read anew each time.
KEPT_LETTERS = 64
#: A term needs so many toxic texts and so high a log ratio of its rates.
LEAST_TEXTS, LEAST_RATIO = 5, 3.0
STEMS = (4, 5, 6)
#: Letters from which a term allows an edit; an edit of a term of just so many counts apart, as ordinary words are near.
SHORT = 4
REPORTING = frozenset("said says say called calls wrote term word words quote quoted quotes citation dit mot wort sagte palabra dijo".split())
ADDRESS = frozenset("you your youre du dich dein vous toi ton tu eres usted".split())
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_MARKS = regex.compile(r"[\"“”„«»]")
FACTS = ("exact", "stem", "one_edit", "two_edits", "short_edit", "quoted", "addressed", "share", "kinds")
_KINDS = FACTS.index("quoted")


class Lexicon:
    """Terms with weights; a term ending in * is a stem that any letters may follow, without edits."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]  # the term that a node spells, and the stem
        self.stem: list[str | None] = [None]
        self.reach = [0]  # edits that the longest term below a node allows
        for term in sorted(terms):
            node, edits = 0, self._allowed(term)
            self.reach[0] = max(self.reach[0], edits)
            for letter in term.rstrip("*"):
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.reach.append(0)
                node = self.next[node][letter]
                self.reach[node] = max(self.reach[node], edits)
            (self.stem if term.endswith("*") else self.word)[node] = term
        self.words: dict[str, tuple[str, int] | None] = {}
        self._fresh()

    def _fresh(self):
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accept: list[tuple[str, int] | None] = []
        self.table: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0)})

    def _state(self, items) -> int:
        """The state of these (node, edits) and all that deleting letters of the lexicon reaches; -1 is dead."""
        best: dict[int, int] = {}
        queue = list(items)
        while queue:
            node, edits = queue.pop()
            if edits > (0 if node == -1 else self.reach[node]) or best.get(node, 9) <= edits:
                continue
            best[node] = edits
            if node >= 0:
                queue += [(n, edits + 1) for n in self.next[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            found = [(edits, self.word[n]) for n, edits in best.items() if n >= 0 and self.word[n] and edits <= self._allowed(self.word[n])]
            self.accept.append((lambda f: (f[1], f[0]))(min(found)) if found else None)
        return self.states[key]

    @staticmethod
    def _allowed(term: str) -> int:
        return 0 if term.endswith("*") or len(term) < SHORT else 1 if len(term) < 8 else 2

    def _step(self, state: int, letter: str) -> int:
        to = set()
        for node, edits in self.sets[state]:
            to.add((node, edits + 1))  # a letter too many
            for other, n in self.next[node].items():
                to.add((n, edits + (other != letter)))
        return self._state(to)

    def find(self, word: str) -> tuple[str, int] | None:
        """The term that the word is, its edits; a word without such a term may be or begin with a stem (edits -1)."""
        if word in self.words:
            return self.words[word]
        if len(self.words) >= TABLE_ROWS:
            self.words.clear()
        if len(self.table) >= TABLE_ROWS:
            self._fresh()
        state, node, stem = self.start, 0, None
        for letter in word:
            if state >= 0:
                key = (state, letter)
                if key not in self.table:
                    self.table[key] = self._step(state, letter)
                state = self.table[key]
            if node is not None:
                node = self.next[node].get(letter)
                if node is not None and self.stem[node]:
                    stem = (self.stem[node], -1)
            if state < 0 and node is None:
                break
        found = self.accept[state] if state >= 0 else None
        if len(word) <= KEPT_LETTERS:
            self.words[word] = found or stem
        return found or stem

    def facts(self, text: str | None) -> np.ndarray:
        """Sums over the hits of one whole text, named in FACTS."""
        out = np.zeros(len(FACTS))
        lower = (text or "").lower()
        words = _WORD.findall(lower)
        known = self.words
        hits = {w for w in set(words) if (known[w] if w in known else self.find(w))} if self.terms else set()
        if not hits:
            return out
        marks = [m.start() for m in _MARKS.finditer(lower)]
        spans, seen = [m.span() for m in _WORD.finditer(lower)], set()
        for i, word in enumerate(words):
            if word not in hits:
                continue
            term, edits = self.find(word)
            weight = self.terms[term]
            near = set(words[max(0, i - WINDOW):i] + words[i + 1:i + 1 + WINDOW])
            lo, hi = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
            before, after = bisect_left(marks, lo - 2), bisect_left(marks, spans[i][1])
            enclosed = before < len(marks) and marks[before] < spans[i][0] and after < len(marks) and marks[after] <= hi + 2
            if enclosed or near & REPORTING:
                out[_KINDS] += weight
            else:
                out[4 if edits == 1 and len(term) == SHORT else {0: 0, -1: 1, 1: 2, 2: 3}[edits]] += weight
                out[_KINDS + 1] += bool(near & ADDRESS)
                seen.add(term)
        hits_n = out[:_KINDS].sum()
        out[_KINDS + 2], out[_KINDS + 3] = hits_n / (len(words) + 20), len(seen)
        out[:_KINDS + 2] = np.log1p(out[:_KINDS + 2])
        return out


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FACTS)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FACTS)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FACTS) + 1))

    def score(self, facts: np.ndarray) -> np.ndarray:
        z = np.clip((facts - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)))


def learn_terms(rows: DataFrame) -> dict[str, float]:
    """Words and stems of the toxic rows (text, y) with the log ratio of their rates: all that have LEAST_TEXTS and LEAST_RATIO.

    The bound on the labelled rows that teach bounds their number too.
    """
    def run(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall((text or "").lower()))
                seen[y].update(words)
                seen[y].update({w[:k] + "*" for w in words for k in STEMS if len(w) > k})
        toxic = list(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(toxic + list(seen[0]), pa.string()), pa.array([seen[1][t] for t in toxic] + [0] * len(seen[0]), pa.int64()),
                                          pa.array([0] * len(toxic) + list(seen[0].values()), pa.int64())], ["term", "toxic", "other"])

    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not ones or ones == n:
        return {}
    ratio = F.log((F.col("toxic") + 0.5) / (ones + 1)) - F.log((F.col("other") + 0.5) / (n - ones + 1))
    found = (rows.select("text", "y").mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
             .filter(F.col("toxic") >= LEAST_TEXTS).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO).toPandas())
    return dict(zip(found["term"], found["ratio"].astype(float), strict=True))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant first, by Newton steps with a ridge."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """From rows (doc_id, text, y), bounded by training_rows: a lexicon of half of them meets the other half to fit the
    weights, so that these are not misled by terms that fit by chance; the lexicon kept is then that of all of them."""
    n = rows.count()
    cut = int(min(1.0, training_rows / max(1, n)) * (1 << 31))
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 31))
    some = rows.filter(place < cut)
    lexicon = Lexicon(learn_terms(some.filter(F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(2)) == 0)))
    shared = rows.sparkSession.sparkContext.broadcast(Model(lexicon))
    seen = _facts(some.filter(F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(2)) == 1), shared, ["y"]).toPandas()
    model = Model(Lexicon(learn_terms(some)))
    if len(seen) and 0 < seen["y"].sum() < len(seen):
        x, y = np.vstack(seen["facts"]), seen["y"].to_numpy(float)
        model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        model.weights = fit_logistic((x - model.mean) / model.scale, y)
    elif n:
        share = min(max(float(rows.agg(F.avg("y")).first()[0]), 1e-3), 1 - 1e-3)
        model.weights[0] = np.log(share / (1 - share))
    return model


def _facts(rows: DataFrame, model, keep: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = [model.value.lexicon.facts(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(x, pa.list_(pa.float64()))], [*keep, "facts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, "text").mapInArrow(run, f"{schema}, facts array<double>")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   threshold: float = 0.7, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels of rows that are not held out (checksum of the id mod 3 is 1) are learned; a null label is none, and of an
    id labelled twice the greatest label counts.  Null texts are empty texts, which have no hits.  Without both classes
    every score is the share of ones, 0.5 without labels.  Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), 3, 1).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    truth = cut_lineage(labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y IS NOT NULL")
                        .filter(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("y").alias("y")))
    n = truth.count()
    cut = int(min(1.0, training_rows / max(1, n)) * (1 << 31))
    few = F.broadcast(truth.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 31)) < cut))
    model = docs.sparkSession.sparkContext.broadcast(train(cut_lineage(rows.join(few, "doc_id").select("doc_id", "text", "y")), training_rows))

    def run(batches):
        for batch in batches:
            got = model.value
            x = np.array([got.lexicon.facts(t.as_py()) for t in batch.column(2)]).reshape(-1, len(FACTS))
            score = got.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
