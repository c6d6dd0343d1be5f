"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

Four-grams of normalised text (lower case, each run of non-letters one blank) are counted in Spark over all labelled
training rows but the few that calibrate; the shorter orders follow from their types, and the discounts from all of them.  A model is a set of sorted arrays:
the n-gram's 64-bit code (16 bits a character, code points folded), and beside it the fully interpolated log probability
in each language, and the back-off weight of each context.  No n-gram is left out: they are dealt by their second and
third last characters into as many parts as their number asks for, a part has all that its n-grams look up, and a task
holds one part at a time.  A text gets the language of the lowest cross-entropy per character.  The
temperature of the reported probability and the rejection limit are calibrated on labelled rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.support import lean, small_batches
from accesslens.session import cut_lineage, scratch_path

ORDER = 4
#: N-grams of a part of the models over all languages, and its cells (n-grams times languages).
PART_ROWS, PART_CELLS = 1_500_000, 1 << 24
#: Bound on the labelled rows that calibrate temperature and rejection.
CALIBRATION_ROWS = 4_000
#: Share of calibration rows that the rejection limit keeps, and how far beyond it lies.
KEEP_SHARE, MARGIN = 0.999, 2.5
#: So much above its language's centre, in nats a character and in such spreads, a long text is never rejected.
LEAST_SPREAD, LEAST_LIMIT = 0.1, 8.0
#: Characters scored at once, and how many times as many are held while the parts take turns.
CHUNK, HELD = 1 << 19, 8


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Normalised characters with the blanks that stand before and after, or nothing if there is no letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[raw]
    if not letter.any():
        return np.empty(0, np.uint64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    body = np.where(letter, raw & 0xFFFF, 32)[kept]
    return np.concatenate([[32] * (ORDER - 1), body, [32]]).astype(np.uint64)


def grams(code: np.ndarray, order: int = ORDER) -> np.ndarray:
    n = len(code) - order + 1
    key = np.zeros(max(n, 0), np.uint64)
    for i in range(order if n > 0 else 0):
        key = (key << np.uint64(16)) | code[i:i + n]
    return key


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Four-grams of a text, a bounded number at once."""
    code = codes(text)
    for at in range(0, max(0, len(code) - ORDER + 1), CHUNK):
        yield grams(code[at:at + CHUNK + ORDER - 1])


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text)."""
    def run(batches):
        sums: dict[str, tuple] = {}
        waiting: dict[str, list] = {}

        def merge(lang):
            keys, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            if lang in sums:
                old_keys, old_n = sums[lang]
                keys, at = np.unique(np.concatenate([old_keys, keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([old_n, n]), len(keys)).astype(np.int64)
            sums[lang] = keys, n

        held: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in _pieces(text.as_py() or ""):
                    waiting.setdefault(lang, []).append(piece)
                    held[lang] = held.get(lang, 0) + len(piece)
                    if held[lang] > 2 * CHUNK:
                        merge(lang)
                        held[lang] = 0
        for lang in list(waiting):
            merge(lang)
        for lang, (keys, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return (labelled.select("lang", "text").mapInArrow(lean(run), "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class Models:
    """keys[k], logp[k]: n-grams of order k + 1 and their log probabilities; contexts[k], back[k]: the same for back-off."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]

    def score(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each n-gram's last character in each language."""
        out = np.empty((len(key), len(self.langs)), np.float32)
        at, new = _look_up(self.keys[order - 1], key)
        out[~new] = self.logp[order - 1][at[~new]]
        if new.any():
            rest = key[new]
            if order == 1:
                out[new] = self.back[0][0]
            else:
                i, other = _look_up(self.contexts[order - 1], rest >> np.uint64(16))
                back = np.zeros((len(rest), len(self.langs)), np.float32)
                back[~other] = self.back[order - 1][i[~other]]
                out[new] = back + self.score(rest & _mask(order - 1), order - 1)
        return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


def _look_up(known: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among the sorted known ones, and which of them are not there."""
    if not len(known):
        return np.zeros(len(key), np.int64), np.ones(len(key), bool)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return at, known[at] != key


def part_of(key, parts: int):
    """The part of n-grams of order 3 or 4, by the two characters before the last; a column or an array of longs."""
    if isinstance(key, Column):
        mixed = F.shiftright(key, 16).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(0x5BD1E995)
        return F.pmod(F.shiftright(mixed, 16).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(parts)).cast("int")
    mixed = ((key.view(np.int64) >> 16) & 0xFFFFFFFF) * 0x5BD1E995
    return ((mixed >> 16) & 0xFFFFFFFF) % parts


def odds(n):
    return np.sqrt(1 + 200 / np.maximum(n, 1))


@dataclass
class Identifier:
    """The broadcast parts of the models, and what calibration found."""

    langs: list[str]
    parts: list[Broadcast]
    temperature: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = np.inf

    def entropies(self, texts: Iterable[str | None], count: int) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each of count texts in each language, and the characters scored."""
        total, n = np.zeros((count, len(self.langs))), np.zeros(count, np.int64)
        held: list[tuple] = []
        size = 0
        for i, text in enumerate(texts):
            for piece in _pieces(text or ""):
                n[i] += len(piece)
                if not self.parts:
                    continue
                distinct, times = np.unique(piece, return_counts=True)
                held.append((distinct, times, np.full(len(distinct), i)))
                size += len(distinct)
                if size >= CHUNK * min(HELD, len(self.parts)):
                    self._add(total, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            self._add(total, *map(np.concatenate, zip(*held)))
        return total / np.maximum(n, 1)[:, None], n

    def _add(self, total: np.ndarray, key: np.ndarray, times: np.ndarray, who: np.ndarray) -> None:
        part = part_of(key, len(self.parts))
        step = max(1, min(CHUNK, (1 << 23) // len(self.langs)))
        for p, shared in enumerate(self.parts):
            mine = np.flatnonzero(part == p)
            if not len(mine):
                continue
            model = shared.value
            for start in range(0, len(mine), step):
                at = mine[start:start + step]
                row = who[at]
                edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                total[row[edge]] -= np.add.reduceat(model.score(key[at]) * times[at, None].astype(np.float64), edge, axis=0)
            if len(self.parts) > 1:
                del model, shared._value  # one part at a time in memory; it is read again from the worker's file

    def far(self, each: np.ndarray, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How far beyond the centre of its language each text lies, in spreads for its length."""
        return (each[np.arange(len(each)), lang] - self.centre[lang]) / (self.spread[lang] * odds(n))


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def build(counts: pd.DataFrame, lower: list[pd.DataFrame] | None = None, langs: list[str] | None = None, discounts: list[dict[str, float]] | None = None) -> Models:
    """Interpolated Kneser-Ney models from (lang, gram, n): n for the longest order, numbers of types below.

    Without the other arguments they follow from counts.  For one part of the n-grams pass the tables of the shorter
    orders, longest first, all languages, and the discounts of each order and language, longest first, over all parts.
    """
    langs = sorted(counts["lang"].unique()) if langs is None else langs

    def table(rows):
        by_lang = dict(iter(rows.assign(key=rows["gram"].to_numpy(np.int64).view(np.uint64)).groupby("lang")))
        none = np.empty(0, np.uint64), np.empty(0)
        sort = {x: by_lang[x].sort_values("key") for x in langs if x in by_lang}
        return [(sort[x]["key"].to_numpy(), sort[x]["n"].to_numpy(np.float64)) if x in sort else none for x in langs]

    tables = [table(counts)]  # by order, longest first: for each language its sorted keys and counts
    for i, order in enumerate(range(ORDER - 1, 0, -1)):
        tables.append([tuple(np.unique(keys & _mask(order), return_counts=True)) for keys, _ in tables[-1]] if lower is None else table(lower[i]))
    if discounts is None:
        discounts = [{x: _discount((n == 1).sum(), (n == 2).sum()) for x, (_, n) in zip(langs, t)} for t in tables]
    model = Models(langs, [], [], [], [])
    for order, table_of in enumerate(reversed(tables), start=1):
        keys = np.unique(np.concatenate([k for k, _ in table_of]))
        context = np.unique(keys >> np.uint64(16)) if order > 1 else np.zeros(1, np.uint64)
        logp, back = np.empty((len(keys), len(langs)), np.float32), np.zeros((len(context), len(langs)), np.float32)
        if order > 1:
            shorter = model.score(keys & _mask(order - 1), order - 1)
        else:
            shorter = np.full((len(keys), len(langs)), np.log(1 / (len(keys) + 1)))
        place = np.searchsorted(context, keys >> np.uint64(16)) if order > 1 else np.zeros(len(keys), int)
        for j, (own, n) in enumerate(table_of):
            discount = discounts[ORDER - order][langs[j]]
            at = np.searchsorted(context, own >> np.uint64(16)) if order > 1 else np.zeros(len(own), int)
            total, kinds = np.bincount(at, n, len(context)), np.bincount(at, minlength=len(context))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
            share = np.zeros(len(keys))
            share[np.searchsorted(keys, own)] = np.maximum(n - discount, 0) / total[at]
            logp[:, j] = np.log(share + weight[place] * np.exp(shorter[:, j].astype(np.float64)))
            back[:, j] = np.log(weight)
        if order == 1:
            back -= np.float32(np.log(len(keys) + 1))
        model.keys.append(keys), model.logp.append(logp), model.contexts.append(context), model.back.append(back)
    return model


def learn(counts: DataFrame, part_rows: int = PART_ROWS, part_cells: int = PART_CELLS) -> Identifier:
    """Broadcast the models of all n-grams in counts (lang, gram, n), part by part."""
    spark = counts.sparkSession
    orders = [cut_lineage(counts)]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1)).alias("gram")
        orders.append(cut_lineage(orders[-1].groupBy("lang", suffix).agg(F.count("*").alias("n"))))
    facts = [df.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect() for df in orders]
    langs = sorted(r["lang"] for r in facts[0])
    if not langs:
        return Identifier([], [])
    discounts = [{r["lang"]: _discount(r["ones"], r["twos"]) for r in of_order} for of_order in facts]
    rows = sum(r["all"] for r in facts[0])
    parts = max(1, -(-rows // part_rows), -(-rows * len(langs) // part_cells))
    short = [df.toPandas() for df in orders[2:]]
    if parts > 1:
        paths = [scratch_path(spark, "grams") for _ in range(2)]
        for df, path in zip(orders[:2], paths):
            df.withColumn("part", part_of(F.col("gram"), parts)).write.partitionBy("part").parquet(path)
        schema = "lang string, gram long, n long, part int"
        of_part = [spark.read.schema(schema).parquet(path) for path in paths]
    shared = []
    for p in range(parts):
        longest, longer = [df.filter(F.col("part") == p).drop("part").toPandas() for df in of_part] if parts > 1 else [df.toPandas() for df in orders[:2]]
        shared.append(spark.sparkContext.broadcast(build(longest, [longer, *short], langs, discounts)))
    return Identifier(langs, shared)


def _texts(column: pa.Array) -> Iterator[str | None]:
    return (text.as_py() for text in column)


def _measure(rows: DataFrame, model: Identifier, keep: list[str]) -> DataFrame:
    """Add lang_pred, entropy, score, accepted to the columns in keep."""
    def run(batches):
        for batch in batches:
            each, n = model.entropies(_texts(batch.column(len(keep))), batch.num_rows)
            known = (n > 0) & bool(model.langs)
            best = each.argmin(axis=1) if model.langs else np.zeros(len(n), np.int64)
            far = model.far(each, n, best) if model.centre is not None else np.zeros(len(n))
            out = []
            for i in range(len(n)):
                if not known[i]:
                    out.append(("und", None, 0.0, False))
                    continue
                gap = (each[i] - each[i, best[i]]) * min(n[i], 400) / model.temperature
                out.append((model.langs[best[i]], float(each[i, best[i]]), float(1 / np.exp(-gap).sum()), bool(far[i] <= model.limit)))
            names = ["lang_pred", "entropy", "score", "accepted"]
            types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *cols], [*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, "text").mapInArrow(lean(run), f"{schema}, lang_pred string, entropy double, score double, accepted boolean")


def train(labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS, part_rows: int = PART_ROWS, part_cells: int = PART_CELLS) -> Identifier:
    """Models from rows (doc_id, lang, text); rows without language or letters teach nothing.

    A tenth of the rows, but no more than about calibration_rows of them, is kept from the counts and measures what the
    models say of texts they have not seen; all others are counted.
    """
    small_batches(labelled.sparkSession)
    labelled = labelled.filter("lang IS NOT NULL")
    tenth = F.pmod(F.xxhash64(F.lit(9), "doc_id", "lang", "text"), F.lit(10)) == 0
    cut = int(min(1.0, calibration_rows / max(1, labelled.filter(tenth).count())) * (1 << 31))
    apart = tenth & (F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1 << 31)) < cut)
    model = learn(count_grams(labelled.filter(~apart)), part_rows, part_cells)
    if not model.langs:
        return model
    sample = labelled.filter(apart)

    def run(batches):
        for batch in batches:
            each, n = model.entropies(_texts(batch.column(1)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each.tolist(), pa.list_(pa.float64())), pa.array(n)], ["lang", "each", "n"]).filter(pa.array(n > 0))

    seen = sample.select("lang", "text").mapInArrow(lean(run), "lang string, each array<double>, n long").toPandas()
    seen = seen[seen["lang"].isin(model.langs)]
    if len(seen):
        each, n, true = np.vstack(seen["each"]), seen["n"].to_numpy(), np.array([model.langs.index(x) for x in seen["lang"]])
        gap = (each - each.min(axis=1, keepdims=True)) * np.minimum(n, 400)[:, None]
        rows = np.arange(len(true))

        def loss(t):
            return np.mean(gap[rows, true] / t + np.log(np.exp(-gap / t).sum(axis=1)))

        model.temperature = float(min((2.0 ** e for e in range(0, 9)), key=loss))
        own = each[rows, true]
        by_lang = [own[true == j] if (true == j).any() else own for j in range(len(model.langs))]
        model.centre = np.array([np.median(x) for x in by_lang])
        model.spread = np.array([max(1.4826 * np.median(np.abs(x - np.median(x))), LEAST_SPREAD) for x in by_lang])
        right = each.argmin(axis=1) == true
        if right.any():  # a wrong label tells nothing of the distance under the predicted language
            model.limit = float(max(LEAST_LIMIT, MARGIN * np.quantile(model.far(each[right], n[right], true[right]), KEEP_SHARE)))
    return model


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows that teach nothing: the checksum of the id as text has this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, entropy, accepted.

    Learns from text and non-null language of the rows that are not held out.  `und`, score 0, not accepted: null texts
    and texts without a letter, and every text if there is nothing to learn from.  accepted is false where the
    cross-entropy is beyond the calibrated limit of the predicted language.  score is the predicted language's share of
    exp(-gap / temperature), a gap being the entropy beyond the best one times the characters, 400 at most.  Equal
    entropies: the first language in code point order.  Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    model = train(rows.filter(~F.col("held_out")).select("doc_id", "lang", "text"))
    return _measure(rows, model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that identify accepts, all columns unchanged.  Only texts go to Python, and one boolean comes back.

    If there is nothing to learn from, every text with a letter stays.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    model = train(rows.filter(~held_out(F.col("doc_id"))))

    def judged(batches):
        for texts in batches:
            each, n = model.entropies(_texts(texts), len(texts))
            mask = n > 0
            if model.centre is not None:
                mask &= model.far(each, n, each.argmin(axis=1)) <= model.limit
            yield pa.array(mask, pa.bool_())

    @F.arrow_udf("boolean")
    def accepted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return lean(judged)(batches)

    return docs.filter(accepted(F.col(text_col)))
