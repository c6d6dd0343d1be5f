"""The llm operators against brute force, on documents with every oddity that their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslens.llm import (bpe_automaton, exact_dedup, hilbert_shards, jaccard_join, language_id, lattice_dedup,
                            line_dedup, mixing, quality, toxicity)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest string, hash long, node int, class string, "
          "token string, number int, ids string, size string, _id int, score double")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def a_lower(text):
    return (text or "").translate(str.maketrans(UP, LOW))


def sentence(r, n):
    return " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randrange(2, 7))) for _ in range(n))


def odd_rows():
    r = random.Random(5)
    base = [sentence(r, 60) for _ in range(8)]
    common = sentence(r, 12)
    rows = []
    for i in range(60):
        text = base[i % 8]
        if i % 3 == 1:
            words = text.split()
            words[r.randrange(60)] = "changed"
            text = " ".join(words)
        if i % 4 == 0:
            text = sentence(r, 40) + "\n \t" + common.upper() + " \r\n" + text.title()
        rows.append((i, text, ["en", "fr", None][i % 3], ["a", "b", "é", "", None][i % 5]))
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \t\n", "en", "a"), (103, "Ä ß 🙂 <|endoftext|>", "de", "b"),
             (104, sentence(r, 30000) + "\n" + common, "en", "hot"), (105, "one two", "en", "a"), (106, "ONE two", None, "a"), (7, base[7], "fr", "c"),
             (7, base[7], "fr", "c"), (None, base[0], "en", None), (None, "only here " + common, "en", None), (-5, base[1], "en", "a")]
    return [(*row, len(row[1] or ""), "x", 1, 2, "y", "z", 3, "i", "s", 4, 0.5) for row in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return (i is not None, i or 0)


def test_exact_dedup(odd, empty):
    got = sorted(map(tuple, exact_dedup.mark_copies(odd, keep=2).collect()), key=str)
    groups = defaultdict(list)
    for i, text, *_ in odd_rows():
        groups[a_lower(text)].append(i)
    want = []
    for i, text, *_ in odd_rows():
        same = groups[a_lower(text)]
        best = max(same, key=key)
        want.append((i, best, len(same), i == best, hashlib.sha256(a_lower(text).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({w[0] for w in want if w[3]} - {None}) + Counter(
        {None: len({w[4] for w in want if w[3] and w[0] is None})}), "of rows equal in id and text one stays"
    assert exact_dedup.drop_copies(empty).count() == 0


def test_misra_gries_finds_what_is_frequent():
    import pandas as pd
    r = random.Random(1)
    digests = [b"hot"] * 400 + [b"warm"] * 200 + [b"%d" % r.randrange(10 ** 6) for _ in range(1400)]
    r.shuffle(digests)
    parts = [pd.DataFrame({"digest": digests[i:i + 100]}) for i in range(0, 2000, 100)]
    found = next(exact_dedup._sketch(20)(iter(parts)))
    held = dict(zip(found["digest"], found["n"]))
    assert len(held) <= 20 and 400 - 2000 / 21 <= held[b"hot"] <= 400 and 200 - 2000 / 21 <= held[b"warm"] <= 200


def test_line_dedup(odd, empty):
    rows = odd_rows()
    held, blanks = defaultdict(list), " \t\n\x0b\x0c\r"
    for i, text, *_ in rows:
        for k in {a_lower(line.strip(blanks)) for line in (text or "").split("\n")}:
            if len(k) >= 40:
                held[k].append(i)
    gone = {k: max(ids, key=key) for k, ids in held.items() if len(ids) >= 5}
    want = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if (k := a_lower(x.strip(blanks))) not in gone or key(i) >= key(gone[k])]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    assert any(w[2] for w in want)
    got = [tuple(r) for r in line_dedup.drop_repeated_lines(odd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_hilbert_curve_is_one_path():
    for dimensions, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        axes = np.stack(np.meshgrid(*[np.arange(side)] * dimensions), axis=-1).reshape(-1, dimensions)
        index = hilbert_shards.hilbert_index(axes, bits)
        assert sorted(index) == list(range(side ** dimensions))
        path = axes[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(odd, empty, spark, tmp_path):
    rows = hilbert_shards.place_in_shards(odd, 7).collect()
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    curve = [r["curve"] for r in sorted(rows, key=lambda r: r["number"])]
    assert curve == sorted(curve)
    assert hilbert_shards.place_in_shards(empty).count() == 0
    hilbert_shards.write_shards(odd, str(tmp_path / "shards"), 7)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == odd.count()


def test_mixing(odd, empty):
    rows = mixing.mix_sources(odd, seed=3).collect()
    size = {r["source"]: 0 for r in rows}
    for i, text, _, source, *_ in odd_rows():
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    total, names = sum(size.values()), sorted([s for s in size if s is not None]) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            free.remove(s)
    target |= share
    for s in names:
        mine = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 * total for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(r["size"] for r in mine)
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    again = mixing.mix_sources(odd.repartition(5, "text"), seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    taken = mixing.take_mix(odd, seed=3)
    assert taken.columns == odd.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in taken.collect())
    assert words == sum(r["taken"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0 and mixing.take_mix(empty).count() == 0


def test_rounding_keeps_expectations(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 4), "a" if i < 24 else "b") for i in range(40)], "doc_id long, text string, source string")
    taken = Counter()
    for seed in range(12):
        for r in mixing.mix_sources(docs, seed=seed).filter("source = 'a'").collect():
            taken[r["doc_id"]] += r["copies"]
    share = mixing.mix_sources(docs).filter("source = 'a'").first()
    mean = 12 * share["target"] / share["source_size"]
    assert abs(sum(taken.values()) / 24 - mean) < 0.12 * mean and len({taken[i] for i in range(24)}) > 2


def jaccard_brute(rows, k, percent):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, queue = {i}, [i]
        while queue:
            for j in links[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), (min(ids) if ids else None) if len(seen) > 1 else rows[i][0], len(links[i])))
    return out


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_join(odd, k, percent):
    got = [tuple(r) for r in jaccard_join.jaccard_classes(odd, k, percent).collect()]
    assert sorted(got, key=str) == sorted(jaccard_brute(odd_rows(), k, percent), key=str)


def test_jaccard_join_in_several_blocks(spark, monkeypatch):
    r = random.Random(9)
    words = sentence(r, 60).split()
    rows = []
    for i in range(70):
        some = list(words)
        for _ in range(r.randrange(0, 4)):
            some[r.randrange(60)] = f"w{r.randrange(50)}"
        rows.append((i, " ".join(some)))
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    got = [tuple(x) for x in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()]
    assert sorted(got) == sorted(jaccard_brute(rows, 4, 85))


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.jaccard_classes(empty).count() == 0
    assert jaccard_join.keep_one_of_each(empty).columns == empty.columns


def test_keep_one_of_each(odd):
    kept = jaccard_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[100] == ids[101] == ids[102] == ids[103] == ids[104] == 1


def test_lattice_points():
    y = np.random.default_rng(0).normal(size=(300, 8)) * 1.5
    points = lattice_dedup.decode(y)
    steps = lattice_dedup.neighbours()
    assert len(steps) == 240 and np.allclose((steps ** 2).sum(axis=1), 2)
    near = ((y - points) ** 2).sum(axis=1)
    assert (near <= 1 + 1e-9).all()  # the covering radius of E8
    assert all((near <= ((y - points - s) ** 2).sum(axis=1) + 1e-9).all() for s in steps)


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_lattice_dedup(spark, monkeypatch, block_rows):
    monkeypatch.setattr(lattice_dedup, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, list(map(float, centres[i % 20] + rng.normal(size=16) * (0.12 if i % 2 else 0.02)))) for i in range(160)]
    rows += [(200 + i, list(map(float, centres[0] * (1 + i % 2)))) for i in range(30)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, None]), (304, []), (305, [1e300] * 16), (306, [2e-300] * 16), (None, list(map(float, centres[3]))), (5, rows[5][1]), (307, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, digest string, cell int").repartition(4)
    got = sorted(map(tuple, lattice_dedup.near_vectors(frame).collect()), key=str)
    ok = [v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if g else None for (_, v), g in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and unit[i] @ unit[j] >= 0.95] for i in range(len(rows))]
    assert sum(g[1] for g in got) >= 0.9 * sum(map(len, links))
    want_links = Counter()
    for (i, _), mine in zip(rows, links):
        want_links[i] += len(mine)
    assert all(sum(g[1] for g in got if g[0] == i) <= n for i, n in want_links.items())
    by_id = {g[0]: g for g in got}
    for i in (300, 301, 302, 303, 304, 307):
        assert by_id[i] == (i, 0, i, True)
    assert by_id[305][1:3] == (1, 305) and by_id[306][1:] == (1, 305, False)
    assert all(by_id[200 + i][2] == by_id[200][2] for i in range(30))


@pytest.mark.parametrize("shared", [7, None])
def test_lattice_dedup_of_different_vectors_under_one_id(spark, shared):
    axes = np.eye(8)
    near = [list(map(float, axes[i] + 1e-3 * axes[7])) for i in range(3)]
    rows = [(shared, list(map(float, axes[i]))) for i in range(6)] + [(shared, list(map(float, axes[5])))] + [(100 + i, v) for i, v in enumerate(near)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = Counter(tuple(r)[:3] for r in lattice_dedup.near_vectors(frame).collect())
    want = Counter({(shared, 0, shared): 2})
    for i in range(3):
        want[(shared, 1, shared or 100 + i)] += 1
        want[(100 + i, 1, shared or 100 + i)] += 1
    want[(shared, 1, shared)] += 2
    assert got == want


def test_lattice_dedup_of_nothing(spark):
    assert lattice_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def odd_texts():
    r = random.Random(2)
    texts = ["", "a" * 999, "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "  \n\n x  ", " 　\x1c\x85 1", "I'm DON'T 'll", "\x00\x01", None, "'", "a'", "'s", " 's",
             "\n's", "!'s", "'s's're'rex'vel'", "x'r", "e", "'", "s", "  ", " ", "\t", "\u00a0a \u00a0 a", "é'd À²½٣ 三"]
    texts += ["".join(r.choice("aehtn hewor .,'\n1\té") for _ in range(80)) for _ in range(300)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x500), r.randrange(0x2000, 0x3100), r.randrange(0x1F300, 0x1F700)])) for _ in range(50)) for _ in range(200)]
    return texts + ["".join(r.choice("'stmdrevl  \n,") for _ in range(30)) for _ in range(300)]


@pytest.mark.parametrize(("slots", "cells", "scalar"), [(1 << 20, 1 << 21, 512), (64, 200, 6)])
def test_automaton_encodes_as_the_library(path, monkeypatch, slots, cells, scalar):
    import pyarrow as pa
    from tokenizers import Tokenizer
    for name, value in (("SLOTS", slots), ("CELLS", cells), ("SCALAR", scalar)):
        monkeypatch.setattr(bpe_automaton, name, value)
    library, automaton = Tokenizer.from_file(path), bpe_automaton.compiled(path)
    encoder, decoder = bpe_automaton.Encoder(automaton), bpe_automaton.Decoder(automaton)
    texts = odd_texts()
    if scalar == 6:
        texts = texts[:120]
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for at, size in ((0, len(texts)), (3, 50), (10, 1), (0, 0)):
        ids = encoder.encode(pa.array(texts, pa.string())[at:at + size])
        assert ids.to_pylist() == want[at:at + size]
        assert decoder.decode(ids).to_pylist() == [t or "" for t in texts[at:at + size]]
    assert decoder.decode(pa.array([[255], None, [220]], pa.list_(pa.int32()))).to_pylist() == [library.decode([255]), "", " "]


def test_words_are_cut_as_the_pattern_says():
    import pyarrow as pa
    import regex
    pattern = regex.compile(bpe_automaton.PATTERN)
    texts = odd_texts()
    offsets, data = bpe_automaton._bytes(pa.array(texts, pa.string()))
    starts = bpe_automaton._word_starts(offsets, data, np.empty(0, int))
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert words == [w for t in texts for w in pattern.findall(t or "")]


def test_compiled_table_accepts_what_the_merges_make(tmp_path):
    import itertools
    import json
    r = random.Random(4)
    for _ in range(6):
        vocab, merges = list("abc"), []
        while len(merges) < 14:
            pair = (r.choice(vocab), r.choice(vocab))
            if "".join(pair) not in vocab and len("".join(pair)) < 6:
                merges.append(pair)
                vocab.append("".join(pair))
        file = tmp_path / "tokenizer.json"
        file.write_text(json.dumps({"added_tokens": [], "model": {"vocab": {t: i for i, t in enumerate(vocab)}, "merges": merges}}))
        encoder = bpe_automaton.Encoder(bpe_automaton.compiled(str(file)))
        strings = ["".join(x) for n in range(1, 8) for x in itertools.product("abc", repeat=n)]
        data = np.frombuffer("".join(strings).encode(), np.uint8)
        flat, sizes = encoder.encode_words(np.append(0, np.cumsum([len(x) for x in strings])), data)
        got = np.split(flat, np.cumsum(sizes)[:-1])
        rank = {pair: i for i, pair in enumerate(merges)}
        for string, ids in zip(strings, got, strict=True):
            parts = list(string)
            while pairs := [(rank[p], i) for i, p in enumerate(itertools.pairwise(parts)) if p in rank]:
                i = min(pairs)[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            assert [vocab[i] for i in ids] == parts
            assert encoder.encode_word(string.encode()) == ids.tolist()


def test_bpe_round_trip(odd, empty, path):
    both = bpe_automaton.decode(bpe_automaton.encode(odd, path), path)
    assert set(both.columns) == {*odd.columns, "ids", "decoded"}
    for r in both.collect():
        assert r["decoded"] == (r["text"] or "") and (r["ids"] == []) == (not r["text"])
    once = bpe_automaton.encode(odd, path, decoded_col="decoded")
    assert sorted(map(str, once.select(*both.columns).collect())) == sorted(map(str, both.collect()))
    assert bpe_automaton.token_digests(odd, path).filter("doc_id = 100").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe_automaton.token_digests(empty, path).count() == 0


def test_language_model_sums_to_one():
    import pandas as pd
    text = "the cat sat on the mat and the dog sat on the log " * 3
    g, n = np.unique(language_id.grams(language_id.codes(text)), return_counts=True)
    model = language_id.build(pd.DataFrame({"lang": "en", "gram": g.view(np.int64), "n": n}))
    letters = model.keys[0]
    for context in (g[0] >> np.uint64(16), g[5] >> np.uint64(16), np.uint64(0x7A7A7A)):
        p = np.exp(model.score((context << np.uint64(16)) | letters)).sum()
        unseen = float(np.exp(model.score(np.array([(context << np.uint64(16)) | np.uint64(0x3B1)]))[0, 0]))
        assert abs(p + unseen - 1) < 1e-3


def test_language_id(odd, empty, spark):
    rows = {}
    for r in language_id.identify(odd).collect():
        rows.setdefault(r["doc_id"], r)
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
    assert all(rows[i]["lang_pred"] == "und" and not rows[i]["accepted"] for i in (100, 101, 102))
    assert rows[104]["lang_pred"] in {"en", "fr", "de"}
    r = random.Random(4)
    say = {"xx": "abcdefgh", "yy": "stuvwxyz"}
    docs = spark.createDataFrame([(i, " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(30)), lang) for i in range(60) for lang, letters in [list(say.items())[i % 2]]], "doc_id long, text string, lang string")
    found = language_id.identify(docs).join(docs, "doc_id").filter("held_out").collect()
    assert found and all(x["lang_pred"] == x["lang"] for x in found)
    assert language_id.keep_identified(docs).count() == 60
    strange = docs.union(spark.createDataFrame([(999, "мир " * 50, None)], docs.schema))
    assert 999 not in {x["doc_id"] for x in language_id.keep_identified(strange).collect()}
    assert language_id.identify(empty).count() == 0 and language_id.keep_identified(empty).columns == empty.columns
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x["lang_pred"] for x in nothing} == {"und"}


def test_rare_language_beside_a_large_one(spark):
    r = np.random.default_rng(7)
    wide = [chr(c) for c in [*range(0x61, 0x7B), *range(0x430, 0x450)]]
    rows = [(i, "".join(r.choice(wide, 80_000)), "many") for i in range(34)]
    signs = [chr(c) for c in range(0x4E00, 0x4F90)]
    rows += [(1000 + i, signs[i] + "".join(r.choice(signs, 50)), "rare") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    found = language_id.identify(docs).filter("doc_id >= 1000").collect()
    assert len(found) == 30 and all(x["lang_pred"] == "rare" for x in found)


def test_only_calibration_rows_are_not_counted(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i if i % 2 else None, "".join(r.choice("abcdefgh") for _ in range(20)), "en") for i in range(600)]
    counted, learn = [], language_id.learn
    monkeypatch.setattr(language_id, "learn", lambda counts, *rest: counted.append(counts.agg(F.sum("n")).first()[0]) or learn(counts, *rest))
    language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), calibration_rows=5)
    assert 580 <= counted[0] / 21 < 600


def test_without_labels_texts_with_letters_stay(odd):
    kept = language_id.keep_identified(odd.withColumn("lang", F.lit(None).cast("string")))
    assert kept.count() == odd.filter(F.col("text").rlike("[a-zA-Z]")).count()


def test_wrong_labels_do_not_widen_the_limit(spark, monkeypatch):
    r = random.Random(13)
    rows = []
    for i in range(500):
        text = " ".join("".join(r.choice(["abcdefgh", "stuvwxyz"][i % 2]) for _ in range(5)) for _ in range(40))
        rows.append((i, text, ["xx", "yy"][i % 2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(language_id.count_grams(docs))
    monkeypatch.setattr(language_id, "learn", lambda *_: model)
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "yy").otherwise(F.col("lang")))
    assert language_id.train(wrong).limit < 15


def test_parts_of_a_model_are_the_whole(odd, monkeypatch):
    labelled = odd.select("doc_id", "lang", "text")
    whole, cut = language_id.train(labelled), language_id.train(labelled, part_rows=500)
    assert len(whole.parts) == 1 and len(cut.parts) > 5
    texts = [r["text"] for r in labelled.collect()]
    want, n = whole.entropies(texts, len(texts))
    monkeypatch.setattr(language_id, "CHUNK", 64)
    got, m = cut.entropies(texts, len(texts))
    assert (n == m).all() and np.allclose(got, want, atol=1e-4) and np.isclose(cut.limit, whole.limit, atol=1e-2)
    counted = language_id.count_grams(labelled.filter("lang IS NOT NULL")).toPandas()
    alone, learnt = language_id.build(counted), language_id.learn(language_id.count_grams(labelled.filter("lang IS NOT NULL"))).parts[0].value
    assert all((a == b).all() for a, b in zip(alone.keys, learnt.keys)) and all(np.allclose(a, b) for a, b in zip(alone.logp, learnt.logp))


def test_lexicon_finds_misspelled_terms():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "worthless": 4.0, "bad": 3.0, "lowe*": 2.0, "scum": 3.0, "abcde": 2.0, "abcde*": 2.0})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(8)
    for _ in range(2000):
        word = list(r.choice(["idiot", "worthless", "bad", "scum"]))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(word) + 1)
            word[at:at + r.randrange(2)] = r.choice(["", "x", "t", "o"])
        word = "".join(word)
        near = [(edits(word, t), t) for t, most in (("idiot", 1), ("worthless", 2), ("bad", 0), ("scum", 1)) if edits(word, t) <= most]
        want = (min(near)[1], min(near)[0]) if near else None
        assert lexicon.find(word) == want, word
    assert lexicon.find("loweichen") == ("lowe*", -1) and lexicon.find("low") is None


def test_a_word_and_its_stem_are_both_found():
    lexicon = toxicity.Lexicon({"abcde": 2.0, "abcde*": 2.0, "scum": 3.0})
    assert lexicon.find("abcdefghij") == ("abcde*", -1) and lexicon.find("abcde") == ("abcde", 0) and lexicon.find("abcdx") == ("abcde", 1)
    assert lexicon.find("skum") == lexicon.find("scumm") == ("scum", 1)
    assert toxicity.Lexicon({"abcde*": 2.0}).find("abcde") == ("abcde*", -1)
    fact = dict(zip(toxicity.FACTS, lexicon.facts("you skum"), strict=True))
    assert fact["short_edit"] > 0 and fact["one_edit"] == 0 and fact["addressed"] > 0


def test_context_separates_quotation():
    lexicon = toxicity.Lexicon({"idiot": 5.0})
    abuse, quoted = (dict(zip(toxicity.FACTS, lexicon.facts(t), strict=True)) for t in ("you are an idiot and more", 'the word "idiot" is old'))
    assert abuse["exact"] > 0 and abuse["quoted"] == 0 and abuse["addressed"] > 0
    assert quoted["exact"] == 0 and quoted["quoted"] > 0
    assert not lexicon.facts(None).any() and not lexicon.facts("").any()


def facts_by_hand(terms, text):
    lexicon, lower = toxicity.Lexicon(terms), text.lower()
    spans = [(m.start(), m.end()) for m in toxicity._WORD.finditer(lower)]
    words = [lower[a:b] for a, b in spans]
    marks = [i for i, c in enumerate(lower) if c in '"“”„«»']
    out, kinds = Counter(), set()
    for i, w in enumerate(words):
        found = lexicon.find(w)
        if not found:
            continue
        lo, hi = max(0, i - toxicity.WINDOW), min(len(words) - 1, i + toxicity.WINDOW)
        near = set(words[lo:i] + words[i + 1:hi + 1])
        if near & toxicity.REPORTING or (any(spans[lo][0] - 2 <= m < spans[i][0] for m in marks) and any(spans[i][1] <= m <= spans[hi][1] + 2 for m in marks)):
            out["quoted"] += terms[found[0]]
            continue
        out["short_edit" if found[1] == 1 and len(found[0]) == 4 else {0: "exact", -1: "stem", 1: "one_edit", 2: "two_edits"}[found[1]]] += terms[found[0]]
        out["addressed"] += bool(near & toxicity.ADDRESS)
        kinds.add(found[0])
    hits = sum(out[k] for k in ("exact", "stem", "one_edit", "two_edits", "short_edit"))
    return [np.log1p(out[k]) for k in toxicity.FACTS[:-2]] + [hits / (len(words) + 20) if out else 0, len(kinds)]


def test_facts_are_those_by_hand():
    terms = {"idiot": 5.0, "worthless": 4.0, "scum": 3.0, "lowe*": 2.0}
    r = random.Random(3)
    pool = ["idiot", "idoit", "idiotx", "worthles", "wrthlss", "scum", "skum", "lowest", "said", "you", '"', "„", "and", "it,", "x"]
    for _ in range(300):
        text = " ".join(r.choice(pool) for _ in range(r.randrange(40)))
        assert np.allclose(toxicity.Lexicon(terms).facts(text), facts_by_hand(terms, text)), text


def test_facts_of_very_long_texts():
    import time
    lexicon = toxicity.Lexicon({"idiot": 5.0, "scum": 3.0})
    start = time.process_time()
    assert lexicon.facts('"idiot" scum, ' * 300_000)[-1] <= 2
    assert lexicon.facts("x" * 5_000_000 + " idiot")[-1] == 1
    assert time.process_time() - start < 60 and max(map(len, lexicon.words)) <= toxicity.KEPT_LETTERS


def test_no_term_is_left_out(spark):
    bad = [f"{'abcdefghij'[i // 100 % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzklmn'[i % 10]}{'opqrstuvwx'[i // 1000]}" for i in range(1300)]
    rows = [(" ".join(bad[i::10]), 1) for i in range(10)] * 12 + [("calm words here", 0)] * 120
    found = toxicity.learn_terms(spark.createDataFrame(rows, "text string, y int"))
    assert set(bad) <= set(found)


def labelled(spark, n=400):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = sentence(r, 40).split()
        bad, junk = i % 5 == 0, i % 7 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(["idiot", "idiott", "worthless", "scumbag"])
        if junk:
            words = words[:1] * 200
        if bad and junk:
            words[3] = "idiot"
        rows.append((i, " ".join(words), "en", "a", "x"))
        labels.append((i, int(not junk), int(bad)))
    docs = spark.createDataFrame(rows + [(9001, None, None, None, None), (9002, "", "en", "a", "x")], "doc_id long, text string, lang string, source string, y string")
    return docs, spark.createDataFrame(labels + [(9001, None, None), (5, 1, 1), (77777, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "label", "at"), [(quality.score_quality, "quality", 1), (toxicity.score_toxicity, "toxic", 2)])
def test_classifiers(spark, odd, empty, score, label, at):
    docs, labels = labelled(spark)
    truth = {r[0]: r[at] for r in labels.collect()}
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["held_out"] and r["doc_id"] < 9000]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) >= 0.95
    none = score(docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert score(odd, labels).count() == odd.count() and score(empty, labels).count() == 0


def test_isotonic():
    assert list(quality.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0.25, 2]))) == [0, 0.5, 0.5, 2]


def test_statistics_of_nothing():
    assert not quality.statistics(None).any() and not quality.statistics("").any()
    assert np.isfinite(quality.statistics(" \n ")).all() and np.isfinite(quality.statistics("x" * 10 ** 6)).all()


HIDDEN = ["_row", "_key", "_gone", "_id", "_id2", "_source", "_source2", "_crc", "_crc2", "_copies", "_rows", "_nth", "_at", "_task", "_n", "_own", "_text", "_sha",
          "_number", "_shard", "_each", "_key0", "_key1", "_key0_", "_before", "col"]


@pytest.fixture(scope="module")
def twice(spark):
    """A table ingested twice, with columns named like those that the operators use inside."""
    r = random.Random(6)
    base = [(i, sentence(r, 30 + i % 3), "en", f"s{i % 3}", i) for i in range(24)]
    base += [(30 + i, base[i][1].upper(), "en", "s0", i) for i in range(6)] + [(None, base[0][1], None, None, 0), (40, None, "en", "s1", 0), (41, "", "en", "s1", 0)]
    rows = [(*row, *HIDDEN) for row in base] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in HIDDEN)).repartition(5)


def test_a_table_ingested_twice(twice):
    single = exact_dedup.drop_copies(twice)
    assert single.columns == twice.columns
    texts = Counter(a_lower(r["text"]) for r in single.collect())
    assert set(texts.values()) == {1} and len(texts) == 25
    assert {r["doc_id"] for r in single.collect()} == {*range(6, 24), *range(30, 36), 41}
    apart = jaccard_join.keep_one_of_each(twice)
    assert apart.columns == twice.columns
    assert Counter(r["doc_id"] for r in apart.collect()) == Counter([None, *range(1, 24), 40, 41])
    assert all(r["_row"] == "_row" and r["_nth"] == "_nth" for r in apart.collect())


def test_mix_of_equal_rows_with_hidden_names(twice):
    mixed = mixing.take_mix(twice)
    assert mixed.columns == twice.columns
    want = Counter()
    for r in mixing.mix_sources(twice).collect():
        want[r["doc_id"], r["source"], r["text_crc32"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], zlib.crc32((r["text"] or "").encode())) for r in mixed.collect())
    assert got == +want and max(got.values()) > 1


def test_shards_of_clashing_columns_can_be_pruned(twice, odd, empty, spark, tmp_path):
    hilbert_shards.write_shards(twice, str(tmp_path / "a"), shards=4, task_bytes=500)
    back = spark.read.parquet(str(tmp_path / "a"))
    assert set(back.columns) == {*twice.columns, "__shard"} and back.count() == twice.count()
    hilbert_shards.write_shards(empty, str(tmp_path / "b"))
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
                                      F.concat(F.lit("s"), F.col("id") % 8).alias("source"), F.concat(F.lit("l"), F.col("id") % 4).alias("lang"))
    hilbert_shards.write_shards(many, str(tmp_path / "c"), shards=64)
    shards = {name: spark.read.parquet(str(tmp_path / "c")).filter(rule).select("_shard").distinct().count() for name, rule in (
        ("source", "source = 's3'"), ("lang", "lang = 'l1'"), ("both", "source = 's3' AND doc_id < 5000"), ("id", "doc_id BETWEEN 100 AND 1500"))}
    assert shards["both"] <= 12 and all(n <= 32 for n in shards.values()), shards

def test_components_of_stars_chains_and_nothing(spark):
    from accesslens.llm.support import components
    r = random.Random(9)
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000 + r.randrange(300), 5000 + r.randrange(300)) for _ in range(250)]
    links += [(7, 7)] + links[:50] + [(b, a) for a, b in links[:20]]
    r.shuffle(links)
    head = {n: n for pair in links for n in pair}

    def find(n):
        while head[n] != n:
            n = head[n]
        return n
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        head[b] = a
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long").repartition(13)).collect()
    assert len(got) == len(linked) and {r["node"]: r["component"] for r in got} == {n: find(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
