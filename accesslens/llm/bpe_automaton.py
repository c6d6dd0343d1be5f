"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens; its state is the last token read.  At first every byte may follow every byte.  Each merge
u + v -> w, in rank order, inserts a gadget: an arc w that enters where u could be entered and leaves as v then leaves,
while v may no longer follow u.  A sequence of tokens is then accepted exactly if it is what the merges make of its
text.  The driver compiles the merges once: the arcs' labels into a trie with suffix links, and for each token the parts
through which its state inherits exits and entries, with the time until which each held.  A transition between two
tokens follows from these chains and is kept in the state table from then on.

A word is encoded in one pass over its bytes: the trie's transitions give the arcs that end at a byte, the longest
first, and of these exactly one continues the accepted sequence before it, since each prefix of a word has exactly one.
No place is left and tried again.  Texts are cut into words by classes of characters; all distinct words of a batch run
through the automaton side by side, a byte at a time, as arrays, and the ids of all words are assembled by arrays too.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from accesslens.llm.support import lean, small_batches

# How the public byte-level tokenizer splits a text before its merges.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Slots of a worker's state table; it is emptied and filled anew when half of them are taken.
SLOTS = 1 << 20
#: Places of words that run side by side; a word of more than SCALAR bytes runs alone.
CELLS, SCALAR = 1 << 21, 512
_NEVER = 1 << 60


def _letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges: the trie of the arcs' labels, and the chains that decide which arc may follow which."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        letters = _letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take blanks or need whole words are not supported")
        arcs = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.label = arcs | {i: t.encode() for t, i in self.special.items()}
        self._compile_gadgets([(vocab[u], vocab[v], vocab[u + v]) for u, v in map(tuple, merges)])
        self._compile_trie({token: label for token, label in arcs.items() if token in self.made})

    def _compile_gadgets(self, merges: list[tuple[int, int, int]]) -> None:
        """Insert the merges' gadgets in order; cut[u << 20 | v] is the time from which v may not follow u.

        exits of a are the parts whose exits the state of a has, each with the time until which it stood alone at a's
        right end; entries of b the parts through which b is entered.  A merge whose parts can't meet any more, or that
        makes a token again, inserts nothing; `made` holds the tokens that have an arc.
        """
        self.cut: dict[int, int] = {}
        self.made = set(self.label) - {w for _, _, w in merges}
        exits, entries = ({token: [(token, _NEVER)] for token in self.made} for _ in range(2))
        for time, (u, v, w) in enumerate(merges):
            if w not in self.made and {u, v} <= self.made and not self._cut_between(exits[u], entries[v]):
                self.cut[u << 20 | v] = time
                self.made.add(w)
                entries[w] = [(w, _NEVER), *((part, min(until, time)) for part, until in entries[u])]
                exits[w] = [(w, _NEVER), *((part, min(until, time)) for part, until in exits[v])]
        self.exits, self.entries = _Chains(exits), _Chains(entries)

    def _cut_between(self, exits, entries) -> bool:
        for part, until in exits:
            for other, open_until in entries:
                time = self.cut.get(part << 20 | other)
                if time is not None and time < until and time <= open_until:
                    return True
        return False

    def may_follow(self, a: int, b: int) -> bool:
        """Whether arc b leaves the state of a: no gadget cut the parts that met before they became longer tokens."""
        return not self._cut_between(self.exits.of(a), self.entries.of(b))

    def _compile_trie(self, arcs: dict[int, bytes]) -> None:
        """The trie by arrays: key (node << 8 | byte) and child of each edge in breadth-first order, link (a node's longest
        proper suffix), last (the longest arc that ends at a node); shorter and width by token: the longest arc that is
        a proper suffix of an arc, and the bytes of its label."""
        child: dict[int, int] = {}
        own = [-1]
        for token, label in arcs.items():
            node = 0
            for byte in label:
                node = child.setdefault(node << 8 | byte, len(own))
                if node == len(own):
                    own.append(-1)
            own[node] = token
        below: dict[int, list[int]] = {}
        for key in child:
            below.setdefault(key >> 8, []).append(key)
        tokens = max(self.label) + 1
        link, last, queue, edges = [0] * len(own), list(own), [0], []
        self.shorter, self.width = np.full(tokens, -1, np.int32), np.zeros(tokens, np.int32)
        for token, label in self.label.items():
            self.width[token] = len(label)
        for node in queue:
            for key in below.get(node, ()):
                down, up = child[key], link[node]
                while up and up << 8 | key & 255 not in child:
                    up = link[up]
                link[down] = child.get(up << 8 | key & 255, 0) if node else 0
                if own[down] >= 0:
                    self.shorter[own[down]] = last[link[down]]
                else:
                    last[down] = last[link[down]]
                edges.append(key)
                queue.append(down)
        self.edge, self.child = np.array(edges, np.int64), np.array([child[key] for key in edges], np.int32)
        self.link, self.last = np.array(link, np.int32), np.array(last, np.int32)


class _Chains:
    """Chains of (part, time) by token, as arrays."""

    def __init__(self, chains: dict[int, list[tuple[int, int]]]):
        sizes = np.zeros(max(chains) + 2, np.int32)
        for token, chain in chains.items():
            sizes[token + 1] = len(chain)
        self.at = np.cumsum(sizes, dtype=np.int32)
        pairs = np.array([pair for token in sorted(chains) for pair in chains[token]], np.int64)
        self.part, self.until = pairs[:, 0].astype(np.int32), pairs[:, 1]

    def of(self, token: int) -> list[tuple[int, int]]:
        held = slice(self.at[token], self.at[token + 1])
        return list(zip(self.part[held].tolist(), self.until[held].tolist(), strict=True))


def _hashed(key: np.ndarray, slots: int) -> np.ndarray:
    return (key * 0x9E3779B1 >> 12) % slots


class _Edges:
    """The trie's edges in an open hash table."""

    def __init__(self, key: np.ndarray, child: np.ndarray):
        self.slots = 1 << max(4, int(3 * len(key)).bit_length())
        self.key, self.child = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        todo, at = np.arange(len(key)), _hashed(key, self.slots)
        while len(todo):
            free = self.key[at[todo]] < 0
            self.key[at[todo[free]]] = key[todo[free]]
            here = self.key[at[todo]] == key[todo]
            self.child[at[todo[here]]] = child[todo[here]]
            todo = todo[~here]
            at[todo] = (at[todo] + 1) % self.slots

    def down(self, key: np.ndarray) -> np.ndarray:
        """The node at the end of each edge, or -1 if there is none."""
        out, todo, at = np.full(len(key), -1, np.int32), np.arange(len(key)), _hashed(key, self.slots)
        while len(todo):
            held = self.key[at[todo]]
            here = held == key[todo]
            out[todo[here]] = self.child[at[todo[here]]]
            todo = todo[~here & (held >= 0)]
            at[todo] = (at[todo] + 1) % self.slots
        return out


class Encoder:
    """One worker's run of the automaton, with the table of the transitions met so far."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.edges = _Edges(automaton.edge, automaton.child)
        self._forget()
        special = sorted(automaton.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's transitions: down an edge, or else where the suffix link's transition leads."""
        out, todo = np.zeros(len(node), np.int32), np.arange(len(node))
        while len(todo):
            down = self.edges.down(node[todo].astype(np.int64) << 8 | byte[todo])
            found = down >= 0
            out[todo[found]] = down[found]
            todo = todo[~found & (node[todo] > 0)]
            node = node.copy()
            node[todo] = self.automaton.link[node[todo]]
        return out

    def _forget(self) -> None:
        self.slots, self.taken = np.full(SLOTS, -1, np.int64), 0

    def follows(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The state table: whether each token may follow the one before; a transition not met yet is decided and kept.

        An open hash table of numbers: key << 1 | answer, at the first free slot from the key's hash on.
        """
        key = before.astype(np.int64) << 20 | token
        out = np.empty(len(key), bool)
        at = _hashed(key, SLOTS)
        todo = np.arange(len(key))
        while len(todo):
            held = self.slots[at[todo]]
            found = held >> 1 == key[todo]
            out[todo[found]] = held[found] & 1
            free = todo[held < 0]
            if len(free):
                new, which = np.unique(key[free], return_inverse=True)
                known = np.fromiter((self.automaton.may_follow(int(k >> 20), int(k & 0xFFFFF)) for k in new), bool, len(new))
                out[free] = known[which]
                self._keep(new << 1 | known)
            todo = todo[~found & (held >= 0)]
            at[todo] = (at[todo] + 1) % SLOTS
        return out

    def _keep(self, entries: np.ndarray) -> None:
        self.taken += len(entries)
        if self.taken > SLOTS // 2:
            self._forget()
            self.taken = len(entries := entries[:SLOTS // 4])
        for entry in entries.tolist():
            at = ((entry >> 1) * 0x9E3779B1 >> 12) % SLOTS
            while self.slots[at] >= 0 and self.slots[at] != entry:
                at = (at + 1) % SLOTS
            self.slots[at] = entry

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word: state[i] is the arc that ends the accepted sequence of the first i bytes."""
        automaton, node, state = self.automaton, 0, [-1]
        for end, byte in enumerate(word, 1):
            node = int(self._next(np.array([node]), np.array([byte]))[0])
            token = int(automaton.last[node])
            while (before := state[end - automaton.width[token]]) >= 0 and not automaton.may_follow(before, token):
                token = int(automaton.shorter[token])
            state.append(token)
        ids, end = [], len(word)
        while end:
            ids.append(state[end])
            end -= automaton.width[state[end]]
        return ids[::-1]

    def encode_words(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        widths = np.diff(offsets)
        order = np.argsort(widths, kind="stable")
        sizes = np.zeros(len(widths), np.int64)
        parts, at, short = [], int(np.searchsorted(widths[order], 1)), int(np.searchsorted(widths[order], SCALAR, "right"))
        while at < short:
            most = widths[order[at:short]] + 1
            fits = max(1, int(np.searchsorted(most * np.arange(1, len(most) + 1), CELLS, "right")))
            some = order[at:at + fits]
            ids, sizes[some] = self._side_by_side(offsets[some], widths[some], data)
            parts.append(ids)
            at += fits
        for i in order[short:]:
            parts.append(np.array(self.encode_word(data[offsets[i]:offsets[i + 1]].tobytes()), np.int32))
            sizes[i] = len(parts[-1])
        ends = np.cumsum(sizes[order])
        begins = np.empty(len(order), np.int64)
        begins[order] = ends - sizes[order]
        return _gather(np.concatenate([*parts, np.empty(0, np.int32)]), begins, sizes)[0], sizes

    def _side_by_side(self, starts: np.ndarray, widths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode_word, for words in ascending order of their widths, a byte of all of them at a time."""
        automaton, longest = self.automaton, int(widths[-1])
        state = np.full((len(widths), longest + 1), -1, np.int32)
        node = np.zeros(len(widths), np.int32)
        for end in range(1, longest + 1):
            todo = np.arange(np.searchsorted(widths, end), len(widths))
            node[todo] = self._next(node[todo], data[starts[todo] + (end - 1)])
            token = automaton.last[node[todo]]
            while len(todo):
                before = state[todo, end - automaton.width[token]]
                ok = before < 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self.follows(before[ask], token[ask])
                state[todo[ok], end] = token[ok]
                todo, token = todo[~ok], automaton.shorter[token[~ok]]
        end, todo, steps = widths.astype(np.int64), np.arange(len(widths)), []
        sizes = np.zeros(len(widths), np.int64)
        while len(todo):
            token = state[todo, end[todo]]
            steps.append((todo, token))
            sizes[todo] += 1
            end[todo] -= automaton.width[token]
            todo = todo[end[todo] > 0]
        ids, last = np.empty(sizes.sum(), np.int32), np.cumsum(sizes) - 1
        for back, (rows, token) in enumerate(steps):
            ids[last[rows] - back] = token
        return ids, sizes

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; null counts as empty."""
        offsets, data = _bytes(texts)
        special = self._special(texts)
        starts = _word_starts(offsets, data, special)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        bounds, held = _bytes(coded.dictionary)
        if len(special):
            flat, sizes = self._encode_special(coded.dictionary)
        else:
            flat, sizes = self.encode_words(bounds, held)
        which = coded.indices.to_numpy()
        out, ends = _gather(flat, (np.cumsum(sizes) - sizes)[which], sizes[which])
        of_text = np.searchsorted(starts, offsets)
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends)[of_text].astype(np.int32)), pa.array(out, pa.int32()))

    def _special(self, texts: pa.Array) -> np.ndarray:
        """The texts that hold a special token."""
        holds = np.zeros(len(texts), bool)
        for content in self.automaton.special:
            holds |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
        return np.flatnonzero(holds)

    def _encode_special(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words, and whole texts that hold special tokens: those are cut at the tokens, and what is between encoded."""
        ids = []
        for word in words.to_pylist():
            parts = self.split.split(word.decode("utf-8", "replace"))
            if len(parts) == 1:
                ids.append(np.array(self.encode_word(word), np.int32))
                continue
            plain = self.encode(pa.array(parts[::2], pa.string()))
            between = [np.array([self.automaton.special[x]], np.int32) for x in parts[1::2]]
            each = [np.asarray(x.values) for x in plain]
            ids.append(np.concatenate([each[0], *(x for pair in zip(between, each[1:], strict=True) for x in pair)]))
        return np.concatenate([*ids, np.empty(0, np.int32)]), np.fromiter(map(len, ids), np.int64, len(ids))


class Decoder:
    """The labels of all tokens, one after another."""

    def __init__(self, automaton: Automaton):
        self.width = automaton.width.astype(np.int64)
        self.starts = np.cumsum(self.width) - self.width
        self.spelled = np.frombuffer(b"".join(automaton.label.get(i, b"") for i in range(len(self.width))), np.uint8)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text that each list of ids spells; broken UTF-8 becomes U+FFFD, null is empty."""
        counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
        flat = ids.flatten().to_numpy()
        out, ends = _gather(self.spelled, self.starts[flat], self.width[flat])
        offsets = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        spelled = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
        try:
            text = spelled.view(pa.string())
            text.validate(full=True)
            return text
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in spelled.to_pylist()], pa.string())


_OTHER, _LETTER, _NUMBER, _BLANK, _EDGE = range(5)


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: blank, letter, number or other."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, f"[{_SPACE}]+")):
        for found in regex.finditer(pattern, every):
            out[found.start():found.end()] = kind
    return out


def _word_starts(offsets: np.ndarray, data: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The bytes where words begin, as PATTERN cuts each text; texts named in whole are not cut.

    A word begins where the class changes.  A blank before a word belongs to it, but of white space only the last blank;
    what comes before that is one word.  An apostrophe that begins a word takes a contraction's letters.
    """
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    size = 1 + (point >= 0x80).astype(np.uint8) + (point >= 0x800) + (point >= 0x10000)
    place = np.cumsum(size, dtype=np.int64) - size
    first = np.zeros(len(point) + 1, bool)
    first[np.searchsorted(place, offsets)] = True
    first[-1] = True
    kind = _classes()[point]
    before = np.where(first[:-1], _EDGE, np.append(_EDGE, kind[:-1])[:len(kind)])
    after = np.where(first[1:], _EDGE, np.append(kind[1:], _EDGE)[:len(kind)])
    blank, space = kind == _BLANK, point == 32
    begins = before != kind
    begins |= blank & (after != _BLANK) & (after != _EDGE)
    glued = np.append(False, space[:-1])[:len(kind)] & (before == _BLANK) & ~blank
    begins &= ~glued
    for i in np.flatnonzero(begins & (point == 39) & (after == _LETTER)):
        letters = point[i + 1:i + 3].tobytes().decode("utf-32-le")
        n = 1 if letters[0] in "stmd" else 2 if letters in ("re", "ve", "ll") and not first[i + 2] else 0
        if n:
            begins[i + 1] = False
            if i + 1 + n < len(begins):
                begins[i + 1 + n] = True
    for i in whole:
        inside = np.searchsorted(place, offsets[i:i + 2])
        begins[inside[0] + 1:inside[1]] = False
    return place[begins]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and the bytes of all texts one after another; broken UTF-8 is replaced in texts."""
    if pa.types.is_string(texts.type):
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([b and b.decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[starts[i]:starts[i] + sizes[i]] of all i, one after another, and where each ends."""
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    places += np.repeat(starts - ends + sizes, sizes)
    return flat[places], ends


def compiled(tokenizer_path: str) -> Automaton:
    with open(tokenizer_path, "rb") as f:
        return Automaton(f.read())


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared: Broadcast) -> Encoder:
    """This worker's encoder for a broadcast automaton; its table serves all tasks of the worker."""
    automaton = shared.value[0]
    if id(automaton) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(automaton)] = Encoder(automaton)
    return _ENCODERS[id(automaton)]


def _with(df: DataFrame, name: str, kind) -> StructType:
    return StructType([f for f in df.schema.fields if f.name != name] + [StructField(name, kind, False)])


def _pieces(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds few bytes of the column, or one row."""
    at, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the token ids of each whole text; null counts as empty, which has no tokens.

    The automaton is compiled on the driver and broadcast (a few MB, bounded by the vocabulary); all other columns stay,
    one named like ids_col is replaced.  decoded_col asks for what the ids decode to in the same pass, see decode.
    """
    small_batches(docs.sparkSession)
    automaton = compiled(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((automaton, Decoder(automaton) if decoded_col else None))
    new = [ids_col, *[decoded_col] * bool(decoded_col)]
    keep = [c for c in docs.columns if c not in new]
    text_at = docs.columns.index(text_col)
    kept_at = [i for i, c in enumerate(docs.columns) if c not in new]

    def run(batches):
        encoder, decoder = _encoder(shared), shared.value[1]
        for batch in batches:
            for piece in _pieces(batch, text_at):
                ids = encoder.encode(piece.column(text_at))
                made = [ids, decoder.decode(ids)] if decoder else [ids]
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in kept_at), *made], [*keep, *new])

    schema = _with(docs, ids_col, ArrayType(IntegerType(), False))
    if decoded_col:
        schema = StructType([*[f for f in schema.fields if f.name != decoded_col], StructField(decoded_col, StringType(), False)])
    return docs.mapInArrow(lean(run), schema)


def decode(tokens: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """tokens with the text that the ids spell; special tokens are spelled out, broken UTF-8 becomes U+FFFD, null is empty."""
    small_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(Decoder(compiled(tokenizer_path)))
    keep = [c for c in tokens.columns if c != text_col]

    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                piece = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), shared.value.decode(piece.column(ids_col))], [*keep, text_col])

    return tokens.mapInArrow(lean(run), _with(tokens, text_col, StringType()))


def token_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = encode(texts, tokenizer_path, decoded_col="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
