"""Jaccard join on word shingles by prefix filters under several global token orders.

Under any order of all tokens, two sets of similarity t or more share a token among the first n - ceil(t n) + 1 of
each.  An order here sorts tokens by how many sets have them, rare ones first, then by a hash of its own.  Sets that
share prefix tokens under the first order form classes (connected components over tokens); under each further order a
class is cut again by its own prefix tokens, whose counts are then those in the class.  Linked sets stay together under
every order, so the classes left at the end, the intersection of the filters, hold every link, and all pairs within a
class are verified, in blocks.

Counts are exact over all sets: a task sends the tokens of a chunk of sets to the buckets of their hash, packed in
arrays; a bucket answers which of them occur again and how often, and the chunk picks its prefixes.  A token that is
frequent in a chunk is sent once with its count, and a chunk names one set for each prefix token, so hot tokens are
reduced before each shuffle.  Equal sets are one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accesslens.llm.support import broadcast_if_small, components, in_block_pairs, lean, one_of_equal, roots, runs, small_batches, whole_row
from accesslens.session import cut_lineage

ORDERS = 3
#: Tokens and sets of a chunk, the count in a chunk from which a token is sent once, and tokens of a bucket.
CHUNK, CHUNK_SETS, HEAVY, BUCKET = 1 << 20, 60_000, 16, 1 << 18
BLOCK_ROWS, BLOCK_TOKENS = 512, 4_000_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_P = 0xD6E8FEB86659FD93
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _M1) | np.uint64(1)
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_FIRST = np.array([True])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    """The first n powers of the odd base, or of its inverse, modulo 2 ** 64."""
    if len(_powers[which]) < n:
        base = _P if which == 0 else pow(_P, -1, 1 << 64)
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        made = np.cumprod(steps)
        if n > 1 << 22:
            return made
        _powers[which] = made
    return _powers[which][:n]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the start of each word in bytes: differences of one running polynomial over them."""
    word = np.zeros(len(raw) + 2, bool)
    np.logical_not(_BLANK[raw], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _power(0, len(raw)), out=total[1:])
    return mix((total[end] - total[start]) * _power(1, len(raw))[start] + (end - start).astype(np.uint64) * _M3), start


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of k words of each text, A-Z lower-cased; fewer words are one, none none."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])
    each, start = word_hashes(np.frombuffer(b"\n".join([*raw, b""]), np.uint8))
    bounds = np.searchsorted(start, first)
    total = np.full(max(0, len(each) - k + 1), k, np.uint64)
    for i in range(k):
        total = total * _M1 + mix(each[i:len(total) + i] + np.uint64(i))
    total = mix(total)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= k:
            some = np.sort(total[a:b - k + 1])
            out.append(some[np.concatenate([_FIRST, some[1:] != some[:-1]])])
        else:
            few = np.full(min(1, b - a), b - a, np.uint64)
            for i in range(b - a):
                few = few * _M1 + mix(each[a + i:a + i + 1] + np.uint64(i))
            out.append(mix(few))
    return out


def in_pieces(texts, k: int):
    """The shingle sets of many texts, a bounded number of bytes at once."""
    held, size = [], 0
    for text in texts:
        text = text.as_py()
        held.append(text)
        size += len(text or "")
        if size >= 1 << 19:
            yield from shingle_sets(held, k)
            held, size = [], 0
    if held:
        yield from shingle_sets(held, k)


def _node(tokens: np.ndarray) -> tuple[bytes, int]:
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """From (doc_id, text): doc_id, n_shingles and the digest of the set, null if it is empty."""
    def run(batches):
        for batch in batches:
            n, digests = [], []
            for tokens in in_pieces(batch.column(1), k):
                n.append(len(tokens))
                digests.append(_node(tokens)[0] if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "n_shingles", "digest"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, digest binary")


def _keyed(tokens: np.ndarray, group: int) -> np.ndarray:
    """Tokens of a class as tokens of their own."""
    return tokens if not group else mix(tokens ^ np.uint64(group & 0xFFFFFFFFFFFFFFFF))


_SENT, _HEAVY, _SETS, _PAIRS = range(4)
_PACKED = "bucket int, chunk long, kind int, one binary, two binary"
_NAMES = ["bucket", "chunk", "kind", "one", "two"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], _NAMES)


def _requests(rows: DataFrame, tokens_of, bits: int) -> DataFrame:
    """Tokens of chunks of distinct sets, cut by the first bits of their hash.

    _SENT: the next 32 bits and the set's place; _HEAVY: the same bits and the count in the chunk.  For the chunk itself
    pass _SETS, node and size by place, and _PAIRS, tokens sent as heavy and the places that have them.
    """
    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        nodes: dict[int, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def packed():
            each = np.array([len(h) for h in held], np.uint32)
            tokens, who = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint16), each)
            at = np.argsort(tokens)
            key, who = tokens[at] >> np.uint64(32 - bits), who[at]
            first = np.flatnonzero(np.concatenate([_FIRST, key[1:] != key[:-1]]))
            times = np.diff([*first, len(key)]).astype(np.uint32)
            heavy = np.repeat(times >= HEAVY, times)
            out = []

            def cut(kind, key, other):
                bucket = (key >> np.uint64(32)).astype(np.int64)
                edge = np.flatnonzero(np.concatenate([_FIRST, bucket[1:] != bucket[:-1]])) if len(key) else []
                for a, b in zip(edge, [*edge[1:], len(key)]):
                    out.append((int(bucket[a]), chunk, kind, key[a:b].astype(np.uint32).tobytes(), other[a:b].tobytes()))

            cut(_SENT, key[~heavy], who[~heavy])
            cut(_HEAVY, key[first[times >= HEAVY]], times[times >= HEAVY])
            own = hash(chunk) % (1 << bits)
            out.append((own, chunk, _SETS, np.fromiter(nodes, np.int64, len(nodes)).tobytes(), each.tobytes()))
            out.append((own, chunk, _PAIRS, key[heavy].tobytes(), who[heavy].tobytes()))
            return _batch(out)

        for batch in batches:
            for own, group, tokens in tokens_of(batch):
                if not len(tokens) or own in nodes:
                    continue
                nodes[own] = group
                held.append(_keyed(tokens, group))
                size += len(tokens)
                if size >= CHUNK or len(held) >= CHUNK_SETS:
                    yield packed()
                    nodes, held, size, chunk = {}, [], 0, chunk + 1
        if held:
            yield packed()

    return rows.mapInArrow(lean(run), _PACKED)


def _answers(batches):
    """For each bucket and chunk the tokens that occur again: _SENT: token, place and count class; _HEAVY: token and class."""
    for group in runs(batches, ["bucket"]):
        rows = list(zip(*(group[n].to_pylist() for n in _NAMES), strict=True))
        out = [r for r in rows if r[2] in (_SETS, _PAIRS)]
        asked = [r for r in rows if r[2] in (_SENT, _HEAVY)]
        if asked:
            keys = [np.frombuffer(r[3], np.uint32) for r in asked]
            times = [np.frombuffer(r[4], np.uint32) if r[2] == _HEAVY else np.ones(len(key), np.uint32) for r, key in zip(asked, keys, strict=True)]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(times))[at]
            end = 0
            for (bucket, chunk, kind, _, two), key in zip(asked, keys, strict=True):
                start, end = end, end + len(key)
                again = total[start:end] > 1
                if again.any():
                    level = np.log2(total[start:end][again]).astype(np.uint8)
                    who = np.frombuffer(two, np.uint16)[again].tobytes() if kind == _SENT else b""
                    full = key[again].astype(np.uint64) | (np.uint64(bucket) << np.uint64(32))
                    out.append((bucket, chunk, kind, full.tobytes(), who + level.tobytes()))
        yield _batch(out)


def _prefixes(order: int, percent: int):
    """Of each chunk: (token, a, b, linked): a the least node that has the prefix token; or a link of two of its nodes."""
    def run(batches):
        for group in runs(batches, ["chunk"]):
            rows = list(zip(*(group[n].to_pylist() for n in _NAMES), strict=True))
            of = {k: [r for r in rows if r[2] == k] for k in range(4)}
            node, size = np.frombuffer(of[_SETS][0][3], np.int64), np.frombuffer(of[_SETS][0][4], np.uint32).astype(np.int64)
            pair, pair_who = np.frombuffer(of[_PAIRS][0][3], np.uint64), np.frombuffer(of[_PAIRS][0][4], np.uint16)
            token, who, level = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
            for *_, one, two in of[_SENT]:
                n = len(one) // 8
                token.append(np.frombuffer(one, np.uint64)), who.append(np.frombuffer(two[:2 * n], np.uint16).astype(np.int64)), level.append(np.frombuffer(two[2 * n:], np.uint8))
            if len(pair):
                key = np.concatenate([np.frombuffer(r[3], np.uint64) for r in of[_HEAVY]])
                of_key = np.concatenate([np.frombuffer(r[4], np.uint8) for r in of[_HEAVY]])
                sort = np.argsort(key)
                token.append(pair), who.append(pair_who.astype(np.int64)), level.append(of_key[sort][np.searchsorted(key[sort], pair)])
            token, who, level = np.concatenate(token), np.concatenate(who), np.concatenate(level)
            sort = np.lexsort((mix(token ^ mix(np.array([order + 1], np.uint64))), level, who))
            token, who = token[sort], who[sort]
            repeated = np.bincount(who, minlength=len(node))
            place = np.arange(len(who)) - (np.cumsum(repeated) - repeated)[who]
            some = size - (percent * size + 99) // 100 + 1 - (size - repeated)  # tokens of one set only come first and link nothing
            taken = place < some[who]
            t, n = token[taken], node[who[taken]]
            if not len(t):
                continue
            sort = np.lexsort((n, t))
            t, n = t[sort], n[sort]
            first = np.flatnonzero(np.concatenate([_FIRST, t[1:] != t[:-1]]))
            least = np.repeat(n[first], np.diff([*first, len(t)]))
            a, b = n[n != least], least[n != least]
            if len(a):
                pairs = np.unique(np.stack([a, b], axis=1), axis=0)
                a, b = pairs[:, 0].copy(), pairs[:, 1].copy()
            tokens = np.concatenate([t[first], mix(a.view(np.uint64))])
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(np.concatenate([n[first], a])), pa.array(np.concatenate([np.zeros(len(first), np.int64), b])),
                                              pa.array(np.arange(len(tokens)) >= len(first))], ["token", "a", "b", "linked"])

    return run


def _stars(rows: DataFrame, tokens_of, order: int, percent: int, total: int) -> DataFrame:
    """Links (a, b) between nodes that share a prefix token in their class, as stars around the least node.

    tokens_of gives (node, class, tokens) for each row of a batch; total is the number of all tokens.
    """
    bits = max(10, int(np.ceil(np.log2(max(1, total / BUCKET)))))
    answered = (_requests(rows, tokens_of, bits).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_answers), _PACKED))
    found = answered.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lean(_prefixes(order, percent)), "token long, a long, b long, linked boolean")
    least = F.min("a").over(Window.partitionBy("token", "linked"))
    return found.select("a", F.when(F.col("linked"), F.col("b")).otherwise(least).alias("b")).filter("a <> b")


def _verified(blocks: DataFrame, percent: int) -> DataFrame:
    """(digest, root, n_links): for each set its links verified in a block pair, and a set that they reach."""
    def run(batches):
        for group in runs(batches, ["class", "_low", "_high"]):
            group = group.combine_chunks()
            digests, rows = np.unique(np.array(group["digest"].to_pylist(), dtype=object), return_index=True)
            if len(digests) < 2:
                continue
            own, cross = group["_own"].to_numpy()[rows], group["_low"][0].as_py() != group["_high"][0].as_py()
            times = group["times"].to_numpy()[rows]
            sets = [np.frombuffer(group["tokens"][int(i)].as_py(), np.uint64) for i in rows]
            size = np.array([len(s) for s in sets])
            _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = count > 1
            place = np.cumsum(shared) - 1
            who, use = np.repeat(np.arange(len(sets)), size), shared[column]
            who, column = who[use], place[column[use]]
            both = np.zeros((len(sets), len(sets)), np.float32)
            for start in range(0, int(shared.sum()), 4096):
                part = (column >= start) & (column < start + 4096)
                bits = np.zeros((len(sets), 4096), np.float32)
                bits[who[part], column[part] - start] = 1
                both += bits @ bits.T
            same = both.astype(np.int64)
            links = 100 * same >= percent * (size[:, None] + size[None, :] - same)
            np.fill_diagonal(links, False)
            if cross:
                links &= own[:, None] != own[None, :]
            n = links @ times
            root = roots(links)
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in some], pa.binary()), pa.array([digests[root[i]] for i in some], pa.binary()), pa.array(n[some], pa.int64())], ["digest", "root", "n_links"])

    keys = ["class", "_low", "_high"]
    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "digest binary, root binary, n_links long")


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, n_links.

    A document's set are its distinct shingles of k words (runs of other characters than ASCII blanks, A-Z lower-cased);
    with fewer words, the whole sequence.  Documents link when 100 * intersection >= percent * union; component_id is
    the least id that links reach, n_links the documents linked directly.  Texts that are null or have no words link
    with nothing and are their own component.  Rows that repeat an id are documents of their own; of a component of
    null ids only, the id is null, else nulls are passed over.  Shingles compare as 64-bit hashes.  Other columns of
    docs are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut_lineage(signatures(rows, k))
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0

    def of_texts(batch):
        for tokens in in_pieces(batch.column(0), k):
            if len(tokens):
                yield _node(tokens)[1], 0, tokens

    classes = components(_stars(rows.select("text"), of_texts, 0, percent, total))
    groups = cut_lineage(signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    candidates = cut_lineage(_with_node(groups).join(classes, "node").select("digest", "least", "times", "node", F.col("component").alias("class")))
    chosen = broadcast_if_small(candidates.select(F.col("least").alias("_least"), F.col("digest").alias("_digest"), "times", "node", "class"))

    def sets_of(batches):
        for batch in batches:
            tokens = list(in_pieces(batch.column(0), k))
            right = [_node(t)[0] == d if len(t) else False for t, d in zip(tokens, batch.column(1).to_pylist(), strict=True)]
            out = [batch.column(1), batch.column(2), batch.column(3), batch.column(4), pa.array([t.tobytes() for t in tokens], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["digest", "times", "node", "class", "tokens"]).filter(pa.array(right, pa.bool_()))

    sets = cut_lineage(rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_least"))).select("text", "_digest", "times", "node", "class")
                       .mapInArrow(lean(sets_of), "digest binary, times long, node long, class long, tokens binary"))

    def of_sets(batch):
        for own, group, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            yield own, group, np.frombuffer(tokens.as_py(), np.uint64)

    for order in range(1, orders):
        now = sets.select("node", "class", "tokens")
        total = now.agg(F.sum(F.octet_length("tokens") / 8)).first()[0] or 0
        finer = broadcast_if_small(components(_stars(now, of_sets, order, percent, total))).withColumnRenamed("component", "_class")
        sets = sets.join(finer, "node").drop("class").withColumnRenamed("_class", "class")
    blocks = in_block_pairs(sets, "class", F.xxhash64("digest"), BLOCK_ROWS, F.octet_length("tokens") / 8, BLOCK_TOKENS)
    verified = cut_lineage(_verified(blocks, percent))
    reached = components(verified.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    linked = (verified.groupBy("digest").agg(F.sum("n_links").alias("others")).join(reached.select(F.col("node").alias("digest"), "component"), "digest", "left"))
    of_group = cut_lineage(groups.join(linked, "digest", "left").withColumn("component", F.coalesce("component", "digest")))
    least = of_group.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = (of_group.join(least, "component").filter("times > 1 OR others IS NOT NULL")
              .select("digest", "component_id", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    known = broadcast_if_small(cut_lineage(answer))
    return signed.join(known, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _with_node(groups: DataFrame) -> DataFrame:
    """Add the node number: the first eight bytes of the digest as a signed number."""
    def run(batches):
        for batch in batches:
            node = [int.from_bytes(d[:8], "little", signed=True) for d in batch.column("digest").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], [*batch.schema.names, "node"])

    return groups.mapInArrow(lean(run), f"digest binary, least {groups.schema['least'].dataType.simpleString()}, times long, node long")


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the least of their component, all columns unchanged.

    Least is by id, null first, then by a hash of the text; of rows that repeat both one stays.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    found = jaccard_classes(docs.select(key.alias("_key"), F.col(text_col).alias("text")), k, percent, "_key", "text")
    gone = cut_lineage(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    rows = docs.select(whole_row(docs).alias("_row"), key.alias("_key"))
    kept = rows.join(broadcast_if_small(gone), F.col("_key") == F.col("_gone"), "left_anti").select("_row.*")
    return one_of_equal(kept, [key])
