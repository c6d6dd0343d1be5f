"""Near-duplicate vectors by lattice hashing.

In each of several tables a random projection takes a unit vector to eight dimensions, where it is decoded to the nearest
point of the E8 lattice, its cell; the next nearest points are probed beside it.  Vectors that meet in a cell are compared
by cosine in double precision.  Equal vectors are one.  A cell is compared in blocks, which bound a task whatever the
size of the cell, and a block gives sums and a spanning forest instead of its links.  A pair that meets more than once
counts in its first meeting only.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.jaccard_join import mix
from accesslens.llm.support import broadcast_if_small, components, in_block_pairs, roots, runs
from accesslens.session import cut_lineage

#: Tables, probed cells beside the own one, and the scale of the projection against the lattice.
TABLES, PROBES, SCALE = 8, 2, 0.9
BLOCK_ROWS = 1024


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of one, or all of one half with an even number of minus signs."""
    ones = [[a if k == i else b if k == j else 0.0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*ones, *halves])


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest whole points of even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    off = y[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points: whole points of even sum, or those moved by one half everywhere."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def _code(points: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit number for each lattice point of a table."""
    out = np.full(points.shape[:-1], table + 1, np.uint64)
    for i in range(8):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.rint(2 * points[..., i]).astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 11) -> np.ndarray:
    """For each unit vector its cell and its probed cells in each table: rows x tables x (1 + probes)."""
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    steps = neighbours()
    for t in range(tables):
        y = unit @ (np.random.default_rng([seed, t]).normal(size=(unit.shape[1], 8)) * scale)
        own = decode(y)
        order = np.argsort(-((y - own) @ steps.T), axis=1, kind="stable")[:, :probes]
        out[:, t] = _code(np.concatenate([own[:, None], own[:, None] + steps[order]], axis=1), t)
    return out


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors can link, and those as unit vectors in double precision (lengths may differ)."""
    good, out = np.zeros(len(column), bool), []
    for i, item in enumerate(column):
        values = item.values
        if values is None or values.null_count or not len(values):
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(v).all() or not v.any():
            continue
        v = v / np.abs(v).max()
        good[i] = True
        out.append(v / np.sqrt(v @ v))
    return good, out


def _signed(rows: DataFrame, keep: str = "vec_id") -> DataFrame:
    """The column keep and digest: the digest of the unit vector, null if it can't link."""
    def run(batches):
        for batch in batches:
            good, units = unit_vectors(batch.column(1))
            digest = np.full(batch.num_rows, None, object)
            digest[good] = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(digest), pa.binary())], [keep, "digest"])

    return rows.select(keep, "embedding").mapInArrow(run, f"{keep} {rows.schema[keep].dataType.simpleString()}, digest binary")


def _placed(rows: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """(cell, tab, probe, digest, times, unit, all_cells): each vector in its own and its probed cells."""
    width = 1 + probes
    names = ["cell", "tab", "probe", "digest", "times", "unit", "all_cells"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                good, units = unit_vectors(piece.column(0))
                for length in {len(u) for u in units}:
                    own = [j for j, u in enumerate(units) if len(u) == length]
                    unit = np.vstack([units[j] for j in own])
                    pick = pa.array(np.flatnonzero(good)[own])
                    where = cells(unit, tables, probes, scale)
                    n, each = len(unit), tables * width
                    again = pa.array(np.repeat(np.arange(n), each))
                    digest, times = (piece.column(c).take(pick).take(again) for c in (1, 2))
                    tab = np.tile(np.repeat(np.arange(tables), width), n).astype(np.int32)
                    probe = np.tile(np.arange(width) > 0, n * tables)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(where.reshape(-1) ^ length), pa.array(tab), pa.array(probe), digest, times, pa.array([u.tobytes() for u in unit], pa.binary()).take(again),
                        pa.array([c.tobytes() for c in where], pa.binary()).take(again)], names)

    return rows.mapInArrow(run, "cell long, tab int, probe boolean, digest binary, times long, unit binary, all_cells binary")


def _met_before(a: np.ndarray, b: np.ndarray, tab: int) -> np.ndarray:
    """Whether two rows of cells meet in a table before tab."""
    return (((a[:, :tab, :1] == b[:, :tab]).any(axis=2)) | ((b[:, :tab, :1] == a[:, :tab]).any(axis=2))).any(axis=1)


def _verified(blocks: DataFrame, least: float, tables: int, width: int) -> DataFrame:
    """(digest, root, n_links): the links of each vector that are counted in a block pair, and a vector they reach."""
    def run(batches):
        for group in runs(batches, ["cell", "_low", "_high"]):
            if len(group) < 2:
                continue
            group = group.combine_chunks()
            digests, rows = np.unique(np.array(group["digest"].to_pylist(), dtype=object), return_index=True)
            probe, own = group["probe"].to_numpy(zero_copy_only=False)[rows], group["_own"].to_numpy()[rows]
            if probe.all() or len(digests) < 2:
                continue
            tab, cross = group["tab"][0].as_py(), group["_low"][0].as_py() != group["_high"][0].as_py()
            times = group["times"].to_numpy()[rows]
            units, codes = group["unit"].to_pylist(), group["all_cells"].to_pylist()
            unit = np.vstack([np.frombuffer(units[i], np.float64) for i in rows])
            code = np.stack([np.frombuffer(codes[i], np.int64).reshape(tables, width) for i in rows])
            links = unit @ unit.T >= least
            np.fill_diagonal(links, False)
            links &= ~(probe[:, None] & probe[None, :])
            if cross:
                links &= own[:, None] != own[None, :]
            if not links.any():
                continue
            root = roots(links)
            i, j = np.nonzero(np.triu(links))
            counted = np.zeros(len(digests), np.int64)
            for at in range(0, len(i), 1 << 15):
                x, y = i[at:at + (1 << 15)], j[at:at + (1 << 15)]
                a, b = code[x], code[y]
                new = ~_met_before(a, b, tab)
                # a vector that probes the other's cell may be probed by it too: they count in the lesser of the two cells
                own_a, own_b = a[:, tab, 0], b[:, tab, 0]
                both = (own_a != own_b) & (a[:, tab] == own_b[:, None]).any(axis=1) & (b[:, tab] == own_a[:, None]).any(axis=1)
                here = np.where(probe[y], own_a, own_b)
                new &= ~both | (here == np.minimum(own_a, own_b))
                np.add.at(counted, x[new], times[y[new]])
                np.add.at(counted, y[new], times[x[new]])
            some = np.flatnonzero(links.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([digests[k] for k in some], pa.binary()), pa.array([digests[root[k]] for k in some], pa.binary()), pa.array(counted[some], pa.int64())], ["digest", "root", "n_links"])

    keys = ["cell", "_low", "_high"]
    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "digest binary, root binary, n_links long")


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Links join vectors of cosine `least` or more that meet in a cell.  Null, empty and zero vectors and those with null
    or non-finite components link with nothing and are their own component; vectors of different lengths never link.
    Rows that repeat an id are vectors of their own; of a component of null ids only, the id is null, else nulls are
    passed over.  Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    signed = cut_lineage(_signed(rows))
    groups = cut_lineage(signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("times")))
    one = cut_lineage(_signed(rows.select(F.col("embedding").alias("vector"), "embedding"), "vector").filter("digest IS NOT NULL")
                      .groupBy("digest").agg(F.any_value("vector").alias("vector"), F.count("*").alias("times")).select("vector", "digest", "times"))
    blocks = in_block_pairs(_placed(one, tables, probes, scale), "cell", F.xxhash64("digest"), BLOCK_ROWS)
    verified = cut_lineage(_verified(blocks, least, tables, 1 + probes))
    reached = components(verified.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    linked = verified.groupBy("digest").agg(F.sum("n_links").alias("others")).join(reached.select(F.col("node").alias("digest"), "component"), "digest", "left")
    of_group = cut_lineage(groups.join(linked, "digest", "left").withColumn("component", F.coalesce("component", "digest")))
    smallest = of_group.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = (of_group.join(smallest, "component").filter("times > 1 OR others IS NOT NULL")
              .select("digest", "component_id", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    known = broadcast_if_small(cut_lineage(answer))
    found = signed.join(known, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
