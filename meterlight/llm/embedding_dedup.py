"""Near-duplicate vectors by lattice hashing: E8 cells, neighbouring cells probed, cosines verified.

Every vector is projected at random, in several tables, and the projections are decoded to points of
the lattice E8. A vector lives in one cell of each table and visits the nearest other cells. Two
vectors are compared where both meet in a cell that is home to at least one of them, and a pair that
meets more than once counts in the cell with the smallest key. Cells are compared in pairs of blocks
of bounded bytes, so that no task holds a large cell and no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.arrow_text import map_batches
from meterlight.llm.components import components
from meterlight.llm.lattice import Cells
from meterlight.llm.stored import stored
from meterlight.session import broadcast_rows

COSINE = 0.95
# A pair at 0.95 meets in one of the tables with a probability of about 0.998, one at 0.97 nearly always.
TABLES = 22
BLOCKS = 2
WIDTH = 0.17
PROBES = 4
BLOCK_BYTES = 4 << 20
CHUNK = 512


@lru_cache(maxsize=4)
def _cells(dim: int, tables: int, blocks: int, width: float) -> Cells:
    return Cells(dim, tables, blocks, width)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, not all zero, at length one; their size does not overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1)[:, None]
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def _read(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``id``, ``vector`` (bytes of doubles; null if it can have no links) and ``dim`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            numbers: list[bytes | None] = []
            for row, known in enumerate(batch.column(0).is_valid().to_pylist()):
                usable = known and column[row].is_valid and len(column[row].values)
                values = column[row].values.to_numpy(zero_copy_only=False) if usable else np.zeros(1)
                # A null component is a NaN here; adding zero turns -0.0 into 0.0.
                usable = np.isfinite(values).all() and values.any()
                numbers.append((values + 0.0).tobytes() if usable else None)
            sizes = pa.array([None if n is None else len(n) // 8 for n in numbers], pa.int32())
            columns = [batch.column(0), pa.array(numbers, pa.binary()), sizes]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "dim"])

    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    schema = f"id {vectors.schema[id].dataType.simpleString()}, vector binary, dim int"
    return map_batches(rows, run, schema)


def _matrices(batch: pa.RecordBatch, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of the rows of one dimension after another."""
    sizes = pc.binary_length(batch.column(vector)).to_numpy(zero_copy_only=False) // 8
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        for some in np.array_split(rows, max(1, len(rows) // 256)):
            data = b"".join(batch.column(vector).take(pa.array(some)).to_pylist())
            yield some, unit_rows(np.frombuffer(data, np.float64).reshape(-1, dim))


def _with_codes(classes: DataFrame, tables: int, blocks: int, width: float, probes: int) -> DataFrame:
    """The classes with ``own`` (keys of their cells) and ``steps`` (to the cells they visit), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[bytes] = [b""] * batch.num_rows
            steps: list[bytes] = [b""] * batch.num_rows
            for rows, units in _matrices(batch, "vector"):
                keys, to = _cells(units.shape[1], tables, blocks, width).keys(units, probes)
                for row, key, step in zip(rows.tolist(), keys, to, strict=True):
                    own[row], steps[row] = key.tobytes(), step.tobytes()
            columns = [*batch.columns, pa.array(own, pa.binary()), pa.array(steps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "own", "steps"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return map_batches(classes, run, f"{schema}, own binary, steps binary")


def _meetings(classes: DataFrame, tables: int, blocks: int, width: float, probes: int) -> DataFrame:
    """``key``, ``node`` and ``home``: the cells in which each class lives (home) or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if not len(rows):
                    continue
                taken = pa.array(rows)
                own = np.frombuffer(b"".join(batch.column(2).take(taken).to_pylist()), np.int64)
                steps = np.frombuffer(b"".join(batch.column(3).take(taken).to_pylist()), np.int16)
                cells = _cells(int(dim), tables, blocks, width)
                own = own.reshape(len(rows), tables, 1)
                visited = own + cells.steps[steps.reshape(len(rows), tables, probes)]
                keys = np.concatenate([own, visited], axis=2)
                home = np.zeros(keys.shape, bool)
                home[:, :, 0] = True
                # Cells of other dimensions are others.
                keys = keys ^ np.int64(int(dim) << 32)
                columns = [
                    pa.array(keys.ravel()),
                    pa.array(np.repeat(nodes[rows], tables * (probes + 1))),
                    pa.array(home.ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "home"])

    return map_batches(
        classes.select("node", "dim", "own", "steps"), run, "key long, node long, home boolean"
    )


def _shared_cells(meetings: DataFrame) -> DataFrame:
    """``key`` and ``n`` of cells with two members or more, home to one at least.

    Of cells with the same members and the same homes the one with the smallest key is enough: a
    pair that meets in all of them counts there.
    """

    def members(seed: int, which: F.Column) -> F.Column:
        return F.bit_xor(F.when(which, F.xxhash64("node", F.lit(seed))).otherwise(0))

    always = F.lit(True)
    cells = meetings.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("home").alias("homes"),
        members(1, always).alias("all1"),
        members(2, always).alias("all2"),
        members(1, F.col("home")).alias("home1"),
        members(2, F.col("home")).alias("home2"),
    )
    same = ["n", "homes", "all1", "all2", "home1", "home2"]
    cells = cells.where("n > 1 AND homes > 0")
    return cells.groupBy(*same).agg(F.min("key").alias("key")).select("key", "n")


class _Members:
    """The vectors of one pair of blocks of a cell."""

    def __init__(self, rows: list[tuple], dim: int, tables: int, probes: int, steps: np.ndarray) -> None:
        node, home, copies, block, vector, own, step = zip(*rows, strict=True)
        self.node, self.home = np.array(node, np.int64), np.array(home, bool)
        self.copies, self.block = np.array(copies, np.int64), np.array(block)
        self.units = unit_rows(np.frombuffer(b"".join(vector), np.float64).reshape(-1, dim))
        own_keys = np.frombuffer(b"".join(own), np.int64).reshape(-1, tables)
        to = np.frombuffer(b"".join(step), np.int16).reshape(-1, tables, probes)
        self.visited = (own_keys[:, :, None] + steps[to]) ^ np.int64(dim << 32)
        self.own = own_keys ^ np.int64(dim << 32)


def first_meetings(held: _Members, a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Which pairs meet in no cell with a smaller key, where one of them is at home."""
    left = np.arange(len(a))
    for table in range(held.own.shape[1]):
        own_a, own_b = held.own[a[left], table], held.own[b[left], table]
        same = own_a == own_b
        at_a = same | (held.visited[b[left], table] == own_a[:, None]).any(axis=1)
        at_b = same | (held.visited[a[left], table] == own_b[:, None]).any(axis=1)
        left = left[~((at_a & (own_a < key)) | (at_b & (own_b < key)))]
    return left


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per place the smallest place that links lead to."""
    root = np.arange(count)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _compared(
    dealt: DataFrame, cosine: float, tables: int, blocks: int, width: float, probes: int
) -> DataFrame:
    """``node``, ``links`` (vectors linked to it) and ``root`` per node and pair of blocks of a cell."""

    def compare(group: tuple, rows: list[tuple]) -> pa.RecordBatch:
        key, i, j, dim = group
        held = _Members(rows, dim, tables, probes, _cells(dim, tables, blocks, width).steps)
        left = np.flatnonzero(held.block == i)
        right = left if i == j else np.flatnonzero(held.block == j)
        links = np.zeros(len(held.node), np.int64)
        found_a, found_b = [], []
        root = np.arange(len(held.node))
        for at in range(0, len(left), CHUNK):
            some = left[at : at + CHUNK]
            close = held.units[some] @ held.units[right].T >= cosine
            close &= held.home[some][:, None] | held.home[right][None, :]
            if i == j:
                close &= np.arange(len(right))[None, :] > np.arange(at, at + len(some))[:, None]
            a, b = np.nonzero(close)
            a, b = some[a], right[b]
            first = first_meetings(held, a, b, key)
            a, b = a[first], b[first]
            np.add.at(links, a, held.copies[b])
            np.add.at(links, b, held.copies[a])
            # A spanning set of the links is enough for components.
            root = _roots(len(root), np.concatenate([np.arange(len(root)), a]), np.concatenate([root, b]))
        held_rows = links > 0
        columns = [held.node[held_rows], links[held_rows], held.node[root[held_rows]]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], names=["node", "links", "root"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for *now, node, home, copies, block, vector, own, steps in zip(
                *(batch.column(k).to_pylist() for k in range(11)), strict=True
            ):
                if now != group:
                    if len(rows) > 1:
                        yield compare(tuple(group), rows)
                    group, rows = now, []
                rows.append((node, home, copies, block, vector, own, steps))
        if len(rows) > 1:
            yield compare(tuple(group), rows)

    return map_batches(dealt, run, "node long, links long, root long")


def near_vectors(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    cosine: float = COSINE,
    tables: int = TABLES,
    blocks: int = BLOCKS,
    width: float = WIDTH,
    probes: int = PROBES,
) -> DataFrame:
    """One row per row of ``vectors``: the id, n_links, component_id and kept.

    Two vectors are linked if they were found and their cosine, in double precision, is at least
    ``cosine``; none below it is. ``component_id`` is the smallest id that links lead to and
    ``kept`` says whether it is the row's own. Vectors that are null, empty, zero, or hold a null
    or a number that is not finite link with nothing; vectors of different lengths do not link with
    each other. Equal vectors are one class: they link with each other and share all links. A row
    without an id has no links and no component, and is kept. Rows that repeat an id take part with
    each of their vectors. An empty table gives an empty result. Only the columns ``id`` and
    ``vector`` are read.

    Cells of a smaller ``width``, or of more ``blocks``, hold fewer strangers and need more
    ``tables``: suit them to the number of vectors. Every link found is counted exactly once,
    however many cells and tasks its pair meets in. Building the result runs jobs whose
    intermediate tables are stored in the shared folder.
    """
    rows = stored(_read(vectors, id, vector), "vectors")
    classes = rows.where("vector IS NOT NULL").groupBy("vector", "dim").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    # Stored once with its numbers, which would differ if it were computed again.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    coded = classes.select("node", "dim", "copies", "vector")
    coded = stored(_with_codes(coded, tables, blocks, width, probes), "vector-codes")
    meetings = _meetings(coded, tables, blocks, width, probes)
    cells = stored(_shared_cells(meetings), "cells")
    held = meetings.join(broadcast_rows(cells, cells.count()), "key")
    # A row's bytes bound the members of a block; blocks of a cell are compared in pairs.
    row_bytes = F.col("dim") * 8 + tables * (8 + 8 * probes) + 100
    placed = (
        held.join(coded, "node")
        .withColumn("blocks", F.ceil(F.col("n") * row_bytes / BLOCK_BYTES).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "dim", "node", "home", "copies", "block", "vector", "own", "steps",
        )
    )
    group = ["key", "i", "j", "dim"]
    dealt = placed.repartition(*group).sortWithinPartitions(*group)
    found = stored(_compared(dealt, cosine, tables, blocks, width, probes), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "root"))
    info = classes.select("vector", "node", "first", "copies").join(links, "node", "left")
    info = info.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = info.groupBy("root").agg(F.min("first").alias("component"))
    info = info.join(firsts, "root").select(
        "vector", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    linked = rows.where("vector IS NOT NULL").join(stored(info, "vector-components"), "vector")
    alone = rows.where("vector IS NULL").select(
        "id", F.col("id").alias("component"), F.lit(0).cast("long").alias("links")
    )
    return linked.select("id", "component", "links").union(alone).select(
        F.col("id").alias(id),
        F.col("links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
