"""N-gram Jaccard join: MinHash candidates, pruned by their posterior, then verified exactly.

Documents with the same set of shingles are one class. Classes that agree in a band of MinHash
values are candidates; bands are set so that a pair at the threshold is missed less than once in a
million times. Candidates meet in groups, split into pairs of blocks of bounded size. Within one,
MinHash values are compared some at a time, and a pair is dropped as soon as the probability that it
reaches the threshold, given the values compared, falls below the tolerance. All others are verified
by the exact Jaccard similarity of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.arrow_text import chain, hash_spans, map_batches, parts, shingles, spread, words
from meterlight.llm.components import components
from meterlight.llm.stored import free_name, stored
from meterlight.session import broadcast_rows

THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS = 40
BAND_VALUES = 5
BAND_MASK = 63
VALUES = BANDS * BAND_VALUES
STEP_VALUES = 20
BLOCK = 512
WHOLE_GROUP = 8192

_MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 31, VALUES, dtype=np.uint32) * 2 + 1
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """Per number of compared values: how many must agree for a pair to stay.

    With an even prior the similarity after ``m`` of ``n`` values agree follows a beta
    distribution; the chance that it reaches the threshold is the binomial tail
    P(Bin(n + 1, threshold) <= m).
    """
    needed = np.zeros(VALUES + 1, np.int64)
    for n in range(1, VALUES + 1):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                needed[n] = m
                break
    return needed


def text_shingles(column: pa.Array) -> list[np.ndarray]:
    """Per text its distinct shingle hashes, sorted."""
    data, _, begins, ends, first = words(column)
    hashes = hash_spans(data, begins, ends)
    return [np.unique(shingles(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]


def min_values(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash values of non-empty sets, one row per set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), VALUES), np.uint32)
    for k, multiplier in enumerate(_MULTIPLIERS):
        out[:, k] = np.minimum.reduceat(flat * multiplier, first)
    return out


def _set_hash(one: np.ndarray) -> tuple[int, int]:
    first = chain(one, 1)
    second = (one + _B) * _A
    second ^= second >> np.uint64(32)
    second *= _B
    return int(first.sum().view(np.int64)), int(second.sum().view(np.int64))


def _signed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Per document: the size of its shingle set, two hashes of the set, and its bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text"):
                sets = text_shingles(part.column(1))
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    values = min_values([sets[k] for k in full]).astype(np.uint64)
                    bands = values.reshape(len(full), BANDS, BAND_VALUES)
                    mixed = np.zeros(bands.shape[:2], np.uint64)
                    for k in range(BAND_VALUES):
                        mixed = (mixed ^ bands[:, :, k]) * _A
                        mixed ^= mixed >> np.uint64(29)
                    mixed = (mixed & ~np.uint64(BAND_MASK)) | np.arange(BANDS, dtype=np.uint64)
                    for row, key in zip(full, mixed.view(np.int64), strict=True):
                        keys[row] = key
                hashes = [_set_hash(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([h for h, _ in hashes], pa.int64()),
                        pa.array([h for _, h in hashes], pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc", "size", "one", "two", "keys"],
                )

    rows = docs.where(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("_id"), F.col(text).alias("_text")
    )
    schema = "doc long, size long, one long, two long, keys array<long>"
    return map_batches(rows, run, schema)


def _candidates(classes: DataFrame) -> DataFrame:
    """``node``, ``rep``, ``grp``, ``band`` and ``n``: the groups in which classes are compared.

    Buckets with the same members are one. Classes joined by buckets form a component, and a
    component of up to ``WHOLE_GROUP`` classes is dealt out as one group (band -1). In larger ones,
    which chance collisions could build at any size, each bucket is a group of its own. That is
    about where pairs meet only: at every size the pairs that agree in a band are compared, each in
    one place (see ``linked_pairs``).
    """
    # A key holds its band in the lowest bits, so that a row is two longs.
    in_bucket = classes.select("node", F.explode("keys").alias("key"))
    buckets = in_bucket.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("node").alias("low"),
        F.bit_xor(F.xxhash64("node")).alias("members"),
    )
    first = F.min(F.struct(F.col("key").bitwiseAND(BAND_MASK).alias("band"), "key")).alias("b")
    buckets = (
        buckets.where("n > 1")
        .groupBy("n", "low", "members")
        .agg(first)
        .select(F.col("b.band").cast("int").alias("band"), "b.key", "n", "low")
    )
    buckets = stored(buckets, "buckets")
    held = in_bucket.join(broadcast_rows(buckets, buckets.count()), "key")
    held = stored(held, "bucket-members")
    roots = components(held.select("node", "low"))
    nodes = held.select("node").distinct().join(roots, "node", "left")
    nodes = nodes.select("node", F.coalesce("root", "node").alias("root"))
    sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = stored(nodes, "candidates").join(stored(sizes, "candidate-sizes"), "root")
    placed = stored(placed, "placed")
    whole = placed.where(F.col("n") <= WHOLE_GROUP).select(
        "node", F.col("root").alias("grp"), F.lit(-1).alias("band"), "n"
    )
    large = placed.where(F.col("n") > WHOLE_GROUP).select("node")
    single = held.join(large, "node").select(
        "node", F.col("key").alias("grp"), "band", "n"
    )
    return whole.union(single)


def _agreeing(values: np.ndarray, other: np.ndarray, last: int, first: int = 0) -> np.ndarray:
    """Whether two rows of values agree in one of the bands before ``last``, from ``first`` on."""
    seen = np.zeros(len(values), bool)
    for k in range(first, last):
        cut = slice(k * BAND_VALUES, (k + 1) * BAND_VALUES)
        seen |= (values[:, cut] == other[:, cut]).all(axis=1)
    return seen


def linked_pairs(
    sets: list[np.ndarray],
    left: np.ndarray,
    right: np.ndarray,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    band: int = -1,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of ``left`` and ``right`` (both places in ``sets``) at or above the threshold.

    With ``left`` and ``right`` the same, each unordered pair comes once. Only pairs that agree in a
    band can be linked: in any band if ``band`` is negative, else in ``band`` and in none before it.
    """
    none = np.zeros(0, np.int64)
    if not len(left) or not len(right):
        return none, none
    values = min_values(sets)
    size = np.array([len(s) for s in sets])
    small = np.minimum(size[left][:, None], size[right][None, :])
    open_pairs = small >= threshold * np.maximum(size[left][:, None], size[right][None, :])
    if left is right:
        open_pairs &= np.triu(np.ones(open_pairs.shape, bool), 1)
    a, b = np.nonzero(open_pairs)
    a, b = left[a], right[b]
    needed = least_matches(threshold, tolerance)
    matches = np.zeros(len(a), np.int64)
    for at in range(0, VALUES, STEP_VALUES):
        cut = slice(at, at + STEP_VALUES)
        for piece in range(0, len(a), 1 << 18):
            rows = slice(piece, piece + (1 << 18))
            matches[rows] += (values[a[rows], cut] == values[b[rows], cut]).sum(axis=1)
        stay = matches >= needed[at + STEP_VALUES]
        a, b, matches = a[stay], b[stay], matches[stay]
    if band < 0:
        meets = _agreeing(values[a], values[b], BANDS)
    else:
        meets = _agreeing(values[a], values[b], band + 1, band)
        meets &= ~_agreeing(values[a], values[b], band)
    a, b = a[meets], b[meets]
    if not len(a):
        return none, none
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    marked = np.zeros(int(flat.max()) + 1, bool)
    shared = np.zeros(len(a), np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.diff(a)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(a)], strict=True):
        own = flat[starts[a[low]] : starts[a[low]] + size[a[low]]]
        marked[own] = True
        for some in range(low, high, 64):
            others = b[some : min(high, some + 64)]
            hits = marked[flat[spread(starts[others], size[others])]]
            first = np.cumsum(size[others]) - size[others]
            shared[some : some + len(others)] = np.add.reduceat(hits.astype(np.int64), first)
        marked[own] = False
    linked = shared >= threshold * (size[a] + size[b] - shared) - 1e-9
    return a[linked], b[linked]


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per place the smallest place that links lead to."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _compared(groups: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``node``, ``links`` and ``root`` (a node it leads to) per node and pair of blocks."""

    def compare(key: tuple, rows: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        _, i, j, band = key
        nodes = np.array(sorted(rows), np.int64)
        block = np.array([rows[node][0] for node in nodes.tolist()])
        sets = [rows[node][1] for node in nodes.tolist()]
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        a, b = linked_pairs(sets, left, right, threshold, tolerance, band)
        links = np.bincount(np.concatenate([a, b]), minlength=len(nodes))
        root = nodes[_roots(len(nodes), a, b)]
        held = links > 0
        columns = [pa.array(nodes[held]), pa.array(links[held]), pa.array(root[held])]
        return pa.RecordBatch.from_arrays(columns, names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for grp, i, j, band, block, node, shingle in zip(
                *columns, batch.column(6), strict=True
            ):
                if (grp, i, j, band) != key:
                    if len(rows) > 1:
                        yield compare(key, rows)
                    key, rows = (grp, i, j, band), {}
                rows[node] = (block, np.frombuffer(shingle.as_buffer(), np.uint64))
        if len(rows) > 1:
            yield compare(key, rows)

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    spreadout = (
        groups.withColumn("blocks", blocks)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "grp",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "band",
            "block",
            "node",
            "shingles",
        )
    )
    keys = ["grp", "i", "j", "band"]
    dealt = spreadout.repartition(*keys).sortWithinPartitions(*keys)
    return map_batches(dealt, run, "node long, links long, root long")


def _with_shingles(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """``node`` and its shingles, for the classes of ``wanted`` (node, rep, one, two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text"):
                sets = text_shingles(part.column(0))
                known = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                same = [_set_hash(s) == pair for s, pair in zip(sets, known, strict=True)]
                rows = [k for k, ok in enumerate(same) if ok]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1).take(pa.array(rows, pa.int64())),
                        pa.array([sets[k].tobytes() for k in rows], pa.binary()),
                    ],
                    names=["node", "shingles"],
                )

    rows = docs.select(F.col(id).cast("long").alias("rep"), F.col(text).alias("_text"))
    found = rows.join(wanted, "rep").select("_text", "node", "one", "two")
    return map_batches(found, run, "node long, shingles binary")


def jaccard_join(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per row of ``docs``: the id, class_id, n_links, copy_of and n_copies.

    Documents with equal shingle sets are copies: ``copy_of`` is the smallest id among them and
    ``n_copies`` their number. ``n_links`` counts the other shingle sets with a similarity at or
    above the threshold, and ``class_id`` is the smallest id that links and copies lead to.

    Null and empty texts, and texts without a word, are like nothing else: their own class, no
    links. A row without an id gets no class and no links. Rows that repeat an id take part with
    each of their texts, and repeated rows with one text are copies. An empty table gives an empty
    result. Only ``id`` (a number) and ``text`` are read. Building the result runs jobs whose narrow
    intermediate tables are stored in the shared folder.
    """
    signed = stored(_signed(docs, id, text), "signed")
    by_set = ["size", "one", "two"]
    classes = (
        signed.where("size > 0")
        .groupBy(*by_set)
        .agg(
            F.min("doc").alias("rep"),
            F.count(F.lit(1)).alias("copies"),
            F.min_by("keys", "doc").alias("keys"),
        )
        .withColumn("node", F.xxhash64(*by_set))
    )
    classes = stored(classes, "classes")
    groups = stored(_candidates(classes), "groups")
    members = groups.select("node").distinct().join(classes, "node")
    wanted = stored(members.select("node", "rep", "one", "two"), "wanted")
    texts = _with_shingles(docs, broadcast_rows(wanted, wanted.count()), id, text)
    found = stored(_compared(groups.join(texts, "node"), threshold, tolerance), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "root"))
    info = classes.select("node", *by_set, "rep", "copies").join(links, "node", "left")
    info = info.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = info.groupBy("root").agg(F.min("rep").alias("first"))
    info = stored(stored(info, "linked").join(stored(firsts, "firsts"), "root"), "classes-linked")
    rows = signed.select("doc", *by_set).join(
        info.select(*by_set, "rep", "copies", "links", "first"), by_set, "left"
    )
    with_id = rows.select(
        F.col("doc").alias(id),
        F.coalesce("first", "doc").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("rep", "doc").alias("copy_of"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )
    none = F.lit(None).cast("long")
    without = docs.where(F.col(id).isNull()).select(
        none.alias(id), none.alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        none.alias("copy_of"), F.lit(1).cast("long").alias("n_copies"),
    )
    return with_id.union(without)


def one_per_class(
    docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows whose id is their class's smallest, or null, with all their columns.

    Where several texts share an id, they all stay if one of them is its class's first.
    """
    name = free_name(docs, "_gone")
    joined = jaccard_join(docs, id, text, threshold)
    others = F.bool_and(F.col(id) != F.col("class_id")).alias("_others")
    gone = joined.where(F.col(id).isNotNull()).groupBy(F.col(id).alias(name)).agg(others)
    gone = gone.where("_others").select(name)
    return docs.join(gone, F.col(id) == F.col(name), "left_anti")
