"""Benchmark decontamination: SimHash windows sized by the items, then exact similarity.

Every window of an item that is as long as the item's size class gives a fingerprint; a text's
windows of that length are fingerprinted at every ``step`` words. Fingerprints are cut into four
blocks, each with a table of its own: two fingerprints within a Hamming distance of three agree in
at least one block, so no such pair is missed. A candidate fixes where the item would begin; there,
and some words around, windows of the item's own length are compared exactly.

A window is at most a third of its item, but four words (or the whole item, if that has fewer). A
step is at most a half of a window, and small enough for one text window to lie within a verbatim
copy of the shortest item wherever that begins: items as long as their window need a step of one
word. A text window with a similarity of 0.8 keeps so long a run of the item's words (all of an item
up to twelve words, half of a short item, 29 words of a long one) that one text window lies within
it, and so has the fingerprint of an item's window.

Items that share a phrase share fingerprints. Each fingerprint is kept once with the items that have
it, and an item is compared in a text only if the text holds one of the item's *probes*: its rarest
shingles, so many that what is left would not reach the threshold.

The items are indexed in blocks of bounded size, each in a file that executors map into memory; a
text's windows are fingerprinted once and looked up in all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.llm.array_file import received_arrays, send_arrays
from meterlight.llm.arrow_text import (
    SHINGLE_WORDS,
    chain,
    hash_spans,
    map_batches,
    parts,
    spread,
    words,
)

THRESHOLD = 0.8
RADIUS = 3
BLOCKS = 4
WINDOWS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20)
# A block of items ends at so many items or bytes of text.
ITEMS_AT_ONCE = 20_000
ITEM_BYTES = 8 << 20
TEXT_BYTES = 4 << 20
CHUNK_WORDS = 50_000

_BLOCK_BITS = 64 // BLOCKS
_BLOCK_MASK = np.uint64((1 << _BLOCK_BITS) - 1)
_NONE = np.zeros(0, np.int64)
_SLACK = 1e-9


@dataclass
class ItemIndex:
    """The distinct fingerprints of the items' windows of one length, with a table per block."""

    window: int
    shortest: int  # how many words its shortest item has
    prints: np.ndarray
    first: np.ndarray  # where each fingerprint's windows begin in ``items`` and ``offsets``
    items: np.ndarray  # of each window: the item's place
    offsets: np.ndarray  # and where in the item the window begins
    starts: np.ndarray  # per block: where each value's fingerprints begin in ``order``
    order: np.ndarray

    @property
    def step(self) -> int:
        return max(1, min(self.window // 2, self.shortest - self.window + 1))


_INDEX_ARRAYS = ("prints", "first", "items", "offsets", "starts", "order")


@dataclass
class Items:
    """A block of items: their ids, sizes, distinct shingles and probes, and the indexes."""

    ids: pa.Array
    words: np.ndarray  # how many words each has
    first: np.ndarray  # where each item's shingles begin
    shingles: np.ndarray  # the distinct ones of each item, sorted
    often: np.ndarray  # how often each occurs in its item
    probe_first: np.ndarray
    probes: np.ndarray
    indexes: list[ItemIndex]

    def arrays(self) -> dict[str, np.ndarray]:
        """All of it as named arrays, for a file."""
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([self.ids], names=["id"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        names = ("words", "first", "shingles", "often", "probe_first", "probes")
        named = {name: getattr(self, name) for name in names}
        named["ids"] = np.frombuffer(sink.getvalue(), np.uint8)
        sizes = [(index.window, index.shortest) for index in self.indexes]
        named["windows"] = np.array(sizes, np.int64).reshape(-1, 2)
        for index in self.indexes:
            named |= {f"{name}-{index.window}": getattr(index, name) for name in _INDEX_ARRAYS}
        return named


def items_of(named: dict[str, np.ndarray]) -> Items:
    """The block whose arrays these are."""
    indexes = [
        ItemIndex(window, shortest, *(named[f"{name}-{window}"] for name in _INDEX_ARRAYS))
        for window, shortest in named["windows"].tolist()
    ]
    with pa.ipc.open_stream(pa.py_buffer(named["ids"])) as stream:
        ids = stream.read_all().column(0).combine_chunks()
    names = ("words", "first", "shingles", "often", "probe_first", "probes")
    return Items(ids, *(named[name] for name in names), indexes)


def window_of(count: int) -> int:
    """The window length for items of ``count`` words: up to a third, but four words if there are."""
    wanted = max(min(count, 4), count // 3)
    return max(size for size in WINDOWS if size <= wanted)


def bit_totals(hashes: np.ndarray, pair: int) -> np.ndarray:
    """Before each feature, how often each of its 64 bits was set so far, modulo 256.

    Features are the hashes of word pairs, or of single words for windows of one word. Windows are
    shorter than 256 words, so that differences of the totals are exact.
    """
    features = chain(hashes, pair)
    bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((len(features) + 1, 64), np.uint8)
    np.cumsum(bits, axis=0, dtype=np.uint8, out=total[1:])
    return total


def fingerprints(total: np.ndarray, begins: np.ndarray, window: int) -> np.ndarray:
    """SimHash of the ``window`` words from each begin: the majority of the features' bits."""
    count = window - _pair(window) + 1
    out = np.empty(len(begins), np.uint64)
    for at in range(0, len(begins), 1 << 13):
        some = begins[at : at + (1 << 13)]
        ones = total.take(some + count, axis=0) - total.take(some, axis=0)
        out[at : at + len(some)] = np.packbits(ones > count // 2, axis=1).view(np.uint64)[:, 0]
    return out


def _pair(window: int) -> int:
    return min(2, window)


def _item_index(window: int, rows: Sequence[tuple[int, np.ndarray]]) -> ItemIndex:
    prints, items, offsets = [], [], []
    for place, hashes in rows:
        begins = np.arange(len(hashes) - window + 1)
        prints.append(fingerprints(bit_totals(hashes, _pair(window)), begins, window))
        items.append(np.full(len(begins), place, np.int32))
        offsets.append(begins.astype(np.int32))
    distinct, which = np.unique(np.concatenate(prints), return_inverse=True)
    by_print = np.argsort(which, kind="stable")
    first = np.searchsorted(which[by_print], np.arange(len(distinct) + 1))
    starts = np.empty((BLOCKS, (1 << _BLOCK_BITS) + 1), np.int32)
    order = np.empty((BLOCKS, len(distinct)), np.int32)
    for block in range(BLOCKS):
        value = (distinct >> np.uint64(block * _BLOCK_BITS)) & _BLOCK_MASK
        order[block] = np.argsort(value, kind="stable")
        starts[block] = np.searchsorted(value[order[block]], np.arange((1 << _BLOCK_BITS) + 1))
    return ItemIndex(
        window,
        min(len(hashes) for _, hashes in rows),
        distinct,
        first,
        np.concatenate(items)[by_print],
        np.concatenate(offsets)[by_print],
        starts,
        order,
    )


def _offsets(lengths: Sequence[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])


def _joined(arrays: Sequence[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


def _window_shingles(hashes: np.ndarray) -> np.ndarray:
    return chain(hashes, min(SHINGLE_WORDS, len(hashes)))


def _probes(shingles: np.ndarray, often: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The rarest shingles, until the others are fewer than the threshold's share of the item."""
    order = np.argsort(common, kind="stable")
    left = often.sum() - np.cumsum(often[order])
    enough = left < THRESHOLD * often.sum() - _SLACK
    return shingles[order[: int(np.argmax(enough)) + 1]]


def build_items(ids: list, texts: list[str | None], id_type: pa.DataType | None = None) -> Items:
    """Index items; one without a word is in no text."""
    data, _, begins, ends, first = words(pa.array(texts, pa.string()))
    hashes = hash_spans(data, begins, ends)
    rows = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    classes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for place, own in enumerate(rows):
        if len(own):
            classes.setdefault(window_of(len(own)), []).append((place, own))
    held = [np.unique(_window_shingles(own), return_counts=True) for own in rows]
    shingles = _joined([distinct for distinct, _ in held], np.uint64)
    often = _joined([count for _, count in held], np.int64)
    starts = _offsets([len(distinct) for distinct, _ in held])
    _, which, items_with = np.unique(shingles, return_inverse=True, return_counts=True)
    common = items_with[which]
    probes = [
        _probes(shingles[a:b], often[a:b], common[a:b]) if b > a else shingles[a:b]
        for a, b in zip(starts[:-1], starts[1:], strict=True)
    ]
    return Items(
        pa.array(ids, id_type),
        np.array([len(own) for own in rows], np.int64),
        starts,
        shingles,
        often,
        _offsets([len(own) for own in probes]),
        _joined(probes, np.uint64),
        [_item_index(window, own) for window, own in sorted(classes.items())],
    )


def _candidates(index: ItemIndex, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a text's and an index's fingerprint within the radius, some of them repeatedly."""
    found_a, found_b = [_NONE], [_NONE]
    for block in range(BLOCKS):
        value = ((prints >> np.uint64(block * _BLOCK_BITS)) & _BLOCK_MASK).astype(np.int64)
        starts = index.starts[block]
        held = starts[value + 1] - starts[value]
        rows = np.flatnonzero(held)
        if len(rows):
            a = np.repeat(rows, held[rows])
            b = index.order[block][spread(starts[value[rows]].astype(np.int64), held[rows])]
            near = np.bitwise_count(prints[a] ^ index.prints[b]) <= RADIUS
            found_a.append(a[near])
            found_b.append(b[near])
    return np.concatenate(found_a), np.concatenate(found_b)


def weighted_similarity(item: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> float:
    """Weighted Jaccard similarity of shingles, where a shingle weighs as often as it occurs."""
    distinct, often = item
    own, count = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(distinct, own), len(distinct) - 1)
    same = distinct[at] == own
    shared = int(np.minimum(count[same], often[at[same]]).sum())
    return shared / (int(often.sum()) + len(window) - shared)


def _best(items: Items, item: int, hashes: np.ndarray, begins: set[int]) -> tuple[float, int]:
    """The best similarity of an item over windows of its length near the begins, and the window's.

    A window whose shingles in the item are too few for the threshold is not compared.
    """
    size = int(items.words[item])
    own = slice(items.first[item], items.first[item + 1])
    distinct, often = items.shingles[own], items.often[own]
    total = int(often.sum())
    last = max(0, len(hashes) - size)
    around = max(2, size // 8)
    count = min(SHINGLE_WORDS, size, len(hashes))
    width = min(size, len(hashes)) - count + 1
    best, where = 0.0, 0
    tried = set()
    for begin in sorted(begins):
        low, high = min(max(begin - around, 0), last), min(max(begin + around, 0), last)
        near = chain(hashes[low : high + size], count)
        at = np.minimum(np.searchsorted(distinct, near), len(distinct) - 1)
        inside = np.concatenate([[0], np.cumsum(distinct[at] == near)])
        held = inside[width:] - inside[:-width]
        rows = np.flatnonzero(held >= (THRESHOLD - _SLACK) * (total + width - held))
        for row in sorted(rows.tolist(), key=lambda row: abs(low + row - begin)):
            at = low + row
            if at in tried:
                continue
            tried.add(at)
            value = weighted_similarity((distinct, often), near[row : row + width])
            if value > best or (value == best and at < where):
                best, where = value, at
            if best == 1.0:
                return best, where
    return best, where


def _grid(window: int, step: int, first: np.ndarray) -> np.ndarray:
    """Where the windows of a length begin: at every step within each text that has room."""
    size = np.diff(first)
    count = np.where(size < window, 0, (size - window) // step + 1)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first[:-1], count) + step * nth


class _Text:
    """The words of one text, and its distinct shingles of each size, made when asked for."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.shingles: dict[int, np.ndarray] = {}

    def holds_a_probe(self, block: Items, items: np.ndarray) -> np.ndarray:
        """Which of the items have a probe among the text's shingles."""
        sizes = np.minimum(block.words[items], SHINGLE_WORDS)
        found = np.zeros(len(items), bool)
        for size in np.unique(sizes).tolist():
            if size not in self.shingles:
                self.shingles[size] = np.unique(chain(self.hashes, size))
            own = self.shingles[size]
            if not len(own):
                continue
            rows = np.flatnonzero(sizes == size)
            count = block.probe_first[items[rows] + 1] - block.probe_first[items[rows]]
            probes = block.probes[spread(block.probe_first[items[rows]], count)]
            there = own[np.minimum(np.searchsorted(own, probes), len(own) - 1)] == probes
            found[rows] = np.logical_or.reduceat(there, np.cumsum(count) - count)
        return found


def _places(block: Items, index: ItemIndex, text: _Text, at: np.ndarray, prints: np.ndarray):
    """Item and begin of each item that the text's windows at these places speak for."""
    distinct, which = np.unique(prints, return_inverse=True)
    count = index.first[distinct + 1] - index.first[distinct]
    rows = spread(index.first[distinct], count)
    items, item_of = np.unique(index.items[rows], return_inverse=True)
    alive = text.holds_a_probe(block, items)[item_of]
    rows = rows[alive]
    held = np.bincount(np.repeat(np.arange(len(distinct)), count)[alive], minlength=len(distinct))
    first = np.cumsum(held) - held
    row = rows[spread(first[which], held[which])]
    begin = np.repeat(at, held[which]) - index.offsets[row]
    return np.unique(np.stack([index.items[row], begin], axis=1), axis=0).tolist()


def find_in_blocks(
    blocks: Sequence[Items], steps: dict[int, int], column: pa.Array, first_only: bool = False
) -> Iterator[tuple[int, int, int, float, int]]:
    """Block, text, item, similarity and first word of each item found in the texts of a column.

    ``steps`` gives the step of each window length. With ``first_only`` a text is left once an item
    is found in it.
    """
    data, _, begins, ends, first = words(column)
    hashes = hash_spans(data, begins, ends)
    texts: dict[int, _Text] = {}
    places: dict[tuple[int, int, int], set[int]] = {}
    grids = {window: _grid(window, step, first) for window, step in steps.items()}
    for low in range(0, len(hashes), CHUNK_WORDS):
        high = low + CHUNK_WORDS
        held = hashes[low : high + max(WINDOWS)]
        totals: dict[int, np.ndarray] = {}
        for window, starts in grids.items():
            some = starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)]
            if not len(some):
                continue
            pair = _pair(window)
            if pair not in totals:
                totals[pair] = bit_totals(held, pair)
            prints = fingerprints(totals[pair], some - low, window)
            for number, block in enumerate(blocks):
                for index in block.indexes:
                    if index.window != window:
                        continue
                    a, b = _candidates(index, prints)
                    text = np.searchsorted(first, some[a], side="right") - 1
                    order = np.argsort(text, kind="stable")
                    a, b, text = a[order], b[order], text[order]
                    names, cuts = np.unique(text, return_index=True)
                    for t, rows in zip(names.tolist(), np.split(np.arange(len(a)), cuts[1:]), strict=False):
                        own = texts.get(t)
                        if own is None:
                            own = texts[t] = _Text(hashes[first[t] : first[t + 1]])
                        at = some[a[rows]] - first[t]
                        for item, begin in _places(block, index, own, at, b[rows]):
                            places.setdefault((t, number, item), set()).add(begin)
    done = -1
    for (text, number, item), begins_at in sorted(places.items()):
        if first_only and text == done:
            continue
        value, where = _best(blocks[number], item, texts[text].hashes, begins_at)
        if value >= THRESHOLD:
            done = text
            yield number, text, item, value, where


def steps_of(indexes: Sequence[ItemIndex]) -> dict[int, int]:
    """The smallest step of each window length, so that results do not depend on the blocks."""
    steps: dict[int, int] = {}
    for index in indexes:
        steps[index.window] = min(index.step, steps.get(index.window, index.step))
    return steps


def find_items(items: Items, column: pa.Array) -> list[tuple[int, int, float, int]]:
    """Text, item, similarity and first word of each item of a block found in a column's texts."""
    return [found[1:] for found in find_in_blocks([items], steps_of(items.indexes), column)]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item found in it: both ids, similarity, start_word and n_words.

    An item is in a text if a window of as many words as the item has (the whole text, if that is
    shorter) has a weighted similarity of five-word shingles of 0.8 or more. Whole texts are
    searched where they are, in one pass and without a shuffle. The items are the query set: they
    are indexed in blocks of at most 20,000 items and about 8 MB of text, one after the other on
    the driver, and executors map the blocks' files into memory. Null and empty texts and items
    match nothing; repeated rows are searched each. Only the named columns are read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = benchmark.schema[item_id].dataType
    arrow_type = to_arrow_type(item_type)
    names, steps = _sent_items(benchmark, item_id, item_text, arrow_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [items_of(received_arrays(name)) for name in names]
        for batch in batches:
            for part in parts(batch, "_text", TEXT_BYTES):
                found = list(find_in_blocks(blocks, steps, part.column(1)))
                ids = [blocks[number].ids[item].as_py() for number, _, item, _, _ in found]
                sizes = [int(blocks[number].words[item]) for number, _, item, _, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([row[1] for row in found], pa.int64())),
                        pa.array(ids, arrow_type),
                        pa.array([row[3] for row in found], pa.float64()),
                        pa.array([row[4] for row in found], pa.int64()),
                        pa.array(sizes, pa.int64()),
                    ],
                    names=["_id", "_item", "similarity", "start_word", "n_words"],
                )

    rows = docs.select(docs[id].alias("_id"), docs[text].alias("_text"))
    kind = f"_id {dict(docs.dtypes)[id]}, _item {dict(benchmark.dtypes)[item_id]}"
    found = map_batches(rows, run, f"{kind}, similarity double, start_word long, n_words long")
    return found.select(
        F.col("_id").alias(id), F.col("_item").alias(item_id), "similarity", "start_word", "n_words"
    )


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items in blocks of bounded size; the driver reads partition by partition."""
    named = benchmark.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_text"))
    ids, texts, held = [], [], 0
    for row in named.orderBy("_item", "_text").toLocalIterator():
        size = len((row["_text"] or "").encode())
        if ids and (len(ids) == ITEMS_AT_ONCE or held + size > ITEM_BYTES):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["_item"])
        texts.append(row["_text"])
        held += size
    yield ids, texts


def _sent_items(
    benchmark: DataFrame, item_id: str, item_text: str, id_type: pa.DataType
) -> tuple[list[str], dict[int, int]]:
    """Index the items block by block and send each to the executors: the files and the steps."""
    spark: SparkSession = benchmark.sparkSession
    names, steps = [], {}
    for ids, texts in _blocks(benchmark, item_id, item_text):
        items = build_items(ids, texts, id_type)
        for window, step in steps_of(items.indexes).items():
            steps[window] = min(step, steps.get(window, step))
        names.append(send_arrays(spark, "items", items.arrays()))
    return names, steps


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows whose text holds no item, with all their columns; see ``contaminated``.

    Rows are judged one by one where they are, in one pass: there is no join, and ids may be null or
    repeat. A null or empty text stays; an empty table, of documents or of items, removes nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(benchmark.schema[item_id].dataType)
    names, steps = _sent_items(benchmark, item_id, item_text, id_type)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [items_of(received_arrays(name)) for name in names]
        for batch in batches:
            for part in parts(batch, text, TEXT_BYTES):
                clean = np.ones(part.num_rows, bool)
                found = find_in_blocks(blocks, steps, part.column(place), first_only=True)
                clean[[row[1] for row in found]] = False
                yield part.filter(pa.array(clean))

    return map_batches(docs, run, docs.schema)
