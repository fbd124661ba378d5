"""Runs of repeated words: maximal pairs from the LCP-interval tree of each text.

A *run* is a stretch of words with a smallest period q that no neighbouring word extends. The pair
of its occurrences at a distance of q is a maximal pair: what precedes and what follows differs. So
the suffixes of a text are sorted, the intervals of equal common prefixes are visited bottom-up, and
each interval lists the positions below it by the word to their left. Positions from two children
of an interval whose left words differ are a maximal pair as long as the interval's common prefix;
if their distance is no more than that length, the pair overlaps or touches and is a run as it is.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.arrow_text import chain, map_batches, parts

MIN_LENGTH = 12
RUNS = "array<struct<start: long, length: long, period: long>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A number per word, the same for equal words only."""
    known = dict.fromkeys(words)
    for number, word in enumerate(known):
        known[word] = number
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def sorted_suffixes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a text in lexical order, and each position's place in it, by prefix doubling."""
    size, step = len(numbers), 1
    rank = numbers.astype(np.int64)
    while True:
        key = (rank + 1) * (int(rank.max(initial=0)) + 2)
        key[: max(0, size - step)] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        place = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(size, np.int64)
        rank[order] = place
        if place[-1] == size - 1:
            return order.astype(np.int32), rank.astype(np.int32)
        step *= 2


def common_prefixes(numbers: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Per place in the order: how many words its suffix shares with the one before it."""
    size, held = len(numbers), 0
    out = np.zeros(size, np.int32)
    words, suffixes, places, shared = map(memoryview, (numbers, order, place, out))
    for at in range(size):
        now = places[at]
        if not now:
            held = 0
            continue
        other = suffixes[now - 1]
        most = size - max(at, other)
        while held < most and words[at + held] == words[other + held]:
            held += 1
        shared[now] = held
        if held:
            held -= 1
    return out


class _Interval:
    """The positions below an interval: all of them, and by the word to their left; both sorted."""

    __slots__ = ("all", "by_left")

    def __init__(self, position: int, left: int) -> None:
        self.all = [position]
        self.by_left = {left: [position]}

    def add(self, position: int, left: int) -> None:
        insort(self.all, position)
        if left in self.by_left:
            insort(self.by_left[left], position)
        else:
            self.by_left[left] = [position]

    def near(self, position: int, reach: int, left_of: memoryview) -> Iterator[int]:
        """The positions within ``reach`` of one in another child, whose left words differ from its own.

        Occurrences of a phrase no further apart than its length lie a period apart. So those after
        the position have one left word between them, and of those before it all but the first have
        the position's own: two lists are enough.
        """
        left = left_of[position]
        at = bisect_right(self.all, position)
        if at < len(self.all) and self.all[at] - position <= reach:
            other = left_of[self.all[at]]
            if other != left:
                listed = self.by_left[other]
                for k in range(bisect_right(listed, position), len(listed)):
                    if listed[k] - position > reach:
                        break
                    yield listed[k]
        if at and position - self.all[at - 1] <= reach:
            first = self.all[bisect_left(self.all, position - reach)]
            if left_of[first] != left:
                yield first


def find_text_runs(numbers: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Start, length and period of the runs of one text, at least ``min_length`` words and two periods long."""
    # A run of n words with period q shows as a pair of n - q equal words, of which q is no more.
    least = max(1, (min_length + 1) // 2)
    grams = np.sort(chain(numbers.astype(np.uint64), least))
    if not (grams[1:] == grams[:-1]).any():
        return []
    order, place = sorted_suffixes(numbers)
    shared = common_prefixes(numbers, order, place)
    left_of = memoryview(np.concatenate([[-1], numbers[:-1]]).astype(np.int32))
    found: dict[tuple[int, int], int] = {}

    def merged(length: int, one: _Interval, two: _Interval) -> _Interval:
        large, small = (one, two) if len(one.all) >= len(two.all) else (two, one)
        for position in small.all:
            for other in large.near(position, length, left_of):
                period = abs(other - position)
                if period + length >= min_length:
                    run = min(position, other), period + length
                    # A multiple of the smallest period spans the same words.
                    found[run] = min(period, found.get(run, period))
        for position in small.all:
            large.add(position, left_of[position])
        return large

    begins = np.flatnonzero((shared >= least) & (np.concatenate([[0], shared[:-1]]) < least))
    ends = np.flatnonzero((shared < least) & (np.concatenate([[0], shared[:-1]]) >= least))
    for begin, end in zip(begins.tolist(), [*ends.tolist(), len(shared)][: len(begins)], strict=True):
        positions = order[begin - 1 : end].tolist()
        lengths = shared[begin:end].tolist()
        open_intervals: list[tuple[int, _Interval]] = []
        for position, length in zip(positions, [*lengths, 0], strict=True):
            now = _Interval(position, left_of[position])
            while open_intervals and open_intervals[-1][0] > length:
                now = merged(*open_intervals.pop(), now)
            if open_intervals and open_intervals[-1][0] == length:
                now = merged(*open_intervals.pop(), now)
            if length:
                open_intervals.append((length, now))
    return sorted((start, length, period) for (start, length), period in found.items())


def kept_words(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when of every run only the first period does."""
    edges = np.zeros(count + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def find_runs(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH
) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, runs (start, length, period) and collapsed.

    Words are what blanks, tabs and line ends separate, numbered from 0. A run has at least
    ``min_length`` words and twice its smallest period; runs are ordered by start, then period, and
    may overlap. ``collapsed`` is the text without the words that follow the first period of a run,
    joined by single spaces. A null or blank text has no words, no runs, and collapses to an empty
    text. Rows are taken one by one, so null or repeated ids do not matter, and an empty table
    gives an empty result. Only the columns ``id`` and ``text`` are read.

    There is no shuffle. A text is handled whole: a task holds one batch, and some hundred bytes
    for each word of the one text at hand that lies in a repeated stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for batch in batches:
            for part in parts(batch, "_text"):
                counts, runs, collapsed = [], [], []
                for value in part.column(1).cast(pa.large_binary()).to_pylist():
                    words = (value or b"").split()
                    found = find_text_runs(word_numbers(words), min_length) if words else []
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    if found:
                        words = [words[k] for k in np.flatnonzero(kept_words(len(words), found))]
                    collapsed.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed)],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("_text"))
    kind = docs.schema[id].dataType.simpleString()
    found = map_batches(rows, run, f"id {kind}, n_words long, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("id", id)
