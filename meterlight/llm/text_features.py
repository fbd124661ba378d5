"""Numbers that describe how a text is written, computed for whole batches of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from meterlight.llm.arrow_text import chain, hash_spans, runs, text_bytes

FEATURES = (
    "log_chars",
    "log_words",
    "word_length",
    "word_length_spread",
    "upper_share",
    "digit_share",
    "space_share",
    "period_share",
    "symbol_share",
    "bracket_share",
    "upper_word_share",
    "symbol_word_share",
    "distinct_word_share",
    "top_word_share",
    "short_word_share",
    "log_lines",
    "line_length",
    "repeated_line_share",
    "repeated_shingle_share",
    "ended_line_share",
)

_SPACE, _UPPER, _LOWER, _DIGIT, _PERIOD, _BRACKET, _SYMBOL = range(7)
_KIND = np.full(256, _LOWER, np.uint8)
_KIND[:128] = _SYMBOL
_KIND[list(b" \t\n\v\f\r")] = _SPACE
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("a") : ord("z") + 1] = _LOWER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[list(b".,;:?'\"-")] = _PERIOD
_KIND[list(b"()[]{}<>|/\\")] = _BRACKET
_ENDS_SENTENCE = np.zeros(256, bool)
_ENDS_SENTENCE[list(b".!?:")] = True


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return np.diff(total[borders])


def _repeated(hashes: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group: how many hashes are distinct, and how often the most frequent one occurs."""
    mixed = hashes ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    codes, _ = pd.factorize(mixed)
    count = np.bincount(codes, minlength=codes.max(initial=-1) + 1)
    place = np.empty(len(count), np.int64)
    place[codes] = np.arange(len(codes))
    distinct = np.bincount(group[place], minlength=groups)
    top = np.zeros(groups, np.int64)
    np.maximum.at(top, group[place], count)
    return distinct, top


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; a null or empty text has zeros throughout."""
    data, offsets = text_bytes(column)
    texts = len(column)
    size = np.diff(offsets).astype(np.float64)
    kind = _KIND[data]
    chars = _sums((data & 0xC0) != 0x80, offsets)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    begins, ends = runs(kind != _SPACE, offsets)
    first = np.searchsorted(begins, offsets)
    words = np.diff(first).astype(np.float64)
    length = (ends - begins).astype(np.float64)
    mean = share(_sums(length, first), words)
    square = share(_sums(length**2, first), words)
    owner = np.repeat(np.arange(texts), np.diff(first))
    upper = np.concatenate([[0], np.cumsum(kind == _UPPER)])
    lower = np.concatenate([[0], np.cumsum((kind == _LOWER))])
    symbol = np.concatenate([[0], np.cumsum(kind == _SYMBOL)])
    all_upper = (upper[ends] - upper[begins] > 1) & (lower[ends] == lower[begins])
    some_symbol = symbol[ends] > symbol[begins]
    hashes = hash_spans(data, begins, ends)
    distinct, top = _repeated(hashes, owner, texts)

    line_begins, line_ends = runs(data != ord("\n"), offsets)
    line_first = np.searchsorted(line_begins, offsets)
    lines = np.diff(line_first).astype(np.float64)
    line_owner = np.repeat(np.arange(texts), np.diff(line_first))
    line_distinct, _ = _repeated(hash_spans(data, line_begins, line_ends), line_owner, texts)
    ended = _ENDS_SENTENCE[data[line_ends - 1]] if len(line_ends) else np.zeros(0, bool)

    five = chain(hashes, 5)
    whole = owner[: len(five)] == owner[4:] if len(five) else np.zeros(0, bool)
    five, five_owner = five[whole], owner[: len(whole)][whole]
    five_distinct, _ = _repeated(five, five_owner, texts)
    fives = np.bincount(five_owner, minlength=texts).astype(np.float64)

    rows = [
        np.log1p(chars),
        np.log1p(words),
        mean,
        np.sqrt(np.maximum(square - mean**2, 0)),
        share(_sums(kind == _UPPER, offsets), size),
        share(_sums(kind == _DIGIT, offsets), size),
        share(_sums(kind == _SPACE, offsets), size),
        share(_sums(kind == _PERIOD, offsets), size),
        share(_sums(kind == _SYMBOL, offsets), size),
        share(_sums(kind == _BRACKET, offsets), size),
        share(_sums(all_upper, first), words),
        share(_sums(some_symbol, first), words),
        share(distinct, words),
        share(top, words),
        share(_sums(length <= 3, first), words),
        np.log1p(lines),
        share(size, lines),
        1 - share(line_distinct, np.maximum(lines, 1)) - (lines == 0),
        share(fives - five_distinct, fives),
        share(_sums(ended, line_first), lines),
    ]
    return np.stack(rows, axis=1)
