"""Byte-level pre-tokenisation of whole batches: texts cut into pieces, and equal pieces found.

A piece is what the tokenizer's pattern cuts a text into before any merge: a contraction, or one
class of characters with at most one blank before it, or white space. Every byte belongs to exactly
one piece. Which class a character has is asked from the tokenizer itself.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from meterlight.llm.arrow_text import hash_spans

SPACE, LETTER, NUMBER, OTHER = range(4)

_PROBES = {LETTER: "A", NUMBER: "1", OTHER: "!"}
_ONE_LETTER = np.frombuffer(b"stmd", np.uint8)
_TWO_LETTERS = {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}


@lru_cache(maxsize=2)
def class_table(path: str) -> np.ndarray:
    """The class of each code point: one that makes one piece with a probe has the probe's class."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    guesses = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        guess = guesses.get(unicodedata.category(char)[0], OTHER)
        order = [guess, *(kind for kind in _PROBES if kind != guess)]
        table[point] = next((k for k in order if len(cut(_PROBES[k] + char)) == 1), SPACE)
    return table


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character begins, and its code point."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[begins].astype(np.int32)
    wide = np.flatnonzero(points >= 0x80)
    if len(wide):
        padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int32)
        first, at = points[wide], begins[wide]
        b, c, d = (padded[at + k] & 0x3F for k in (1, 2, 3))
        two = (first & 0x1F) << 6 | b
        three = (first & 0x0F) << 12 | b << 6 | c
        four = (first & 0x07) << 18 | b << 12 | c << 6 | d
        points[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return begins, points


def _special_places(data: np.ndarray, offsets: np.ndarray, special: bytes) -> np.ndarray:
    """Where the special token's own string begins within a text."""
    at = np.flatnonzero(data == special[0])
    at = at[at + len(special) <= len(data)]
    for k, byte in enumerate(special):
        at = at[data[at + k] == byte]
    text = np.searchsorted(offsets, at, side="right") - 1
    return at[at + len(special) <= offsets[text + 1]]


def cut_pieces(
    data: np.ndarray, offsets: np.ndarray, table: np.ndarray, special: bytes
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each piece of the texts, and which pieces are the special token."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    marked = _special_places(data, offsets, special)
    borders = np.unique(np.concatenate([offsets, marked, marked + len(special)]))
    borders = borders[borders < len(data)]
    chars, points = _code_points(data)
    kinds = table[points]
    first = np.zeros(len(chars) + 1, bool)
    first[np.searchsorted(chars, borders)] = True
    first[-1] = True
    start = first[:-1].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    blank = kinds == SPACE
    # A blank directly before a class belongs to it, and is the last of its run of white space.
    after = np.flatnonzero(start[1:] & ~blank[1:] & ~first[1:-1] & (points[:-1] == 0x20)) + 1
    start[after] = False
    start[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:-1]
    _contractions(points, first, start)
    inside = np.searchsorted(chars, marked)
    for k in range(1, len(special)):
        start[inside + k] = False
    begins = chars[start]
    is_special = np.isin(begins, marked)
    return begins, np.append(begins[1:], len(data)), is_special


def _contractions(points: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
    """Cut after 's 't 'm 'd 're 've 'll where the apostrophe begins a piece."""
    padded = np.concatenate([points, np.zeros(3, np.int32)])
    ends = np.concatenate([first, np.ones(3, bool)])
    at = np.flatnonzero(start & (points == 0x27))
    at = at[~ends[at + 1]]
    one = at[np.isin(padded[at + 1], _ONE_LETTER)]
    two = at[~ends[at + 2]]
    wanted = np.zeros(128, np.int32)
    for letter, follower in _TWO_LETTERS.items():
        wanted[letter] = follower
    letter = padded[two + 1]
    two = two[(letter < 128) & (padded[two + 2] == wanted[letter % 128]) & (wanted[letter % 128] > 0)]
    for begins, length in ((one, 2), (two, 3)):
        start[begins + 1] = False
        stop = begins + length
        start[stop[stop < len(start)]] = True


def distinct_pieces(
    data: np.ndarray, begins: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its text among the distinct ones, and one place of each.

    Pieces are grouped by a 64-bit hash; all are then compared with their group's first, and a
    batch in which two texts share a hash is grouped by the texts themselves.
    """
    codes, _ = pd.factorize(hash_spans(data, begins, ends))
    places = np.empty(codes.max(initial=-1) + 1, np.int64)
    places[codes[::-1]] = np.arange(len(codes))[::-1]
    if not _same(data, begins, ends, places[codes]):
        texts = [data[b:e].tobytes() for b, e in zip(begins, ends, strict=True)]
        codes, _ = pd.factorize(np.array(texts, dtype=object))
        places = np.empty(codes.max(initial=-1) + 1, np.int64)
        places[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, places


def _same(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    length = ends - begins
    if not np.array_equal(length, length[other]):
        return False
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 8,), dtype="<u8", buffer=padded.data, strides=(1,))
    low = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    left, at = np.flatnonzero(other != np.arange(len(other))), 0
    while len(left):
        mask = low[np.minimum(length[left] - at, 8)]
        here, there = eight[begins[left] + at], eight[begins[other[left]] + at]
        if np.any((here ^ there) & mask):
            return False
        at += 8
        left = left[length[left] > at]
    return True
