"""Directly addressable codes: numbers cut into byte chunks by level, any of them readable at once.

Level 0 holds the lowest eight bits of every number, level k the next eight bits of those that have
more. A bitmap per level says which numbers go on, and a rank directory counts the set bits before
each block of 512, so the place of a number's next chunk takes one look-up and a count over at most
64 bytes.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK_BITS = 512
_HEAD = struct.Struct("<4sBxxxQ")
_COUNT = struct.Struct("<Q")


def pack(numbers: np.ndarray) -> bytes:
    """The image of unsigned numbers of up to 32 bits."""
    left = numbers.astype(np.uint32)
    levels = []
    while True:
        more = left >> 8 > 0
        chunk = _COUNT.pack(len(left)) + (left & 0xFF).astype(np.uint8).tobytes()
        if not more.any():
            levels.append(chunk)
            break
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        per_block = np.bitwise_count(bits).reshape(-1, 64).sum(axis=1)
        ranks = (np.cumsum(per_block) - per_block).astype("<u4")
        levels.append(chunk + bits.tobytes() + ranks.tobytes())
        left = left[more] >> 8
    return _HEAD.pack(MAGIC, len(levels), len(numbers)) + b"".join(levels)


class Dac:
    """The numbers of one image, read in place."""

    def __init__(self, image: bytes | memoryview | np.ndarray) -> None:
        data = np.frombuffer(image, np.uint8)
        magic, levels, self.count = _HEAD.unpack(data[: _HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not an image of directly addressable codes")
        self.levels, at = [], _HEAD.size
        for level in range(levels):
            (size,) = _COUNT.unpack(data[at : at + _COUNT.size].tobytes())
            at += _COUNT.size
            chunks = data[at : at + size]
            at += size
            bits = ranks = None
            if level + 1 < levels:
                blocks = -(-size // BLOCK_BITS)
                bits = data[at : at + 64 * blocks]
                at += 64 * blocks
                ranks = np.frombuffer(data[at : at + 4 * blocks].tobytes(), "<u4")
                at += 4 * blocks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, place: int) -> int:
        """One number, from one chunk per level."""
        if not 0 <= place < self.count:
            raise IndexError(place)
        number = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            number |= int(chunks[place]) << (8 * level)
            if bits is None or not bits[place >> 3] >> (place & 7) & 1:
                break
            block = place // BLOCK_BITS
            before = int(np.bitwise_count(bits[block * 64 : place >> 3]).sum())
            rest = int(bits[place >> 3]) & ((1 << (place & 7)) - 1)
            place = int(ranks[block]) + before + rest.bit_count()
        return number

    def all(self) -> np.ndarray:
        """All numbers."""
        numbers = self.levels[0][0].astype(np.uint32)
        places = None
        for level, (chunks, _, _) in enumerate(self.levels[1:], 1):
            size = len(self.levels[level - 1][0])
            on = np.unpackbits(self.levels[level - 1][1], count=size, bitorder="little")
            on = np.flatnonzero(on)
            places = on if places is None else places[on]
            numbers[places] |= chunks.astype(np.uint32) << (8 * level)
        return numbers
