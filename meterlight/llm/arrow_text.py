"""Text columns of Arrow batches as byte arrays, and 64-bit hashes over them.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased
text. A *shingle* is five words in a row; a text of one to four words is one shingle of all its
words, and a text without a word has none.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
SHINGLE_WORDS = 5

_MIX_A = np.uint64(0x9E3779B97F4A7C15)
_MIX_B = np.uint64(0xFF51AFD7ED558CCD)
_MIX_C = np.uint64(0xC4CEB9FE1A85EC53)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IN_WORD[128:] = True


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that Spark hands to Python small, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with small batches, and with this folder's code at hand on every executor."""
    bounded_batches(df.sparkSession)
    ship_code(df.sparkSession)
    return df.mapInArrow(function, schema)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once, as they need not have it installed."""
    context = spark.sparkContext
    if any(path.rpartition("/")[2].startswith("meterlight-llm-") for path in context.listFiles):
        return
    root = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp(prefix='meterlight-')}/meterlight-llm-{os.getpid()}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)


def parts(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take at most ``most`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, size in enumerate(sizes):
        if row > begin and held + size > most:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of True that does not pass a text's border."""
    size = len(inside)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < size]
    begins[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, text offsets, begin and end of each word, and each text's first word."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    begins, ends = runs(_IN_WORD[data], offsets)
    return data, offsets, begins, ends, np.searchsorted(begins, offsets)


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    length = ends - begins
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 8,), dtype="<u8", buffer=padded.data, strides=(1,))
    hashes = length.astype(np.uint64) * _MIX_A
    left = np.arange(len(begins))
    at = 0
    while len(left):
        got = eight[begins[left] + at] & _LOW_BYTES[np.minimum(length[left] - at, 8)]
        mixed = (hashes[left] ^ got) * _MIX_B
        hashes[left] = mixed ^ (mixed >> np.uint64(32))
        at += 8
        left = left[length[left] > at]
    return hashes


def chain(hashes: np.ndarray, count: int) -> np.ndarray:
    """A hash of each ``count`` hashes in a row."""
    rows = max(0, len(hashes) - count + 1)
    out = np.zeros(rows, np.uint64)
    for k in range(count):
        out = (out ^ hashes[k : k + rows]) * _MIX_A
        out ^= out >> np.uint64(29)
    out *= _MIX_C
    return out ^ (out >> np.uint64(32))


def shingles(word_hashes: np.ndarray, count: int = SHINGLE_WORDS) -> np.ndarray:
    """The shingle hashes of one text, in the order of the text."""
    if not len(word_hashes):
        return word_hashes
    return chain(word_hashes, min(count, len(word_hashes)))


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow list column from all values in a row and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each run of ``lengths``, one run after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(begins - before, lengths) + np.arange(total)
