"""Token ids of a corpus in files of directly addressable codes, in ascending document order.

A file is a Parquet file of Spark, whose rows are segments: the image of some documents' ids (see
``dac``), uncompressed, with the documents' ids and lengths. Spark's own writer commits a task's
file or none, on any file system that it can write to, so lost executors leave no half file.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.llm.arrow_text import list_column, map_batches, parts, spread, text_bytes
from meterlight.llm.dac import Dac, pack
from meterlight.llm.pieces import class_table, cut_pieces, distinct_pieces
from meterlight.session import broadcast_rows, new_shared_path

END_ID = 0
TEXT_BYTES = 8 << 20
CALL_BYTES = 1 << 12

MEMO_PIECES = 400_000
MEMO_BYTES = 64 << 20

_tokenizers: dict[bytes, tuple] = {}


def _tokenizer(described: bytes):
    """The library's tokenizer and a memo for it, made once per process."""
    key = hashlib.sha256(described).digest()
    if key not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(described.decode())
        made.no_truncation()
        made.no_padding()
        _tokenizers[key] = made, PieceMemo()
    return _tokenizers[key]


@lru_cache(maxsize=2)
def _token_bytes(tokenizer) -> np.ndarray:
    """How many bytes each token stands for: its characters in the byte-level alphabet."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, id in vocab.items():
        out[id] = len(token)
    return out


class PieceMemo:
    """What the library gave for pieces of the batches before, in one process; bounded."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bytes = 0
        self.starts = self.counts = self.ids = np.zeros(0, np.int64)

    def look_up(self, tokenizer, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids begin in ``ids``, and how many it has; new ones are encoded."""
        if len(self.place) > MEMO_PIECES or self.bytes > MEMO_BYTES:
            self.clear()
        new = [piece for piece in pieces if piece not in self.place]
        if new:
            ids, counts = _encode_pieces(tokenizer, [piece.decode() for piece in new])
            begin, last = len(self.counts), len(self.ids)
            # A piece's own bytes, and eight for each id.
            self.bytes += sum(map(len, new)) + 8 * len(ids)
            self.place.update(zip(new, range(begin, begin + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, last + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
        rows = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        return self.starts[rows], self.counts[rows]


def _encode_pieces(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The library's ids of each piece, all in a row, and how many each has.

    Pieces of a blank and letters are joined into longer calls: the pattern cuts such a text into
    the same pieces again, and the tokens' lengths tell where a piece ends.
    """
    word = np.fromiter((t[0] == " " and t[1:].isalpha() and t.isascii() for t in texts), bool, len(texts))
    counts = np.zeros(len(texts), np.int64)
    found = []
    rows = np.flatnonzero(word)
    length = np.fromiter(map(len, texts), np.int64, len(texts))[rows]
    token_bytes = _token_bytes(tokenizer)
    calls = np.split(rows, np.flatnonzero(np.diff(np.cumsum(length) // CALL_BYTES)) + 1)
    calls = [call for call in calls if len(call)]
    joined = ["".join(texts[k] for k in call) for call in calls]
    for call, got in zip(calls, tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
        ids = np.array(got.ids, np.int64)
        piece_ends = np.cumsum([len(texts[k]) for k in call.tolist()])
        last = np.searchsorted(np.cumsum(token_bytes[ids]), piece_ends, side="right")
        counts[call] = np.diff(last, prepend=0)
        found.append((call, ids))
    alone = np.flatnonzero(~word)
    single = tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False)
    for row, got in zip(alone.tolist(), single, strict=True):
        counts[row] = len(got.ids)
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int64)
    for call, ids in found:
        out[spread(first[call], counts[call])] = ids
    if len(alone):
        flat = [id for got in single for id in got.ids]
        out[spread(first[alone], counts[alone])] = flat
    return out, counts


def encode_texts(tokenizer, memo: PieceMemo, classes: np.ndarray, special: bytes, column: pa.Array):
    """The library's ids of all texts in a row, each text closed by the end id, and their counts.

    Each distinct piece of the batch that the memo lacks goes through the library once.
    """
    data, offsets = text_bytes(column)
    begins, ends, _ = cut_pieces(data, offsets, classes, special)
    if len(begins):
        codes, places = distinct_pieces(data, begins, ends)
        raw = data.tobytes()
        spans = zip(begins[places].tolist(), ends[places].tolist(), strict=True)
        starts, counts = memo.look_up(tokenizer, [raw[b:e] for b, e in spans])
        per_piece = counts[codes]
        ids = memo.ids[spread(starts[codes], per_piece)]
        total = np.concatenate([[0], np.cumsum(per_piece)])
        per_text = np.diff(total[np.searchsorted(begins, offsets)])
    else:
        ids, per_text = np.zeros(0, np.int64), np.zeros(len(column), np.int64)
    out = np.full(len(ids) + len(column), END_ID, np.int64)
    counts = per_text + 1
    out[spread(np.cumsum(counts) - counts, per_text)] = ids
    return out, counts


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str | None = None, id: str = "doc_id", text: str = "text"
) -> str:
    """Encode all texts and write them to ``path`` in ascending order of the id; returns the path.

    The texts are range-partitioned by id, so that each task holds a run of documents; a task
    writes segments of about 8 MB of text. The default path lies in the shared folder. Null and
    empty texts are just the end id. Null ids come first; rows that repeat are written each.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or new_shared_path(spark, "tokens")
    with open(tokenizer, "rb") as file:
        described = file.read()
    made = Tokenizer.from_file(tokenizer)
    special = next(iter(made.get_added_tokens_decoder().values())).content.encode()
    classes = zlib.compress(class_table(tokenizer).tobytes())
    described = spark.sparkContext.broadcast(zlib.compress(described))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, memo = _tokenizer(zlib.decompress(described.value))
        table = np.frombuffer(zlib.decompress(classes), np.uint8)
        part_id, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in parts(batch, "_text", TEXT_BYTES):
                ids, counts = encode_texts(encoder, memo, table, special, part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part_id], pa.int32()),
                        pa.array([before], pa.int64()),
                        list_column(part.column(0).cast(pa.int64()), np.array([len(counts)])),
                        list_column(counts, np.array([len(counts)])),
                        pa.array([pack(ids)], pa.binary()),
                    ],
                    names=["part", "before", "ids", "lengths", "codes"],
                )
                before += len(ids)

    rows = docs.select(F.col(id).cast("long").alias("_id"), docs[text].alias("_text"))
    order = [F.col("_id"), F.xxhash64("_text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "part int, before long, ids array<long>, lengths array<long>, codes binary"
    map_batches(rows, run, schema).write.option("compression", "none").parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' segments with ``start``, the number of ids in all segments before each.

    The driver sees nothing; only one total per written part meets in one task.
    """
    segments = spark.read.parquet(path)
    parts_of = segments.select("part", (F.col("before") + _held()).alias("n"))
    totals = parts_of.groupBy("part").agg(F.max("n").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    # One row per part, of which a file has one: the images stay where they are.
    starts = broadcast_rows(starts, len(segments.inputFiles()))
    return segments.join(starts, "part").withColumn("start", F.col("_before") + F.col("before"))


def _held():
    return F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)


def documents_of(spark: SparkSession, path: str, id: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, start, n_tokens and ids_crc32 of its token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start = batch.column(0)[row].as_py()
                counts = np.array(batch.column(2)[row].values)
                ids = Dac(batch.column(3)[row].as_buffer()).all().astype("<u4")
                ends = np.cumsum(counts)
                begins = ends - counts
                crcs = [
                    zlib.crc32(ids[b:e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)
                ]
                columns = [batch.column(1)[row].values, pa.array(start + begins), pa.array(counts)]
                columns.append(pa.array(crcs, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["_id", "start", "n_tokens", "ids_crc32"]
    segments = read_token_files(spark, path).select("start", "ids", "lengths", "codes")
    schema = "_id long, start long, n_tokens long, ids_crc32 long"
    return map_batches(segments, run, schema).withColumnRenamed("_id", id)


def token_at(spark: SparkSession, path: str, place: int) -> int:
    """One token id by its place in the whole corpus: one segment is found, one code is read."""
    segments = read_token_files(spark, path).withColumn("n", _held())
    row = segments.where((F.col("start") <= place) & (F.col("start") + F.col("n") > place)).first()
    if row is None:
        raise IndexError(place)
    return Dac(row["codes"])[place - row["start"]]
