"""Collocations mined relationally: occurrence relations, merge-joined by piece and position, counted.

The relation R(k) holds where phrases of k words occur: per distinct piece of text, with its number
of copies, the sorted positions at which one begins. It is stored, and R(k) merge-joined with itself
on piece and next position gives the occurrences of k + 1 words. These are counted by group; before
they are extended again, the relation is semi-joined with the frequent groups. The semi-join goes
through a bitmap of hashed groups, whose size has a bound; an infrequent phrase that passes it by
chance is counted and found infrequent, so the counts are exact whatever the bitmap lets through.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.llm.array_file import received_arrays, send_arrays
from meterlight.llm.arrow_text import hash_spans, map_batches, parts, spread, text_bytes
from meterlight.llm.stored import stored
from meterlight.operators.numbering import number_rows

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
# A phrase goes if a longer one holds so many hundredths of its occurrences.
CONTAINED = 50
NO_LANGUAGE = "und"

# Bits of a semi-join's bitmap: so many for each frequent group, at most and at least so many in all.
BITS_EACH, MOST_BITS, LEAST_BITS = 16, 1 << 28, 1 << 16
BATCH_PIECES = 50_000

_TO_PIECES = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 0x20


@contextmanager
def _pieces_per_batch(spark: SparkSession) -> Iterator[None]:
    """Larger batches, for jobs over short pieces that run within; their bytes stay bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_PIECES))
    yield
    spark.conf.set(name, before)


def text_pieces(text: bytes) -> list[bytes]:
    """The pieces of a text that have a word, their words joined by single spaces."""
    found = []
    for piece in text.translate(_TO_PIECES).split(b"\n"):
        piece = piece.strip(b" ")
        if b"  " in piece:
            piece = b" ".join(piece.split())
        if piece:
            found.append(piece)
    return found


def _pieces(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang``, ``piece`` and ``weight``: each distinct piece of a language and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text"):
                counts: dict[tuple[str, bytes], int] = {}
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                for language, value in zip(part.column(0).to_pylist(), texts, strict=True):
                    for piece in text_pieces(value or b""):
                        counts[language, piece] = counts.get((language, piece), 0) + 1
                columns = [
                    pa.array([language for language, _ in counts], pa.string()),
                    pa.array([piece for _, piece in counts], pa.binary()).cast(pa.string()),
                    pa.array(counts.values(), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "piece", "weight"])

    rows = docs.select(
        F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("_lang"), F.col(text).alias("_text")
    )
    found = map_batches(rows, run, "lang string, piece string, weight long")
    return found.groupBy("lang", "piece").agg(F.sum("weight").alias("weight"))


class _Words:
    """The words of a batch of pieces, one piece after the other."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.data, offsets = text_bytes(batch.column(1))
        blank = self.data == _SPACE
        cuts = np.flatnonzero(blank)
        self.begins = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
        self.ends = np.sort(np.concatenate([cuts, offsets[1:]]))
        self.first = np.searchsorted(self.begins, offsets)
        self.piece = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        languages, places = text_bytes(batch.column(0))
        self.lang = hash_spans(languages, places[:-1], places[1:]) * _MIX

    def hashes(self, at: np.ndarray, count: int) -> np.ndarray:
        """A hash of the language and the phrase of ``count`` words at each place."""
        return hash_spans(self.data, self.begins[at], self.ends[at + count - 1]) ^ self.lang[self.piece[at]]

    def phrases(self, at: np.ndarray, count: int) -> pa.Array:
        begins, sizes = self.begins[at], self.ends[at + count - 1] - self.begins[at]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        held = pa.py_buffer(self.data[spread(begins, sizes)])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), held)

    def joined(self, starts: np.ndarray) -> np.ndarray:
        """Sorted places whose next place is among them too, in the same piece: a merge join."""
        following = np.searchsorted(starts, starts + 1)
        found = np.zeros(len(starts), bool)
        some = following < len(starts)
        found[some] = starts[following[some]] == starts[some] + 1
        at = starts[found]
        return at[self.piece[at] == self.piece[at + 1]]


def _starts(words: _Words, batch: pa.RecordBatch, length: int) -> np.ndarray:
    """The places of the phrases of ``length`` words that the stored relation implies."""
    if length == 1:
        return np.arange(len(words.begins))
    held = batch.column(3).to_pylist()
    within = np.frombuffer(b"".join(held), np.int32)
    counts = np.array([len(h) // 4 for h in held])
    return words.joined(np.repeat(words.first[:-1], counts) + within)


def _counted(relation: DataFrame, length: int, min_count: int) -> DataFrame:
    """``lang``, ``phrase`` and ``count`` of the frequent phrases of ``length`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Words(batch)
            at = _starts(words, batch, length)
            piece = pa.array(words.piece[at])
            found = pa.table(
                {
                    "lang": batch.column(0).take(piece),
                    "phrase": words.phrases(at, length),
                    "count": batch.column(2).take(piece),
                }
            )
            sums = found.group_by(["lang", "phrase"]).aggregate([("count", "sum")])
            columns = [sums["lang"], sums["phrase"].cast(pa.string()), sums["count_sum"]]
            yield from pa.table(columns, names=["lang", "phrase", "count"]).to_batches()

    found = map_batches(relation, run, "lang string, phrase string, count long")
    counts = found.groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
    return counts.where(F.col("count") >= min_count)


def _bitmap(groups: DataFrame) -> str:
    """A bitmap in which the hashes of all groups are set, sent to every executor; returns its name.

    Tasks turn groups into bits, Spark joins those to blocks of 4 KB, and the driver lays the
    blocks, of at most ``MOST_BITS`` bits in all, end to end.
    """
    wanted = max(LEAST_BITS, min(MOST_BITS, groups.count() * BITS_EACH))
    bits = 1 << (wanted - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            languages, places = text_bytes(batch.column(0))
            hashes = hash_spans(data, offsets[:-1], offsets[1:])
            hashes ^= hash_spans(languages, places[:-1], places[1:]) * _MIX
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(hashes, bits)))], names=["bit"])

    set_bits = map_batches(groups.select("lang", "phrase"), run, "bit long")
    blocks = (
        set_bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("map"))
        .collect()
    )
    whole = np.zeros(bits // 8, np.uint8)
    for row in blocks:
        block = np.frombuffer(row["map"], np.uint8)
        at = (row["block"] - 1) * 4096
        whole[at : at + len(block)] = block[: len(whole) - at]
    return send_arrays(groups.sparkSession, "frequent", {"bits": whole})


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a bitmap for each hash."""
    last = np.uint64(bits - 1)
    return (hashes & last).astype(np.int64), ((hashes * _MIX) >> np.uint64(32) & last).astype(np.int64)


def _semi_joined(relation: DataFrame, length: int, frequent: str) -> DataFrame:
    """The relation of ``length`` words: pieces with two or more frequent phrases, and their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = received_arrays(frequent)["bits"]
        for batch in batches:
            words = _Words(batch)
            at = _starts(words, batch, length)
            one, two = _bits(words.hashes(at, length), len(held) * 8)
            both = (held[one >> 3] >> (one & 7)) & (held[two >> 3] >> (two & 7)) & 1
            at = at[both.astype(bool)]
            counts = np.bincount(words.piece[at], minlength=batch.num_rows)
            within = (at - words.first[:-1][words.piece[at]]).astype(np.int32)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            rows = np.flatnonzero(counts > 1)
            starts = [within[cuts[r] : cuts[r + 1]].tobytes() for r in rows.tolist()]
            taken = pa.array(rows)
            columns = [batch.column(k).take(taken) for k in range(3)] + [pa.array(starts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "piece", "weight", "starts"])

    return map_batches(relation, run, "lang string, piece string, weight long, starts binary")


def frequent_phrases(pieces: DataFrame, max_words: int, min_count: int) -> list[DataFrame]:
    """Per length from 1 to ``max_words`` the phrases that occur ``min_count`` times, with their counts."""
    spark, relation, found = pieces.sparkSession, pieces, []
    with _pieces_per_batch(spark):
        for length in range(1, max_words + 1):
            found.append(stored(_counted(relation, length, min_count), f"phrases-{length}"))
            if length < max_words:
                joined = _semi_joined(relation, length, _bitmap(found[-1]))
                relation = stored(joined, f"occurrences-{length}")
    return found


def _cut(phrase: Column, at: Column) -> tuple[Column, Column]:
    """The first ``at`` words of a phrase, and the rest."""
    words = F.split(phrase, " ")
    first = F.slice(words, F.lit(1), at)
    return F.array_join(first, " "), F.array_join(F.slice(words, at + 1, F.size(words) - at), " ")


def _scored(candidates: DataFrame, parts_: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r`` and ``score`` by each candidate's lowest-scoring cut."""
    first, rest = _cut(F.col("phrase"), F.col("cut"))
    cuts = F.explode(F.sequence(F.lit(1), F.size(F.split("phrase", " ")) - 1)).alias("cut")
    cut = candidates.select("lang", "phrase", F.col("count").alias("a"), cuts)
    cut = cut.withColumns({"first": first, "rest": rest})
    for part, name in (("first", "l"), ("rest", "r")):
        counts = parts_.select("lang", F.col("phrase").alias(part), F.col("count").alias(name))
        cut = cut.join(counts, ["lang", part])
    # Counts up to 15 digits; products have 38.
    a, l, r = (F.col(name).cast("decimal(15,0)") for name in ("a", "l", "r"))
    cut = cut.withColumns({"_over": F.lit(1_000_000).cast("decimal(7,0)") * a * a, "_under": l * r})
    cut = cut.withColumn("score", F.expr("_over div _under"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("lowest")
    return (
        cut.groupBy("lang", "phrase", "a")
        .agg(lowest)
        .select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score")
    )


def _holders(longer: DataFrame, length: int) -> DataFrame:
    """``lang``, ``phrase`` of fewer than ``length`` words, and the largest count of a longer one around it."""
    words = F.split("phrase", " ")

    def within(size: int) -> Column:
        begins = F.sequence(F.lit(1), F.lit(length - size + 1))
        return F.transform(begins, lambda at: F.array_join(F.slice(words, at, F.lit(size)), " "))

    inside = [within(size) for size in range(2, length)]
    held = longer.select("lang", "count", F.explode(F.concat(*inside)).alias("phrase"))
    return held.groupBy("lang", "phrase").agg(F.max("count").alias("around"))


def mine_collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    contained: int = CONTAINED,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n and score.

    Letters A to Z are lower-cased, texts are split at ``.,;:!?`` and line ends into pieces, and
    those at blanks and tabs into words. ``a`` counts a phrase's occurrences within pieces, overlaps
    included; ``n`` counts the language's words. Phrases of 2 to ``max_words`` words with ``a`` of at
    least ``min_count`` are candidates. A cut leaves a first part and a rest that occur ``l`` and
    ``r`` times, and scores floor(1000000 a a / (l r)); the lowest-scoring cut counts, of equal ones
    the first. A candidate goes if a longer one holds it and has ``contained`` hundredths of its
    occurrences. The first ``top`` of each language by score, ``a`` (both descending) and phrase
    (by bytes) are returned.

    A null text is empty, a null language is ``und``; an empty table, or one without words, gives an
    empty result. Every row counts, repeated ones too. Only ``text`` and ``lang`` are read. Copies of
    a piece travel as one row with a number; the relations and counts are stored in the shared folder.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    pieces = stored(_pieces(docs, text, lang), "pieces")
    frequent = frequent_phrases(pieces, max_words, min_count)
    blanks = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit("")))
    totals = pieces.groupBy("lang").agg(F.sum((blanks + 1) * F.col("weight")).alias("n"))
    known = frequent[0]
    for found in frequent[1:]:
        known = known.union(found)
    candidates = frequent[1]
    for found in frequent[2:]:
        candidates = candidates.union(found)
    scored = _scored(candidates, known)
    for length in range(3, max_words + 1):
        around = _holders(frequent[length - 1], length)
        scored = scored.join(around, ["lang", "phrase"], "left")
        small = F.col("around").isNull() | (100 * F.col("around") < contained * F.col("a"))
        scored = scored.where(small).drop("around")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = number_rows(scored, ["lang"], order, "rank").where(F.col("rank") <= top)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return ranked.join(stored(totals, "language-words"), "lang").select(*names)
