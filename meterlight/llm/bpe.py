"""Byte-level BPE: a lexicon of frequent pieces as a minimal transducer, exact merges for the rest.

All texts are cut into pieces and the pieces counted in Spark. The most frequent ones are encoded
once and compiled, with their token ids, into a minimal acyclic transducer that executors map into
memory. A task looks up the distinct pieces of a batch by walking the transducer; pieces it lacks
are merged by the tokenizer's own rules. Results do not depend on which pieces the lexicon holds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.array_file import received_arrays, send_arrays
from meterlight.llm.arrow_text import list_column, map_batches, parts, spread, text_bytes
from meterlight.llm.pieces import class_table, cut_pieces, distinct_pieces
from meterlight.llm.stored import stored
from meterlight.llm.transducer import build_transducer, walk

LEXICON_PIECES = 150_000
LEXICON_BYTES = 24
SHORT_PIECE = 32
FLUSH_PIECES = 300_000
TEXT_BYTES = 4 << 20
_NONE = np.iinfo(np.int32).max


def _byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in own]
    chars = {byte: chr(byte) for byte in own}
    chars |= {byte: chr(256 + k) for k, byte in enumerate(others)}
    return [chars[byte] for byte in range(256)]


def tokenizer_arrays(path: str) -> dict[str, np.ndarray]:
    """Merge rules, token bytes, the special token and character classes of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    vocab = described["model"]["vocab"]
    chars = _byte_chars()
    byte_of = {char: byte for byte, char in enumerate(chars)}
    added = {token["id"]: token["content"] for token in described["added_tokens"]}
    if len(added) != 1:
        raise ValueError("a tokenizer with one added token is needed")
    special = next(iter(added))
    tokens = [b""] * (max([*vocab.values(), special]) + 1)
    for token, id in vocab.items():
        tokens[id] = bytes(byte_of[char] for char in token)
    tokens[special] = added[special].encode()
    rules = [rule.split(" ") if isinstance(rule, str) else rule for rule in described["model"]["merges"]]
    pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in rules], np.int64)
    merged = np.array([vocab[a + b] for a, b in rules], np.int32)
    order = np.argsort(pairs, kind="stable")
    return {
        "byte_ids": np.array([vocab[char] for char in chars], np.int32),
        "pairs": pairs[order],
        "ranks": order.astype(np.int32),
        "merged": merged[order],
        "token_bytes": np.frombuffer(b"".join(tokens), np.uint8),
        "token_lengths": np.array([len(token) for token in tokens], np.int64),
        "special": np.array([special], np.int64),
        "classes": class_table(path),
    }


def special_bytes(model: dict[str, np.ndarray]) -> bytes:
    id = int(model["special"][0])
    end = int(model["token_lengths"][: id + 1].sum())
    return model["token_bytes"][end - int(model["token_lengths"][id]) : end].tobytes()


def _rank_of(model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each pair of neighbours, and its place among the rules; no rule: the last rank."""
    wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
    at = np.minimum(np.searchsorted(model["pairs"], wanted), len(model["pairs"]) - 1)
    known = (model["pairs"][at] == wanted) & (left >= 0) & (right >= 0)
    return np.where(known, model["ranks"][at], _NONE), at


def _merge_short(model, data, begins, ends) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many short pieces at once: a round merges each piece's leftmost best pair."""
    length = ends - begins
    width = int(length.max())
    rows = np.arange(len(begins))
    ids = np.full((len(begins), width + 1), -1, np.int32)
    inside = np.arange(width) < length[:, None]
    ids[:, :width][inside] = model["byte_ids"][data[spread(begins, length)]]
    after = np.tile(np.arange(1, width + 2), (len(begins), 1))
    before = np.tile(np.arange(-1, width), (len(begins), 1))
    ranks = np.full((len(begins), width + 1), _NONE, np.int32)
    if width > 1:
        ranks[:, : width - 1], _ = _rank_of(model, ids[:, : width - 1], ids[:, 1:width])
    while len(rows):
        best = ranks[rows].argmin(axis=1)
        rows, best = (x[ranks[rows, best] < _NONE] for x in (rows, best))
        if not len(rows):
            break
        right = after[rows, best]
        _, at = _rank_of(model, ids[rows, best], ids[rows, right])
        ids[rows, best] = model["merged"][at]
        ids[rows, right] = -1
        ranks[rows, right] = _NONE
        follows = after[rows, right]
        after[rows, best] = follows
        held = follows <= width
        before[rows[held], follows[held]] = best[held]
        ranks[rows, best], _ = _rank_of(
            model, ids[rows, best], ids[rows, np.minimum(follows, width)]
        )
        left = before[rows, best]
        has = left >= 0
        some, left = rows[has], left[has]
        ranks[some, left], _ = _rank_of(model, ids[some, left], ids[some, best[has]])
    there = ids >= 0
    return ids[there], there.sum(axis=1)


def _merge_long(model, piece: bytes) -> list[int]:
    """Token ids of one long piece: best pairs come from a heap, the leftmost first."""
    ids = [int(id) for id in model["byte_ids"][np.frombuffer(piece, np.uint8)]]
    after = [*range(1, len(ids)), -1]
    before = list(range(-1, len(ids) - 1))
    pairs, ranks, merged = model["pairs"], model["ranks"], model["merged"]
    known: dict[int, tuple[int, int] | None] = {}

    def rule(a: int, b: int) -> tuple[int, int] | None:
        key = a << 32 | b
        if key not in known:
            at = int(np.searchsorted(pairs, key))
            there = at < len(pairs) and pairs[at] == key
            known[key] = (int(ranks[at]), int(merged[at])) if there else None
        return known[key]

    heap = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] >= 0 and (found := rule(ids[at], ids[after[at]])):
            heapq.heappush(heap, (found[0], at, ids[at], ids[after[at]], found[1]))

    for at in range(len(ids) - 1):
        offer(at)
    while heap:
        _, at, left, right, new = heapq.heappop(heap)
        other = after[at]
        if ids[at] != left or other < 0 or ids[other] != right:
            continue
        ids[at], ids[other] = new, -1
        after[at] = after[other]
        if after[at] >= 0:
            before[after[at]] = at
        offer(at)
        offer(before[at])
    return [id for id in ids if id >= 0]


def merge_pieces(model, data, begins, ends) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces in a row, and how many each has."""
    counts = np.zeros(len(begins), np.int64)
    length = ends - begins
    found: list[tuple[np.ndarray, np.ndarray]] = []
    edges = (1, 6, 10, 16, SHORT_PIECE)
    for low, high in zip((0, *edges), edges, strict=False):
        rows = np.flatnonzero((length > low) & (length <= high))
        for part in np.array_split(rows, max(1, len(rows) >> 16)):
            if len(part):
                ids, counts[part] = _merge_short(model, data, begins[part], ends[part])
                found.append((part, ids))
    for row in np.flatnonzero(length > SHORT_PIECE):
        ids = np.array(_merge_long(model, data[begins[row] : ends[row]].tobytes()), np.int32)
        counts[row] = len(ids)
        found.append((np.array([row]), ids))
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int32)
    for rows, ids in found:
        out[spread(first[rows], counts[rows])] = ids
    return out, counts


def encode_batch(model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in a row, and how many each text has."""
    data, offsets = text_bytes(column)
    begins, ends, special = cut_pieces(data, offsets, model["classes"], special_bytes(model))
    if not len(begins):
        return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
    codes, places = distinct_pieces(data, begins, ends)
    first, last = begins[places], ends[places]
    entry = walk(model, data, first, last)
    entry[special[places]] = -1
    counts = np.where(entry >= 0, model["entry_lengths"][entry], 0)
    unseen = np.flatnonzero((entry < 0) & ~special[places])
    merged, counts[unseen] = merge_pieces(model, data, first[unseen], last[unseen])
    counts[special[places]] = 1
    starts = np.cumsum(counts) - counts
    ids = np.full(int(counts.sum()), model["special"][0], np.int32)
    seen = np.flatnonzero(entry >= 0)
    ids[spread(starts[seen], counts[seen])] = model["entry_ids"][
        spread(model["entry_starts"][entry[seen]], counts[seen])
    ]
    ids[spread(starts[unseen], counts[unseen])] = merged
    per_piece = counts[codes]
    total = np.concatenate([[0], np.cumsum(per_piece)])
    per_text = np.diff(total[np.searchsorted(begins, offsets)])
    return ids[spread(starts[codes], per_piece)], per_text


def decode_batch(model, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The text of each run of token ids; bytes that are no UTF-8 become U+FFFD."""
    lengths = model["token_lengths"]
    starts = np.cumsum(lengths) - lengths
    took = lengths[ids]
    data = model["token_bytes"][spread(starts[ids], took)]
    total = np.concatenate([[0], np.cumsum(took)])
    borders = total[np.concatenate([[0], np.cumsum(counts)])]
    return [
        data[b:e].tobytes().decode("utf-8", "replace")
        for b, e in zip(borders[:-1], borders[1:], strict=True)
    ]


def piece_counts(docs: DataFrame, text: str, classes: bytes, special: bytes) -> DataFrame:
    """How often each piece of up to ``LEXICON_BYTES`` bytes occurs in all texts: piece, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(classes), np.uint8)
        held: dict[bytes, int] = {}
        for batch in batches:
            for part in parts(batch, "_text", TEXT_BYTES):
                data, offsets = text_bytes(part.column(0))
                begins, ends, _ = cut_pieces(data, offsets, table, special)
                codes, places = distinct_pieces(data, begins, ends)
                often = np.bincount(codes, minlength=len(places)).tolist()
                raw = data.tobytes()
                for b, e, n in zip(
                    begins[places].tolist(), ends[places].tolist(), often, strict=True
                ):
                    if e - b <= LEXICON_BYTES:
                        piece = raw[b:e]
                        held[piece] = held.get(piece, 0) + n
                if len(held) > FLUSH_PIECES:
                    yield _counted(held)
                    held = {}
        yield _counted(held)

    rows = docs.select(docs[text].alias("_text"))
    return (
        map_batches(rows, count, "piece binary, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
    )


def _counted(held: dict[bytes, int]) -> pa.RecordBatch:
    columns = [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["piece", "n"])


def lexicon_arrays(model: dict[str, np.ndarray], pieces: Sequence[bytes]) -> dict[str, np.ndarray]:
    """The transducer of the pieces, and each entry's token ids."""
    special = special_bytes(model)
    pieces = sorted({p for p in pieces if p and p != special and b"\0" not in p})
    data = np.frombuffer(b"".join(pieces), np.uint8)
    length = np.array([len(piece) for piece in pieces], np.int64)
    ends = np.cumsum(length)
    ids, counts = merge_pieces(model, data, ends - length, ends)
    automaton = build_transducer(pieces)
    if not np.array_equal(walk(automaton, data, ends - length, ends), np.arange(len(pieces))):
        raise AssertionError("the transducer does not give each piece its own entry")
    return automaton | {
        "entry_ids": ids,
        "entry_lengths": np.append(counts, 0),
        "entry_starts": np.append(np.cumsum(counts) - counts, 0),
    }


def build_lexicon(
    docs: DataFrame, tokenizer: str, text: str = "text", pieces: int = LEXICON_PIECES
) -> str:
    """Compile the corpus's most frequent pieces and send the file to all executors.

    Counts cover all texts. The driver gets the most frequent ones of up to 24 bytes, ``pieces`` of
    them at most, a few megabytes at any size of the corpus. Returns the file's name on the
    executors.
    """
    model = tokenizer_arrays(tokenizer)
    classes = zlib.compress(model["classes"].tobytes())
    counted = piece_counts(docs, text, classes, special_bytes(model)).where("n > 1")
    counted = stored(counted.withColumn("size", F.floor(F.log2("n") * 16).cast("int")), "pieces")
    # A few hundred sizes, each about 4 percent above the one before.
    sizes = counted.groupBy("size").agg(F.count(F.lit(1)).alias("pieces")).collect()
    least, held = 0, 0
    for row in sorted(sizes, key=lambda row: -row["size"]):
        held += row["pieces"]
        if held > pieces:
            least = row["size"] + 1
            break
    frequent = counted.where(F.col("size") >= least).select("piece").collect()
    arrays = model | lexicon_arrays(model, [bytes(row["piece"]) for row in frequent])
    return send_arrays(docs.sparkSession, "bpe-lexicon", arrays)


def encode(docs: DataFrame, lexicon: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_tokens and the token ids of the whole text.

    Ids are those of the tokenizer file with no special tokens added; the special token's own
    string in a text becomes its id. Null and empty texts have no ids, repeated rows are encoded
    each, an empty table gives an empty result. Only ``id`` and ``text`` are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received_arrays(lexicon)
        for batch in batches:
            for part in parts(batch, "_text", TEXT_BYTES):
                ids, counts = encode_batch(model, part.column(1))
                columns = [part.column(0), pa.array(counts), list_column(ids, counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_tokens", "ids"])

    rows = docs.select(docs[id].alias("_id"), docs[text].alias("_text"))
    schema = f"_id {dict(docs.dtypes)[id]}, n_tokens long, ids array<int>"
    return map_batches(rows, run, schema).withColumnRenamed("_id", id)


def decode(encoded: DataFrame, lexicon: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: the id and the text of its token ids; null counts as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received_arrays(lexicon)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            counts = np.diff(lists.offsets.to_numpy())
            texts = decode_batch(model, lists.flatten().to_numpy(), counts)
            columns = [batch.column(0), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "text"])

    rows = encoded.select(encoded[id].alias("_id"), encoded[ids].alias("_ids"))
    schema = f"_id {dict(encoded.dtypes)[id]}, text string"
    return map_batches(rows, run, schema).withColumnRenamed("_id", id)


def round_trip(docs: DataFrame, lexicon: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text: id, n_tokens, ids, ids_sha256 and decoded_sha256.

    As ``decode(encode(docs))``, but the decoded text does not leave the task. Digests are of the
    ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received_arrays(lexicon)
        for batch in batches:
            for part in parts(batch, "_text", TEXT_BYTES):
                ids, counts = encode_batch(model, part.column(1))
                texts = decode_batch(model, ids, counts)
                ends = np.cumsum(counts)
                flat = ids.astype("<u4")
                digests = [
                    hashlib.sha256(flat[e - n : e]).hexdigest()
                    for e, n in zip(ends.tolist(), counts.tolist(), strict=True)
                ]
                decoded = [hashlib.sha256(text.encode()).hexdigest() for text in texts]
                columns = [part.column(0), pa.array(counts), list_column(ids, counts)]
                columns += [pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    rows = docs.select(docs[id].alias("_id"), docs[text].alias("_text"))
    schema = (
        f"_id {dict(docs.dtypes)[id]}, n_tokens long, ids array<int>,"
        " ids_sha256 string, decoded_sha256 string"
    )
    return map_batches(rows, run, schema).withColumnRenamed("_id", id)
