"""Language of a text: unigram piece models, summed over all segmentations.

A word is a run of letters, lower-cased, with a blank before it. Per language every piece of a fixed
public vocabulary has a probability; the probability of a word is the sum over all ways of cutting
it into pieces, found by the forward algorithm. Expectation maximisation over the words of a bounded
sample fits the pieces' probabilities; languages do not depend on each other and are fitted some at a
time. A text's languages are weighed by the product over its words.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlight.llm.array_file import received_arrays, send_arrays
from meterlight.llm.arrow_text import map_batches, parts, runs, text_bytes
from meterlight.llm.pieces import distinct_pieces
from meterlight.llm.stored import stored
from meterlight.llm.transducer import build_transducer

# A language learns from about so many texts, the last of which begins within so many bytes.
TRAIN_DOCS = 1000
TRAIN_BYTES = 4 << 20
LANGUAGES_AT_ONCE = 8
FOLDS = 3
HELD_OUT_FOLD = 1
UNKNOWN = "und"
# Longer words are summed by logarithms, some places at a time.
WORD_BYTES = 32
ROUNDS = 3
CHUNK = 16_384
CELLS = 1 << 21
FLOOR = 1e-7
# More languages than this are looked up in a table instead of an expression.
NAMED_LANGUAGES = 500
_SCALE = 1 << 30

_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[128:] = True


def held_out(id: Column) -> Column:
    """Whether a document never trains: by the CRC-32 of its id as text; a null id never does."""
    fold = F.crc32(id.cast("string")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(True))


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model that can stand in a lower-case word, as bytes.

    A piece's word mark is a blank. Every single byte is a piece too, so every word has a
    segmentation.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {bytes([byte]) for byte in range(1, 256)}
    for id in range(model.get_piece_size()):
        if model.is_control(id) or model.is_unknown(id) or model.is_byte(id):
            continue
        piece = model.id_to_piece(id).replace("▁", " ").encode()
        inside = piece.removeprefix(b" ")
        if all(_LETTER[byte] for byte in inside):
            pieces.add(piece)
    return sorted(pieces)


def spelled_words(
    column: pa.Array, most: int | None = WORD_BYTES - 1
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with a blank before each word, begin and end of each word, and each text's first word.

    Longer words are cut every ``most`` bytes; None, as the models have it, leaves all words whole.
    """
    data, offsets = text_bytes(pc.utf8_lower(column))
    begins, ends = runs(_LETTER[data], offsets)
    step = len(data) if most is None else most
    long = np.flatnonzero(ends - begins > step)
    if len(long):
        more = [np.arange(begins[k] + step, ends[k], step) for k in long]
        begins = np.sort(np.concatenate([begins, *more]))
        ends = np.minimum(ends[np.searchsorted(ends, begins, side="right")], begins + step)
    length = ends - begins
    total = np.cumsum(length + 1)
    starts = total - length - 1
    out = np.full(int(total[-1]) if len(total) else 0, ord(" "), np.uint8)
    inside = np.repeat(starts + 1 - (np.cumsum(length) - length), length) + np.arange(length.sum())
    from_place = np.repeat(begins - (np.cumsum(length) - length), length) + np.arange(length.sum())
    out[inside] = data[from_place]
    return out, starts, total, np.searchsorted(begins, offsets)


@dataclass
class Lattice:
    """All pieces in some words: where each begins and ends within which word."""

    words: int
    width: int
    length: np.ndarray  # of each word
    steps: list[tuple[int, int, np.ndarray, np.ndarray]]  # begin, size, words, pieces


def pieces_at(
    automaton, data: np.ndarray, places: np.ndarray, ends: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size by size, which of the places begin a piece that ends by their word's end, and the piece."""
    keys, targets, outputs = automaton["keys"], automaton["targets"], automaton["outputs"]
    final = automaton["final"]
    left = np.arange(len(places))
    state = np.full(len(left), len(final) - 1, np.int64)
    number = np.zeros(len(left), np.int64)
    size = 0
    while True:
        inside = ends[left] > places[left] + size
        left, state, number = left[inside], state[inside], number[inside]
        if not len(left):
            return
        key = state * 256 + data[places[left] + size]
        size += 1
        edge = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[edge] == key
        left, edge = left[there], edge[there]
        number = number[there] + outputs[edge]
        state = targets[edge].astype(np.int64)
        done = final[state]
        if done.any():
            yield size, left[done], number[done]


def lattice(automaton, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Lattice:
    """Walk the vocabulary's transducer from every place of every word."""
    length = ends - begins
    width = int(length.max(initial=0))
    steps = []
    for place in range(width):
        left = np.flatnonzero(length > place)
        for size, rows, pieces in pieces_at(automaton, data, begins[left] + place, ends[left]):
            steps.append((place, size, left[rows], pieces))
    return Lattice(len(begins), width, length, steps)


def forward(net: Lattice, chances: np.ndarray) -> np.ndarray:
    """Per word, place and language: the chance of all segmentations up to that place."""
    alpha = np.zeros((net.width + 1, net.words, chances.shape[1]))
    alpha[0] = 1
    for place, size, words, pieces in net.steps:
        alpha[place + size, words] += alpha[place, words] * chances[pieces]
    return alpha


class Block:
    """The pieces that begin at the next places of some long words, and the log chances up to there.

    ``carry`` has the log chances that earlier pieces have brought to the first places. ``alpha`` is
    final for the block's places and the one after them, and goes on as far as its pieces reach.
    """

    def __init__(self, automaton, logs, data, begins, ends, carry):
        self.logs, self.left = logs, ends - begins
        words, langs = len(begins), logs.shape[1]
        self.places = int(min(self.left.max(), max(1, CELLS // (words * langs))))
        count = np.minimum(self.left, self.places)
        word = np.repeat(np.arange(words), count)
        place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        found = list(pieces_at(automaton, data, begins[word] + place, ends[word]))
        at = np.concatenate([rows for _, rows, _ in found])
        order = np.argsort(place[at], kind="stable")
        at = at[order]
        self.word, self.place = word[at], place[at]
        self.size = np.concatenate([np.full(len(rows), size) for size, rows, _ in found])[order]
        self.piece = np.concatenate([pieces for _, _, pieces in found])[order]
        self.bounds = np.searchsorted(self.place, np.arange(self.places + 1))
        rows = max(self.places + int(self.size.max()) + 1, len(carry))
        self.alpha = np.full((rows, words, langs), -np.inf)
        self.alpha[: len(carry)] = carry
        for at in range(self.places):
            held, word, to = self._from(at)
            own = self.alpha[at, word] + logs[self.piece[held]]
            self.alpha[to, word] = np.logaddexp(self.alpha[to, word], own)

    def _from(self, place: int) -> tuple[slice, np.ndarray, np.ndarray]:
        held = slice(self.bounds[place], self.bounds[place + 1])
        return held, self.word[held], place + self.size[held]

    @property
    def done(self) -> np.ndarray:
        """Which words end in this block."""
        return self.left <= self.places

    def whole(self) -> np.ndarray:
        """The log chances of the words that end here."""
        return self.alpha[self.left[self.done], np.flatnonzero(self.done)]

    def backward(self, after: np.ndarray | None) -> np.ndarray:
        """From each place the log chances of the rest of the word; ``after`` is the next block's."""
        beta = np.full(self.alpha.shape, -np.inf)
        if after is not None:
            beta[self.places :, ~self.done] = after[: len(beta) - self.places]
        beta[self.left[self.done], np.flatnonzero(self.done)] = 0
        for at in reversed(range(self.places)):
            held, word, to = self._from(at)
            np.logaddexp.at(beta[at], word, self.logs[self.piece[held]] + beta[to, word])
        return beta


def _blocks(automaton, logs, data, begins, ends) -> Iterator[tuple[np.ndarray, int, np.ndarray, Block]]:
    """The blocks of some long words: the words in it, its first place, its carry and itself."""
    words, low = np.arange(len(begins)), 0
    carry = np.zeros((1, len(words), logs.shape[1]))
    while len(words):
        block = Block(automaton, logs, data, begins[words] + low, ends[words], carry)
        yield words, low, carry, block
        carry = block.alpha[block.places :, ~block.done]
        words, low = words[~block.done], low + block.places


def _by_length(length: np.ndarray, langs: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of short and of long words, each in groups of about one length."""
    order = np.argsort(length, kind="stable")
    short = np.searchsorted(length[order], WORD_BYTES, side="right")
    most = min(CHUNK, max(1, CELLS // (WORD_BYTES * langs)))
    return tuple(
        np.array_split(rows, -(-len(rows) // most)) if len(rows) else []
        for rows in (order[:short], order[short:])
    )


def word_chances(automaton, chances, data, begins, ends) -> np.ndarray:
    """The log chance of each word in each language."""
    out = np.zeros((len(begins), chances.shape[1]))
    short, long = _by_length(ends - begins, chances.shape[1])
    for rows in short:
        net = lattice(automaton, data, begins[rows], ends[rows])
        alpha = forward(net, chances)
        out[rows] = np.log(alpha[net.length, np.arange(len(rows))])
    logs = np.log(chances) if long else None
    for rows in long:
        for words, _, _, block in _blocks(automaton, logs, data, begins[rows], ends[rows]):
            out[rows[words[block.done]]] = block.whole()
    return out


def _expect_long(automaton, logs, data, begins, ends, counts, expected) -> None:
    """Add how often each piece is expected in some long words; blocks are made again backwards."""
    whole = np.zeros(counts.shape)
    held = []
    for words, low, carry, block in _blocks(automaton, logs, data, begins, ends):
        whole[words[block.done]] = block.whole()
        held.append((words, low, carry.copy()))
    beta = None
    for words, low, carry in reversed(held):
        block = Block(automaton, logs, data, begins[words] + low, ends[words], carry)
        beta = block.backward(beta)
        word, place = block.word, block.place
        rest = logs[block.piece] + beta[place + block.size, word] - whole[words[word]]
        gained = np.exp(block.alpha[place, word] + rest) * counts[words[word]]
        for k in range(gained.shape[1]):
            expected[:, k] += np.bincount(block.piece, gained[:, k], len(expected))


def fit_pieces(
    automaton, pieces: int, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS
) -> np.ndarray:
    """The chance of each piece in each language, by expectation maximisation.

    ``counts`` says how often each word occurs in each language. Every round adds half an occurrence
    to each piece, so that no piece is impossible.
    """
    chances = np.full((pieces, counts.shape[1]), 1 / pieces)
    data = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(word) for word in words], np.int64)
    ends = np.cumsum(length)
    begins = ends - length
    short, long = _by_length(length, max(1, counts.shape[1]))
    nets = [(rows, lattice(automaton, data, begins[rows], ends[rows])) for rows in short]
    for _ in range(rounds):
        expected = np.full(chances.shape, 0.5)
        for rows, net in nets:
            alpha = forward(net, chances)
            beta = np.zeros_like(alpha)
            beta[net.length, np.arange(net.words)] = 1
            whole = alpha[net.length, np.arange(net.words)]
            weight = counts[rows] / whole
            for place, size, held, numbers in reversed(net.steps):
                behind = chances[numbers] * beta[place + size, held]
                beta[place, held] += behind
                gained = alpha[place, held] * behind * weight[held]
                for k in range(gained.shape[1]):
                    expected[:, k] += np.bincount(numbers, gained[:, k], pieces)
        logs = np.log(chances) if long else None
        for rows in long:
            _expect_long(automaton, logs, data, begins[rows], ends[rows], counts[rows], expected)
        chances = np.maximum(expected / expected.sum(axis=0), FLOOR)
    return chances


def _sample(docs: DataFrame, id: str, text: str, lang: str, most: int) -> DataFrame:
    """``_lang`` and ``_text`` of about ``most`` training texts of each language.

    The texts with the smallest hashes of their ids are taken, until they pass ``TRAIN_BYTES``; a
    language has one at least. Rows that repeat id, language and text count once.
    """
    known = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(id))).select(
        F.col(lang).alias("_lang"),
        F.col(text).alias("_text"),
        F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(_SCALE)).alias("_mark"),
    )
    # Twice the share, and the smallest hash at least, so that no language is missed.
    share = F.greatest(F.least(F.lit(_SCALE), F.expr(f"{2 * _SCALE * most}L div _docs")), F.col("_least") + 1)
    sizes = known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_docs"), F.min("_mark").alias("_least"))
    shares = stored(sizes.select("_lang", share.alias("_share")), "language-shares")
    named = shares.limit(NAMED_LANGUAGES + 1).collect()
    if len(named) > NAMED_LANGUAGES:
        chosen = known.join(shares, "_lang").where(F.col("_mark") < F.col("_share"))
    else:
        some = F.lit(False)
        for row in named:
            some = some | ((F.col("_lang") == row["_lang"]) & (F.col("_mark") < row["_share"]))
        chosen = known.where(some)
    chosen = chosen.select("_lang", "_text", "_mark").distinct()
    before = Window.partitionBy("_lang").orderBy("_mark", "_text").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.octet_length("_text")).over(before), F.lit(0))
    taken = F.count(F.lit(1)).over(before)
    chosen = chosen.withColumns({"_held": held, "_taken": taken})
    return chosen.where((F.col("_held") < TRAIN_BYTES) & (F.col("_taken") < most)).select("_lang", "_text")


def _word_counts(sample: DataFrame) -> DataFrame:
    """``lang``, ``word`` and ``n``: how often each word occurs in each language of the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text"):
                data, begins, ends, first = spelled_words(part.column(1), None)
                codes, places = distinct_pieces(data, begins, ends)
                raw = data.tobytes()
                spelled = [raw[begins[k] : ends[k]] for k in places]
                langs = part.column(0).to_pylist()
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                names = sorted(set(langs))
                which = np.array([names.index(lang) for lang in langs])[owner]
                for k, name in enumerate(names):
                    often = np.bincount(codes[which == k], minlength=len(places))
                    rows = np.flatnonzero(often)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(rows), pa.string()),
                            pa.array([spelled[row] for row in rows], pa.binary()),
                            pa.array(often[rows]),
                        ],
                        names=["lang", "word", "n"],
                    )

    counted = map_batches(sample, count, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit_languages(
    docs: DataFrame,
    vocabulary_path: str,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    most: int = TRAIN_DOCS,
) -> str:
    """Fit one piece model per language and send them to all executors; returns the file's name.

    Learns from the text of at most ``most`` documents and about ``TRAIN_BYTES`` per language outside
    the held-out fold, chosen by a hash of the id. The driver gets the words of eight languages at a
    time with their counts, and the list of all languages. Rows without a language, and languages
    without a word, teach nothing; an empty string is a language. An empty table gives a model
    without languages.
    """
    counted = _word_counts(_sample(docs, id, text, lang, most))
    counted = stored(counted, "language-words")
    langs = sorted(row["lang"] for row in counted.select("lang").distinct().collect())
    pieces = vocabulary(vocabulary_path)
    automaton = build_transducer(pieces)
    chances = [np.zeros((len(pieces), 0))]
    for at in range(0, len(langs), LANGUAGES_AT_ONCE):
        some = langs[at : at + LANGUAGES_AT_ONCE]
        rows = counted.where(F.col("lang").isin(some)).orderBy("word", "lang").toArrow().combine_chunks()
        words = rows["word"].cast(pa.large_binary()).dictionary_encode().combine_chunks()
        column = {name: k for k, name in enumerate(some)}
        counts = np.zeros((len(words.dictionary), len(some)))
        place = words.indices.to_numpy(zero_copy_only=False)
        counts[place, [column[name] for name in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
        chances.append(fit_pieces(automaton, len(pieces), words.dictionary.to_pylist(), counts))
    names = np.frombuffer(json.dumps(langs).encode(), np.uint8)
    arrays = automaton | {"chances": np.hstack(chances), "langs": names}
    return send_arrays(docs.sparkSession, "language-model", arrays)


def _scores(model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text, and its share; some distinct words at a time."""
    langs = json.loads(model["langs"].tobytes())
    data, begins, ends, first = spelled_words(column, None)
    total = np.zeros((len(column), len(langs)))
    if not langs:
        return [UNKNOWN] * len(column), np.zeros(len(column))
    if len(begins):
        codes, places = distinct_pieces(data, begins, ends)
        owner = np.repeat(np.arange(len(column)), np.diff(first))
        order = np.argsort(codes, kind="stable")
        step = max(1, 4 * CELLS // len(langs))
        for low in range(0, len(places), step):
            some = places[low : low + step]
            chance = word_chances(model, model["chances"], data, begins[some], ends[some])
            rows = order[slice(*np.searchsorted(codes[order], [low, low + len(some)]))]
            for k in range(len(langs)):
                total[:, k] += np.bincount(owner[rows], chance[codes[rows] - low, k], len(column))
    best = total.argmax(axis=1)
    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [langs[k] for k in best], share


def _has_letter(column: pa.Array) -> np.ndarray:
    ascii_letter = pc.match_substring_regex(column, "[A-Za-z]").to_pylist()
    texts = column.to_pylist()
    return np.array(
        [bool(a) or any(c.isalpha() for c in t or "") for a, t in zip(ascii_letter, texts, strict=True)],
        bool,
    )


def predict_languages(
    docs: DataFrame, model: str, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, lang_pred and score (0 to 1).

    Whole texts are scored, without a shuffle. The score is the language's share among all learned
    ones. A text that is null or has no letter is ``und`` with score 0, and so is every text if no
    language was learned. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = received_arrays(model)
        for batch in batches:
            for part in parts(batch, "_text"):
                langs, share = _scores(arrays, part.column(1))
                there = _has_letter(part.column(1)) & (arrays["chances"].shape[1] > 0)
                found = [name if ok else UNKNOWN for name, ok in zip(langs, there, strict=True)]
                columns = [part.column(0), pa.array(found, pa.string())]
                columns.append(pa.array(np.where(there, share, 0.0)))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "lang_pred", "score"])

    rows = docs.select(docs[id].alias("_id"), docs[text].alias("_text"))
    schema = f"_id {dict(docs.dtypes)[id]}, lang_pred string, score double"
    scored = map_batches(rows, run, schema)
    return scored.select(
        F.col("_id").alias(id), held_out(F.col("_id")).alias("held_out"), "lang_pred", "score"
    )
