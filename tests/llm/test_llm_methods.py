"""The operators' cores, without Spark, against plain versions."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.brute_force import base_spans, items_in, shingles, words

from meterlight.llm import bpe, decontaminate, jaccard_join, langid, pii
from meterlight.llm.additive_model import fit
from meterlight.llm.arrow_text import parts, text_bytes
from meterlight.llm.dac import Dac, pack
from meterlight.llm.license_scan import notice_words, probes
from meterlight.llm.license_texts import NOTICES
from meterlight.llm.pieces import distinct_pieces
from meterlight.llm.text_features import FEATURES, features
from meterlight.llm.transducer import build_transducer, walk

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcdeXYZ '\t\n\r 012½²#$%.,!é日本　\xa0\x85\x1c\x00ﬁ𝒳🙂" + "'strevmld" * 2


def odd_texts():
    rng = random.Random(1)
    made = ["".join(rng.choices(LETTERS, k=rng.randrange(60))) for _ in range(1500)]
    made += ["don't we'll I'd'd 's's '' 'sabc they're're", "", None, "  ", "\n\n a", "a  \n"]
    made += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|it's"]
    made += ["x" * 5000, "ab" * 700 + " " * 50 + "!" * 333, "日本" * 400]
    return made


@pytest.fixture(scope="module")
def model():
    return bpe.tokenizer_arrays(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("size", [0, 3, 2000])
def test_bpe_is_that_of_the_library_whatever_the_lexicon_holds(model, library, size):
    texts = odd_texts()
    pieces = Counter(
        piece.encode()
        for text in texts
        for piece in (text or "").replace("  ", " ").split("\n")
        if 0 < len(piece.encode()) <= bpe.LEXICON_BYTES
    )
    whole = model | bpe.lexicon_arrays(model, [p for p, _ in pieces.most_common(size)])
    ids, counts = bpe.encode_batch(whole, pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    decoded = bpe.decode_batch(whole, ids, counts)
    for text, end, count, back in zip(texts, ends, counts, decoded, strict=True):
        assert ids[end - count : end].tolist() == library.encode(text or "", add_special_tokens=False).ids
        assert back == (text or "")


def test_decoding_loose_tokens_matches_the_library(model, library):
    rng = np.random.default_rng(3)
    for _ in range(50):
        ids = rng.integers(0, len(model["token_lengths"]), 12)
        assert bpe.decode_batch(model, ids, np.array([12])) == [
            library.decode(ids.tolist(), skip_special_tokens=False)
        ]


def test_transducer_is_minimal_and_numbers_its_strings():
    rng = random.Random(5)
    strings = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 7))).encode() for _ in range(300)})
    automaton = build_transducer(strings)
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    begins = ends - [len(s) for s in strings]
    assert walk(automaton, data, begins, ends).tolist() == list(range(len(strings)))
    prefixes = {s[:k] for s in strings for k in range(len(s) + 1)}
    rights = {frozenset(s[len(p) :] for s in strings if s.startswith(p)) for p in prefixes}
    assert len(automaton["final"]) == len(rights)
    others = [b"a" * 9, b"zz", strings[0] + b"c" * 7]
    data = np.frombuffer(b"".join(others), np.uint8)
    ends = np.cumsum([len(s) for s in others])
    assert (walk(automaton, data, ends - [len(s) for s in others], ends) == -1).all()
    assert walk(build_transducer([]), data, np.array([0]), np.array([3])).tolist() == [-1]


def test_equal_pieces_are_found_also_when_hashes_collide(monkeypatch):
    data, _ = text_bytes(pa.array(["ab" * 3 + "cd"]))
    begins, ends = np.arange(0, 8, 2), np.arange(2, 9, 2)
    expected = distinct_pieces(data, begins, ends)[0].tolist()
    monkeypatch.setattr("meterlight.llm.pieces.hash_spans", lambda d, b, e: np.zeros(len(b), np.uint64))
    assert distinct_pieces(data, begins, ends)[0].tolist() == expected == [0, 0, 0, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_give_back_all_numbers_and_each_one(numbers):
    codes = Dac(pack(np.array(numbers, np.uint32)))
    assert codes.all().tolist() == numbers
    assert len(codes) == len(numbers)
    for place in range(0, len(numbers), 7):
        assert codes[place] == numbers[place]
    with pytest.raises(IndexError):
        codes[len(numbers)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1290.@+-_ ()%é", max_size=60))
def test_base_spans_follow_the_patterns(text):
    found = [s for s in pii.find_spans(text) if s.kind in pii.BASE_KINDS]
    assert pii.joined(found) == base_spans(text)


def test_personal_data_of_each_kind_with_checksums_and_context():
    text = (
        "mail a.b@example.org or 10.0.0.255, card 4111 1111 1111 1111 not 4111 1111 1111 1112, "
        "+1 (555) 123-4567, GB82 WEST 1234 5698 7654 32 not GB83 WEST 1234 5698 7654 32, ssn 123-45-6789"
    )
    kinds = Counter(span.kind for span in pii.find_spans(text))
    assert kinds == {"email": 1, "ip": 1, "card": 1, "phone": 1, "iban": 1, "ssn": 1}
    assert not pii.find_spans("order 123-45-6789")
    assert pii.redact("to a@b.c now", pii.find_spans("to a@b.c now")) == "to [email] now"
    assert pii.find_spans(None) == pii.find_spans("") == []
    assert pii.joined(pii.find_spans("0" * 6000 + ".1.2.3")).startswith("ip:0:6006")


def test_items_are_found_as_by_trying_every_window():
    rng = random.Random(3)
    lexicon = [f"w{k}" for k in range(400)] + ["the", "of"] * 40
    items = [" ".join(rng.choices(lexicon, k=rng.choice([1, 3, 5, 8, 15, 30, 59, 140]))) for _ in range(60)]
    texts = [None, "", "the"]
    for _ in range(400):
        own = rng.choice(items).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            at = rng.randrange(len(own))
            own[at : at + rng.choice([0, 1])] = [rng.choice(lexicon)] * rng.choice([0, 1])
            own = own or ["x"]
        before, after = (rng.choices(lexicon, k=rng.choice([0, 3, 60])) for _ in range(2))
        texts.append(" ".join(before + own + after))
    index = decontaminate.build_items(list(range(len(items))), items)
    found = decontaminate.find_items(index, pa.array(texts, pa.string()))
    expected = items_in(texts, items)
    assert {(t, i): round(v, 9) for t, i, v, _ in found} == {k: round(v, 9) for k, v in expected.items()}
    assert len(expected) > 200


@pytest.mark.parametrize("size", range(1, 16))
def test_short_items_are_found_at_every_place(size):
    lexicon = [f"w{k}" for k in range(400)]
    rng = random.Random(size)
    items = [" ".join(rng.choices(lexicon, k=size)) for _ in range(4)]
    texts = [
        " ".join(rng.choices(lexicon, k=before) + [item] + rng.choices(lexicon, k=after))
        for item in items
        for before in range(8)
        for after in (0, 1, 7)
    ]
    index = decontaminate.build_items(list(range(len(items))), items)
    found = decontaminate.find_items(index, pa.array(texts, pa.string()))
    expected = items_in(texts, items)
    assert {(t, i): round(v, 9) for t, i, v, _ in found} == {k: round(v, 9) for k, v in expected.items()}
    assert len(expected) >= len(texts)


def test_fingerprints_within_the_radius_are_always_found():
    rng = np.random.default_rng(4)
    rows = [(0, rng.integers(0, 2**63, 40, dtype=np.uint64))]
    index = decontaminate._item_index(13, rows)
    for flips in range(decontaminate.RADIUS + 1):
        for _ in range(50):
            mask = np.uint64(sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
            a, b = decontaminate._candidates(index, index.prints[:1] ^ mask)
            assert 0 in b


def test_items_without_words_and_long_texts_over_many_chunks(monkeypatch):
    items = decontaminate.build_items([1, 2], [None, "one two three four five six seven eight nine ten"])
    long = " ".join(f"x{k}" for k in range(2000)) + " one two three four five six seven eight nine ten"
    whole = decontaminate.find_items(items, pa.array([long, "!?", None]))
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 37)
    assert decontaminate.find_items(items, pa.array([long, "!?", None])) == whole == [(0, 1, 1.0, 2000)]


def stem_items(count, rng, lexicon):
    stem = " ".join(rng.choices(lexicon, k=16))
    return stem, [f"{stem} " + " ".join(rng.choices(lexicon, k=rng.choice([2, 9, 24, 54]))) for _ in range(count)]


def test_items_with_a_shared_stem_are_found_and_few_are_compared(monkeypatch):
    rng = random.Random(8)
    lexicon = [f"w{k}" for k in range(3000)]
    stem, items = stem_items(300, rng, lexicon)
    texts = [" ".join([*rng.choices(lexicon, k=k), stem, *rng.choices(lexicon, k=40)]) for k in range(9)]
    texts += [" ".join([*rng.choices(lexicon, k=k), items[k], *rng.choices(lexicon, k=9)]) for k in range(30)]
    index = decontaminate.build_items(list(range(len(items))), items)
    compared = []
    best = decontaminate._best
    monkeypatch.setattr(decontaminate, "_best", lambda *args: compared.append(args[1]) or best(*args))
    found = decontaminate.find_items(index, pa.array(texts, pa.string()))
    expected = items_in(texts, items)
    assert {(t, i): round(v, 9) for t, i, v, _ in found} == {k: round(v, 9) for k, v in expected.items()}
    assert len(expected) >= 30
    # An item of which the stem is 0.8 or nearly so is compared in every text that has the stem.
    nearly = sum(len(item.split()) <= 18 for item in items)
    assert len(compared) <= len(texts) * nearly + 60


def test_blocks_of_items_share_one_search(monkeypatch):
    rng = random.Random(9)
    lexicon = [f"w{k}" for k in range(500)]
    items = [" ".join(rng.choices(lexicon, k=rng.choice([2, 4, 5, 13, 14, 15, 60]))) for _ in range(40)]
    texts = [" ".join([*rng.choices(lexicon, k=k % 7), items[k], *rng.choices(lexicon, k=k % 5)]) for k in range(40)]
    whole = decontaminate.build_items(list(range(40)), items)
    column = pa.array(texts, pa.string())
    expected = sorted(decontaminate.find_items(whole, column))
    cuts = [decontaminate.build_items(list(range(k, k + 8)), items[k : k + 8]) for k in range(0, 40, 8)]
    cuts = [decontaminate.items_of(block.arrays()) for block in cuts]
    steps = decontaminate.steps_of([index for block in cuts for index in block.indexes])
    found = decontaminate.find_in_blocks(cuts, steps, column)
    assert sorted((t, cuts[n].ids[i].as_py(), v, w) for n, t, i, v, w in found) == expected
    first = [t for _, t, *_ in decontaminate.find_in_blocks(cuts, steps, column, first_only=True)]
    assert first == sorted({t for t, *_ in expected})


def test_pairs_are_pruned_without_losing_any_and_verified_exactly():
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 2**63, 120, dtype=np.uint64) for _ in range(6)]
    sets = []
    for k in range(150):
        own = base[k % 6].copy()
        change = rng.choice(120, rng.integers(0, 40), replace=False)
        own[change] = rng.integers(0, 2**63, len(change), dtype=np.uint64)
        sets.append(np.unique(own))
    every = np.arange(len(sets))
    a, b = jaccard_join.linked_pairs(sets, every, every)
    found = {tuple(sorted(pair)) for pair in zip(a.tolist(), b.tolist(), strict=True)}
    assert len(found) == len(a)
    expected = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        shared = len(np.intersect1d(sets[i], sets[j]))
        if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
            expected.add((i, j))
    assert found == expected and len(expected) > 50
    a, b = jaccard_join.linked_pairs(sets, every[:50], every[50:])
    across = {tuple(sorted(pair)) for pair in zip(a.tolist(), b.tolist(), strict=True)}
    assert across == {(i, j) for i, j in expected if (i < 50) != (j < 50)}


def test_a_pair_stays_while_the_threshold_is_possible():
    needed = jaccard_join.least_matches(0.8, 1e-6)
    assert (np.diff(needed) >= 0).all()
    assert needed[jaccard_join.VALUES] < 0.8 * jaccard_join.VALUES


def test_band_keys_agree_with_the_bands_before():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 3, (4, jaccard_join.VALUES)).astype(np.uint32)
    other = values.copy()
    other[1:, : jaccard_join.BAND_VALUES] += 1
    assert jaccard_join._agreeing(values, other, 1).tolist() == [True, False, False, False]
    assert not jaccard_join._agreeing(values, other, 0).any()


def test_features_of_empty_texts_are_zero_and_do_not_depend_on_neighbours():
    texts = ["", None, "One two.\nTHREE | four", "x" * 9000, "a a a a a a a a"]
    together = features(pa.array(texts))
    assert together.shape == (5, len(FEATURES)) and not together[:2].any()
    alone = np.concatenate([features(pa.array([text], pa.string())) for text in texts])
    assert np.allclose(together, alone)


def test_additive_model_learns_shapes_and_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) & (x[:, 2] < 0.9)).astype(float)
    learned = fit(x[:3000], y[:3000])
    assert (0, 1) in learned.pairs
    assert ((learned.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97
    one = fit(x[:10], np.ones(10))
    assert np.allclose(one.scores(x), 11 / 12)
    assert np.allclose(fit(np.zeros((0, 4)), np.zeros(0)).scores(x), 0.5)


def test_forward_sums_all_segmentations():
    pieces = sorted({b"a", b"b", b"c", b" ", b"ab", b" a", b"bc", b"abc"})
    automaton = build_transducer(pieces)
    rng = np.random.default_rng(8)
    chances = rng.random((len(pieces), 2))
    spelled = [b" abc", b" cab", b"bbb"]

    def total(word, k):
        if not word:
            return 1.0
        return sum(
            chances[pieces.index(word[:n]), k] * total(word[n:], k)
            for n in range(1, len(word) + 1)
            if word[:n] in pieces
        )

    data = np.frombuffer(b"".join(spelled), np.uint8)
    ends = np.cumsum([len(w) for w in spelled])
    got = langid.word_chances(automaton, chances, data, ends - [len(w) for w in spelled], ends)
    assert np.allclose(got, np.log([[total(w, k) for k in range(2)] for w in spelled]))


def test_fitting_pieces_raises_the_likelihood():
    pieces = sorted({bytes([b]) for b in b"abcd "} | {b"ab", b"cd", b" ab"})
    automaton = build_transducer(pieces)
    spelled = [b" abab", b" cdcd", b" abcd"]
    counts = np.array([[9.0, 1.0], [1.0, 9.0], [2.0, 2.0]])
    data = np.frombuffer(b"".join(spelled), np.uint8)
    ends = np.cumsum([5, 5, 5])
    before = -np.inf
    for rounds in (1, 2, 4):
        chances = langid.fit_pieces(automaton, len(pieces), spelled, counts, rounds)
        now = (langid.word_chances(automaton, chances, data, ends - 5, ends) * counts).sum()
        assert now >= before - 0.5
        before = now


def test_the_vocabulary_keeps_long_pieces():
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert {b" maintenance", b" officially"} <= set(pieces)
    assert max(map(len, pieces)) > 20


@pytest.mark.parametrize("cells", [1, 60, 1 << 21])
def test_long_words_are_summed_whole(monkeypatch, cells):
    monkeypatch.setattr(langid, "CELLS", cells)
    pieces = sorted({b"a", b"b", b" ", b"ab", b" a", b"abbabaabba", b"ba" * 8})
    automaton = build_transducer(pieces)
    rng = np.random.default_rng(9)
    chances = rng.random((len(pieces), 2)) * 1e-6
    spelled = [" " + "".join(rng.choice(["a", "b", "ab", "ba" * 8], k)) for k in (3, 9, 30, 31, 300)]
    texts = pa.array([" ".join(spelled), None, spelled[-1]])
    expected = []
    for word in map(str.encode, spelled):
        logs = [np.zeros(2)]
        for end in range(1, len(word) + 1):
            ways = [
                logs[end - len(piece)] + np.log(chances[number])
                for number, piece in enumerate(pieces)
                if word[:end].endswith(piece)
            ]
            logs.append(np.logaddexp.reduce(ways))
        expected.append(logs[-1])
    model = automaton | {"chances": chances, "langs": np.frombuffer(b'["p", "q"]', np.uint8)}
    names, share = langid._scores(model, texts)
    for row, total in ((0, np.sum(expected, axis=0)), (2, expected[-1])):
        assert names[row] == "pq"[int(total.argmax())]
        assert np.isclose(share[row], 1 / np.exp(total - total.max()).sum())
    data = np.frombuffer("".join(spelled).encode(), np.uint8)
    ends = np.cumsum([len(word) for word in spelled])
    begins = ends - [len(word) for word in spelled]
    assert np.allclose(langid.word_chances(automaton, chances, data, begins, ends), expected)


@pytest.mark.parametrize("cells", [1, 60, 1 << 21])
def test_long_words_are_fitted_as_short_ones(monkeypatch, cells):
    pieces = sorted({b"a", b"b", b" ", b"ab", b" a", b"abba", b"baba"})
    automaton = build_transducer(pieces)
    rng = np.random.default_rng(10)
    spelled = [b" " + bytes(rng.choice([97, 98], size).astype(np.uint8)) for size in range(1, 30)]
    counts = rng.integers(0, 5, (len(spelled), 2)).astype(float)
    whole = langid.fit_pieces(automaton, len(pieces), spelled, counts)
    monkeypatch.setattr(langid, "CELLS", cells)
    monkeypatch.setattr(langid, "WORD_BYTES", 6)
    assert np.allclose(langid.fit_pieces(automaton, len(pieces), spelled, counts), whole)
    longest = [word * 20 for word in spelled[-2:]]
    assert np.isfinite(langid.fit_pieces(automaton, len(pieces), longest, counts[-2:], 1)).all()


def test_words_are_spelled_with_a_blank_and_long_ones_are_cut():
    data, begins, ends, first = langid.spelled_words(pa.array(["Ab, c1", "x" * 70, None, "é"]))
    raw = data.tobytes()
    got = [raw[b:e] for b, e in zip(begins, ends, strict=True)]
    assert got == [b" ab", b" c", b" " + b"x" * 31, b" " + b"x" * 31, b" " + b"x" * 8, " é".encode()]
    assert first.tolist() == [0, 2, 5, 5, 6]


def test_every_notice_has_a_probe_in_all_parts_that_could_match():
    chosen = set(probes(NOTICES, 0.8))
    for _, text in NOTICES:
        own = [set(one) for one in shingles(notice_words(text))]
        without = sum(not (chosen & one) for one in own)
        assert without < 0.8 * len(own)
    assert notice_words("A-b_C9 é") == words("A-b_C9 é") == ["a", "b", "c9", "é"]


def test_parts_keep_every_row_within_the_bound():
    batch = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "b" * 50, "", "cc"]})
    got = [part.column(0).to_pylist() for part in parts(batch, "t", 6)]
    assert got == [["aaaa", None], ["b" * 50, ""], ["cc"]] or sum(got, []) == batch.column(0).to_pylist()
    assert all(sum(len(x or "") for x in rows) <= 6 or len(rows) <= 2 for rows in got)
