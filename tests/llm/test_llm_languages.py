"""Language models: bounds, labels of any kind, and scores as a plain forward sum gives them."""

from __future__ import annotations

import json
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from meterlight.llm import langid
from meterlight.llm.array_file import received_arrays
from meterlight.llm.queries import PIECES, QUERIES, table

DE = "der hund und die katze schlafen heute nicht im haus"
EN = "the dog and the cat do not sleep in the house today"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def taught(spark, names=("de", "en")):
    rows = [(k, f"{DE} {k}" if k % 2 else f"{EN} {k}", names[0] if k % 2 else names[1]) for k in range(60)]
    return frame(spark, rows)


def predicted(docs, model):
    return {row["doc_id"]: (row["lang_pred"], round(row["score"], 9)) for row in langid.predict_languages(docs, model).collect()}


def test_the_empty_string_is_a_language(spark):
    docs = taught(spark, ("", ""))
    got = predicted(docs, langid.fit_languages(docs, PIECES))
    assert set(got.values()) == {("", 1.0)}
    odd = taught(spark, ("a\0b\"", ""))
    got = predicted(odd, langid.fit_languages(odd, PIECES))
    assert {got[1][0], got[2][0]} == {"a\0b\"", ""}


def test_blocks_of_languages_and_looked_up_shares_give_the_same(spark, monkeypatch):
    rows = [(k, f"{DE} x{'abcdefg'[k % 7]}" if k % 2 else f"{EN} y", f"l{k % 9}") for k in range(300)]
    docs = frame(spark, [*rows, (301, None, "l1"), (302, "", "l2"), (303, "no language", None), (None, DE, "l3")])
    whole = predicted(docs, langid.fit_languages(docs, PIECES))
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 2)
    monkeypatch.setattr(langid, "NAMED_LANGUAGES", 3)
    # Words are scored and fitted a few at a time.
    monkeypatch.setattr(langid, "CELLS", 300)
    assert predicted(docs, langid.fit_languages(docs, PIECES)) == whole
    assert {whole[301], whole[302]} == {("und", 0.0)}


def test_the_sample_is_bounded_in_texts_and_bytes(spark, monkeypatch):
    def size(docs, most):
        got = langid._sample(docs, "doc_id", "text", "lang", most).groupBy("_lang")
        sums = got.agg(F.count("*").alias("n"), F.sum(F.length("_text")).alias("bytes")).collect()
        return {row["_lang"]: (row["n"], row["bytes"]) for row in sums}

    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("ab "), 30), "id").alias("text"), F.lit("x").alias("lang")
    )
    assert size(docs, 100)["x"][0] == 100
    monkeypatch.setattr(langid, "TRAIN_BYTES", 1000)
    few, held = size(docs, 100)["x"]
    assert 10 <= few <= 12 and held < 1200
    # Rows that repeat count once, and a language of one long text keeps it.
    one, two = [k for k in range(50) if zlib.crc32(str(k).encode()) % 3 != 1][:2]
    again = docs.where(F.col("doc_id") == one).crossJoin(spark.range(500).select(F.lit(1).alias("one"))).drop("one")
    assert size(again, 100)["x"][0] == 1
    long = frame(spark, [(one, "word " * 5000, "long"), (two, "short", "short")])
    assert size(long, 100)["long"] == (1, 25000)
    assert size(docs.where("false"), 100) == {}


def plain_chance(word, pieces, longest, chances):
    """The log chance of a word per language: the sum over all its segmentations."""
    raw = b" " + word.encode()
    sums = [[1.0] * chances.shape[1]] + [[0.0] * chances.shape[1] for _ in raw]
    for end in range(1, len(raw) + 1):
        for begin in range(max(0, end - longest), end):
            number = pieces.get(raw[begin:end])
            if number is not None:
                for k in range(chances.shape[1]):
                    sums[end][k] += sums[begin][k] * chances[number, k]
    return [math.log(value) for value in sums[-1]]


def test_op6_scores_as_a_plain_forward_sum(spark, small):
    docs = table(spark, small, "documents")
    arrays = received_arrays(langid.fit_languages(docs, PIECES))
    langs = json.loads(arrays["langs"].tobytes())
    pieces = {piece: number for number, piece in enumerate(langid.vocabulary(PIECES))}
    longest = max(map(len, pieces))
    known: dict[str, list[float]] = {}
    got = {row["doc_id"]: row for row in QUERIES["op6_language"](spark, small).collect()}
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    assert set(got) == set(texts)
    for id, text in texts.items():
        words = re.findall("[a-z\x80-\U0010ffff]+", (text or "").lower())
        total = [0.0] * len(langs)
        for word in words:
            if word not in known:
                known[word] = plain_chance(word, pieces, longest, arrays["chances"])
            total = [a + b for a, b in zip(total, known[word], strict=True)]
        if not any(letter.isalpha() for letter in text or ""):
            assert (got[id]["lang_pred"], got[id]["score"]) == ("und", 0.0)
            continue
        best = max(total)
        assert got[id]["lang_pred"] == langs[total.index(best)]
        share = 1 / sum(math.exp(value - best) for value in total)
        assert got[id]["score"] == pytest.approx(share, abs=1e-6)
