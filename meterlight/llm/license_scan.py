"""Licence notices in texts, by MinHash over overlapping windows; DataFrame expressions only.

A text is cut into windows of two notice lengths that overlap by one, for a few notice lengths, so
that every notice lies within one window. A window and a notice that share a MinHash band are a
candidate; the exact share of the notice's shingles that the window holds decides.

Notices of up to six words have one shingle or two, and a match holds one of them at least: there
the shingles themselves are the keys, so that no match is missed. For longer notices a band is a
single value: a window that holds 0.8 of a notice's shingles, all distinct, has a similarity of at
least 1/5 to it, for which 80 bands miss once in 56 million cases. The worst of ``NOTICES`` are those
of seven words, with a similarity of 3/14 and one miss in 239 million.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm.license_texts import NOTICES

THRESHOLD = 0.8
SHINGLE_WORDS = 5
BANDS = 80
# Notices of up to so many words share windows; longer ones, and those of fewer words than a shingle
# has, get a class of their own length.
LENGTHS = (6, 9, 14, 21, 32, 48, 72, 108, 162, 243)
# Up to this class the shingles are the keys, without MinHash.
EXACT_LENGTH = 6

_WORD = "[0-9a-z\x80-\U0010ffff]+"
_BETWEEN = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"


def notice_words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def probes(notices: Sequence[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which each text that holds a notice has at least one.

    Per notice, words that are in few notices are taken until the shingles without any of them are
    fewer than the threshold's share, so that no window can reach it without such a word.
    """
    words = [notice_words(text) for _, text in notices]
    common = Counter(word for own in words for word in set(own))
    chosen: set[str] = set()
    for own in words:
        size = min(SHINGLE_WORDS, len(own))
        shingles = [set(own[k : k + size]) for k in range(len(own) - size + 1)]
        # Long words first: they are rare in running text. Then those that many notices share.
        order = sorted(set(own), key=lambda w: (w not in chosen, -min(len(w), 8), -common[w], w))
        mine: set[str] = set()
        for word in order:
            if sum(not (mine & shingle) for shingle in shingles) < threshold * len(shingles) - 1e-9:
                break
            mine.add(word)
        chosen |= mine
    return sorted(chosen)


def _words_of(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(lower, _BETWEEN), lambda word: word != "")


def _shingles_of(words: Column, low: Column, count: Column, length: Column) -> Column:
    """Hashes of the shingles of ``count`` words from ``low`` (from 0); fewer words: all in one.

    Shingles have five words, in a class of shorter notices as many as these.
    """
    size = F.least(count, length, F.lit(SHINGLE_WORDS))
    places = F.sequence(low + 1, low + count - size + 1)
    return F.transform(
        places, lambda at: F.xxhash64(F.concat_ws(" ", F.slice(words, at, size)))
    )


def _bands_of(shingles: Column) -> Column:
    """The smallest hash of the set for each of ``BANDS`` seeds, marked with the seed."""
    seeds = F.array(*(F.lit(seed) for seed in range(BANDS)))
    return F.transform(
        seeds,
        lambda seed: F.xxhash64(seed, F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, seed)))),
    )


def _keys_of(shingles: Column, length: Column) -> Column:
    """What a window and a notice of a length class must share to be a candidate."""
    return F.array_distinct(F.when(length <= EXACT_LENGTH, shingles).otherwise(_bands_of(shingles)))


def _windows_of(words: Column, length: int) -> Column:
    """Where windows of twice the length begin, each one length after the other."""
    last = F.greatest(F.lit(0), F.size(words) - length - 1)
    return F.transform(
        F.sequence(F.lit(0), last, F.lit(length)),
        lambda low: F.struct(F.lit(length).alias("length"), low.alias("low")),
    )


def length_class(words: int) -> int:
    if words < SHINGLE_WORDS:
        return words
    return next((length for length in LENGTHS if words <= length), words)


def _has_probe(notices: Sequence[tuple[str, str]], threshold: float) -> Column:
    """Whether a window holds a word that each match with a notice of its length class must have."""
    classes: dict[int, list[tuple[str, str]]] = {}
    for name, text in notices:
        classes.setdefault(length_class(len(notice_words(text))), []).append((name, text))
    found = F.lit(False)
    for length, own in sorted(classes.items()):
        words = F.array(*map(F.lit, probes(own, threshold)))
        found = F.when(F.col("_length") == length, F.arrays_overlap("_part", words)).otherwise(found)
    return found


def _templates(spark, notices: Sequence[tuple[str, str]]) -> DataFrame:
    """Per notice: its number, licence, length class, shingles and keys."""
    rows = [
        F.struct(
            F.lit(number).alias("notice"),
            F.lit(name).alias("license"),
            F.lit(length_class(len(notice_words(text)))).alias("length"),
            F.split(F.lit(" ".join(notice_words(text))), " ").alias("words"),
        )
        for number, (name, text) in enumerate(notices)
    ]
    listed = spark.range(1).select(F.inline(F.array(*rows)))
    shingles = F.array_distinct(_shingles_of(F.col("words"), F.lit(0), F.size("words"), F.col("length")))
    return listed.withColumn("wanted", shingles).withColumn("keys", _keys_of(F.col("wanted"), F.col("length")))


def scan_licenses(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    notices: Sequence[tuple[str, str]] = tuple(NOTICES),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and notice found: id, notice (its number), license, containment, start_word.

    A notice is found where a window holds at least ``threshold`` of its distinct five-word shingles
    (of fewer words: all of them in a row); the first of the windows that hold the largest share
    gives ``start_word``. Words are runs of ASCII letters, digits and non-ASCII characters of the
    lower-cased text. Texts and windows without any of the words that every match must have are
    passed over; this loses nothing. There is no shuffle but for the matches. The notices are a given, bounded
    list and are broadcast. Null and empty texts match nothing; rows that repeat an id count as one
    document; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    notices = [(name, words) for name, words in notices if notice_words(words)]
    if not notices:
        none = docs.where(F.lit(False)).select(
            F.col(id).alias("_id"), *(F.lit(None).cast(kind) for kind in ("int", "string", "double", "long"))
        )
        return none.toDF(id, "notice", "license", "containment", "start_word")
    templates = _templates(spark, notices)
    named = sorted({length_class(len(notice_words(words))) for _, words in notices})
    lower = F.lower(F.coalesce(docs[text], F.lit("")))
    has_probe = F.lit(False)
    for word in probes(notices, threshold):
        has_probe = has_probe | F.contains(lower, F.lit(word))
    gated = docs.where(has_probe).select(docs[id].alias("_id"), _words_of(docs[text]).alias("_words"))
    gated = gated.where(F.size("_words") > 0)
    windows = F.flatten(F.array(*(_windows_of(F.col("_words"), length) for length in named)))
    held = gated.select("_id", "_words", F.explode(windows).alias("_window")).select(
        "_id",
        F.col("_window.length").alias("_length"),
        F.col("_window.low").alias("_low"),
        F.slice("_words", F.col("_window.low") + 1, 2 * F.col("_window.length")).alias("_part"),
    )
    held = held.where(_has_probe(notices, threshold))
    held = held.withColumn("_own", _shingles_of(F.col("_part"), F.lit(0), F.size("_part"), F.col("_length")))
    keyed = held.select(
        "_id", "_length", "_low", "_own", F.explode(_keys_of(F.col("_own"), F.col("_length"))).alias("_key")
    )
    keys = templates.select("length", F.explode("keys").alias("key"), "notice")
    # A given list: some notices of 80 keys each.
    joined = keyed.join(
        F.broadcast(keys), (F.col("_length") == F.col("length")) & (F.col("_key") == F.col("key"))
    )
    candidates = joined.select("_id", "_low", "_own", "notice")
    known = templates.select("notice", "license", "wanted")
    share = F.size(F.array_intersect("wanted", "_own")) / F.size("wanted")
    verified = candidates.join(F.broadcast(known), "notice").withColumn("_share", share)
    best = F.max(F.struct(F.col("_share"), (-F.col("_low")).alias("_back")))
    return (
        verified.where(F.col("_share") >= threshold - 1e-9)
        .groupBy("_id", "notice", "license")
        .agg(best.alias("_best"))
        .select(
            F.col("_id").alias(id),
            "notice",
            "license",
            F.col("_best._share").alias("containment"),
            (-F.col("_best._back")).cast("long").alias("start_word"),
        )
    )
