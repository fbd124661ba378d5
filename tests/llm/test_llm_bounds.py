"""Bounds in bytes, ties among repeated rows, and the one rule of the Jaccard join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from meterlight.llm import jaccard_join, token_files
from meterlight.llm.exact_dedup import kept_documents
from meterlight.llm.queries import TOKENIZER


def test_of_repeated_rows_the_one_that_reads_smallest_stays(spark):
    rows = [(1, "a  b", "z"), (1, "a  b", "y"), (1, "a b", "x"), (2, "a b", "w"), (3, "c", "v"), (3, "c", "v"),
            (None, "d", "u"), (None, "d", "t"), (4, None, "s"), (5, "", "r"), (1, "other", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `the.source` string")
    docs = docs.withColumn("_gone", F.lit("clash")).withColumn("_times", F.lit(1))
    got = kept_documents(docs.repartition(4))
    assert got.columns == docs.columns
    kept = sorted((tuple(r)[:3] for r in got.collect()), key=str)
    assert kept == sorted(
        [(1, "a  b", "y"), (3, "c", "v"), (None, "d", "t"), (4, None, "s"), (1, "other", "q")], key=str
    )
    assert kept_documents(docs.where("false")).count() == 0


def test_only_copies_are_shuffled(spark):
    docs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("text "), 50), F.col("id") % 1990).alias("text")
    )
    got = kept_documents(docs)
    assert got.count() == 1990
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_the_memo_is_bounded_in_bytes(monkeypatch):
    from tokenizers import Tokenizer

    made, memo = Tokenizer.from_file(TOKENIZER), token_files.PieceMemo()
    monkeypatch.setattr(token_files, "MEMO_BYTES", 100_000)
    for k in range(8):
        long = (f"x{k}" * 15_000).encode()
        starts, counts = memo.look_up(made, [long, b" word"])
        ids = memo.ids[starts[0] : starts[0] + counts[0]]
        assert made.decode(ids.tolist()) == long.decode()
        # The last batch may pass the bound, what is held before it does not.
        assert len(memo.place) <= 4
    assert memo.bytes < 400_000


def test_pairs_link_only_where_they_share_a_band():
    random = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = random.integers(0, 2**63, 60, dtype=np.uint64)
        other = base.copy()
        other[: random.integers(0, 8)] = random.integers(0, 2**63, 1, dtype=np.uint64)
        sets += [np.unique(base), np.unique(other)]
    every = np.arange(len(sets))
    values = jaccard_join.min_values(sets)
    whole = set(zip(*(x.tolist() for x in jaccard_join.linked_pairs(sets, every, every)), strict=True))
    by_band = []
    for band in range(jaccard_join.BANDS):
        by_band += list(zip(*(x.tolist() for x in jaccard_join.linked_pairs(sets, every, every, band=band)), strict=True))
    # Group by group or band by band, the same pairs are linked, each once.
    assert len(by_band) == len(set(by_band)) and set(by_band) == whole and len(whole) >= 40
    # At a threshold that bands were not made for, a pair without a common band is left alone.
    low = set(zip(*(x.tolist() for x in jaccard_join.linked_pairs(sets, every, every, threshold=0.0)), strict=True))
    for a, b in low:
        cuts = values[a].reshape(-1, jaccard_join.BAND_VALUES) == values[b].reshape(-1, jaccard_join.BAND_VALUES)
        assert cuts.all(axis=1).any()
