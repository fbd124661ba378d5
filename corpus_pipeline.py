"""A training corpus from raw documents, stage by stage; each stage's rows are stored and read again.

All stages but the last return the columns they were given, extra and clashing names included, and
all give an empty result for an empty table. What each does with nulls, empty texts, ties and
repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlight.llm import bpe
from meterlight.llm.decontaminate import clean_documents
from meterlight.llm.exact_dedup import kept_documents
from meterlight.llm.jaccard_join import one_per_class
from meterlight.llm.quality import fit_quality, good_documents
from meterlight.llm.queries import TOKENIZER, table
from meterlight.llm.stored import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; it learns from the labels of ``sf_dir``.

    Null and empty texts are scored like any other; rows that repeat get the same score. Without
    labels every score is 0.5, below the threshold, and no row stays.
    """
    return good_documents(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays.

    A null text is an empty one. Of rows that repeat the id and the text one stays: the one whose
    other columns read smallest.
    """
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the one with the smallest id stays.

    Texts without a word have no shingle and are linked with nothing, rows without an id stay. Rows
    that share an id stay together if one of their texts is its class's first.
    """
    return one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay, items without a word are in no text. Rows that repeat
    are judged each.
    """
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of them and of the text decoded from them.

    One row per row of ``docs``, repeated ones too; a null text is empty and has no ids. Only the id
    and the columns made here are returned, all others are left out.
    """
    return bpe.round_trip(docs, bpe.build_lexicon(docs, TOKENIZER))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

# The quality model and the tokenizer cannot be put into SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
