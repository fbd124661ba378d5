"""Text quality: an additive model with pairwise terms, fitted on labelled texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm.additive_model import AdditiveModel, fit
from meterlight.llm.arrow_text import map_batches, parts
from meterlight.llm.text_features import FEATURES, features

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
FOLDS = 4
HELD_OUT_FOLD = 2

_SCALE = 1 << 30


def held_out(id: Column) -> Column:
    """Whether a document never trains: by the CRC-32 of its id as text; a null id never does."""
    fold = F.crc32(id.cast("string")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(True))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most: int = TRAIN_ROWS,
) -> AdditiveModel:
    """Fit on about ``most`` labelled documents outside the held-out fold.

    Those whose ids hash lowest are taken; the driver gets their features only. A label is 0 or 1,
    other labels and null ids do not train; of several labels of one id the lowest counts, and of
    several rows of one id each counts.
    """
    known = (
        labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
    )
    mark = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(_SCALE))
    # The bound is computed here, where numbers of any size are exact.
    share = min(_SCALE, -(-_SCALE * most // max(1, known.count())))
    chosen = known.where(mark < F.lit(share))
    # About ``most`` rows of two numbers.
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), "_id"
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text"):
                numbers = features(part.column(0))
                columns = [part.column(1), *(pa.array(numbers[:, k]) for k in range(len(FEATURES)))]
                yield pa.RecordBatch.from_arrays(columns, names=["_label", *FEATURES])

    schema = ", ".join(["_label int", *(f"{name} double" for name in FEATURES)])
    found = map_batches(rows.select("_text", "_label"), measure, schema).collect()
    numbers = np.array([tuple(row) for row in found], float).reshape(-1, len(FEATURES) + 1)
    # The order in which rows arrive must not matter for the fit.
    numbers = numbers[np.lexsort(numbers.T[::-1])]
    return fit(numbers[:, 1:], numbers[:, 0])


def score_quality(
    docs: DataFrame, model: AdditiveModel, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, score (0 to 1) and predicted (score >= 0.7).

    Whole texts are measured, without a shuffle. Null and empty texts have features of zero and the
    score that the model gives them. An empty table gives an empty result; only ``id`` and
    ``text`` are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "_text"):
                scores = pa.array(model.scores(features(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), scores], names=["_id", "score"])

    rows = docs.select(docs[id].alias("_id"), docs[text].alias("_text"))
    scored = map_batches(rows, run, f"_id {dict(docs.dtypes)[id]}, score double")
    return scored.select(
        F.col("_id").alias(id),
        held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_documents(
    docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, text):
                scores = model.scores(features(part.column(place)))
                yield part.filter(pa.array(scores >= threshold))

    place = docs.columns.index(text)
    return map_batches(docs, run, docs.schema)
