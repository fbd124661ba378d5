"""The operators of this folder, each applied to its whole table of the samples."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.llm import bpe, langid, quality, token_files
from meterlight.llm.collocations import mine_collocations
from meterlight.llm.decontaminate import contaminated
from meterlight.llm.embedding_dedup import near_vectors
from meterlight.llm.exact_dedup import exact_dedup
from meterlight.llm.jaccard_join import jaccard_join
from meterlight.llm.kd_shards import shard_documents
from meterlight.llm.license_scan import scan_licenses
from meterlight.llm.periodic_runs import find_runs
from meterlight.llm.pii import find_pii

SHARDS = 24
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, bpe.build_lexicon(docs, TOKENIZER)).drop("ids")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.fit_languages(docs, PIECES))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), TOKENIZER)
    return token_files.documents_of(spark, path)


def planted_text(id: Column, text: Column) -> Column:
    """The words of a text, of which every tenth id's repeat from some place on."""
    hashed = F.crc32(id.cast("string").cast("binary"))
    turn = F.floor(hashed / 10)
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    count = F.size(words)
    begin = (turn % F.greatest(count, F.lit(1))).cast("int")
    rest = count - begin
    period = (1 + F.floor(rest / (3 + turn % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, begin + 1, period), F.ceil(rest / period).cast("int")))
    planted = F.concat(F.slice(words, F.lit(1), begin), F.slice(again, F.lit(1), rest))
    chosen = (hashed % 10 == 0) & (count > 0)
    return F.when(chosen, F.array_join(planted, " ")).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.transform(
        "runs",
        lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")),
    )
    order = F.transform("runs", lambda r: F.struct(r.length.alias("length"), -r.start, -r.period, r.alias("run")))
    best = F.array_max(order)["run"]
    found = found.withColumns({"best": best, "lines": F.array_join(lines, "")})
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language": op6_language,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_kd_shards": op8_kd_shards,
    "op9_pii": op9_pii,
    "op10_token_files": op10_token_files,
    "op11_runs": op11_runs,
    "op12_collocations": op12_collocations,
    "op13_embedding_dedup": op13_embedding_dedup,
}
