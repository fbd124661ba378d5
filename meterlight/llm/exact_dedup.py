"""Exact duplicates by progressive refinement: length, prefix hash, full hash, then content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm.stored import free_name, stored
from meterlight.session import broadcast_rows

PREFIX_CHARS = 64


def normalized(text: Column) -> Column:
    """Each run of blanks, tabs and line ends as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_keys(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Id, length, prefix hash and full hash of each row: all that the refinement passes around."""
    body = normalized(F.col(text))
    return docs.select(
        F.col(id).alias("_id"),
        F.length(body).alias("_length"),
        F.xxhash64(F.substring(body, 1, PREFIX_CHARS)).alias("_prefix"),
        F.sha2(body, 256).alias("_full"),
    )


def duplicate_groups(
    docs: DataFrame, keys: DataFrame, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per group of two or more equal texts: _length, _prefix, _full, _keep and _size.

    Rows are grouped by length and prefix hash; only rows of groups with two or more are grouped by
    the hash of the whole text, and only the content of what is left is read again: the smallest
    and the largest text of a group must be the same. All groupings combine on the map side, so
    that a group that holds a third of all rows reaches a task as one row per task before. Texts
    that share a SHA-256 but differ make the job fail.
    """
    # What has two rows is stored, so that each join reads both sides as they are and a hot key's
    # rows can be split.
    twice = F.count(F.lit(1)) > 1
    alike = keys.groupBy("_length", "_prefix").agg(twice.alias("_twice")).where("_twice")
    left = keys.join(stored(alike.drop("_twice"), "alike"), ["_length", "_prefix"], "left_semi")
    hashed = ["_length", "_prefix", "_full"]
    same = left.groupBy(*hashed).agg(twice.alias("_twice")).where("_twice").drop("_twice")
    left = left.join(stored(same, "same-hash"), hashed, "left_semi")
    texts = docs.select(F.col(id).alias("_doc"), normalized(F.col(text)).alias("_body"))
    wanted = stored(left.select("_id", *hashed).distinct(), "same-hash-rows")
    content = texts.join(
        broadcast_rows(wanted, wanted.count()),
        F.col("_doc").eqNullSafe(F.col("_id")) & (F.sha2("_body", 256) == F.col("_full")),
    )
    groups = content.groupBy(*hashed).agg(
        F.min("_id").alias("_keep"),
        F.count(F.lit(1)).alias("_size"),
        F.min("_body").alias("_low"),
        F.max("_body").alias("_high"),
    )
    equal = F.when(F.col("_low") == F.col("_high"), F.col("_size"))
    checked = F.coalesce(equal, F.raise_error(F.lit("different texts share a hash")).cast("long"))
    return groups.select(*hashed, "_keep", checked.alias("_size"))


def _decided(docs: DataFrame, id: str, text: str) -> DataFrame:
    keys = stored(text_keys(docs, id, text), "text-keys")
    groups = stored(duplicate_groups(docs, keys, id, text), "copy-groups")
    return keys.join(groups, ["_length", "_prefix", "_full"], "left").withColumn(
        "_keep", F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    )


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the smallest id stays. A null text is an empty one. A null id comes
    after all others; rows that repeat both id and text share one decision, as they are one
    document (``kept_documents`` leaves one of them). An empty table gives an empty result. Only
    the columns ``id`` and ``text`` are read. Building the result runs the jobs that
    store the narrow keys of all rows and the groups of equal texts.
    """
    return _decided(docs, id, text).select(
        F.col("_id").alias(id),
        F.col("_keep").alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_full").alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, as ``exact_dedup`` decides.

    Of rows that repeat both id and text the one whose columns read smallest as JSON stays. Only
    rows in groups of equal texts are looked up or grouped; texts of others stay where they are as
    long as those groups' rows are few enough to broadcast their ids and hashes.
    """
    names = [free_name(docs, name) for name in ("_gone", "_gone_full", "_full_text", "_times")]
    gone, gone_full, full, times = names
    decided = _decided(docs, id, text).where("_size > 1")
    known = decided.groupBy(F.col("_id").alias(gone), F.col("_full").alias(gone_full)).agg(
        F.when(F.first("_keep").eqNullSafe(F.first("_id")), F.count(F.lit(1))).otherwise(0).alias(times)
    )
    # Rows to drop (0), and those of which one stays.
    known = stored(known.where(F.col(times) != 1), "copies")
    repeated = known.where(F.col(times) > 1)
    size = known.count()
    marked = docs.withColumn(full, F.sha2(normalized(F.col(text)), 256))
    same = F.col(id).eqNullSafe(F.col(gone)) & (F.col(full) == F.col(gone_full))
    single = marked.join(broadcast_rows(known, size), same, "left_anti").drop(full)
    if repeated.isEmpty():
        return single
    again = marked.join(broadcast_rows(repeated, size), same, "left_semi")
    row = F.struct(*(F.col("`" + name.replace("`", "``") + "`") for name in docs.columns))
    chosen = again.groupBy(id, full).agg(F.min_by(row, F.to_json(row)).alias(times))
    return single.union(chosen.select(f"{times}.*"))
