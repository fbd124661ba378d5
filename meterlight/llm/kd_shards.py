"""Shards by a k-d tree: split at weighted medians along the widest metadata dimension."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.stored import stored
from meterlight.operators.numbering import number_rows

BINS = 1024
# What the driver takes of one pass at most: a sum per open node and piece.
MOST_SUMS = 1 << 20


@dataclass
class _Node:
    """A part of the rows that is to be cut into ``leaves`` shards, of which ``first`` is the first."""

    first: int
    leaves: int


@dataclass
class _Bracket:
    """Where a node's cut lies: ranks of one dimension, and the weight of the ranks before them."""

    dim: int
    low: int
    high: int
    before: int
    wanted: float
    width: int = 0


def _brackets(rows: DataFrame, nodes: dict[int, _Node], dims: int) -> dict[int, _Bracket]:
    """Per node the dimension over which its rows' ranks spread most, from end to end."""
    extents = (
        rows.groupBy("_node")
        .agg(
            F.sum("_weight").alias("weight"),
            *(F.min(F.col("_ranks")[k]).alias(f"min{k}") for k in range(dims)),
            *(F.max(F.col("_ranks")[k]).alias(f"max{k}") for k in range(dims)),
        )
        .collect()
    )
    found = {}
    for row in extents:
        node = nodes[row["_node"]]
        if node.leaves > 1:
            k = max(range(dims), key=lambda k: row[f"max{k}"] - row[f"min{k}"])
            wanted = row["weight"] * (node.leaves // 2) / node.leaves
            found[row["_node"]] = _Bracket(k, row[f"min{k}"], row[f"max{k}"] + 1, 0, wanted)
    return found


def _cuts(rows: DataFrame, brackets: dict[int, _Bracket]) -> dict[int, tuple[int, int]]:
    """Per node the dimension, and the rank below which its left leaves' part of the weight lies.

    Each round counts the weight of equal pieces of every open bracket in one pass that combines on
    the map side, and goes on in the piece where the part is reached.
    """
    spark, cut, left = rows.sparkSession, {}, dict(brackets)
    while left:
        bins = max(2, min(BINS, MOST_SUMS // len(left)))
        for bracket in left.values():
            bracket.width = math.ceil((bracket.high - bracket.low) / bins)
        # One row per open node.
        listed = spark.createDataFrame(
            [(n, b.dim, b.low, b.high, b.width) for n, b in left.items()],
            "_node long, _dim int, _low long, _high long, _width long",
        )
        rank = F.col("_ranks")[F.col("_dim")]
        counted = (
            rows.join(F.broadcast(listed), "_node")
            .where((rank >= F.col("_low")) & (rank < F.col("_high")))
            .groupBy("_node", F.floor((rank - F.col("_low")) / F.col("_width")).alias("_piece"))
            .agg(F.sum("_weight").alias("_sum"))
            .orderBy("_node", "_piece")
            .collect()
        )
        pieces: dict[int, list[tuple[int, int]]] = {}
        for row in counted:
            pieces.setdefault(row["_node"], []).append((row["_piece"], row["_sum"]))
        for n, bracket in list(left.items()):
            for piece, weight in pieces[n]:
                begin = bracket.low + piece * bracket.width
                if bracket.before + weight < bracket.wanted:
                    bracket.before += weight
                    continue
                if bracket.width > 1:
                    bracket.low, bracket.high = begin, min(bracket.high, begin + bracket.width)
                else:
                    # The row at this rank spans the wanted weight: it goes where it fits better.
                    goes_left = bracket.wanted - bracket.before > weight / 2
                    cut[n] = bracket.dim, begin + 1 if goes_left else begin
                    del left[n]
                break
    return cut


def _split(rows: DataFrame, nodes: dict[int, _Node], cut: dict[int, tuple[int, int]]) -> DataFrame:
    """Move each row of a cut node to the node's left or right child, and the tree with it."""
    listed = []
    for n, (dim, at) in cut.items():
        node, right = nodes[n], len(nodes)
        half = node.leaves // 2
        nodes[right] = _Node(node.first + half, node.leaves - half)
        nodes[n] = _Node(node.first, half)
        listed.append((n, dim, at, right))
    # One row per cut node.
    cuts = rows.sparkSession.createDataFrame(listed, "_node long, _dim int, _at long, _right long")
    moved = rows.join(F.broadcast(cuts), "_node", "left")
    goes_right = F.col("_ranks")[F.col("_dim")] >= F.col("_at")
    node = F.when(goes_right, F.col("_right")).otherwise(F.col("_node"))
    return stored(moved.withColumn("_node", node).drop("_dim", "_at", "_right"), "kd-nodes")


def kd_shards(
    rows: DataFrame,
    id: str,
    weight: str,
    dims: Sequence[str],
    shards: int | None = None,
    target: int | None = None,
) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (gapless per shard, in the order of ``id``).

    ``rows`` should be narrow: it is stored several times. The tree cuts until there are ``shards``
    leaves, or, with ``target``, until a leaf holds about that weight. Every dimension is first
    turned into ranks (ties go by id, then weight), so that widths compare and each cut can fall
    between any two rows; a dimension in which a third of the rows share one value still splits
    evenly. What the driver holds is the tree and at most a million sums at a time; every round of
    a level reads the stored, narrow rows once.

    Leaves' weights differ by a few rows' weight at most. Nulls come first in a dimension and in
    the id. Rows that repeat are placed each on its own. An empty table gives an empty result.
    Columns other than those named pass through; the names shard and slot are taken.
    """
    ranked = rows.select("*")
    ranks = [f"_rank{k}" for k in range(len(dims))]
    for rank, name in zip(ranks, dims, strict=True):
        ranked = number_rows(ranked, [], [F.col(name), F.col(id), F.col(weight)], rank)
    placed = ranked.withColumns(
        {
            "_ranks": F.array(*ranks),
            "_weight": F.col(weight).cast("long"),
            "_node": F.lit(0).cast("long"),
        }
    )
    placed = stored(placed.drop(*ranks), "kd-nodes")
    if shards is None:
        total = placed.agg(F.sum("_weight")).first()[0] or 0
        shards = max(1, math.ceil(total / target))
    nodes = {0: _Node(0, shards)}
    while brackets := _brackets(placed, nodes, len(dims)):
        placed = _split(placed, nodes, _cuts(placed, brackets))
    leaves = placed.sparkSession.createDataFrame(
        [(n, node.first) for n, node in nodes.items()], "_node long, shard int"
    )
    # One row per leaf.
    placed = placed.join(F.broadcast(leaves), "_node").drop("_node", "_ranks", "_weight")
    numbered = number_rows(placed, ["shard"], [F.col(id), F.col(weight)], "slot")
    return numbered.withColumn("slot", F.col("slot") - 1)


def shard_documents(
    docs: DataFrame,
    shards: int,
    id: str = "doc_id",
    text: str = "text",
    dims: Sequence[str] = ("source", "lang"),
) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot and grown_shard.

    The size is the text's UTF-8 bytes plus 8, a null text has none; sizes of shards are near equal
    (law ``bytes``). Dimensions are the size and the columns ``dims``. Texts are read once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(id).alias("_id"),
        (F.octet_length(body).cast("long") + 8).alias("_size"),
        F.crc32(body).alias("_crc"),
        *(F.col(name).alias(f"_dim{k}") for k, name in enumerate(dims)),
    )
    names = [f"_dim{k}" for k in range(len(dims))]
    placed = kd_shards(narrow, "_id", "_size", [*names, "_size"], shards=shards)
    return placed.select(
        F.col("_id").alias(id),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
