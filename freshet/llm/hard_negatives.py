"""Hard negatives of anchors by best-first search of an R-tree.

An anchor's positives are its best rows of the same label by whole inner product; for each positive, the negatives are
the best rows of other labels whose score lies between a share of the positive's score and that score.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; vectors are
compared with vectors of their own length only (empty ones score 0 among themselves); whole components beyond
+-2**20 are held there; rows that repeat in full count once, rows that share an id but differ all take part and an
anchor of that id is one for each of them; ties go to the smaller id; extra columns are ignored; an empty table gives
no rows; an anchor without positives, or a positive without fitting rows, gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.rtree import TreeParams, best_rows, packed
from freshet.llm.vectors import matrix, usable, whole
from freshet.session import durable

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class MiningParams:
    """``scale``: components become ``floor(scale * x)``; a negative's score is at least ``low_percent`` and at most
    ``high_percent`` of the positive's."""

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low_percent: int = 80
    high_percent: int = 100
    tree: TreeParams = field(default_factory=TreeParams)


def vector_rows(df: DataFrame, label: Column, scale: int, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    own = df.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("v")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    return own.withColumn("v", whole("v", scale))


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of whole scores, rounded up or down to whole scores."""
    return -((-score * percent) // 100) if up else (score * percent) // 100


def hard_negatives(rows: DataFrame, anchor: Column, params: MiningParams = MiningParams()) -> DataFrame:
    """Ranked negatives of every positive of the rows for which ``anchor`` is true; ``rows`` as of ``vector_rows``."""
    spark, rows = rows.sparkSession, durable(rows)
    anchors = durable(rows.filter(anchor).distinct())
    index = packed(rows, params.tree)
    blocks = []
    for dim, n in sorted((r["dim"], r["n"]) for r in anchors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()):
        parts = max(1, math.ceil(8 * max(dim, 1) * n / params.tree.block_bytes))
        dealt = anchors.filter(F.size("v") == dim).withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(parts)))
        blocks += [_block(index, dealt.filter(F.col("part") == i), dim, params) for i in range(parts)]
    result = spark.createDataFrame([], RESULT)
    for block in blocks:
        result = result.unionByName(block)
    return result


def _block(index: DataFrame, anchors: DataFrame, dim: int, params: MiningParams) -> DataFrame:
    """The negatives of one block of anchors."""
    spark = index.sparkSession
    own = anchors.select("vec_id", "label", "v").toArrow()
    n = len(own)
    queries = {"id": np.asarray(own["vec_id"]), "label": np.asarray(own["label"]), "v": matrix(own["v"]).reshape(n, dim)}
    if not n:
        return spark.createDataFrame([], RESULT)
    edge = 1 << 61
    anywhere = np.tile(np.array([-edge, edge], dtype=np.int64), (n, 1, 1))
    positives = best_rows(index, queries, anywhere, params.positives, True, params.tree).toArrow()
    q, rank, ids, scores = (np.asarray(positives[c]) for c in ("query", "rank", "id", "score"))
    # a window that nothing fits stands where an anchor has fewer positives
    windows = np.tile(np.array([edge, -edge], dtype=np.int64), (n, params.positives, 1))
    windows[q, rank - 1] = np.stack([_share(scores, params.low_percent, True), _share(scores, params.high_percent, False)], axis=1)
    found = durable(best_rows(index, queries, windows, params.negatives, False, params.tree))
    named = spark.createDataFrame(
        pa.table({
            "query": pa.array(q, pa.int32()), "window": pa.array(rank - 1, pa.int32()), "anchor_id": queries["id"][q],
            "positive_id": ids, "positive_score": scores,
        })
    )
    # as many rows as the block's queries have positives
    return found.join(F.broadcast(named), ["query", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
