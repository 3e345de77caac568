"""Exact k-means on whole vectors with ns-bounds: norms of total displacements since a distance was evaluated.

Method. A vector keeps, for each centroid, the squared distance when it was last evaluated and the round of that
evaluation. The driver keeps the centroids of all rounds. A stored distance is loosened by the norm of the centroid's
total displacement between then and now, which is never more than the sum of the norms of its steps: distance plus
displacement bounds the own centroid from above, distance minus displacement each other one from below. A vector whose
upper bound lies below all lower bounds keeps its cluster unread. For the others the own distance is evaluated, then,
where a lower bound still does not clear it, exactly those distances; the decision itself compares whole numbers, ties
go to the smaller centroid number.

On Spark: the vectors with their bounds are one table, rewritten to the shared folder each round by one scan without an
exchange. Sums of the clusters change by the vectors that moved, which are summed per task before they meet. Centroids
(their number times the dimension, for each round) are all that passes through the driver.

Defined cases: vectors of another length, null vectors, null or non-finite components are left out; whole components
beyond +-2**20 are held there; a null id takes part but seeds no centroid; repeated rows all take part and seed by their
vectors' order; with fewer vectors than centroids there are as many centroids as vectors that can seed; without any
seed, as with an empty table, there are no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.vectors import matrix, product, usable, whole
from freshet.session import durable

#: room for rounding when two bounds are compared, as a share of them
SLACK = 1e-9


@dataclass(frozen=True)
class ClusterParams:
    """``scale``: components become ``floor(scale * x)``; ``seed``: first part of the hashed seed keys."""

    clusters: int = 16
    dim: int = 64
    scale: int = 64
    rounds: int = 3
    seed: int = 1


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``v`` to those of ``c``, exact."""
    v, c = v.astype(np.int64), c.astype(np.int64)
    return (v * v).sum(axis=1)[:, None] - 2 * product(v, c.T) + (c * c).sum(axis=1)


def assigned(v, cluster, near, at, history):
    """(cluster, near, at, evaluations) of vectors for the last centroids of ``history``.

    ``near`` holds squared distances and ``at`` the rounds they belong to; both None where nothing is known yet.
    """
    now, centres = len(history) - 1, history[-1]
    if near is None:
        near = squared(v, centres)
        return near.argmin(axis=1), near, np.full(near.shape, now, dtype=np.int32), near.size
    cluster, near, at = cluster.copy(), near.copy(), at.copy()
    rows, every = np.arange(len(v)), np.arange(len(centres))
    moved = np.sqrt(np.array([((centres - c) ** 2).sum(axis=1) for c in history], dtype=np.float64))
    loose, far = moved[at, every], np.sqrt(near.astype(np.float64))
    lower = far - loose
    lower[rows, cluster] = np.inf
    upper = far[rows, cluster] + loose[rows, cluster]
    reach = lambda u: u + SLACK * (1 + u)
    left = np.flatnonzero(lower.min(axis=1, initial=np.inf) <= reach(upper))
    if not len(left):
        return cluster, near, at, 0
    own = cluster[left]
    exact = ((v[left].astype(np.int64) - centres[own]) ** 2).sum(axis=1)
    near[left, own], at[left, own] = exact, now
    open_ = lower[left] <= reach(np.sqrt(exact.astype(np.float64)))[:, None]
    best, at_best, evaluations = exact.copy(), own.copy(), len(left)
    for j in every:
        mine = np.flatnonzero(open_[:, j])
        if not len(mine):
            continue
        d = ((v[left[mine]].astype(np.int64) - centres[j]) ** 2).sum(axis=1)
        near[left[mine], j], at[left[mine], j] = d, now
        evaluations += len(mine)
        wins = (d < best[mine]) | ((d == best[mine]) & (j < at_best[mine]))
        best[mine[wins]], at_best[mine[wins]] = d[wins], j
    cluster[left] = at_best
    return cluster, near, at, evaluations


STATE = "vec_id long, v array<int>, cluster int, before int, near array<long>, at array<int>"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _stepped(batch: pa.RecordBatch, history: list[np.ndarray]):
    """Vectors of a batch of the state, or of bare vectors, and what ``assigned`` makes of them."""
    v = matrix(batch.column(1))
    if batch.num_columns == 2:
        return v, np.full(len(v), -1), *assigned(v, None, None, None, history)
    cluster = np.asarray(batch.column(2)).astype(np.int64)
    return v, cluster, *assigned(v, cluster, matrix(batch.column(3)), matrix(batch.column(4)), history)


def _known(state: DataFrame) -> DataFrame:
    return state.select(*[c for c in ("vec_id", "v", "cluster", "near", "at") if c in state.columns])


def _round(state: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """Bounds and clusters of all vectors for the last centroids of ``history``."""

    def lists(x, kind):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), kind))

    def run(batches):
        for batch in batches:
            if len(batch):
                _, before, cluster, near, at, _ = _stepped(batch, history)
                yield pa.record_batch(
                    [
                        batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(before, pa.int32()),
                        lists(near, pa.int64()), lists(at, pa.int32()),
                    ],
                    names=["vec_id", "v", "cluster", "before", "near", "at"],
                )

    return durable(_known(state).mapInArrow(run, STATE))


def _change(state: DataFrame, clusters: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their cluster add to the clusters' counts and sums."""

    def run(batches):
        total = np.zeros((clusters, dim + 1), dtype=np.int64)
        for batch in batches:
            v = matrix(batch.column(2))
            for column, sign in ((0, -1), (1, 1)):
                place = np.asarray(batch.column(column))
                for c in range(clusters):  # -1, before the first round, is none of them
                    mine = place == c
                    total[c, 0] += sign * int(mine.sum())
                    total[c, 1:] += sign * v[mine].sum(axis=0, dtype=np.int64)
        c, i = np.nonzero(total)
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(total[c, i])], names=["c", "i", "x"])

    parts = state.filter("cluster <> before").select("before", "cluster", "v").mapInArrow(run, "c int, i int, x long")
    summed = parts.groupBy("c", "i").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros((clusters, dim + 1), dtype=np.int64)
    total[np.asarray(summed["c"]), np.asarray(summed["i"])] = np.asarray(summed["x"])
    return total[:, 0], total[:, 1:]


def _nearest(state: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """(vec_id, cluster, distance) for the last centroids of ``history``."""

    def run(batches):
        for batch in batches:
            if len(batch):
                v, _, cluster, *_ = _stepped(batch, history)
                distance = ((v.astype(np.int64) - history[-1][cluster]) ** 2).sum(axis=1)
                yield pa.record_batch(
                    [batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"]
                )

    return durable(_known(state).mapInArrow(run, "vec_id long, cluster int, distance long"))


def clustered(df: DataFrame, params: ClusterParams = ClusterParams(), vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector; distances are squared."""
    spark = df.sparkSession
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"))
    kept = own.filter(usable("v") & (F.size("v") == params.dim)).withColumn("v", whole("v", params.scale))
    key = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.filter("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(params.clusters)
    first = [r["v"] for r in seeds.collect()]
    if not first:
        return spark.createDataFrame([], RESULT)
    history, clusters, state = [np.array(first, dtype=np.int64)], len(first), kept
    counts, sums = np.zeros(clusters, dtype=np.int64), np.zeros((clusters, params.dim), dtype=np.int64)
    for _ in range(params.rounds):
        state = _round(state, history)
        n, s = _change(state, clusters, params.dim)
        counts, sums = counts + n, sums + s
        history.append(np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], history[-1]))
    near = _nearest(state, history)
    inertia = {r["cluster"]: r["x"] for r in near.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}
    hashed = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in history[-1]]
    facts = spark.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()), h) for c, h in enumerate(hashed)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # one row per centroid
    return near.join(F.broadcast(facts), "cluster").select(*[x.split()[0] for x in RESULT.split(", ")])
