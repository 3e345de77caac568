"""R-trees packed by sort, tile and recursion, and best-first search for inner products in score windows.

Method. Rows are cut into chunks of neighbouring rows by a range exchange on (dimension, label, first component, id).
In a chunk, the rows of a label are tiled: sorted by the component that spreads most, cut into slabs, each slab sorted
by the next component, and so on, until slabs are leaves. Leaves keep their smallest bounding box, their range of
labels and their smallest id, and are the rows of the index table. Sixteen neighbouring boxes make a box of the level
above, up to one root; the upper levels are built when a chunk is read, which costs less than storing them.

A box bounds the inner product of a query with any row in it, component by component. A search holds its open boxes in
a queue, highest bound first. A box is left out when its interval lies outside every window, when every window that it
meets is full and the box lies strictly below the window's k-th score (or ties with it and holds larger ids only), or
when it holds no fitting label. The queue ends with the first box strictly below all that is still wanted.

On Spark: a block of queries of bounded size goes to all tasks, each task walks its chunks of the index with what it
has found so far, and the tasks' best rows are ranked by a grouped limit. Reading the index again for each block costs
little beside the products of a block of tens of thousands of queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.vectors import matrix, product
from freshet.session import durable

#: a score below all scores, for places that are not taken
NONE = -(1 << 62)
LEAVES = (
    "chunk string, dim int, label_low long, label_high long, low array<int>, high array<int>, "
    "ids array<long>, labels array<long>, vectors array<int>"
)


@dataclass(frozen=True)
class TreeParams:
    """``leaf_rows``: rows of a leaf; ``fan_out``: boxes in a box; ``chunk_rows``: rows packed together.

    ``block_bytes`` bounds the queries that go to all tasks at once.
    """

    leaf_rows: int = 256
    fan_out: int = 16
    chunk_rows: int = 16_384
    block_bytes: int = 16 << 20


def tiles(vectors: np.ndarray, leaf_rows: int) -> Iterator[np.ndarray]:
    """Row numbers of each leaf, by sorting and tiling along the components that spread most."""
    leaves = math.ceil(len(vectors) / leaf_rows)
    levels = min(vectors.shape[1], max(1, int(math.log(max(leaves, 1), 4))))
    axes = np.argsort(-np.var(vectors, axis=0), kind="stable")[:levels]

    def cut(rows: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        n = math.ceil(len(rows) / leaf_rows)
        if n <= 1 or not len(axes):
            yield from (rows[i:i + leaf_rows] for i in range(0, len(rows), leaf_rows))
            return
        rows = rows[np.argsort(vectors[rows, axes[depth]], kind="stable")]
        last = depth == len(axes) - 1
        slabs = n if last else math.ceil(n ** (1 / (len(axes) - depth)))
        size = leaf_rows * math.ceil(n / slabs)
        for i in range(0, len(rows), size):
            yield from [rows[i:i + size]] if last else cut(rows[i:i + size], depth + 1)

    yield from cut(np.arange(len(vectors)), 0)


def packed(rows: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """The leaves of ``rows`` (vec_id, label, v), written to the shared folder; rows that repeat in full count once."""

    def leaves(ids, labels, vectors, chunk):
        order = np.lexsort((*vectors.T[::-1], ids, labels))
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
        ids, labels, vectors = ids[new], labels[new], vectors[new]
        starts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
        out = [[] for _ in range(9)]
        for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            for leaf in tiles(vectors[a:b], params.leaf_rows):
                at = a + np.sort(leaf)
                own = vectors[at]
                row = (chunk, own.shape[1], labels[a], labels[a], own.min(axis=0), own.max(axis=0), ids[at], labels[at], own.ravel())
                for column, x in zip(out, row, strict=True):
                    column.append(x)
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32())]
        names = [x.split()[0] for x in LEAVES.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    def pack(batches):
        from pyspark import TaskContext

        part, turn, held = TaskContext.get().partitionId(), 0, []

        def flush():
            ids, labels = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in (0, 1))
            lists = pa.chunked_array([b.column(2) for b in held]).combine_chunks()
            sizes = np.asarray(lists.value_lengths())
            for dim in np.unique(sizes):
                mine = sizes == dim
                own = matrix(lists.filter(pa.array(mine)))
                yield leaves(ids[mine], labels[mine], own.reshape(int(mine.sum()), int(dim)), f"{part}-{turn}-{dim}")

        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= 2 * params.chunk_rows:
                yield from flush()
                held, turn = [], turn + 1
        if any(len(b) for b in held):
            yield from flush()

    own = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v")
    chunks = max(1, math.ceil(own.count() / params.chunk_rows))
    # the id as last key also cuts a label all of whose vectors are equal
    dealt = own.repartitionByRange(chunks, F.size("v"), "label", F.get("v", F.lit(0)), "vec_id")
    return durable(dealt.mapInArrow(pack, LEAVES))


class Tree:
    """Boxes over a chunk's leaves, the root first; a node holds the nodes or the leaf given by its child range."""

    def __init__(self, low, high, label_low, label_high, least_id, fan_out: int):
        levels = [(low, high, label_low, label_high, least_id)]
        while len(levels[-1][0]) > 1:
            at = np.arange(0, len(levels[-1][0]), fan_out)
            ways = (np.minimum, np.maximum, np.minimum, np.maximum, np.minimum)
            levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip(ways, levels[-1], strict=True)))
        levels = levels[::-1]
        starts = np.cumsum([0, *[len(x[0]) for x in levels]])
        self.low, self.high, self.label_low, self.label_high, self.least_id = (
            np.concatenate([x[i] for x in levels]) for i in range(5)
        )
        self.first_leaf = int(starts[-2])
        self.children = [range(0)] * len(self.low)
        for depth in range(len(levels) - 1):
            for i in range(len(levels[depth][0])):
                below = int(starts[depth + 1])
                self.children[starts[depth] + i] = range(below + i * fan_out, min(below + (i + 1) * fan_out, int(starts[depth + 2])))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest inner product of each query with what each box may hold."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        low, high = self.low.T, self.high.T
        return product(up, low) + product(down, high), product(up, high) + product(down, low)


class Found:
    """The k best rows of each query and window: scores descending, ties by smaller id."""

    def __init__(self, windows: np.ndarray, k: int):
        self.low, self.high = windows[:, :, 0], windows[:, :, 1]
        self.scores = np.full((*self.low.shape, k), NONE, dtype=np.int64)
        self.ids = np.full((*self.low.shape, k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            fits = (scores >= max(self.low[q, w], self.scores[q, w, -1])) & (scores <= self.high[q, w])
            if fits.any():
                s = np.concatenate([self.scores[q, w], scores[fits]])
                i = np.concatenate([self.ids[q, w], ids[fits]])
                best = np.lexsort((i, -s))[:self.scores.shape[2]]
                self.scores[q, w], self.ids[q, w] = s[best], i[best]


def visit(tree: Tree, leaves: list, queries: dict, found: Found, same_label: bool) -> int:
    """Search one tree for all queries; returns the number of leaves that were read."""
    read, vectors = 0, queries["v"]
    for first in range(0, len(vectors), 1024):
        lower, upper = tree.bounds(vectors[first:first + 1024])
        for r in range(len(lower)):
            q = first + r
            label, own_id, low, high = queries["label"][q], queries["id"][q], found.low[q], found.high[q]
            if same_label:
                fits = (tree.label_low <= label) & (label <= tree.label_high)
            else:
                fits = (tree.label_low != label) | (tree.label_high != label)
            meets = (upper[r][:, None] >= low) & (lower[r][:, None] <= high)
            fits &= meets.any(axis=1)
            best, least = upper[r].tolist(), tree.least_id.tolist()
            queue = [(-best[0], 0)] if fits[0] else []
            kth, kth_id = found.scores[q, :, -1], found.ids[q, :, -1]
            while queue:
                bound, node = heapq.heappop(queue)
                bound = -bound
                if (bound < np.maximum(kth, low)).all():
                    break
                if not (meets[node] & ((bound > kth) | ((bound == kth) & (least[node] < kth_id)))).any():
                    continue
                if node < tree.first_leaf:
                    for child in tree.children[node]:
                        if fits[child]:
                            heapq.heappush(queue, (-best[child], child))
                    continue
                read += 1
                ids, labels, rows = leaves[node - tree.first_leaf]
                scores = product(rows, vectors[q])
                wanted = (labels == label) & (ids != own_id) if same_label else labels != label
                wanted &= (scores >= np.maximum(kth, low).min()) & (scores <= high.max())
                if wanted.any():
                    found.add(q, scores[wanted], ids[wanted])
    return read


def best_rows(
    index: DataFrame, queries: dict, windows: np.ndarray, k: int, same_label: bool, params: TreeParams = TreeParams()
) -> DataFrame:
    """(query, window, rank, id, score): the ``k`` best rows of the index for each query and window.

    ``queries`` holds arrays id, label and v (one row a query, all of one dimension) of at most ``block_bytes``;
    ``windows`` has for each query and window its lowest and highest score. A row fits when its label is (or, where
    ``same_label`` is false, is not) the query's; rows with the query's own id do not fit under the same label.
    """
    dim = queries["v"].shape[1]
    sent = index.sparkSession.sparkContext.broadcast((queries, windows))

    def search(batches):
        (own, spans), chunk, held, size = sent.value, None, [], 0
        own = own | {"v": own["v"].astype(np.float64)}
        found = Found(spans, k)

        def walk():
            low, high = (np.array([x[i] for x in held]).reshape(len(held), dim) for i in (1, 2))
            ranges = [np.array([x[i] for x in held]) for i in (3, 4)]
            least = np.array([x[5].min() for x in held])
            visit(Tree(low, high, *ranges, least, params.fan_out), [x[5:] for x in held], own, found, same_label)

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                name, _, label_low, label_high, *arrays = row
                low, high, ids, labels, flat = (np.asarray(x.values) for x in arrays)
                if held and (name.as_py() != chunk or size >= 2 * params.chunk_rows):
                    walk()
                    held, size = [], 0
                chunk = name.as_py()
                vectors = flat.reshape(len(ids), dim).astype(np.float64)
                held.append((name, low, high, label_low.as_py(), label_high.as_py(), ids, labels, vectors))
                size += len(ids)
        if held:
            walk()
        q, w, place = np.nonzero(found.scores > NONE)
        yield pa.record_batch(
            [pa.array(q.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(found.ids[q, w, place]), pa.array(found.scores[q, w, place])],
            names=["query", "window", "id", "score"],
        )

    from pyspark.sql import Window

    parts = index.filter(F.col("dim") == dim).mapInArrow(search, "query int, window int, id long, score long")
    # the grouped limit keeps k rows of a query and window before they are exchanged
    place = F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "id"))
    return parts.withColumn("rank", place).filter(F.col("rank") <= k)
