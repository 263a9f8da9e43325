"""Approximate nearest neighbours: a hierarchical k-means tree, walked best bin first.

The tree is fitted to a bounded sample (SAMPLE vectors): k-means splits a node into BRANCH
children until a node holds LEAF sampled vectors or fewer. It is a constant of bounded size. Every
row of the table goes down to one leaf. A query walks the tree with a priority queue of nodes
by the distance to their centres: the nearest node is taken off the queue, a leaf is visited, an
inner node puts its children on the queue.

Calibration decides how many leaves are visited. For a bounded set of the queries (CALIBRATION)
the true neighbours come from a scan of all rows; then the visits widen, leaf by leaf, until
TARGET of these neighbours lie in visited leaves. All queries visit that many leaves.

Leaves are cut into blocks of about BLOCK rows by a hash of the row, and the queries of a leaf
into groups of about GROUP, so a leaf of any size, or a vector that a third of the rows share,
makes more tasks, not larger ones. Rows move only to groups that visit their leaf. In a block
every row is scored: inner products shortlist, and the shortlist's distances are summed from
differences in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite components, take no part,
nor do rows without an id; shorter vectors count as 0 beyond their end; ties go to the smaller
id; repeated rows are candidates each, but ask only once; rows with the query's id are never its
results; other columns are ignored; an empty table has no row.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import stored

# Bounds of what is fitted on the driver: sampled vectors, and queries of the calibration.
SAMPLE = 16384
CALIBRATION = 128
BRANCH = 8
LEAF = 64
TARGET = 0.97
BLOCK = 8192
GROUP = 4096
STEPS = 12
# A node at this depth is a leaf, however many sampled vectors it holds.
DEPTH = 64


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): double components of the vectors that take part."""
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    other = F.exists("embedding", lambda x: x != 0)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(finite & other).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, padded with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b, up to rounding."""
    out = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(out, 0, out=out)


def k_means(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres, and the centre of each point; starts are far from each other."""
    chosen = [0]
    far = squares(points, points[:1])[:, 0]
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        np.minimum(far, squares(points, points[chosen[-1:]])[:, 0], out=far)
    centres = points[chosen].copy()
    for _ in range(STEPS):
        owner = squares(points, centres).argmin(1)
        moved = centres.copy()
        for c in range(len(centres)):
            if (owner == c).any():
                moved[c] = points[owner == c].mean(0)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres, squares(points, centres).argmin(1)


@dataclass
class Node:
    centres: np.ndarray | None = None  # of the children
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


class Tree:
    """A hierarchical k-means tree; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, branch: int = BRANCH, leaf: int = LEAF):
        self.leaves = 0
        self.root = self._grow(points, branch, leaf, 0)

    def _grow(self, points: np.ndarray, branch: int, leaf: int, depth: int) -> Node:
        if len(points) > leaf and depth < DEPTH:
            centres, owner = k_means(points, branch)
            used = np.unique(owner)
            if len(used) > 1:
                children = [self._grow(points[owner == c], branch, leaf, depth + 1) for c in used]
                return Node(centres[used], children)
        node = Node(leaf=self.leaves)
        self.leaves += 1
        return node

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: at every node the nearest child."""
        out = np.zeros(len(points), np.int32)
        open_nodes = [(self.root, np.arange(len(points)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if node.centres is None:
                out[rows] = node.leaf
            elif len(rows):
                owner = squares(points[rows], node.centres).argmin(1)
                open_nodes += [(child, rows[owner == c]) for c, child in enumerate(node.children)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        queue = [(0.0, 0, self.root)]
        made, out = 1, []
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            if node.centres is None:
                out.append(node.leaf)
                continue
            gaps = ((node.centres - query) ** 2).sum(1)
            for gap, child in zip(gaps.tolist(), node.children, strict=True):
                heapq.heappush(queue, (gap, made, child))
                made += 1
        return out


def best(
    ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of the k nearest rows of each query, own ids left out."""
    which, rows = [], []
    for at in range(0, len(queries), 256):
        some = queries[at : at + 256]
        near = squares(some, data)
        near[query_ids[at : at + 256, None] == ids[None]] = np.inf
        if near.shape[1] > k:
            # All that rounding may have moved across the kth place stay on the shortlist.
            worst = np.partition(near, k - 1, axis=1)[:, k - 1]
            scale = (some**2).sum(1) + (data**2).sum(1).max(initial=0)
            short = near <= (worst + 1e-11 * scale)[:, None]
        else:
            short = np.ones(near.shape, bool)
        short &= np.isfinite(near)
        a, b = np.nonzero(short)
        which.append(a + at)
        rows.append(b)
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    which, rows = np.concatenate(which), np.concatenate(rows)
    exact = np.empty(len(which))
    for at in range(0, len(which), 1 << 16):
        part = slice(at, at + (1 << 16))
        exact[part] = np.sqrt(((queries[which[part]] - data[rows[part]]) ** 2).sum(1))
    order = np.lexsort((ids[rows], exact, which))
    which, rows, exact = which[order], rows[order], exact[order]
    first = np.searchsorted(which, which)
    top = np.arange(len(which)) - first < k
    return which[top], ids[rows[top]], exact[top]


FOUND = "ask bigint, query_id bigint, vec_id bigint, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what the blocks found for each query; k rows per block at most come in."""
    nearest = Window.partitionBy("ask").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def exact_neighbours(vectors: DataFrame, asked: pa.Table, width: int, k: int) -> DataFrame:
    """(ask, rank, vec_id, score): true neighbours of a bounded set of queries, by one scan."""
    asks = asked.column("ask").to_numpy()
    query_ids = asked.column("query_id").to_numpy()
    queries = dense(asked.column("q"), width)

    def run(batches):
        for batch in batches:
            ids, data = batch.column("vec_id").to_numpy(), dense(batch.column("v"), width)
            which, names, scores = best(ids, data, query_ids, queries, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(asks[which]), pa.array(query_ids[which]), pa.array(names), pa.array(scores)],
                ["ask", "query_id", "vec_id", "score"],
            )

    return _ranked(vectors.select("vec_id", "v").mapInArrow(run, FOUND), k)


def leaves_for(recall: list[int], leaves: int, target: float) -> int:
    """The fewest visits after which ``target`` of the neighbours were met; ``recall`` holds the
    visit in which each was."""
    if not recall:
        return 1
    met = np.bincount(recall, minlength=leaves)
    share, visits = 0.0, 0
    while visits < leaves and share < target:
        share += met[visits] / len(recall)
        visits += 1
    return visits


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, target: float = TARGET, visits: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, v); ``visits`` sets the number
    of leaves instead of the calibration."""
    spark = vectors.sparkSession
    vectors = stored(vectors, "tree-vectors")
    shape = vectors.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("width")).first()
    rows, width = shape["rows"], shape["width"] or 0
    if not rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def some(table: DataFrame, key: Column, count: int, most: int) -> DataFrame:
        """About ``most`` rows by a hash, of ``count``."""
        return table.where(F.pmod(key, F.lit(max(count, 1))) < most).limit(2 * most)

    spread = F.xxhash64("vec_id", F.lit("tree"))
    sample = some(vectors, spread, rows, SAMPLE).union(vectors.limit(1)).toArrow()
    tree = Tree(dense(sample.column("v"), width))

    def to_leaf(batches):
        for batch in batches:
            leaf = tree.place(dense(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    indexed = stored(vectors.mapInArrow(to_leaf, "vec_id bigint, v array<double>, leaf int"), "tree-index")
    asked = stored(
        vectors.where(is_query)
        .select(F.xxhash64("vec_id", "v").alias("ask"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        .dropDuplicates(["ask"]),
        "tree-queries",
    )
    if visits is None:
        few = some(asked, F.xxhash64("ask", F.lit("calibration")), asked.count(), CALIBRATION).toArrow()
        true = exact_neighbours(vectors, few, width, k).select("ask", "vec_id")
        # CALIBRATION * 2 * k rows at most; a repeated id counts with every leaf it is in.
        true = indexed.select("vec_id", "leaf").join(F.broadcast(true), "vec_id").distinct().collect()
        order = {
            ask: {leaf: n for n, leaf in enumerate(tree.visits(q, tree.leaves))}
            for ask, q in zip(few.column("ask").to_pylist(), dense(few.column("q"), width), strict=True)
        }
        visits = leaves_for([order[row["ask"]][row["leaf"]] for row in true], tree.leaves, target)

    def to_visits(batches):
        for batch in batches:
            lists = [tree.visits(q, visits) for q in dense(batch.column("q"), width)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "leaves"]
            )

    asking = asked.mapInArrow(to_visits, "ask bigint, query_id bigint, q array<double>, leaves array<int>")
    asking = stored(asking.select("ask", "query_id", "q", F.explode("leaves").alias("leaf")), "tree-visits")

    # Blocks of each leaf and groups of its queries: one row per leaf, a bounded number.
    sizes = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    groups = asking.groupBy("leaf").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    cut = sizes.join(groups, "leaf")
    row = F.monotonically_increasing_id()
    data = (
        indexed.join(F.broadcast(cut), "leaf")
        .withColumn("block", F.pmod(F.xxhash64(row), F.col("blocks")))
        .withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
    )
    asking = (
        asking.join(F.broadcast(cut), "leaf")
        .withColumn("group", F.pmod("ask", F.col("groups")))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    )

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, points = left.column("vec_id").to_numpy(), dense(left.column("v"), width)
        query_ids, queries = right.column("query_id").to_numpy(), dense(right.column("q"), width)
        which, names, scores = best(ids, points, query_ids, queries, k)
        asks = right.column("ask").to_numpy()
        return pa.table({"ask": asks[which], "query_id": query_ids[which], "vec_id": names, "score": scores})

    by = ["leaf", "block", "group"]
    found = (
        data.select(*by, "vec_id", "v")
        .groupBy(*by)
        .cogroup(asking.select(*by, "ask", "query_id", "q").groupBy(*by))
        .applyInArrow(run, FOUND)
    )
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
