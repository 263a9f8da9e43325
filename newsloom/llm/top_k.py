"""Exact top-k search by inner product: dual-tree search over cover trees.

A cover tree here is a sequence of nested nets: the centres in farthest-first order, of which every
beginning is a net. Level by level the beginning grows by FANOUT; a node is a centre on a level,
its children are the centres of the next level that are nearest to it, itself among them. Each
node has a covering radius.

Queries are rows of the table itself, and both are indexed together: the upper tree is fitted to a
bounded sample, every row goes to its nearest centre of the lowest level, its cell, and radii are
taken over all rows, for queries and for data. Below, each block of a cell gets a tree of its own
inside the task that searches it, and so does each group of queries.

Pairs of nodes, queries around q within r and data around d within s, can reach no more than
q.d + |q| s + |d| r + r s. The search takes the pair with the highest bound, drops it where the
bound is under the worst k-th score that the queries below the node have so far, and else splits
its wider node, until two leaves meet and are scored. First every query searches a block of its own
cell; then the upper tree, walked against itself, leaves pairs of cells, and groups of queries
meet the blocks of these cells, which are walked in the same way. What is not dropped is scored
exactly. If the vectors have no structure nothing is pruned, and the search is a blocked scan.

Cells are cut into blocks of BLOCK rows by a hash of the id, so that a cell of any size, or a
vector that a third of the rows share, makes more blocks, not larger ones; queries come in groups
of at most about GROUP. Rows are copied for the groups that reach their block, and for no other.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do
rows without an id; shorter vectors count as 0 beyond their end; ties go to the smaller id;
repeated rows are candidates each, but ask only once; candidates with the query's id never match;
other columns are ignored. Scores beyond 64 bits are held at the limits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import stored

SCALE = 1024
# Bounds: sampled vectors, cells, rows of a block, queries of a group.
SAMPLE = 4096
CELLS = 64
BLOCK = 8192
GROUP = 4096
LEAF = 128
QUERY_LEAF = 32
# Nodes of a level, in those of the level above.
FANOUT = 4


def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): components times SCALE, rounded down; unusable rows left out."""
    usable = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, padded with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    largest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(
        np.abs(b.astype(np.float64)).max(initial=0)
    )
    if largest * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def nets(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres in farthest-first order (every beginning of it is a net), the nearest centre of
    each point and its distance."""
    chosen = [0]
    near = np.zeros(len(points), np.int64)
    far = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(most, len(points)):
        k = int(np.argmax(far))
        if far[k] == 0:
            break
        distance = np.linalg.norm(points - points[k], axis=1)
        closer = distance < far
        near[closer], far[closer] = len(chosen), distance[closer]
        chosen.append(k)
    return np.array(chosen), near, far


class CoverTree:
    """Nested nets over given centres in farthest-first order, the leaves; nodes are numbered from
    the root on. ``radii`` are bounds of the distance to anything below a node, from those of the
    leaves."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray):
        self.leaves = len(centres)
        sizes = [max(1, self.leaves)]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // FANOUT))
        first, points, children = 0, [], []
        for level, size in enumerate(reversed(sizes)):
            net = centres[:size]
            if level:
                above = points[-1]
                gaps = np.linalg.norm(net[:, None] - above[None], axis=2)
                parent = gaps.argmin(1)
                parent[: len(above)] = np.arange(len(above))  # nets are nested
                for k in range(len(above)):
                    children.append((first + np.flatnonzero(parent == k)).tolist())
            points.append(net)
            first += size
        self.first_leaf = first - self.leaves
        self.centres = np.concatenate(points)
        self.children = children + [[] for _ in range(self.leaves)]
        self.radii = np.zeros(first)
        self.radii[self.first_leaf :] = radii
        for node in range(self.first_leaf - 1, -1, -1):
            below = self.children[node]
            gaps = np.linalg.norm(self.centres[below] - self.centres[node], axis=1)
            self.radii[node] = (gaps + self.radii[below]).max()
        self.norms = np.linalg.norm(self.centres, axis=1)

    def leaf(self, node: int) -> int:
        """Number of the leaf, -1 for an inner node."""
        return node - self.first_leaf if node >= self.first_leaf else -1


def indexed_leaves(vectors: np.ndarray, leaf: int) -> tuple[CoverTree, list[np.ndarray]]:
    """A tree over some rows and the rows of its leaves, each of about ``leaf``."""
    points = vectors.astype(np.float64)
    centres, near, far = nets(points, 1 + len(points) // leaf)
    order = np.argsort(near, kind="stable")
    bounds = np.searchsorted(near[order], np.arange(len(centres) + 1))
    members = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    radii = np.array([far[m].max(initial=0) for m in members])
    return CoverTree(points[centres], radii), members


def walk(queries: CoverTree, data: CoverTree, worst, met) -> None:
    """Walk two trees together, the pair of the highest bound first. ``worst(leaf)`` is the score
    that a query leaf has to beat; ``met(q, d)`` takes the pairs of leaves that are left."""
    below = {}

    def leaves_under(node: int) -> list[int]:
        if node not in below:
            leaf = queries.leaf(node)
            under = [leaf] if leaf >= 0 else [x for c in queries.children[node] for x in leaves_under(c)]
            below[node] = under
        return below[node]

    def bounds(q: int, nodes: list[int]) -> np.ndarray:
        return reach(
            queries.centres[q], queries.radii[q], queries.norms[q],
            data.centres[nodes], data.radii[nodes], data.norms[nodes],
        )

    heap = [(-float(bounds(0, [0])[0]), 0, 0)]
    while heap:
        bound, q, d = heapq.heappop(heap)
        if -bound < min(map(worst, leaves_under(q))):
            continue
        q_leaf, d_leaf = queries.leaf(q), data.leaf(d)
        if q_leaf >= 0 and d_leaf >= 0:
            met(q_leaf, d_leaf)
        elif d_leaf >= 0 or (q_leaf < 0 and queries.radii[q] > data.radii[d]):
            for child in queries.children[q]:
                heapq.heappush(heap, (-float(bounds(child, [d])[0]), child, d))
        else:
            below_d = data.children[d]
            for child, value in zip(below_d, bounds(q, below_d).tolist(), strict=True):
                heapq.heappush(heap, (-value, q, child))


def reach(q: np.ndarray, r, q_norm, d: np.ndarray, s: np.ndarray, d_norm: np.ndarray) -> np.ndarray:
    """Upper bound of the inner products between two nodes, a little above for rounding."""
    bound = d @ q + q_norm * s + d_norm * r + r * s
    return bound + np.abs(bound) * 1e-9 + 1


def search(
    ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
    floors: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k best (score, id) of each query in a block, none of them under its floor."""
    low = np.iinfo(np.int64).min
    best = np.full((len(queries), k), low)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    if len(data) and len(queries):
        data_tree, rows_of = indexed_leaves(data, LEAF)
        query_tree, queries_of = indexed_leaves(queries, QUERY_LEAF)
        needed = np.array([floors[group].min() for group in queries_of])

        def met(q: int, d: int) -> None:
            group, rows = queries_of[q], rows_of[d]
            scores = products(queries[group], data[rows])
            scores[query_ids[group][:, None] == ids[rows][None]] = low
            scores = np.concatenate([best[group], scores], axis=1)
            names = np.concatenate(
                [best_ids[group], np.broadcast_to(ids[rows], (len(group), len(rows)))], axis=1
            )
            top = np.lexsort((names, ~scores), axis=1)[:, :k]
            best[group] = np.take_along_axis(scores, top, 1)
            best_ids[group] = np.take_along_axis(names, top, 1)
            needed[q] = np.maximum(best[group, -1], floors[group]).min()

        walk(query_tree, data_tree, needed.__getitem__, met)
    ok = (best > low) & (best >= floors[:, None])
    which, place = np.nonzero(ok)
    return which, best_ids[which, place], best[which, place]


def _cell_udf(centres: np.ndarray):
    """Nearest centre of each vector, and the distance."""

    def run(batches):
        for batch in batches:
            points = matrix(batch.column("v"), centres.shape[1]).astype(np.float64)
            squares = (points**2).sum(1)[:, None] + (centres**2).sum(1)[None]
            cell = (squares - 2 * points @ centres.T).argmin(1) if len(points) else np.zeros(0)
            cell = cell.astype(np.int32)
            far = np.linalg.norm(points - centres[cell], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(far)],
                [*batch.schema.names, "cell", "far"],
            )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, v)."""
    spark = vectors.sparkSession
    vectors = stored(vectors, "vectors")
    shape = vectors.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("width")).first()
    rows, width = shape["rows"], shape["width"] or 0
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not rows:
        return spark.createDataFrame([], schema)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(rows))
    sample = vectors.where(spread < SAMPLE).limit(2 * SAMPLE).union(vectors.limit(1)).toArrow()
    points = matrix(sample.column("v"), width).astype(np.float64)
    centres = points[nets(points, CELLS)[0]]
    indexed = stored(
        vectors.mapInArrow(_cell_udf(centres), "vec_id bigint, v array<bigint>, cell int, far double"),
        "indexed",
    )
    cells = indexed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius"))
    cells = {row["cell"]: row for row in cells.collect()}  # CELLS rows at most
    blocks = {cell: -(-row["rows"] // BLOCK) for cell, row in cells.items()}
    block_of = F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair))
    data = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), block_of[F.col("cell")]).cast("int"))
    asked = (
        indexed.where(is_query)
        .withColumn("asks", F.xxhash64("vec_id", "v"))
        .dropDuplicates(["asks"])
        .select("asks", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "cell", "far")
    )
    count = asked.count()
    groups = -(-count // GROUP) or 1
    asked = asked.withColumn("group", F.pmod("asks", F.lit(groups)).cast("int"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data = left.column("vec_id").to_numpy(), matrix(left.column("v"), width)
        query_ids, queries = right.column("query_id").to_numpy(), matrix(right.column("q"), width)
        asks = right.column("asks").to_numpy()
        which, names, scores = search(
            ids, data, query_ids, queries, right.column("floor").to_numpy(), k
        )
        return pa.table(
            {"asks": asks[which], "query_id": query_ids[which], "vec_id": names, "score": scores}
        )

    def met(data: DataFrame, asking: DataFrame) -> DataFrame:
        by = ["cell", "block", "group"]
        reached = asking.select(*(F.col(name).alias(f"at_{name}") for name in by)).distinct()
        here = (F.col("cell") == F.col("at_cell")) & (F.col("block") == F.col("at_block"))
        return (
            data.join(reached, here)
            .select(*(F.col(f"at_{name}").alias(name) for name in by), "vec_id", "v")
            .groupBy(*by)
            .cogroup(asking.select(*by, "asks", "query_id", "q", "floor").groupBy(*by))
            .applyInArrow(run, "asks bigint, query_id bigint, vec_id bigint, score bigint")
        )

    # Every query in one block of its own cell: a first k-th score.
    low = F.lit(np.iinfo(np.int64).min).cast("bigint")
    own = asked.withColumn("block", F.pmod("asks", block_of[F.col("cell")]).cast("int"))
    first = met(data, own.withColumn("floor", low))
    floors = first.groupBy("asks").agg(F.min("score").alias("floor"), F.count("*").alias("found"))
    asked = stored(
        asked.join(floors.where(F.col("found") >= k).select("asks", "floor"), "asks", "left").withColumn(
            "floor", F.coalesce("floor", low)
        ),
        "asked",
    )

    # The upper tree against itself: radii of queries on one side, of all rows on the other.
    worst = {row["cell"]: row for row in asked.groupBy("cell").agg(
        F.max("far").alias("radius"), F.min("floor").alias("floor")
    ).collect()}  # CELLS rows at most
    inside = np.array([cells[c]["radius"] if c in cells else 0.0 for c in range(len(centres))])
    asking_from = np.array([worst[c]["radius"] if c in worst else 0.0 for c in range(len(centres))])
    nobody = np.iinfo(np.int64).max
    pairs = []

    def left(q: int, d: int) -> None:
        if q in worst and d in cells:
            pairs.append((q, d))

    walk(
        CoverTree(centres, asking_from),
        CoverTree(centres, inside),
        lambda q: worst[q]["floor"] if q in worst else nobody,
        left,
    )
    # CELLS * CELLS pairs at most; the blocks of a cell come from the bounded table of cells.
    targets = spark.createDataFrame(pairs, "cell int, target int")
    every = F.sequence(F.lit(0), block_of[F.col("target")] - 1)
    asking = (
        asked.join(F.broadcast(targets), "cell")
        .withColumn("block", F.explode(every))
        .select("asks", "query_id", "q", "floor", "group", F.col("target").alias("cell"), "block")
    )
    found = met(data, asking)
    ranked = Window.partitionBy("asks").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
