"""Vector code compression: each vector becomes PARTS one-byte indexes into small codebooks, which
are fitted to all vectors in exact integers.

LAESA pivots. The parts' distances to a few fixed pivots are computed once and stored with them.
Each round computes the pivots' distances to the codebook's entries only; by the triangle
inequality their differences bound the distance of a part to an entry from below. Entries are
tried in the order of these bounds, and an entry whose bound exceeds the best exact distance so
far is not evaluated. The bounds are floating-point and taken a little lower; what decides are
exact integer squares, and ties go to the lower index.

A round is one pass over the stored parts: every batch gives a count and componentwise sums per
entry, which Spark adds up. The driver sees the codebooks alone, PARTS * ENTRIES * width numbers.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped; shorter
vectors, and widths that PARTS does not divide, count as 0 beyond their end; the first entries are
the parts of the smallest ids (equal ids by their vectors, rows without an id last); fewer rows
than entries make shorter codebooks; entries nobody uses stay; repeated rows are rows of their
own; other columns are ignored; an empty table has no row. Components beyond 64 bits are held at
the limits, and so are errors; all work on large components is in Python's integers.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.tables import stored
from newsloom.llm.top_k import matrix

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
PIVOTS = 3
# Components up to this size keep squared distances of any width here within 2^62.
SAFE = 1 << 24
MAX_LONG = (1 << 63) - 1


def whole(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): components times ``scale``, rounded down; unusable rows left out."""
    usable = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = embeddings.where(F.col("embedding").isNotNull()).where(usable)
    return rows.select("vec_id", "label", v.alias("v"))


def _cut(column: pa.Array, width: int) -> np.ndarray:
    """(row, part, component); Python integers where squares would leave 64 bits."""
    points = matrix(column, width)
    if len(points) and (points.max() > SAFE or points.min() < -SAFE):
        points = points.astype(object)
    return points.reshape(len(points), PARTS, -1)


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows, in floating point."""
    a, b = points.astype(np.float64), others.astype(np.float64)
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def nearest(
    points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, the lowest index among equals, and its squared distance."""
    if len(points) and points.dtype != entries.dtype:
        points, entries = points.astype(object), entries.astype(object)
    between = _distances(entries, pivots)  # the round's only new distances
    low = np.zeros((len(points), len(entries)))
    for p in range(pivots.shape[0]):
        np.maximum(low, np.abs(to_pivots[:, p, None] - between[None, :, p]), out=low)
    # Rounding may lift a bound by some units in the last place of the distances it comes from.
    slack = 1e-9 * (to_pivots.max(1, initial=0) + between.max(initial=0) + 1)
    low = np.maximum(low - slack[:, None], 0) ** 2 * (1 - 1e-9)
    order = np.argsort(low, axis=1, kind="stable")
    best = np.zeros(len(points), np.int64)
    least = np.zeros(len(points), points.dtype)
    rows = np.arange(len(points))
    for k in range(len(entries)):
        if k:
            # Bounds only grow along the order: a point that stops here has its entry.
            rows = rows[low[rows, order[rows, k]] <= least[rows].astype(np.float64) * (1 + 1e-9)]
        if not len(rows):
            break
        tried = order[rows, k]
        square = ((points[rows] - entries[tried]) ** 2).sum(1)
        if k:
            better = (square < least[rows]) | ((square == least[rows]) & (tried < best[rows]))
            chosen, tried, square = rows[better], tried[better], square[better]
        else:
            chosen = rows
        best[chosen], least[chosen] = tried, square
    return best, least


def _with_pivots(parts: DataFrame, pivots: list[np.ndarray], width: int) -> DataFrame:
    """``parts`` with ``far``: distances to the pivots, part by part."""

    def run(batches):
        for batch in batches:
            points = _cut(batch.column("v"), width)
            far = np.concatenate(
                [_distances(points[:, j], pivots[j]) for j in range(PARTS)], axis=1
            )
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(points) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "far"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    return parts.mapInArrow(run, f"{schema}, far array<double>")


def _assigned(batch: pa.RecordBatch, books, pivots, width: int):
    """Points, and per part the nearest entries and squared distances."""
    points = _cut(batch.column("v"), width)
    far = batch.column("far")
    far = far.flatten().to_numpy(zero_copy_only=False).reshape(len(points), PARTS, -1)
    found = [nearest(points[:, j], far[:, j], books[j], pivots[j]) for j in range(PARTS)]
    return points, found


def _totals(stored_parts: DataFrame, books, pivots, width: int) -> list:
    """Per part, entry and component: number of points and their sum."""

    def run(batches):
        for batch in batches:
            points, found = _assigned(batch, books, pivots, width)
            out = []
            for j, (entry, _) in enumerate(found):
                for e in np.unique(entry):
                    mine = points[entry == e, j]
                    sums = mine.sum(0) if len(mine) < 1 << 32 else mine.astype(object).sum(0)
                    out += [(j, int(e), i, len(mine), Decimal(int(s))) for i, s in enumerate(sums)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "place", "n", "total"])

    sums = stored_parts.select("v", "far").mapInArrow(
        run, "part int, entry int, place int, n bigint, total decimal(38,0)"
    )
    return (
        sums.groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
        .collect()  # PARTS * ENTRIES * components of a part at most
    )


def _book_array(book: list[list[int]]) -> np.ndarray:
    largest = max((abs(x) for entry in book for x in entry), default=0)
    return np.array(book, object if largest > SAFE else np.int64).reshape(len(book), -1)


class Codebooks:
    """Entries of every part, and the pivots the search uses."""

    def __init__(self, entries: list[list[list[int]]], pivots: list[np.ndarray], width: int):
        self.entries, self.pivots, self.width = entries, pivots, width

    @property
    def arrays(self) -> list[np.ndarray]:
        return [_book_array(book) for book in self.entries]

    def sha256(self) -> str:
        flat = (str(x) for book in self.entries for entry in book for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def _pivots_of(book: list[list[int]], count: int) -> np.ndarray:
    """Fixed pivots of a part: first entries, each far from those taken before."""
    entries = np.array(book, np.float64).reshape(len(book), -1)
    chosen = [0]
    while len(chosen) < min(count, len(entries)):
        gaps = _distances(entries, entries[chosen]).min(1)
        chosen.append(int(gaps.argmax()))
    return entries[chosen]


def fit(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, pivots: int = PIVOTS):
    """Codebooks fitted to all ``vectors`` (vec_id, label, v), and the stored vectors with their
    pivot distances; None and None if there are no vectors."""
    vectors = stored(vectors, "code-vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return None, None
    width = max(PARTS, -(-width // PARTS) * PARTS)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v")
    starts = [row["v"] + [0] * (width - len(row["v"])) for row in first.collect()]
    size = width // PARTS
    books = [[start[j * size : (j + 1) * size] for start in starts] for j in range(PARTS)]
    fixed = [_pivots_of(book, pivots) for book in books]
    parts = stored(_with_pivots(vectors, fixed, width), "code-parts")
    found = Codebooks(books, fixed, width)
    for _ in range(rounds):
        for row in _totals(parts, found.arrays, fixed, width):
            found.entries[row["part"]][row["entry"]][row["place"]] = int(row["total"]) // row["n"]
    return found, parts


def encode(parts: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): indexes as two hex digits each, squared distance summed."""
    arrays, pivots, width = books.arrays, books.pivots, books.width
    digits = [f"{e:02x}" for e in range(256)]

    def run(batches):
        for batch in batches:
            points, found = _assigned(batch, arrays, pivots, width)
            codes = ["".join(digits[e] for e in row) for row in zip(*(e for e, _ in found), strict=True)]
            error = sum((square.astype(object) for _, square in found), np.zeros(len(points), object))
            error = [min(int(x), MAX_LONG) for x in error]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    kind = parts.schema["label"].dataType.simpleString()
    id_kind = parts.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_kind}, label {kind}, code string, error bigint"
    return parts.select("vec_id", "label", "v", "far").mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``approximate``: the vector that a code stands for."""
    table = F.lit([[[x / scale for x in entry] for entry in book] for book in books.entries])
    index = F.sequence(F.lit(0), F.lit(PARTS - 1))
    at = lambda j: F.conv(F.substr("code", 2 * j + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("approximate", F.flatten(F.transform(index, lambda j: table[j][at(j)])))


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of all usable rows."""
    books, parts = fit(whole(embeddings))
    if books is None:
        return embeddings.sparkSession.createDataFrame(
            [], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
        )
    codes = stored(encode(parts, books), "codes")
    held = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MAX_LONG).cast("decimal(38,0)"))
    # A few rows per label; which join fits is left to Spark, which knows the stored sizes.
    labels = codes.groupBy(F.col("label").alias("of")).agg(held.cast("bigint").alias("label_error"))
    return codes.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def twin_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of ``compress`` for vectors whose width PARTS divides."""
    near = (
        "{to} AS MATERIALIZED (SELECT vec_id, label, rid, part, p, entry, error FROM (SELECT x.*, b.entry, "
        "list_sum(list_transform(list_zip(x.p, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS error, "
        "row_number() OVER (PARTITION BY x.rid, x.part ORDER BY list_sum(list_transform(list_zip(x.p, b.e), "
        "lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry) AS best FROM parts AS x JOIN {book} AS b ON b.part = x.part) "
        "WHERE best = 1)"
    )
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, "
        f"list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, rid, j.part, list_slice(v, j.part * len(v) // {PARTS} + 1, "
        f"(j.part + 1) * len(v) // {PARTS}) AS p FROM kept, (SELECT unnest(range({PARTS})) AS part) AS j)",
        f"book_0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, p AS e FROM parts WHERE rid <= {ENTRIES})",
    ]
    for k in range(rounds):
        steps.append(near.format(to=f"near_{k}", book=f"book_{k}"))
        steps.append(
            f"mean_{k} AS MATERIALIZED (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e "
            "FROM (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (SELECT part, entry, unnest(p) AS x, "
            f"unnest(range(len(p))) AS i FROM near_{k}) GROUP BY ALL) GROUP BY part, entry)"
        )
        steps.append(
            f"book_{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM book_{k} AS b "
            f"LEFT JOIN mean_{k} AS m ON m.part = b.part AND m.entry = b.entry)"
        )
    steps += [
        near.format(to="final", book=f"book_{rounds}"),
        "coded AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' "
        "ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM final GROUP BY rid)",
        f"digest AS (SELECT sha256(string_agg(list_aggregate(list_transform(e, lambda x: CAST(x AS VARCHAR)), 'string_agg', ','), "
        f"',' ORDER BY part, entry)) AS codebooks_sha256 FROM book_{rounds})",
    ]
    return (
        "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) "
        "AS label_error, codebooks_sha256 FROM coded, digest"
    )
