import collections
import hashlib
import math

import numpy as np
import pytest

from newsloom.llm import vector_codes as codes

PARTS, ENTRIES, ROUNDS = 8, 16, 6


def brute(rows):
    """(vec_id, code, error, label_error, digest) in plain Python integers."""
    kept = []
    for vec_id, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, label, [math.floor(4096 * x) for x in v]))
    width = max((len(v) for _, _, v in kept), default=0)
    width = max(PARTS, -(-width // PARTS) * PARTS)
    size = width // PARTS
    kept = [(i, label, v, v + [0] * (width - len(v))) for i, label, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[v[j * size : (j + 1) * size] for j in range(PARTS)] for _, _, _, v in kept]
    books = [[parts[j] for parts in cut[:ENTRIES]] for j in range(PARTS)]

    def nearest(part, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in book]
        return min(range(len(book)), key=lambda e: (gaps[e], e)), min(gaps)

    for _ in range(ROUNDS):
        for j, book in enumerate(books):
            mine = collections.defaultdict(list)
            for parts in cut:
                mine[nearest(parts[j], book)[0]].append(parts[j])
            books[j] = [
                [sum(col) // len(mine[e]) for col in zip(*mine[e])] if mine[e] else entry
                for e, entry in enumerate(book)
            ]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, labels = [], collections.Counter()
    for (vec_id, label, _, _), parts in zip(kept, cut):
        found = [nearest(parts[j], books[j]) for j in range(PARTS)]
        error = sum(gap for _, gap in found)
        labels[label] += error
        out.append((vec_id, "".join(f"{e:02x}" for e, _ in found), error, label))
    return sorted(((i, c, e, labels[label], digest) for i, c, e, label in out), key=repr)


SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, far int, code int, error int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def vectors(count, width, seed):
    rng = np.random.default_rng(seed)
    return [
        (int(k), [float(np.float32(x)) for x in rng.normal(size=width).round(2)], int(k) % 4 or None)
        for k in range(count)
    ]


def compressed(table):
    return sorted((tuple(r) for r in codes.compress(table).collect()), key=repr)


@pytest.mark.parametrize("width", [16, 24])
def test_equals_brute_force(spark, width):
    rows = vectors(90, width, width)
    rows += rows[:5]  # repeated rows
    rows += [(7, rows[50][1], None), (None, rows[3][1], 2)]  # an id twice, no id
    rows += [(200 + k, rows[1][1], 1) for k in range(30)]  # one very common vector
    rows += [(300, None, 1), (301, [None] * width, 1), (302, [math.nan] * width, 1), (303, [math.inf] * width, 1)]
    assert compressed(frame(spark, rows)) == brute(rows)


def test_odd_widths(spark):
    rows = [(0, [], 1), (1, [0.5], None), (2, [1.0, -1.0, 0.25] * 3, 1), (3, [0.1] * 13, None)]
    assert compressed(frame(spark, rows)) == brute([(i, [float(np.float32(x)) for x in v], n) for i, v, n in rows])


def test_large_components(spark):
    rows = [(k, [float(np.float32(x)) for x in ((-1) ** k * 10.0**k, 3.0 * k)] * 8, 1) for k in range(20)]
    rows = [(i, v, n) for i, v, n in rows if max(map(abs, v)) * 4096 < 2**60]
    got, want = compressed(frame(spark, rows)), brute(rows)
    held = [(i, c, min(e, codes.MAX_LONG), min(t, codes.MAX_LONG), d) for i, c, e, t, d in want]
    assert got == held


def test_search_is_exact():
    """Pruned search against all distances, ties and equal entries included."""
    rng = np.random.default_rng(1)
    points = rng.integers(-9, 9, (500, 4))
    entries = np.concatenate([rng.integers(-9, 9, (12, 4)), points[:2], points[:2]])
    pivots = entries[:3].astype(float)
    best, least = codes.nearest(points, codes._distances(points, pivots), entries, pivots)
    gaps = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (best == gaps.argmin(1)).all() and (least == gaps.min(1)).all()


def test_decoded_vectors_are_near(spark):
    books, parts = codes.fit(codes.whole(frame(spark, vectors(90, 16, 3))))
    both = codes.decode(codes.encode(parts, books).join(parts.select("vec_id", "v"), "vec_id"), books)
    for row in both.collect():
        whole = [round(x * codes.SCALE) for x in row["approximate"]]
        assert sum((a - b) ** 2 for a, b in zip(whole, row["v"])) == row["error"]


def test_empty_table(spark):
    assert compressed(frame(spark, [])) == []
    assert compressed(frame(spark, [(1, None, 1)])) == []
