"""Repeated passages over a whole corpus, by a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes around it also starts anywhere else. Texts arrive in
batches. Each batch gets a suffix array; it is merge-scanned against the arrays of the existing
levels for long matches; arrays of equal size merge into one of the next level, as in a binary
counter, so that an entry is rewritten a logarithmic number of times.

Sparse arrays. Not every suffix is entered. In every window of LENGTH bytes the seed (SEED bytes)
with the smallest hash is the anchor; equal windows have equal anchors at the same place. The
windows of one anchor are neighbours; together they are the anchor's *body*. One entry per body,
about one per 80 bytes: the seed's hash, the body's hash, its text and place. An array is kept in
the order of the seed's hash, not of the seed's letters: the scan asks for equality of long
prefixes only, and equal prefixes are neighbours in either order. It is a table bucketed by seed,
so that scans and merges read bucket by bucket and shuffle nothing.

Matches. Equal bodies: all their windows are repeated. Equal seeds under different bodies (the
ends of a match): the windows of one text of each body are compared one by one.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing; a text that repeats
itself loses those bytes too; rows that are equal in id and text are copies of each other; a null
id is carried through; other columns are ignored. Text and id together are told by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.arrays import Piece, Rolling, mix, pieces
from newsloom.llm.tables import bucket_of, delete_folder, new_folder, stored
from newsloom.streaming.states import settings

LENGTH = 200
SEED = 40
BATCHES = 4
# Window starts that are searched at a time; with a window they stay under 2^PLACE_BITS.
STRETCH = 1 << 19
PLACE_BITS = 20
# A join on seed and body may use buckets by seed alone.
BY_BUCKET = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
# Bodies of one seed that are compared in one task.
CROWD = 2048


def _least_place(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (then leftmost) of every ``width`` neighbouring hashes."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    return (least & low).astype(np.int64)


def anchors(piece: Piece, length: int = LENGTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Bodies of a piece: text, lo (its first byte), size, seed and body hashes; n and run tell of
    neighbours that are all equal (a periodic text), which count as one entry."""
    data, offsets = piece.data, piece.offsets
    width = length - seed + 1
    empty = {name: np.zeros(0, np.int64) for name in ("text", "lo", "size", "seed", "body", "n", "run")}
    if len(data) < length:
        return empty
    rolling = Rolling(data)
    hashes = rolling.windows(seed)
    valid = np.zeros(len(data) - length + 2, np.int8)
    long = np.diff(offsets) >= length
    valid[offsets[:-1][long]] += 1
    valid[offsets[1:][long] - length + 1] -= 1
    valid = np.cumsum(valid[:-1]).astype(bool)
    firsts, lasts, places = [], [], []
    for at in range(0, len(valid), STRETCH):
        ok = valid[at : at + STRETCH]
        place = _least_place(hashes[at : at + len(ok) + width - 1], width) + at
        change = np.ones(len(ok), bool)
        change[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
        begin = np.flatnonzero(change)
        end = np.append(begin[1:], len(ok)) - 1
        keep = ok[begin]
        firsts.append(begin[keep] + at)
        lasts.append(end[keep] + at)
        places.append(place[begin[keep]])
    lo, last, place = map(np.concatenate, (firsts, lasts, places))
    if not len(lo):
        return empty
    text = np.searchsorted(offsets, lo, "right") - 1
    size = last - lo + length
    shape = ((place - lo) << 32 | size).astype(np.uint64)
    body = mix(rolling.hashes(lo, lo + size) + shape * np.uint64(0x9E3779B97F4A7C15))
    head = hashes[place]
    new = np.ones(len(lo), bool)
    new[1:] = (body[1:] != body[:-1]) | (head[1:] != head[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(lo)))
    run = last[at + n - 1] - lo[at] + length
    return {
        "text": text[at], "lo": lo[at] - offsets[text[at]], "size": size[at],
        "seed": head[at].view(np.int64), "body": body[at].view(np.int64), "n": n, "run": run,
    }


def windows_of(data: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of every body: which body, at which byte of it, and its hash."""
    flat = np.frombuffer(b"".join(v.as_py() for v in data), np.uint8)
    sizes = np.array([len(v.as_buffer()) for v in data], np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    which = np.repeat(np.arange(len(sizes)), counts)
    step = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begins[which] + step
    return which, step, Rolling(flat).hashes(start, start + length)


def repeated_windows(bodies: pa.Table, length: int) -> pa.RecordBatch:
    """Spans of repeated windows in bodies that are not known to be repeated as a whole; all
    bodies of a seed are in the table."""
    which, step, body = windows_of(bodies.column("data").combine_chunks(), length)
    seeds = bodies.column("seed").to_numpy()
    body = mix(body + mix(seeds.view(np.uint64))[which])
    order = np.argsort(body)
    same = body[order][1:] == body[order][:-1]
    twice = np.zeros(len(body), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    known = bodies.column("known").to_numpy()
    at = np.flatnonzero(twice & ~known[which])
    # Neighbouring windows of a body make one span.
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) != 1) | (np.diff(which[at]) != 0)
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(at))[: len(begin)] - 1
    body_of = which[at[begin]]
    lo = bodies.column("lo").to_numpy()[body_of] + step[at[begin]]
    size = step[at[end]] - step[at[begin]] + length
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bodies.column("key").to_numpy()[body_of]),
            pa.array(lo.astype(np.int32)),
            pa.array(size.astype(np.int32)),
        ],
        ["key", "lo", "size"],
    )


def with_key(documents: DataFrame) -> DataFrame:
    """Rows with the key that stands for them in the index."""
    return documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


class SuffixIndex:
    """The family of arrays. ``add`` takes a batch (key, text); afterwards ``spans`` has the
    repeated bytes of all batches so far: key, lo, size."""

    def __init__(self, spark, length: int = LENGTH, seed: int = SEED, buckets: int | None = None):
        self.spark, self.length, self.seed = spark, length, seed
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, tuple[str, str]] = {}
        self._spans: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        carried = self._array_of(batch)
        level = 0
        while level in self.levels:
            carried = self._merged(carried, self.levels.pop(level))
            level += 1
        for other in self.levels.values():
            self._scan(carried, other)
        self.levels[level] = carried

    def _entries(self, batch: DataFrame) -> DataFrame:
        length, seed = self.length, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                keys = rows.column("key").to_numpy()
                for piece in pieces(rows.column("text")):
                    found = anchors(piece, length, seed)
                    columns = [found["seed"], found["body"], keys[piece.first + found["text"]]]
                    columns += [found[c].astype(np.int32) for c in ("lo", "size", "n", "run")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in columns],
                        ["seed", "body", "key", "lo", "size", "n", "run"],
                    )

        return batch.select("key", "text").mapInArrow(
            run, "seed bigint, body bigint, key bigint, lo int, size int, n int, run int"
        )

    def _keep(self, table: DataFrame) -> tuple[str, str]:
        """Write an array as a bucketed table in shared storage; keep the spans it found."""
        name, path = f"suffixes_{uuid.uuid4().hex}", new_folder(self.spark, "suffixes")
        writer = table.write.bucketBy(self.buckets, "seed").option("path", path)
        writer.saveAsTable(name)
        found = self.spark.table(name).where("found IS NOT NULL").select(F.explode("found").alias("f"))
        self._spans.append(stored(found.select("f.key", "f.lo", "f.size"), "spans"))
        return name, path

    def _array(self, kept: tuple[str, str]) -> DataFrame:
        return self.spark.table(kept[0]).where("head").drop("head", "found")

    def _array_of(self, batch: DataFrame) -> tuple[str, str]:
        same = Window.partitionBy("seed", "body").orderBy("key", "lo")
        whole = Window.partitionBy("seed", "body")
        table = (
            self._entries(batch)
            .repartition(self.buckets, "seed")
            .withColumn("head", F.row_number().over(same) == 1)
            .withColumn("n", F.sum("n").over(whole))
        )
        span = F.struct("key", "lo", F.col("run").alias("size"))
        return self._keep(
            table.select(
                "seed", "body", "n", "key", "lo", "size", "head",
                F.when(F.col("n") > 1, F.array(span)).alias("found"),
            )
        )

    @staticmethod
    def _matches():
        """Spans that a match of bodies in l and r adds: of a side that had no match before."""
        sides = [
            F.when(F.col(f"{s}.n") == 1, F.struct(f"{s}.key", f"{s}.lo", f"{s}.size"))
            for s in "lr"
        ]
        return F.filter(F.array(*sides), lambda x: x.isNotNull())

    def _merged(self, new: tuple[str, str], old: tuple[str, str]) -> tuple[str, str]:
        left, right = self._array(new).alias("l"), self._array(old).alias("r")
        both = F.col("l.n").isNotNull() & F.col("r.n").isNotNull()
        joined = left.join(right, ["seed", "body"], "full").select(
            "seed",
            "body",
            (F.coalesce("l.n", F.lit(0)) + F.coalesce("r.n", F.lit(0))).alias("n"),
            *(F.coalesce(f"r.{c}", f"l.{c}").alias(c) for c in ("key", "lo", "size")),
            F.lit(True).alias("head"),
            F.when(both, self._matches()).alias("found"),
        )
        # Buckets by seed also have equal seeds and bodies together; nothing needs a shuffle, and
        # each bucket is written by one task.
        with settings(self.spark, BY_BUCKET):
            kept = self._keep(joined)
        for name, path in (new, old):
            self.spark.sql(f"DROP TABLE {name}")
            delete_folder(self.spark, path)
        return kept

    def _scan(self, new: tuple[str, str], old: tuple[str, str]) -> None:
        left, right = self._array(new).alias("l"), self._array(old).alias("r")
        found = left.join(right, ["seed", "body"]).select(F.explode(self._matches()).alias("f"))
        with settings(self.spark, BY_BUCKET):
            self._spans.append(stored(found.select("f.key", "f.lo", "f.size"), "spans"))

    def _ends(self) -> DataFrame:
        """One text of each body whose seed has several bodies, with their number."""
        arrays = [self._array(kept) for kept in self.levels.values()]
        table = arrays[0]
        for more in arrays[1:]:
            table = table.union(more)
        split = table.groupBy("seed").agg(
            F.min("body").alias("a"), F.max("body").alias("b"), F.count("*").alias("bodies")
        )
        return table.join(split.where("a <> b").select("seed", "bodies"), "seed")

    def _bodies(self, documents: DataFrame, ends: DataFrame) -> DataFrame:
        """The bytes of each wanted body: seed, key, lo, known, data."""
        asked = ends.groupBy("key").agg(
            F.collect_list("seed").alias("seeds"), F.collect_list("lo").alias("los"),
            F.collect_list("size").alias("sizes"), F.collect_list("n").alias("ns"),
        )
        texts = _prune(documents, ends).dropDuplicates(["key"]).join(asked, "key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                seeds, los, sizes, ns = (
                    rows.column(c).flatten().to_numpy() for c in ("seeds", "los", "sizes", "ns")
                )
                counts = rows.column("los").value_lengths().to_numpy()
                keys = np.repeat(rows.column("key").to_numpy(), counts)
                at, cut = 0, []
                for text, count in zip(rows.column("text"), counts, strict=True):
                    data = memoryview(text.as_buffer())
                    for k in range(at, at + count):
                        cut.append(bytes(data[los[k] : los[k] + sizes[k]]))
                    at += count
                columns = [seeds, keys, los, ns > 1]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(cut, pa.binary())],
                    ["seed", "key", "lo", "known", "data"],
                )

        return texts.select("key", "text", "seeds", "los", "sizes", "ns").mapInArrow(
            run, "seed bigint, key bigint, lo int, known boolean, data binary"
        )

    def _window_spans(self, documents: DataFrame) -> DataFrame:
        """Windows at the ends of matches, one by one.

        The bodies of one seed meet in one task, sorted by seed; where there are over CROWD of
        them, the windows themselves are dealt out instead."""
        length = self.length
        ends = stored(self._ends().select("key", "seed", "lo", "size", "n", "bodies"), "ends")
        spans = "key bigint, lo int, size int"

        def within_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = None
            for rows in batches:
                table = pa.Table.from_batches([rows])
                table = table if rest is None else pa.concat_tables([rest, table])
                seeds = table.column("seed").to_numpy()
                last = int(np.searchsorted(seeds, seeds[-1]))
                yield repeated_windows(table.slice(0, last), length)
                rest = table.slice(last)
            if rest is not None:
                yield repeated_windows(rest, length)

        few = self._bodies(documents, ends.where(F.col("bodies") <= CROWD))
        out = few.repartition("seed").sortWithinPartitions("seed").mapInArrow(within_task, spans)
        many = ends.where(F.col("bodies") > CROWD)
        if many.isEmpty():
            return out

        def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for first in range(0, len(rows), CROWD):
                    part = rows.slice(first, CROWD)
                    which, step, body = windows_of(part.column("data"), length)
                    columns = [
                        part.column("seed").to_numpy()[which], body.view(np.int64),
                        part.column("key").to_numpy()[which],
                        (part.column("lo").to_numpy()[which] + step).astype(np.int32),
                        part.column("known").to_numpy(zero_copy_only=False)[which],
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in columns], ["seed", "body", "key", "lo", "known"]
                    )

        windows = self._bodies(documents, many).mapInArrow(
            dealt_out, "seed bigint, body bigint, key bigint, lo int, known boolean"
        )
        same = Window.partitionBy("seed", "body")
        repeated = windows.withColumn("times", F.count("*").over(same))
        return out.union(
            repeated.where("times > 1 AND NOT known").select("key", "lo", F.lit(length).alias("size"))
        )

    def spans(self, documents: DataFrame) -> DataFrame:
        """Repeated bytes of everything added; ``documents`` (key, text) holds it all."""
        out = self._window_spans(documents)
        for found in self._spans:
            out = out.union(found)
        return out


def _prune(documents: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Texts whose key's bucket is wanted (or, left_anti, is not): a bounded broadcast."""
    buckets = wanted.select(bucket_of(F.col("key")).alias("_bucket")).distinct()
    marked = documents.withColumn("_bucket", bucket_of(F.col("key")))
    return marked.join(F.broadcast(buckets), "_bucket", how).drop("_bucket")


def covered(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans: starts and ends of the maximal runs."""
    if not len(lo):
        return lo, lo
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], (lo + size)[order]
    reach = np.maximum.accumulate(end)
    fresh = np.ones(len(lo), bool)
    fresh[1:] = lo[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return lo[at], reach[np.append(at[1:], len(lo)) - 1]


def without_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of rows (doc_id, text, found: lo << 32 | size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for first in range(0, len(rows), 256):
                part = rows.slice(first, 256)
                spans = part.column("found")
                out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
                for text, found in zip(part.column("text"), spans, strict=True):
                    data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
                    data = memoryview(data)
                    codes = found.values.to_numpy() if found.is_valid else np.zeros(0, np.int64)
                    starts, ends = covered(codes >> 32, codes & 0xFFFFFFFF)
                    edges = zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True)
                    out["n_bytes"].append(len(data))
                    out["n_removed"].append(int((ends - starts).sum()))
                    out["n_spans"].append(len(starts))
                    out["kept"].append(b"".join(data[a:b] for a, b in edges))
                columns = [pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns, pa.array(out["kept"], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "found").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary",
    )


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, seed: int = SEED, batches: int = BATCHES
) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the remaining bytes, ``kept``."""
    keyed = with_key(documents)
    index = SuffixIndex(documents.sparkSession, length, seed)
    for number in range(batches):
        index.add(keyed.where(F.pmod(F.hash("key"), F.lit(batches)) == number))
    spans = stored(index.spans(keyed), "repeats")
    code = F.shiftleft(F.col("lo").cast("bigint"), 32) + F.col("size")
    by_text = spans.groupBy("key").agg(F.collect_set(code).alias("found"))
    touched = _prune(keyed, spans).join(by_text, "key", "left")
    clean = _prune(keyed, spans, "left_anti").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"),
    )
    return without_spans(touched).union(clean)


def digest(removed: DataFrame) -> DataFrame:
    """``remove_repeats`` with a hash in place of the bytes."""
    return removed.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
