"""Packing documents into sequences of a fixed number of tokens.

Bounded-space online best fit: each task packs its documents as they come into at most OPEN open
bins. A bitset keyed by free space finds the open bin with the least room that still suffices;
if there is none and all bins are open, the fullest closes first. Rows leave a task when their
bin closes, so a task holds at most OPEN sequences. What is still open at the end of the tasks
(at most OPEN bins each) is packed once more, whole bins at a time, for MERGED tasks together.

Only documents longer than a sequence are cut, into full sequences and a rest.

Defined cases: a null or empty text is one piece that holds the end-of-text id alone; repeated
rows are packed each on its own; a null id is carried through; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrays import frugal
from newsloom.llm.tables import stored
from newsloom.llm.tokens import END_OF_TEXT, Encoder

SIZE = 2048
OPEN = 256
MERGED = 64
# Pieces that leave a task together.
OUT_ROWS = 4096


class BestFit:
    """At most ``most`` open bins of ``size``. ``place`` returns the bin, the offset in it, and
    the bins that closed."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.rooms = 0  # bit f: some open bin has f free
        self.by_room: dict[int, list[int]] = {}
        self.open = 0
        self.made = 0

    def _take(self, room: int) -> int:
        bins = self.by_room[room]
        chosen = bins.pop()
        if not bins:
            self.rooms ^= 1 << room
        self.open -= 1
        return chosen

    def place(self, length: int) -> tuple[int, int, list[int]]:
        closed = []
        enough = self.rooms >> length
        if enough:
            room = length + (enough & -enough).bit_length() - 1
            chosen = self._take(room)
        else:
            if self.open == self.most:
                least = (self.rooms & -self.rooms).bit_length() - 1
                closed.append(self._take(least))
            room, chosen = self.size, self.made
            self.made += 1
        left = room - length
        if left:
            self.by_room.setdefault(left, []).append(chosen)
            self.rooms |= 1 << left
            self.open += 1
        else:
            closed.append(chosen)
        return chosen, self.size - room, closed


def _packed_by_task(
    documents: DataFrame, path: str, size: int, most: int, with_ids: bool
) -> DataFrame:
    """Pieces with their task's bin and offset; ``open``: the bin was still open at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        first_bin = TaskContext.get().partitionId() << 32
        packer = BestFit(size, most)
        waiting: dict[int, list] = {}
        ready: list = []
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "open", "ids"]
        names = names if with_ids else names[:-1]

        def out(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            if with_ids:
                arrays.append(pa.array(list(columns[8]), pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            keys = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for key, ids in zip(keys, encoder.each(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(END_OF_TEXT)).astype("<u4")
                for number, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    row = [key, number, start, len(part), zlib.crc32(part.tobytes())]
                    chosen, offset, closed = packer.place(len(part))
                    row += [first_bin + chosen, offset, False]
                    if with_ids:
                        row.append(part.astype(np.int32))
                    waiting.setdefault(chosen, []).append(row)
                    for done in closed:
                        ready += waiting.pop(done)
                    if len(ready) >= OUT_ROWS:
                        yield out(ready)
                        ready = []
        if ready:
            yield out(ready)
        for rows in waiting.values():
            for row in rows:
                row[7] = True
            yield out(rows)

    return documents.select("doc_id", "text").mapInArrow(
        frugal(run),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, "
        "offset bigint, open boolean" + (", ids array<int>" if with_ids else ""),
    )


def _merge(size: int):
    """Whole bins into sequences, the largest first; each group has MERGED * OPEN rows at most."""

    def run(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values(["used", "bin"], ascending=[False, True])
        packer = BestFit(size, len(bins))
        named: dict[int, int] = {}
        sequences, bases = [], []
        for one, used in zip(bins["bin"], bins["used"], strict=True):
            chosen, base, _ = packer.place(int(used))
            sequences.append(named.setdefault(chosen, one))
            bases.append(base)
        return pd.DataFrame({"bin": bins["bin"].to_numpy(), "sequence": sequences, "base": bases})

    return run


def pack(
    documents: DataFrame, path: str, size: int = SIZE, most: int = OPEN, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the
    ids themselves if asked for."""
    pieces = stored(_packed_by_task(documents, path, size, most, with_ids), "pieces")
    bins = pieces.where("open").groupBy("bin").agg(F.sum("length").alias("used"))
    group = F.expr(f"shiftright(bin, 32) div {MERGED}")
    merged = bins.groupBy(group).applyInPandas(
        _merge(size), "bin bigint, sequence bigint, base bigint"
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rest = ["ids"] if with_ids else []
    closed = pieces.where("NOT open").select(*columns, F.col("bin").alias("sequence_id"), "offset", *rest)
    moved = (
        pieces.where("open")
        .join(merged, "bin")
        .select(
            *columns,
            F.col("sequence").alias("sequence_id"),
            (F.col("base") + F.col("offset")).alias("offset"),
            *rest,
        )
    )
    return closed.union(moved)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces with ids; a sequence is of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda part: part["ids"])).alias("ids")
    )
