"""Vectorised work on a column of texts: byte arrays, words, rolling hashes.

Texts arrive as Arrow columns; they are cut into pieces of whole texts of about PIECE bytes, so
that the numpy arrays stay small however large a batch is. A text longer than that is a piece
of its own."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18

_random = np.random.default_rng(20240229)
# One random odd number per byte value, and the base of the rolling hash (odd, so it has an
# inverse modulo 2^64).
BYTE_VALUE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_random.integers(0, 1 << 63)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return what Arrow and the C library hold but do not use to the system: a worker waits for
    its next task with the memory of its program alone."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function over Arrow batches that gives memory back after every batch and at its end."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        def each() -> Batches:
            for batch in batches:
                yield batch
                give_back()

        try:
            yield from run(each())
        finally:
            give_back()

    return wrapped


_powers = {}


def powers(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo 2^64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < count:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    if len(have) <= 4 * PIECE:
        _powers[base] = have
    return have[:count]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Piece:
    """Some whole texts one after the other: ``data[offsets[i]:offsets[i+1]]`` is text i, which
    is row ``first + i`` of the batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """Null texts count as empty ones."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield Piece(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


class Rolling:
    """Prefix sums from which the hash of any substring follows in constant time."""

    def __init__(self, data: np.ndarray):
        terms = BYTE_VALUE[data]
        terms *= powers(BASE, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = powers(INVERSE, len(data) + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.sums[ends] - self.sums[starts]
        out *= self.inverse[starts]
        return mix(out)

    def windows(self, size: int) -> np.ndarray:
        """Of every substring of ``size`` bytes, by start."""
        out = self.sums[size:] - self.sums[:-size]
        out *= self.inverse[: len(out)]
        return mix(out)


@dataclass
class Words:
    """Words of a piece: where they start and end, and ``first[i]:first[i+1]`` those of text i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(piece: Piece) -> Words:
    """Maximal runs of bytes that are not ASCII white space, within each text."""
    inside = ~WHITE[piece.data]
    bounds = piece.offsets[:-1][np.diff(piece.offsets) > 0]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[bounds] = inside[bounds]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    lasts = piece.offsets[1:][np.diff(piece.offsets) > 0] - 1
    closes[lasts] = inside[lasts]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, piece.offsets))


GRAM_BASE = int(_random.integers(0, 1 << 63)) * 2 + 1


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of every run of ``size`` neighbouring word hashes, by its first word."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        out *= np.uint64(GRAM_BASE)
        out += hashes[k : len(hashes) - size + 1 + k]
    return mix(out)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i+1]]``; empty ranges give 0."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
