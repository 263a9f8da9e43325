"""Token ids of texts by the public word-level byte-pair tokenizer, words found in numpy.

The tokenizer's own steps (normalise, split into words, merge each word) are kept. Word bounds of
a piece of whole texts come from a table of character classes, words are told by 64-bit rolling
hashes and lengths, and only the distinct words of a piece are looked up; the tokenizer's answers
per word are remembered in a bounded cache. Texts with characters outside the table, or with
the string of a special token, go through the tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from newsloom.llm.arrays import BASE, INVERSE, mix, powers

# Bounds in each Python worker: words of the cache (a full one is emptied), and characters of
# texts worked on together (a longer text is a piece of its own).
CACHED_WORDS = 1 << 18
PIECE = 1 << 17

# Texts of these characters only: ASCII, Latin-1 and Latin Extended letters and signs. Left out
# are controls, superscript digits, fractions and the dotted capital I.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]")
END = 0x250
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)

END_OF_TEXT = 0


def _class(code: int) -> int:
    letter = chr(code)
    if not PLAIN.match(letter) or max(map(ord, letter.lower())) >= END:
        return OTHER
    if re.match(r"\s", letter):
        return SPACE
    if re.match(r"\d", letter):
        return DIGIT
    return LETTER if re.match(r"[^\W\d_]", letter) else SIGN


# The last place stands for all characters beyond the table.
CLASSES = np.array([_class(code) for code in range(END)] + [OTHER], np.uint8)
LETTER_VALUE = np.random.default_rng(20240301).integers(0, 1 << 63, END, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)
# Endings after an apostrophe that are words of their own with it.
ONE_LETTER = [ord(x) for x in "stmd"]
TWO_LETTERS = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the letters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: 256 + k for k, b in enumerate(others)}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-case plain characters; the last one is a space."""
    kind = CLASSES[codes]
    start = np.empty(len(codes), bool)
    start[0] = kind[0] != SPACE
    start[1:] = (kind[1:] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    # An apostrophe at the start of a word and what may belong to it.
    marks = np.flatnonzero((codes == ord("'")) & start)
    marks = marks[marks + 2 < len(codes)]
    after, second = codes[marks + 1], codes[marks + 2]
    one = np.isin(after, ONE_LETTER)
    two = np.zeros(len(marks), bool)
    for a, b in TWO_LETTERS:
        two |= (after == a) & (second == b)
    for which, length in ((one, 2), (two, 3)):
        at = marks[which]
        start[at + 1] = False
        rest = at + length
        start[rest] |= kind[rest] == LETTER
    starts = np.flatnonzero(start)
    edges = np.flatnonzero(start | (kind == SPACE))
    return starts, edges[np.searchsorted(edges, starts, "right")]


class Encoder:
    """Encodes texts with one tokenizer file."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)", re.I)
        self._clear()

    @classmethod
    def at(cls, path: str) -> Encoder:
        """The worker's encoder for this file; loaded once."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _clear(self) -> None:
        """Hash of a word -> its number; ``flat[firsts[number]:][:sizes[number]]`` are its ids."""
        self.numbers: dict[int, int] = {}
        self.firsts, self.sizes, self.flat = array("q"), array("q"), array("I")

    def _learn(self, key: int, word: str) -> int:
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.model.tokenize(letters)]
        self.firsts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        number = self.numbers[key] = len(self.numbers)
        return number

    def _whole(self, text: str) -> np.ndarray:
        """A text by the tokenizer itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _plain(self, joined: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a lower-case string that ends with a space, and the number of ids
        of the text that begins at each of ``starts``."""
        codes = _codes(joined)
        first, last = _bounds(codes)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        terms = LETTER_VALUE[codes]
        terms *= powers(BASE, len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        hashes = (sums[last] - sums[first]) * powers(INVERSE, len(codes))[first]
        hashes = mix(hashes ^ (last - first).astype(np.uint64))
        known, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.numbers) > CACHED_WORDS:
            self._clear()
        keys = known.tolist()
        numbers = np.array([self.numbers.get(key, -1) for key in keys])
        for k in np.flatnonzero(numbers < 0).tolist():
            word = joined[first[where[k]] : last[where[k]]]
            numbers[k] = self._learn(keys[k], word)
        number = numbers[which]
        # Copies: the buffers grow with the next new word, so no view of them may stay.
        size = np.frombuffer(self.sizes, np.int64)[number]
        begins = np.frombuffer(self.firsts, np.int64)[number]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begins - ends + size, size)
        ids = np.frombuffer(self.flat, np.uint32)[at]
        before = np.concatenate([[0], ends])[np.searchsorted(first, starts)]
        return ids, np.diff(before, append=ends[-1])

    def _piece(self, texts: list[str]) -> Iterator[np.ndarray]:
        joined = " ".join(texts) + " "
        odd: dict[int, np.ndarray] = {}
        starts = np.cumsum([0] + [len(text) + 1 for text in texts[:-1]])
        bad = np.flatnonzero(CLASSES[np.minimum(_codes(joined), END)] == OTHER)
        hit = set((np.searchsorted(starts, bad, "right") - 1).tolist())
        if self.special.search(joined):
            hit.update(k for k, text in enumerate(texts) if self.special.search(text))
        if hit:
            texts = list(texts)
            for k in hit:
                odd[k] = self._whole(texts[k])
                texts[k] = ""
            joined = " ".join(texts) + " "
            starts = np.cumsum([0] + [len(text) + 1 for text in texts[:-1]])
        ids, counts = self._plain(joined.lower(), starts)
        at = 0
        for k, count in enumerate(counts.tolist()):
            yield odd[k] if k in odd else ids[at : at + count]
            at += count

    def each(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column, in order; a null text has none."""
        waiting: list[str] = []
        size = 0
        for value in column:
            text = value.as_py() or ""
            if waiting and size + len(text) > PIECE:
                yield from self._piece(waiting)
                waiting, size = [], 0
            waiting.append(text)
            size += len(text) + 1
        if waiting:
            yield from self._piece(waiting)

    def ids(self, text: str | None) -> np.ndarray:
        return next(iter(self._piece([text or ""])))

    def count(self, text: str | None) -> int:
        return len(self.ids(text))
