"""Plain re-computations of the operators' results, on small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= size:
        return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
    return {tuple(words)} if words else set()


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def similar(a, b, percent):
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    times = collections.Counter(
        d[k : k + length] for d in data for k in range(len(d) - length + 1)
    )
    out = []
    for d in data:
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if times[d[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = collections.Counter(grams)
    marked = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(marked)


def lines_gone(rows, percent=80):
    """Numbers of the lines to remove, by row; rows (id, text) in order of id."""
    seen, gone = [], []
    for _, text in rows:
        own, mine = [], []
        for k, line in enumerate((text or "").split("\n")):
            words = WORD.findall(line.lower())
            if len(words) < 5:
                continue
            grams = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
            if any(similar(grams, other, percent) for other in seen + mine):
                own.append(k)
            mine.append(grams)
        seen += mine
        gone.append(own)
    return gone
