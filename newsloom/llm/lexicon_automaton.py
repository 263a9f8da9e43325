"""A lexicon trie intersected with Levenshtein automata.

Both are walked at once: a state is the set of (trie node, errors so far) that the letters read
can have reached. States are determinised when first met and remembered, so that reading a word
costs one look-up per letter, and most words end in the dead state after a few."""

from __future__ import annotations

# Bound of the remembered states; at the bound the memory is emptied.
STATES = 50_000


def allowed_errors(term: str) -> int:
    """Edits after which a word still counts as a misspelling of ``term``."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """``terms`` are matched as whole words, also misspelled; ``stems`` as beginnings of words."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.slack = [0]  # most errors that a term below a node allows
        self.terms, self.stems = list(terms), list(stems)
        for k, term in enumerate(self.terms):
            self.term_at[self._insert(term, allowed_errors(term))] = k
        for k, stem in enumerate(self.stems):
            self.stem_at[self._insert(stem, 0)] = k
        self._reset()

    def _insert(self, word: str, errors: int) -> int:
        node = 0
        for letter in word:
            self.slack[node] = max(self.slack[node], errors)
            if letter not in self.children[node]:
                self.children[node][letter] = len(self.children)
                self.children.append({})
                self.slack.append(0)
            node = self.children[node][letter]
        self.slack[node] = max(self.slack[node], errors)
        return node

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stem_hits: list[int] = []
        self._number(frozenset())
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With every letter of the trie that the word may lack."""
        todo = list(pairs)
        while todo:
            node, errors = todo.pop()
            for child in self.children[node].values():
                if errors < self.slack[child] and (child, errors + 1) not in pairs:
                    pairs.add((child, errors + 1))
                    todo.append((child, errors + 1))
        return frozenset(pairs)

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            best = None
            for node, errors in state:
                term = self.term_at.get(node)
                if term is not None and errors <= allowed_errors(self.terms[term]):
                    best = min(best or (errors, term), (errors, term))
            self.accepts.append(best)
            stems = [self.stem_at[n] for n, e in state if e == 0 and n in self.stem_at]
            self.stem_hits.append(min(stems, default=-1))
        return self.numbers[state]

    def _move(self, state: int, letter: str) -> int:
        reached = set()
        for node, errors in self.states[state]:
            child = self.children[node].get(letter)
            if child is not None:
                reached.add((child, errors))
            if errors < self.slack[node]:
                reached.add((node, errors + 1))
                for other in self.children[node].values():
                    if errors < self.slack[other]:
                        reached.add((other, errors + 1))
        number = self._number(self._closed(reached))
        self.moves[state][letter] = number
        return number

    def match(self, word: str) -> tuple[str, int, int] | None:
        """("term", number, errors) or ("stem", number, 0); exact terms first, then stems."""
        if len(self.states) > STATES:
            self._reset()
        state, stem = self.start, -1
        for letter in word:
            move = self.moves[state].get(letter)
            state = self._move(state, letter) if move is None else move
            if state == 0:
                break
            if self.stem_hits[state] >= 0:
                stem = self.stem_hits[state]
        found = self.accepts[state]
        if found and found[0] == 0:
            return "term", found[1], 0
        if stem >= 0:
            return "stem", stem, 0
        return ("term", found[1], found[0]) if found else None
