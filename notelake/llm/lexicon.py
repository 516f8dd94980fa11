"""A lexicon trie read through Levenshtein automata.

The product of the trie with every entry's Levenshtein automaton is one nondeterministic automaton whose states
are (trie node, edits so far). ``LexiconAutomaton`` determinises it lazily: a set of such states is one state,
and its transitions are made once and kept. A word is then read letter by letter, and most words die within a few.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Entry:
    """``stem`` entries match any longer word that starts with them, exactly; others match whole words with up to ``edits`` edits, the first letter always equal."""

    text: str
    edits: int = 0
    stem: bool = False
    weight: float = 1.0


@dataclass(frozen=True)
class Match:
    text: str
    edits: int
    stem: bool
    weight: float


def allowed_edits(word: str) -> int:
    """More edits the longer the word: none under 5 letters, one under 9, else two."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class LexiconAutomaton:
    def __init__(self, entries: Iterable[Entry], most_states: int = 200_000) -> None:
        self.most_states = most_states
        self.children: list[dict[str, int]] = [{}]
        self.word_at: list[Entry | None] = [None]
        self.stem_at: list[Entry | None] = [None]
        self.deepest = [0]
        for entry in sorted(set(entries), key=lambda e: (e.text, e.stem, e.edits, e.weight)):
            if entry.text:
                self._insert(entry)
        self._reset()

    def _insert(self, entry: Entry) -> None:
        node = 0
        for c in entry.text:
            self.deepest[node] = max(self.deepest[node], entry.edits)
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.word_at.append(None)
                self.stem_at.append(None)
                self.deepest.append(0)
            node = self.children[node][c]
        self.deepest[node] = max(self.deepest[node], entry.edits)
        (self.stem_at if entry.stem else self.word_at)[node] = entry

    def _reset(self) -> None:
        self.moves: list[dict[str, int | None]] = []
        self.sets: list[dict[int, int]] = []
        self.accepts: list[Match | None] = []
        self.stems: list[Match | None] = []
        self.index: dict[frozenset, int] = {}
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of the state with these fewest edits per node."""
        key = frozenset(nodes.items())
        if key not in self.index:
            self.index[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            found = [(e, self.word_at[n].text, self.word_at[n].weight) for n, e in nodes.items() if self.word_at[n] and e <= self.word_at[n].edits]
            self.accepts.append(Match(min(found)[1], min(found)[0], False, min(found)[2]) if found else None)
            stems = [self.stem_at[n] for n, e in nodes.items() if self.stem_at[n] and e == 0]
            self.stems.append(Match(stems[0].text, 0, True, stems[0].weight) if stems else None)
        return self.index[key]

    def _move(self, state: int, c: str) -> int | None:
        out: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.deepest[node] and edits < out.get(node, 99):
                out[node] = edits
                for child in self.children[node].values():  # the text left this letter out
                    reach(child, edits + 1)

        for node, edits in self.sets[state].items():
            for letter, child in self.children[node].items():
                if letter == c:
                    reach(child, edits)
                elif node:  # another letter in its place
                    reach(child, edits + 1)
            if node:  # a letter too many
                reach(node, edits + 1)
        if state == 0:  # edits start after the first letter
            out = {n: e for n, e in out.items() if e == 0 or n in self._under(c)}
        return self._state(out) if out else None

    def _under(self, c: str) -> set[int]:
        found, todo = set(), [self.children[0][c]] if c in self.children[0] else []
        while todo:
            node = todo.pop()
            found.add(node)
            todo += self.children[node].values()
        return found

    def match(self, word: str) -> Match | None:
        """The entry of fewest edits that the word matches; an exact entry before a stem, the longest stem before a misspelling."""
        if len(self.sets) > self.most_states:
            self._reset()
        state: int | None = 0
        stem = None
        for c in word:
            stem = self.stems[state] or stem
            moves = self.moves[state]
            if c in moves:
                state = moves[c]
            else:
                state = moves[c] = self._move(state, c)
            if state is None:
                return stem
        found = self.accepts[state]
        return found if found and (found.edits == 0 or not stem) else stem
