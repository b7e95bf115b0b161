"""Generalised suffix automaton over integer symbols."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence


class SuffixAutomaton:
    """All substrings of the added sequences.

    ``next[v]`` maps a symbol to a state, ``link[v]`` is the suffix link and ``length[v]``
    the longest string of state ``v``.  ``end[v]`` is the (sequence, end) at which the state was made.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.count = 0

    def add(self, sequence: Sequence[int]) -> list[int]:
        """Adds a sequence; returns the state of each of its prefixes."""
        at, states = 0, []
        for symbol in sequence:
            at = self._extend(at, symbol)
            states.append(at)
        self.count += 1
        return states

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, parent: int, symbol: int) -> int:
        """The state that parent's longest string plus symbol ends in, made on its own if it isn't yet."""
        child = self.next[parent][symbol]
        if self.length[child] == self.length[parent] + 1:
            return child
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new, parent = self._state(self.length[last] + 1, 0, {}), last
        while parent >= 0 and symbol not in self.next[parent]:
            self.next[parent][symbol] = new
            parent = self.link[parent]
        if parent >= 0:
            self.link[new] = self._split(parent, symbol)
        return new

    def stream(self, symbols: Iterable[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each symbol, (state, length) of the longest suffix read that occurs."""
        at = size = 0
        moves, link, length = self.next, self.link, self.length
        for symbol in symbols:
            while at and symbol not in moves[at]:
                at = link[at]
                size = length[at]
            if symbol in moves[at]:
                at = moves[at][symbol]
                size += 1
            else:
                at = size = 0
            yield at, size

    def holder(self, state: int, size: int) -> int:
        """The state of the suffix of ``size`` symbols of ``state``'s strings."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state
