"""Weighted finite-state transducers: states, arcs, composition and best paths.

A transducer reads one symbol at a time. An arc leads from a state under a
symbol to another state, writes a symbol and has a weight. A symbol of which
nothing is said in a state passes through there unchanged at weight 0; one
with an empty list of arcs cannot be read there. Weights add up along a path,
and of all paths to an end state the heaviest counts (the max-plus semiring).
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable

Arc = tuple[str, float, Hashable]


class Transducer:
    """arcs: (state, symbol) to what can be done there, as (written, weight, next state)."""

    def __init__(self, start: Hashable, arcs: dict[tuple[Hashable, str], list[Arc]]):
        self.start, self.arcs = start, arcs

    def step(self, state: Hashable, symbol: str) -> list[Arc]:
        found = self.arcs.get((state, symbol))
        return [(symbol, 0.0, state)] if found is None else found

    def best(self, word: Iterable[Iterable[tuple[str, float]]]) -> dict[Hashable, float]:
        """End states and the weight of the heaviest path to each. An item of
        ``word`` is the choice of (symbol, weight) that a reader may make there."""
        reached = {self.start: 0.0}
        for choice in word:
            ahead: dict[Hashable, float] = {}
            for state, so_far in reached.items():
                for symbol, given in choice:
                    for _, weight, target in self.step(state, symbol):
                        total = so_far + given + weight
                        if total > ahead.get(target, float("-inf")):
                            ahead[target] = total
            reached = ahead
        return reached


def compose(first: Transducer, second: Transducer, symbols: Iterable[str]) -> Transducer:
    """The transducer that reads as ``first`` does and writes what ``second`` makes
    of it; its states are pairs that can be reached by the given symbols."""
    start = (first.start, second.start)
    arcs: dict[tuple[Hashable, str], list[Arc]] = {}
    known, waiting, symbols = {start}, [start], list(symbols)
    while waiting:
        a, b = here = waiting.pop()
        for symbol in symbols:
            arcs[here, symbol] = [(out, w + v, (x, y)) for mid, w, x in first.step(a, symbol) for out, v, y in second.step(b, mid)]
            for _, _, target in arcs[here, symbol]:
                if target not in known:
                    known.add(target)
                    waiting.append(target)
    return Transducer(start, arcs)
