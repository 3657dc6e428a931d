"""A semi-Markov conditional random field over short lattices.

A lattice has units 0..n-1; an arc covers the units i..j-1 with one kind and the
features of that whole span, and each unit may also stand alone as nothing
(kind 0, score 0). A labelling is a path of arcs and single units from 0 to n.
Its score is the sum of its arcs' feature weights and of the weights between
neighbouring kinds. Spans are bounded by whoever makes the arcs, so all passes
are linear in n.

Training is on partial labels: ``allowed`` paths are those that keep the known
spans and leave out all others, free where the truth isn't known; the gradient
is the arcs' chances among the allowed paths less those among all.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

NEVER = -math.inf


@dataclass
class Lattice:
    n: int
    arcs: list[tuple[int, int, int, list[str]]]  #: first unit, unit after the last, kind, features
    allowed: list[bool] = field(default_factory=list)  #: of each arc, for training
    alone: list[bool] = field(default_factory=list)  #: of each unit: whether it may stand alone in an allowed path


def total(xs: list[float]) -> float:
    """log of the sum of exponentials"""
    top = max(xs)
    return top if top == NEVER else top + math.log(sum(math.exp(x - top) for x in xs))


class SemiMarkov:
    def __init__(self, kinds: int):
        self.kinds = kinds + 1
        self.weights: dict[tuple[int, str], float] = defaultdict(float)
        self.between = [[0.0] * self.kinds for _ in range(self.kinds)]

    def score(self, kind: int, features: list[str]) -> float:
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in features)

    def best(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """Arcs (i, j, kind) of the path with the highest score; of equal ones that with nothing in it, then the earlier arc."""
        ending = defaultdict(list)
        for i, j, kind, features in lattice.arcs:
            ending[j].append((i, kind, self.score(kind, features)))
        rows, back = [[0.0] + [NEVER] * (self.kinds - 1)], [[None] * self.kinds]
        for t in range(1, lattice.n + 1):
            row, came = [NEVER] * self.kinds, [None] * self.kinds
            for i, kind, s in [(t - 1, 0, 0.0), *ending[t]]:
                for y in range(self.kinds):
                    v = rows[i][y] + self.between[y][kind] + s
                    if v > row[kind]:
                        row[kind], came[kind] = v, (i, y)
            rows.append(row)
            back.append(came)
        t, y, found = lattice.n, max(range(self.kinds), key=lambda k: (rows[-1][k], -k)), []
        while t > 0:
            i, before = back[t][y]
            if y:
                found.append((i, t, y))
            t, y = i, before
        return found[::-1]

    def chances(self, lattice: Lattice, scores: list[float], only_allowed: bool) -> tuple[float, list[float], list[list[float]]]:
        """log of the sum over paths, each arc's chance, and the expected number of each pair of neighbouring kinds."""
        kinds, n = range(self.kinds), lattice.n
        arcs = [(t, t + 1, 0, 0.0, -1) for t in range(n) if not only_allowed or lattice.alone[t]]
        arcs += [(i, j, k, scores[a], a) for a, (i, j, k, _) in enumerate(lattice.arcs) if not only_allowed or lattice.allowed[a]]
        ending, starting = defaultdict(list), defaultdict(list)
        for arc in arcs:
            ending[arc[1]].append(arc)
            starting[arc[0]].append(arc)
        ahead = [[0.0] + [NEVER] * (self.kinds - 1)]
        for t in range(1, n + 1):
            row = [[] for _ in kinds]
            for i, _, k, s, _ in ending[t]:
                row[k].append(total([ahead[i][y] + self.between[y][k] for y in kinds]) + s)
            ahead.append([total(x) if x else NEVER for x in row])
        behind = [[NEVER] * self.kinds for _ in range(n)] + [[0.0] * self.kinds]
        for t in range(n - 1, -1, -1):
            for y in kinds:
                behind[t][y] = total([self.between[y][k] + s + behind[j][k] for _, j, k, s, _ in starting[t]] or [NEVER])
        whole = total(ahead[n])
        chance, pairs = [0.0] * len(lattice.arcs), [[0.0] * self.kinds for _ in kinds]
        if whole == NEVER:
            return whole, chance, pairs
        for i, j, k, s, a in arcs:
            for y in kinds:
                v = ahead[i][y] + self.between[y][k] + s + behind[j][k] - whole
                if v > -30:
                    p = math.exp(v)
                    pairs[y][k] += p
                    if a >= 0:
                        chance[a] += p
        return whole, chance, pairs

    def fit(self, lattices: list[Lattice], epochs: int, rate: float = 0.3, decay: float = 1e-4) -> list[float]:
        """Adaptive gradient steps, lattice by lattice in the order given; the log-likelihood of each epoch."""
        seen: dict[tuple[int, str], float] = defaultdict(float)
        seen_between = [[1e-6] * self.kinds for _ in range(self.kinds)]
        told = []
        for _ in range(epochs):
            likelihood = 0.0
            for x in lattices:
                scores = [self.score(k, f) for _, _, k, f in x.arcs]
                known, want, want_pairs = self.chances(x, scores, True)
                if known == NEVER:
                    continue
                every, have, have_pairs = self.chances(x, scores, False)
                likelihood += known - every
                for (_, _, k, features), w, h in zip(x.arcs, want, have):
                    g = w - h
                    if abs(g) > 1e-4:
                        for f in features:
                            step = g - decay * self.weights[k, f]
                            seen[k, f] += step * step
                            self.weights[k, f] += rate * step / math.sqrt(seen[k, f])
                for y in range(self.kinds):
                    for k in range(self.kinds):
                        g = want_pairs[y][k] - have_pairs[y][k]
                        if abs(g) > 1e-4:
                            seen_between[y][k] += g * g
                            self.between[y][k] += rate * g / math.sqrt(seen_between[y][k])
            told.append(likelihood)
        return told
