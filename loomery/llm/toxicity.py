"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. The lexicon reads a clause's words and writes
symbols: insult (words, and word stems of four to six letters, weighted by what
was learned), harm, intention, target, negation, report. Five transducers
(module transducers) read those, composed into one: *threat* turns a harm after
an intention into a threat; *negation* and *reported speech* mark the insults
and threats after them; *target* remembers a second person; *insult* takes one
insult and one threat at most and drops the rest. The composed machine's
heaviest path gives the clause's class (its end state: negated, reported,
targeted, with a threat) and weight; a clause without a path that takes
something is no match. A document's score is the logistic sum of its matched
clauses' weights, each times the reliability of its class, which is learned
too, calibrated on the labelled rows; words without a match never count.

An insult arc weighs ``log(1 + ratio / words)``: how often toxic rows have it
beyond chance, over how often a clean text of the document's length would.
Rows count for an arc only as far as its neighbours differ, so that copies of
one toxic text don't make insults of all its words.

The lexicon is fitted on a sample of labelled rows drawn by hash over the whole
table, of about ``TRAIN_ROWS`` rows and ``TRAIN_WORDS`` words at most. Arcs are
counted and judged in Spark; the ones kept reach the driver. Scores see the
text only. Words are runs of ASCII letters and of other characters but
punctuation, found in the bytes of a megabyte of texts at a time; only words
whose first four bytes begin an arc are looked at one by one.

Defined cases: null and empty texts and texts without a match score the prior;
repeated rows score alike; ties between classes go to the lesser one; without
labelled rows of both kinds the prior is 0.1 and only threats match; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.kernels import span_hashes, text_slices, utf8
from loomery.llm.shared import checked_broadcast, stage, text_of, word_count
from loomery.llm.transducers import Transducer, compose

TRAIN_ROWS, TRAIN_WORDS = 200_000, 100_000_000
#: Arcs that clean rows are searched for by a set in every task; beyond it their counts meet in a join.
SOUGHT_ARCS = 200_000
#: Rows of prior belief that an arc or class starts from, and least toxic rows of an arc.
PRIOR_ROWS, LEAST_ROWS = 10.0, 3
#: Words whose weights a grammar keeps at hand.
KEPT_WORDS = 100_000
STEMS = (4, 5, 6)

#: Cue words of the transducers other than insult (English, German, French, Spanish).
TARGETS = frozenset("you your yours u ur youre du dich dir dein deine ihr euch tu te toi vous votre usted ustedes ti".split())
NEGATIONS = frozenset("not never no nobody isnt arent wasnt dont nicht kein keine nie pas jamais nunca tampoco".split())
REPORTED = frozenset("said says called quoted reported wrote claimed allegedly sagte schrieb angeblich dit écrit prétend dijo dice escribió".split())
INTENTIONS = frozenset("will gonna going shall werde werden vais allons voy vamos".split())
HARMS = frozenset("kill hurt destroy beat stab shoot burn töten schlagen verletzen tuer frapper brûler matar golpear quemar".split())
#: Prior reliability of a class by what modifies the clause.
PLAIN, TARGETED, DENIED, QUOTED, THREAT_WEIGHT = 0.9, 0.93, 0.4, 0.5, 3.0

SYMBOLS = ("insult", "harm", "intention", "target", "negation", "report")
CUES = {"harm": HARMS, "intention": INTENTIONS, "target": TARGETS, "negation": NEGATIONS, "report": REPORTED}
NEGATED, QUOTED_BIT, TARGETED_BIT, THREAT_BIT = 1, 2, 4, 8


def grammar() -> Transducer:
    """The composition threat o negation o report o target o insult."""
    threat = Transducer(0, {(0, "intention"): [("", 0, 1)], (0, "harm"): [("", 0, 0)], (1, "harm"): [("threat", THREAT_WEIGHT, 1), ("", 0, 1)], (1, "intention"): [("", 0, 1)]})
    marked = lambda bit, cue, kinds: Transducer(0, {(0, cue): [("", 0, 1)], (1, cue): [("", 0, 1)]} | {(1, k): [(f"{k}{bit}", 0, 1)] for k in kinds})
    negation = marked(NEGATED, "negation", ("insult", "threat"))
    report = marked(QUOTED_BIT, "report", ("insult", "threat", f"insult{NEGATED}", f"threat{NEGATED}"))
    target = Transducer(0, {(k, "target"): [("", 0, 1)] for k in (0, 1)})
    # states of insult: the marks of what was taken, and whether an insult and a threat were
    take: dict = {}
    for marks, taken, (number, kind), bits in product(range(4), range(4), enumerate(("insult", "threat")), range(4)):
        once = [] if taken >> number & 1 else [(kind, 0, (marks | bits, taken | 1 << number))]
        take[(marks, taken), kind + "".join(str(b) for b in (NEGATED, QUOTED_BIT) if bits & b)] = once
    return compose(compose(compose(compose(threat, negation, SYMBOLS), report, SYMBOLS), target, SYMBOLS), Transducer((0, 0), take), SYMBOLS)


MACHINE = grammar()


def class_of(state: tuple) -> int | None:
    """The class bits of an end state of the composed machine, if its path took anything."""
    (*_, target), (marks, taken) = state
    return marks | target << 2 | (taken >> 1) << 3 if taken else None


#: Lower-case bytes that words are made of, and that end a clause.
_LETTER = np.array([97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in range(256)])
_CLAUSE_END = np.array([chr(b) in ".!?;:,\n" for b in range(256)])


class Found:
    """Words of lower-cased texts: bytes, and each word's row, start and end."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
        a, b = int(self.offsets[0]), int(self.offsets[-1])
        part = self.data[a:b]
        inside = _LETTER[part]
        for lead, follow, size in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):  # signs and blanks beyond ASCII
            at = np.flatnonzero(part == lead)
            if follow is not None:
                at = at[np.isin(part[np.minimum(at + 1, len(part) - 1)], follow)]
            for k in range(size):
                inside[np.minimum(at + k, len(part) - 1)] = False
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = self.offsets[1:-1] - a
        row = row[(row > 0) & (row < b - a)]
        row = row[inside[row - 1] & inside[row]]
        if len(row):  # a text ends and the next begins without a blank
            starts, ends = np.sort(np.concatenate((starts, row))), np.sort(np.concatenate((ends, row)))
        self.starts, self.ends = starts + a, ends + a
        self.rows = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.n = np.bincount(self.rows, minlength=len(texts))
        self.base = a

    def word(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode()

    def heads(self) -> np.ndarray:
        """The first four bytes of each word, as a number; shorter words end in zeros."""
        head = np.zeros(len(self.starts), np.uint32)
        for k in range(4):
            at = self.starts + k
            has = at < self.ends
            head[has] |= self.data[at[has]].astype(np.uint32) << np.uint32(8 * k)
        return head

    def kinds(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of each kind (by a 64-bit hash) among the given ones, and each one's kind."""
        part = self.data[self.base : int(self.offsets[-1])]
        _, first, which = np.unique(span_hashes(part, self.starts[words] - self.base, self.ends[words] - self.base), return_index=True, return_inverse=True)
        return words[first], which

    def begun_by(self, heads: np.ndarray) -> np.ndarray:
        """Numbers of the words that begin with one of the (sorted) heads."""
        if not len(heads):
            return np.zeros(0, np.int64)
        own = self.heads()
        return np.flatnonzero(heads[np.minimum(np.searchsorted(heads, own), len(heads) - 1)] == own)

    def clauses(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of the clause that each of the words is in."""
        ends = np.flatnonzero(_CLAUSE_END[self.data[self.base : int(self.offsets[-1])]]) + self.base
        after = np.searchsorted(ends, self.starts[words])
        padded = np.concatenate(([-1], ends, [int(self.offsets[-1])]))
        return np.maximum(padded[after] + 1, self.offsets[self.rows[words]]), np.minimum(padded[after + 1], self.offsets[self.rows[words] + 1])


def head_number(label: str) -> int:
    return int.from_bytes(label.encode()[:4].ljust(4, b"\0"), "little")


def arcs_of(word: str) -> list[str]:
    """Labels that the insult transducer may read for a word: itself and its stems."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


class Grammar:
    """The lexicon's insult arcs (label to ratio) on top of the fixed cues, the
    reliability of the machine's classes, and the log-odds of the prior."""

    def __init__(self, arcs: dict[str, float], prior: float = 0.1, reliability: dict[int, float] | None = None):
        self.arcs, self.bias, self.reliability = arcs, math.log(prior / (1 - prior)), reliability or {}
        self.slope, self.shift = 1.0, self.bias
        self.kept: dict[str, float] = {}
        self.alone: dict[tuple[str, ...], int] = {}
        self.heads = np.unique(np.array([*map(head_number, [a.rstrip("*") for a in arcs]), *(head_number(w) for cues in CUES.values() for w in cues)], np.uint32))

    def ratio(self, word: str) -> float:
        """Of the word's strongest insult arc."""
        if (found := self.kept.get(word)) is None:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            found = self.kept[word] = max(self.arcs.get(a, 0.0) for a in arcs_of(word))
        return found

    def read(self, word: str, words: int) -> list[tuple[str, float]]:
        """What the lexicon may write for a word of a text with so many words; an
        insult can be passed over."""
        ratio = self.ratio(word)
        return self._cue(word) + ([("insult", math.log1p(ratio / words)), ("", 0.0)] if ratio else [])

    def match(self, clause: list[str], words: int) -> tuple[int, float] | None:
        """(class, weight) of the heaviest path over a clause's words that takes something."""
        return self._heaviest([choice for w in clause if (choice := self.read(w, words))])

    def matches_of(self, texts: pa.Array) -> list[list[tuple[int, float]]]:
        """Matched clauses of each text; a repeated clause counts once. Of the insults
        between two cues only the strongest can be on the heaviest path, so the machine
        reads that one alone."""
        found = Found(texts)
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(texts))]
        likely = found.begun_by(self.heads)
        first, which = found.kinds(likely)
        words = [found.word(k) for k in first.tolist()]
        ratio = np.array([self.ratio(w) for w in words])[which] if words else np.zeros(0)
        cue = np.array([any(w in cues for cues in CUES.values()) for w in words], bool)[which]
        kept = np.flatnonzero((ratio > 0) | cue)
        likely, which, ratio, cue = likely[kept], which[kept], ratio[kept], cue[kept]
        if not len(likely):
            return out
        low, high = found.clauses(likely)
        begins = np.concatenate(([True], low[1:] != low[:-1]))
        parts = np.flatnonzero(begins | cue | np.concatenate(([True], cue[:-1])))
        strongest = np.maximum.reduceat(ratio, parts)
        clause = np.flatnonzero(begins[parts])
        cues = [words[k] if c else "" for k, c in zip(which[parts].tolist(), cue[parts].tolist(), strict=True)]
        best, seen = strongest.tolist(), set()
        at = parts[clause]
        for a, b, row, x, y in zip(clause.tolist(), [*clause[1:].tolist(), len(parts)], found.rows[likely[at]].tolist(), low[at].tolist(), high[at].tolist(), strict=True):
            text = (row, found.data[x:y].tobytes().strip())
            if text not in seen:
                seen.add(text)
                if m := self._path(cues[a:b], best[a:b], int(found.n[row])):
                    out[row].append(m)
        return out

    def _path(self, cues: list[str], ratios: list[float], words: int) -> tuple[int, float] | None:
        """``match`` for parts of a clause: a cue word, or (an empty text) the strongest of some insults."""
        insults = [r for r in ratios if r]
        if len(insults) == 1 and not HARMS.intersection(cues):  # the class doesn't depend on the weight
            key = tuple(f"{c}+insult" if r else c for c, r in zip(cues, ratios, strict=True))
            if key not in self.alone:
                if len(self.alone) >= KEPT_WORDS:
                    self.alone.clear()
                self.alone[key] = self._heaviest([[*self._cue(c), *([("insult", 1.0), ("", 0.0)] if r else [])] for c, r in zip(cues, ratios, strict=True)])[0]
            return self.alone[key], math.log1p(insults[0] / words)
        if not insults and not HARMS.intersection(cues):
            return None
        return self._heaviest([[*self._cue(c), *([("insult", math.log1p(r / words)), ("", 0.0)] if r else [])] for c, r in zip(cues, ratios, strict=True)])

    @staticmethod
    def _cue(word: str) -> list[tuple[str, float]]:
        return [(symbol, 0.0) for symbol, cues in CUES.items() if word in cues]

    @staticmethod
    def _heaviest(choices: list[list[tuple[str, float]]]) -> tuple[int, float] | None:
        taken = [(-weight, kind) for state, weight in MACHINE.best(choices).items() if (kind := class_of(state)) is not None]
        return (min(taken)[1], -min(taken)[0]) if taken else None

    def matches(self, text: str) -> list[tuple[int, float]]:
        return self.matches_of(pa.array([text]))[0]

    def factor(self, kind: int) -> float:
        """Evidence of a class over that of the plain one."""
        odds = lambda k: math.log((r := min(max(self.reliability.get(k, prior_reliability(k)), 0.02), 0.98)) / (1 - r)) - self.bias
        return min(max(odds(kind) / odds(0), 0.0), 1.25) if odds(0) > 0 else 1.0

    def total(self, matches: list[tuple[int, float]]) -> float:
        return sum(weight * self.factor(kind) for kind, weight in matches)

    def scores(self, texts: pa.Array) -> list[float]:
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, self.shift + self.slope * self.total(m))))) for m in self.matches_of(texts)]

    def score(self, text: str | None) -> float:
        return self.scores(pa.array([text], pa.string()))[0]


def prior_reliability(kind: int) -> float:
    """By what modifies the clause; a target adds to what an unmodified one has."""
    return min(DENIED if kind & NEGATED else PLAIN, QUOTED if kind & QUOTED_BIT else PLAIN) if kind & 3 else TARGETED if kind & TARGETED_BIT else PLAIN


def arc_ratio(toxic: Column, clean: Column, rows: dict[int, int], words: dict[int, int]) -> Column:
    """Of an arc in so many toxic and clean rows: what a toxic row has of it beyond
    chance, over its (shrunken) rate per word of clean text."""
    rate = (clean + PRIOR_ROWS / 2) / max(words[0], 1)
    return F.greatest(toxic - rate * words[1], F.lit(0.0)) / rows[1] / rate


def surprise(toxic: Column, clean: Column, prior: float) -> Column:
    """Twice the log-likelihood ratio of the label's own rate against the prior."""
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((toxic + clean) * p))).otherwise(0.0)
    return 2 * (part(toxic, prior) + part(clean, 1 - prior))


def _toxic_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that have an arc, and a bitmap of the neighbours that its words stand between."""
    rows: Counter[str] = Counter()
    places: dict[str, int] = {}

    def put() -> pa.RecordBatch:
        masks = np.array(list(map(places.__getitem__, rows)), np.uint64).view(np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.string()), pa.array(rows.values(), pa.int64()), pa.array(masks)], ["arc", "n", "places"])
        rows.clear()
        places.clear()
        return out

    for batch in text_slices(batches):
        found = Found(batch.column("text"))
        for a, n in zip((np.cumsum(found.n) - found.n).tolist(), found.n.tolist(), strict=True):
            words = [found.word(k) for k in range(a, a + n)]
            seen: dict[str, int] = {}
            for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                bit = 1 << (zlib.crc32(f"{before} {after}".encode()) & 63)
                for arc in arcs_of(word):
                    seen[arc] = seen.get(arc, 0) | bit
            rows.update(seen.keys())
            for arc, bits in seen.items():
                places[arc] = places.get(arc, 0) | bits
            if len(rows) > KEPT_WORDS:
                yield put()
    yield put()


def spread(rows: Column, places: Column) -> Column:
    """Rows of an arc that stand for different passages: no more than the
    neighbours it was seen with (linear counting; copies repeat theirs)."""
    free = 64 - F.bit_count(places)
    return F.when(free > 0, F.least(rows, F.rint(64 * F.log(64 / free)).cast("long"))).otherwise(rows)


def _clean_arcs(sought: list[str]):
    """Rows of each sought arc."""
    heads = np.unique(np.array([head_number(a.rstrip("*")) for a in sought], np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {a: k for k, a in enumerate(sought)}
        counts = np.zeros(len(sought), np.int64)
        for batch in text_slices(batches):
            found = Found(batch.column("text"))
            likely = found.begun_by(heads)
            first, which = found.kinds(likely)
            arcs = [[number[a] for a in arcs_of(found.word(k)) if a in number] for k in first.tolist()]
            n = np.array(list(map(len, arcs)), np.int64)
            flat, at = np.array([a for x in arcs for a in x], np.int64), np.cumsum(n) - n
            each = n[which]  # arcs of each word
            place = np.repeat(at[which] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            pairs = np.unique(np.repeat(found.rows[likely], each) * len(sought) + flat[place])
            counts += np.bincount(pairs % len(sought), minlength=len(sought)) if len(pairs) else 0
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([sought[k] for k in some.tolist()], pa.string()), pa.array(counts[some])], ["arc", "clean"])

    return run


def _all_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each arc, in parts."""
    counts: Counter[str] = Counter()
    for batch in text_slices(batches):
        found = Found(batch.column("text"))
        ends = np.cumsum(found.n).tolist()
        for n, b in zip(found.n.tolist(), ends, strict=True):
            counts.update({a for k in range(b - n, b) for a in arcs_of(found.word(k))})
            if len(counts) > KEPT_WORDS:
                yield _arc_counts(counts)
                counts.clear()
    yield _arc_counts(counts)


def _arc_counts(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["arc", "clean"])


def _training_matches(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = grammar.matches_of(batch.column("text"))
            lists = lambda k, t: pa.array([[m[k] for m in x] for x in found], pa.list_(t))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists(0, pa.int64()), lists(1, pa.float64())], ["toxic", "kinds", "weights"])

    return run


def _count_totals(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kinds", "weights", "toxic")), strict=True)
            counts = Counter((min(round(4 * grammar.total(list(zip(k, w, strict=True)))), 160), t) for k, w, t in rows)
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in counts], pa.int64()) for i in range(2)), pa.array(counts.values(), pa.int64())], ["quarter", "toxic", "n"])

    return run


def calibrate(seen: dict[tuple[int, int], int], slope: float, bias: float) -> tuple[float, float]:
    """Slope and bias of a logistic regression on totals in steps of a quarter,
    by Newton's method, with PRIOR_ROWS of pull towards the given ones."""
    x, y, n = np.array([(k / 4, t, c) for (k, t), c in seen.items()], float).T
    start = now = np.array([slope, bias])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ now, -40, 40)))
        gradient = design.T @ (n * (y - p)) - PRIOR_ROWS * (now - start)
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + PRIOR_ROWS * np.eye(2), gradient)
        now = now + np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    return max(float(now[0]), 0.05), float(now[1])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, words of the labelled rows that may be learned from, of about
    TRAIN_ROWS rows and TRAIN_WORDS words at most."""
    usable = labels.filter("toxic is not null and doc_id is not null").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    n = usable.count()
    if n > TRAIN_ROWS:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < TRAIN_ROWS)
    usable = checked_broadcast(usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    rows = stage(docs.select("doc_id", text_of().alias("text")).join(usable, "doc_id").withColumn("words", word_count()), "labelled")
    words = rows.agg(F.sum("words")).first()[0] or 0
    if words > TRAIN_WORDS:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("words")), F.lit(words)) < TRAIN_WORDS)
    return rows.select("text", "toxic", "words")


def insult_arcs(rows: DataFrame, n: dict[int, int], words: dict[int, int]) -> DataFrame:
    """arc, ratio of the arcs that are more frequent in toxic rows than chance would have it."""
    prior = n[1] / (n[0] + n[1])
    text = lambda kind: rows.filter(F.col("toxic") == kind).select("text")
    found = text(1).mapInArrow(_toxic_arcs, "arc string, n long, places long").groupBy("arc").agg(F.sum("n").alias("n"), F.bit_or("places").alias("places"))
    found = stage(found.filter(F.col("n") >= LEAST_ROWS).select("arc", spread(F.col("n"), F.col("places")).alias("toxic")).filter(F.col("toxic") >= LEAST_ROWS), "arcs")
    least = 2 * math.log(max(found.count(), 2))  # about one arc by chance
    surprising = lambda clean: surprise(F.col("toxic"), clean, prior) >= least
    likely = found.filter(surprising(F.lit(0)))  # clean rows only make it less
    few = likely.count() <= SOUGHT_ARCS
    count = _clean_arcs([r["arc"] for r in likely.select("arc").collect()]) if few else _all_arcs
    clean = text(0).mapInArrow(count, "arc string, clean long").groupBy("arc").agg(F.sum("clean").alias("clean"))
    both = likely.join(clean, "arc", "left").fillna(0, ["clean"])
    kept = both.filter((F.col("toxic") * n[0] > F.col("clean") * n[1]) & surprising(F.col("clean")))
    return kept.select("arc", arc_ratio(F.col("toxic"), F.col("clean"), n, words).alias("ratio")).filter("ratio > 0")


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    rows = training_rows(docs, labels)
    sums = rows.groupBy("toxic").agg(F.count("*"), F.sum("words")).collect()
    n, words = {r[0]: r[1] for r in sums}, {r[0]: r[2] for r in sums}
    if not n.get(0) or not n.get(1):
        return Grammar({})
    prior = n[1] / (n[0] + n[1])
    arcs = {r["arc"]: r["ratio"] for r in insult_arcs(rows, n, words).collect()}
    first = Grammar(arcs, prior)
    found = stage(rows.select("text", "toxic").mapInArrow(_training_matches(first), "toxic int, kinds array<long>, weights array<double>"), "matches")
    kinds = found.select("toxic", F.explode(F.array_distinct("kinds")).alias("kind")).groupBy("kind", "toxic").agg(F.count("*").alias("n"))
    seen = {(r["kind"], r["toxic"]): r["n"] for r in kinds.collect()}
    reliability = {}
    for kind in {k for k, _ in seen}:
        t, c = seen.get((kind, 1), 0), seen.get((kind, 0), 0)
        reliability[kind] = (t + PRIOR_ROWS * prior_reliability(kind)) / (t + c + PRIOR_ROWS)
    grammar = Grammar(arcs, prior, reliability)
    totals = found.mapInArrow(_count_totals(grammar), "quarter long, toxic long, n long").groupBy("quarter", "toxic").agg(F.sum("n").alias("n"))
    seen = {(r["quarter"], r["toxic"]): r["n"] for r in totals.collect()}
    grammar.slope, grammar.shift = calibrate(seen, 1.0, grammar.bias)
    return grammar


def _scores(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(grammar.scores(batch.column("text")), pa.float64())], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    scored = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(_scores(learn(docs, labels)), "doc_id long, score double")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _clean_rows(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield batch.filter(pa.array([x < 0.5 for x in grammar.scores(batch.column("text"))], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with its columns."""
    return docs.mapInArrow(_clean_rows(learn(docs, labels)), docs.schema)
