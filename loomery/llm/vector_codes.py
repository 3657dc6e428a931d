"""Product-quantisation codes of vectors, codebooks learned by Yinyang Lloyd.

Vectors become integers, are cut into equal parts, and every part position has a
codebook. Lloyd's rounds need each part's nearest entry again and again; most
of that is skipped. A codebook's entries are clustered into groups once; a
vector keeps, for each part, the entry it has and one lower bound per group on
the distance to the group's other entries. When entries move, a bound falls by
the largest drift of its group, and only groups whose bound no longer exceeds
the exact distance to the own entry are scanned. Scans and ties are decided on
integers, so the codes are those of a full comparison, bit by bit.

A round is one pass over the vectors that gives back only what changed: for
each entry, the count and sums of the parts that came less those that left,
summed per task, then per entry, so that the driver sees at most parts x
entries x tasks-combined rows of numbers, whatever the table's size. Bounds
follow from the codebooks' history alone, so a pass replays the rounds since
the last table of bounds instead of writing one each round: after an exact
first round a replay is mostly skipping. A table (entry and bounds of each
part) is written every ``KEEP_EVERY`` rounds, which bounds the replay. A lost
executor costs the tasks that ran on it; vectors are read from one staged table.

Defined cases: rows whose vector is null, or holds null or non-finite
components, are dropped; so are those whose length isn't that of the kept
vector with the smallest vec_id (nulls last, then by components); a length that
parts don't divide is filled up with zeros; with fewer kept vectors than
entries a codebook has one entry per vector; repeated rows count each; a null
label is a label; an empty table gives no rows; other columns are ignored.
Integers of 2^28 or more have no exact 64-bit distances: a ValueError says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.shared import checked_broadcast, stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a codebook per group; rounds after which bounds are written; rows worked at once.
GROUP_SIZE, KEEP_EVERY, AT_ONCE = 4, 8, 8192
LARGEST = 1 << 28
#: Bounds are lowered and distances raised by so much before they are compared, which covers the rounding of either.
SLACK = 1e-9


@dataclass
class Codebooks:
    """The codebooks of all rounds so far: ``history[r]`` is an integer array (part, entry, position)."""

    history: list[np.ndarray]
    groups: np.ndarray = field(init=False)  # (part, entry): its group
    n_groups: int = field(init=False)

    def __post_init__(self):
        first = self.history[0]
        self.n_groups = max(1, -(-first.shape[1] // GROUP_SIZE))
        self.groups = np.stack([group_entries(part, self.n_groups) for part in first])

    def drifts(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """How far entries moved to round r: the largest of each (part, group)."""
        moved = np.sqrt(((self.history[r] - self.history[r - 1]).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
        return moved, np.stack([[moved[p][self.groups[p] == g].max(initial=0.0) for g in range(self.n_groups)] for p in range(len(moved))])


def group_entries(entries: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Groups of a codebook's entries: plain k-means over the few entries, farthest-first start."""
    e = entries.astype(np.float64)
    chosen = [0]
    while len(chosen) < n:
        far = np.min([((e - e[c]) ** 2).sum(1) for c in chosen], axis=0)
        chosen.append(int(far.argmax()))
    middle = e[chosen]
    for _ in range(rounds):
        near = ((e[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        for g in range(n):
            if (near == g).any():
                middle[g] = e[near == g].mean(0)
    return near.astype(np.int64)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, entry) of integer rows."""
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)


@dataclass
class Bounds:
    """Of a batch: the entry of each part (row, part), and the lower bounds (row, part, group)."""

    own: np.ndarray
    low: np.ndarray
    scanned: int = 0


def first_bounds(x: np.ndarray, books: Codebooks) -> Bounds:
    """A full comparison with the first codebooks."""
    n, parts, _ = x.shape
    made = Bounds(np.zeros((n, parts), np.int64), np.full((n, parts, books.n_groups), np.inf))
    for p in range(parts):
        d = distances(x[:, p], books.history[0][p])
        made.own[:, p] = d.argmin(1)  # the first of equals
        made.scanned += d.size
        _set_bounds(made, p, np.arange(n), d.astype(np.float64), books.groups[p], np.ones((n, books.n_groups), bool))
    return made


def _set_bounds(b: Bounds, p: int, rows: np.ndarray, d: np.ndarray, groups: np.ndarray, scanned: np.ndarray) -> None:
    """Bounds of the scanned groups from distances (rows, entry); what wasn't measured is infinite."""
    d[np.arange(len(rows)), b.own[rows, p]] = np.inf
    for g in range(scanned.shape[1]):
        at = np.flatnonzero(scanned[:, g])
        b.low[rows[at], p, g] = np.sqrt(d[np.ix_(at, np.flatnonzero(groups == g))].min(1, initial=np.inf)) * (1 - SLACK)


def next_bounds(x: np.ndarray, b: Bounds, books: Codebooks, r: int) -> None:
    """``b`` after the entries moved to round r: groups whose bound fails are scanned, the others can't hold a nearer entry or a tie."""
    drift = books.drifts(r)[1]
    for p in range(x.shape[1]):
        entries, groups = books.history[r][p], books.groups[p]
        b.low[:, p] = np.maximum(b.low[:, p] - drift[p], 0)
        own = ((x[:, p] - entries[b.own[:, p]]) ** 2).sum(1)
        fails = b.low[:, p] <= np.sqrt(own.astype(np.float64))[:, None] * (1 + SLACK)
        rows = np.flatnonzero(fails.any(1))
        if not len(rows):
            continue
        fails, best, which = fails[rows], own[rows], b.own[rows, p].copy()
        old, d = which.copy(), np.full((len(rows), len(entries)), np.inf)
        for g in range(books.n_groups):
            at, members = np.flatnonzero(fails[:, g]), np.flatnonzero(groups == g)
            if not len(at) or not len(members):
                continue
            exact = distances(x[rows[at], p], entries[members])
            b.scanned += exact.size
            d[np.ix_(at, members)] = exact
            k = exact.argmin(1)
            least, entry = exact[np.arange(len(at)), k], members[k]
            nearer = (least < best[at]) | ((least == best[at]) & (entry < which[at]))
            best[at], which[at] = np.where(nearer, least, best[at]), np.where(nearer, entry, which[at])
        b.own[rows, p] = which
        left = np.flatnonzero(which != old)  # the entry left behind is one of its group's others now
        behind = groups[old[left]]
        b.low[rows[left], p, behind] = np.minimum(b.low[rows[left], p, behind], np.sqrt(own[rows[left]].astype(np.float64)) * (1 - SLACK))
        _set_bounds(b, p, rows, d, groups, fails)



def integer_vectors(embeddings: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """The kept rows (vec_id, label, components) as a staged table, and how many components a part has."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null").filter(finite)
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    length = least[0] if least else 0
    rows = rows.filter(F.size("embedding") == length)
    biggest = rows.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x))))).first()[0] or 0.0
    if biggest * scale >= LARGEST:
        raise ValueError(f"components up to {biggest:g} times {scale} have no exact 64-bit distances")
    fill = -length % parts
    ints = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    ints = F.concat(ints, F.array_repeat(F.lit(0), fill)) if fill else ints
    return stage(rows.select("vec_id", "label", ints.alias("ints")), "vectors"), (length + fill) // parts


def _batches(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors as (row, part, position)."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            piece = batch.slice(at, AT_ONCE)
            flat = piece.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield piece, flat.reshape(piece.num_rows, parts, -1)


def _replay(piece: pa.RecordBatch, x: np.ndarray, books: Codebooks, kept_at: int) -> tuple[Bounds, np.ndarray]:
    """Bounds with the newest codebooks, and the entries of the round before."""
    if kept_at < 0:
        b, begun = first_bounds(x, books), 0
    else:
        raw = lambda name, kind, *shape: np.frombuffer(b"".join(piece.column(name).to_pylist()), kind).reshape(len(x), x.shape[1], *shape)
        b, begun = Bounds(raw("own", "<i4").astype(np.int64), raw("low", "<f8", books.n_groups).copy()), kept_at
    before = b.own.copy() if begun == len(books.history) - 1 else None
    for r in range(begun + 1, len(books.history)):
        before = b.own.copy()
        next_bounds(x, b, books, r)
    return b, before


CHANGES = "part int, entry int, n long, sums array<long>"


def _changes(books: Codebooks, kept_at: int):
    """What a task's vectors change in the counts and sums of the entries, against the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.history[0].shape
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for piece, x in _batches(batches, parts):
            b, before = _replay(piece, x, books, kept_at)
            first = len(books.history) == 1
            for p in range(parts):
                moved = np.arange(len(x)) if first else np.flatnonzero(before[:, p] != b.own[:, p])
                np.add.at(n[p], b.own[moved, p], 1)
                np.add.at(sums[p], b.own[moved, p], x[moved, p])
                if not first:
                    np.subtract.at(n[p], before[moved, p], 1)
                    np.subtract.at(sums[p], before[moved, p], x[moved, p])
        found = [(p, e, int(n[p, e]), sums[p, e].tolist()) for p in range(parts) for e in range(entries) if n[p, e] or sums[p, e].any()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "sums"])

    return run


def _kept(books: Codebooks, kept_at: int):
    """The vectors with their entries and bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _batches(batches, books.history[0].shape[0]):
            b = _replay(piece, x, books, kept_at)[0]
            own, low = ([r.tobytes() for r in a] for a in (b.own.astype("<i4"), b.low.astype("<f8")))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("vec_id", "label", "ints")), pa.array(own, pa.binary()), pa.array(low, pa.binary())], ["vec_id", "label", "ints", "own", "low"])

    return run


def _codes(books: Codebooks, kept_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _batches(batches, books.history[0].shape[0]):
            own = _replay(piece, x, books, kept_at)[0].own
            nearest = books.history[-1][np.arange(x.shape[1])[None], own]
            code = ["".join(f"{k:02x}" for k in row) for row in own.tolist()]
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), pa.array(code, pa.string()), pa.array(((x - nearest) ** 2).sum((1, 2)))], ["vec_id", "label", "code", "error"])

    return run


def learn_codebooks(vectors: DataFrame, width: int, parts: int, entries: int, rounds: int, keep_every: int = KEEP_EVERY, told: Callable[[int, np.ndarray], None] | None = None) -> tuple[Codebooks, DataFrame, int]:
    """The codebooks of all rounds, and the table and round that bounds were kept in last."""
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    first = np.array([r["ints"] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    books, kept_at = Codebooks([first]), -1
    n, sums = np.zeros(first.shape[:2], object), np.zeros(first.shape, object)
    for r in range(rounds):
        wide = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
        for row in vectors.mapInArrow(_changes(books, kept_at), CHANGES).groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():
            n[row["part"], row["entry"]] += row["n"]
            for k in range(width):
                sums[row["part"], row["entry"], k] += int(row[f"s{k}"])
        used = n > 0
        new = books.history[-1].copy()
        new[used] = np.array([[int(s) // int(c) for s in row] for row, c in zip(sums[used], n[used])], np.int64).reshape(-1, width)
        if told:
            told(r, new)
        if r - kept_at >= keep_every:
            schema = vectors.select("vec_id", "label", "ints").schema.add("own", "binary").add("low", "binary")
            vectors, kept_at = stage(vectors.mapInArrow(_kept(books, kept_at), schema), "bounds"), r
        books.history.append(new)
    return books, vectors, kept_at


def codebooks_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, books.history[-1].reshape(-1).tolist())).encode()).hexdigest()


def compress_vectors(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, keep_every: int = KEEP_EVERY) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row of ``embeddings`` (vec_id, embedding, label)."""
    vectors, width = integer_vectors(embeddings, parts, scale)
    nothing = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not width or vectors.isEmpty():
        return embeddings.sparkSession.createDataFrame([], nothing)
    books, vectors, kept_at = learn_codebooks(vectors, width, parts, entries, rounds, keep_every)
    schema = vectors.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    coded = stage(vectors.mapInArrow(_codes(books, kept_at), schema), "codes")
    totals = checked_broadcast(stage(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors"))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
