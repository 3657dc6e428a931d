"""Language-model scores from class-based n-grams.

Tokens are words (runs of other characters than blanks, A-Z lower-cased) and
one end per document. The model is

    p(w | v) = LAMBDA * p(C(w) | D(v)) * p(w | C(w)) + (1 - LAMBDA) * p(w)

with smoothed transitions, emissions and unigrams; base_score is the unigram
part alone. C is the class that a word is predicted by, D the one it predicts
by; both come from exchange clustering.

*Core words*, at least one in ``CLUSTERED`` tokens, have one class for both.
Their training tokens are written once as class-independent ids. A turn counts,
for every core word, the classes before and after it, and half of the words
move to the class that raises the class-bigram likelihood most; turns go on
until two of them gain less than ``GAIN`` nats a token. *All other words* that
were seen ``LEAST`` times or more then get their class C by the same exchange:
the one where the classes before them raise the likelihood most. That is done
in a shuffle by word hash, so the number of words with a class of their own
grows with the corpus. Rarer and unseen words are predicted by one of eight
classes by shape, and every word outside the core predicts by its shape; the
end has a class of its own.

Counts cover all training documents. What is broadcast is bounded by
construction: core words (65,536 at most), and for scoring words with at least
one in ``FREQUENT`` tokens (a million at most) with their counts and classes.
Tokens of other words meet their counts and classes in a shuffle by hash, in
buckets sized from the counts; none of them can be hot.

Defined cases: a null text is empty and has one token, its end; without
training documents all counts are 0; repeated rows are scored one by one; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.kernels import ASCII_LOWER, NOT_BLANK, give_back, shaped_words, text_slices, utf8
from loomery.llm.shared import stage, text_of

CLASSES, SHAPES = 48, 8
FREQUENT, CLUSTERED = 1 << 20, 1 << 16
LAMBDA = 0.9
#: Nats a token that two turns of the exchange must gain to go on.
GAIN = 0.002
#: Times that a word with a class of its own choice was seen.
LEAST = 5
#: Distinct words and tokens of a bucket of the shuffle by hash, about.
BUCKET_WORDS, BUCKET_TOKENS = 500_000, 2_000_000
#: Buckets of a small corpus; a document has a row in each bucket that it has rare words of.
BUCKETS = 16
#: Pairs of a word and the class before it, or rare tokens, that a task works on at a time.
PAIRS, RARE = 1 << 15, 1 << 18
#: Bytes of text that a task counts together.
PIECE = 4 << 20

END = CLASSES + SHAPES
ALL = END + 1
#: Id of a document's end in the written ids; words outside the core have -1 - shape.
END_ID = -100


class Words:
    """Words by ascending hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    @cached_property
    def slots(self) -> np.ndarray:
        """Place of the word by the first bits of its hash: -1 for none, -2 for several."""
        slots = np.full(1 << max(10, (8 * len(self.hashes)).bit_length()), -1, np.int32)
        at = self.slot_of(self.hashes, len(slots))
        slots[at] = np.arange(len(at))
        slots[np.flatnonzero(np.bincount(at, minlength=len(slots)) > 1)] = -2
        return slots

    @staticmethod
    def slot_of(hashes: np.ndarray, n: int) -> np.ndarray:
        return (hashes >> np.uint64(65 - n.bit_length())).astype(np.int64)

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes}  # each worker makes its own slots

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the words, -1 for those that aren't among these."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = self.slots[self.slot_of(hashes, len(self.slots))]
        if len(shared := np.flatnonzero(at == -2)):
            at[shared] = np.minimum(np.searchsorted(self.hashes, hashes[shared]), len(self.hashes) - 1)
        return np.where((at >= 0) & (self.hashes[np.maximum(at, 0)] == hashes), at, -1)


@dataclass
class Model:
    """Bounded tables of what was learned."""

    n: int  # training tokens
    v: int  # distinct ones
    ends: int
    core: Words
    classes: np.ndarray  # of the core words
    frequent: Words
    counts: np.ndarray  # of the frequent words
    emitted_by: np.ndarray  # their classes C, -1 for shape
    moves: np.ndarray  # training tokens by (D before, C)
    shape_words: np.ndarray  # distinct words of the shape classes

    def unigram_total(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    def transitions(self) -> np.ndarray:
        """p(C | D), each row smoothed by one draw from the classes' own rates."""
        own = self.moves.sum(axis=0) + 0.5
        return (self.moves + own / own.sum()) / (self.moves.sum(axis=1, keepdims=True) + 1)

    def emission(self, count: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """p(w | C(w)) of words seen so often in training, in classes below END; shape
        classes leave half a count to each of their words and to the unseen."""
        own = self.moves.sum(axis=0)[:END].astype(float)
        size = np.concatenate((np.maximum(own[:CLASSES], 1), own[CLASSES:] + 0.5 * (self.shape_words + 1)))
        return (count + np.where(kind < CLASSES, 0.0, 0.5)) / size[kind]


def token_slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column("text"))
    yield from shaped_words(data, offsets, NOT_BLANK, ASCII_LOWER)


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, shape) of all words of a batch."""
    found = list(token_slices(batch)) or [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, PIECE):
        kinds, n = np.unique(tokens_of(batch)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n, pa.int64())], ["hash", "n"])


def stream(rows: np.ndarray, codes: np.ndarray, n: int, end: int) -> np.ndarray:
    """The codes of n rows one after the other, each row followed by ``end``."""
    out = np.full(len(codes) + n, end, np.int32)
    out[np.arange(len(codes)) + rows] = codes
    return out


def _core_ids(core: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, PIECE):
            rows, hashes, shapes = tokens_of(batch)
            place = core.look_up(hashes)
            ids = stream(rows, np.where(place >= 0, place, -1 - shapes), batch.num_rows, END_ID)
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])

    return run


def _count_classes(classes: np.ndarray):
    """(word, counts): classes before and after each core word, and under negative
    numbers all moves between classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = np.concatenate((classes, np.arange(END - 1, CLASSES - 1, -1)))  # -1 - shape counts from the end
        moves = np.zeros(ALL * ALL, np.int64)
        sides = np.zeros((2, len(classes) * ALL), np.int64)
        for batch in batches:
            for part in batch.column("ids"):
                ids = np.frombuffer(part.as_buffer(), np.int32)
                ends = ids == END_ID
                kind = np.where(ends, END, kind_of[np.where(ends, 0, ids)])
                before = np.concatenate(([END], kind[:-1]))
                moves += np.bincount(before * ALL + kind, minlength=ALL * ALL)
                at = np.flatnonzero(ids >= 0)
                word = ids[at].astype(np.int64) * ALL
                if len(at):
                    sides[0] += np.bincount(word + before[at], minlength=sides.shape[1])
                    sides[1] += np.bincount(word + kind[at + 1], minlength=sides.shape[1])
        both = np.concatenate([sides[k].reshape(-1, ALL) for k in range(2)], axis=1)
        some = np.flatnonzero(both.any(axis=1))
        yield _counted([-1 - TaskContext.get().partitionId() % 64, *some.tolist()], [moves, *both[some]])
        del sides, both
        give_back()

    return run


def _counted(words: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array([c.tobytes() for c in counts], pa.binary())], ["word", "counts"])


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for w, c in zip(batch.column("word").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(c.as_py(), np.int64)
            sums[w] = sums[w] + part if w in sums else part
    yield _counted(list(sums), list(sums.values()))
    sums.clear()
    give_back()


def class_counts(ids: DataFrame, classes: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Summed (word, counts), and the matrix of moves between classes."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ids.mapInArrow(_count_classes(classes), "word long, counts binary").repartition(parts, "word")
    found = stage(found.mapInArrow(_sum_counts, "word long, counts binary"), "classes")
    moves = [np.frombuffer(r["counts"], np.int64) for r in found.filter("word < 0").collect()]  # 64 at most
    return found.filter("word >= 0"), sum(moves, np.zeros(ALL * ALL, np.int64)).reshape(ALL, ALL)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(moves: np.ndarray) -> float:
    """Log-likelihood of the class sequence and of the words in their classes, but
    for a part that doesn't depend on the classes."""
    return float(xlogx(moves.astype(float)).sum() - xlogx(moves.sum(axis=0).astype(float)).sum() - xlogx(moves.sum(axis=1).astype(float)).sum())


def best_class(old: int, before: np.ndarray, after: np.ndarray, moves: np.ndarray) -> int:
    """The class where a word's neighbours raise the class-bigram likelihood most."""
    left = moves.astype(float)
    left[:, old] -= before
    left[old] -= after
    left = np.maximum(left, 0)
    n = before.sum()
    into, out = left[:, :CLASSES], left[:CLASSES]
    gain = (xlogx(into + before[:, None]) - xlogx(into)).sum(axis=0) + (xlogx(out + after) - xlogx(out)).sum(axis=1)
    held_in, held_out = into.sum(axis=0), out.sum(axis=1)
    gain -= xlogx(held_in + n) - xlogx(held_in) + xlogx(held_out + n) - xlogx(held_out)
    return int(gain.argmax())


def _exchange(core: Words, classes: np.ndarray, moves: np.ndarray, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, new = batch.column("word").to_pylist(), []
            for w, c in zip(words, batch.column("counts"), strict=True):
                both = np.frombuffer(c.as_py(), np.int64).astype(float)
                mine = int(core.hashes[w] >> np.uint64(17)) % 2 == turn % 2
                new.append(best_class(int(classes[w]), both[:ALL], both[ALL:], moves) if mine else int(classes[w]))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(new, pa.int64())], ["word", "class"])

    return run


def cluster_core(ids: DataFrame, core: Words, counts: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the core words, and the moves between classes under them."""
    classes = np.zeros(len(counts), np.int64)
    classes[np.lexsort((core.hashes, -counts))] = np.arange(len(counts)) % CLASSES
    reached: list[float] = []
    while True:
        by_word, moves = class_counts(ids, classes)
        reached.append(likelihood(moves))
        if not len(counts) or (len(reached) > 2 and reached[-1] - reached[-3] < GAIN * tokens):
            return classes, moves
        moved = by_word.mapInArrow(_exchange(core, classes, moves, len(reached)), "word long, class long").toArrow()  # at most CLUSTERED rows
        classes = classes.copy()
        classes[moved.column("word").to_numpy()] = moved.column("class").to_numpy()


def contexts(model_core: Words, classes: np.ndarray, rows: np.ndarray, hashes: np.ndarray, shapes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Core place (or -1) of each word and the class D before it; ``last`` has the class
    before each row's next word and is moved on."""
    place = model_core.look_up(hashes)
    kind = np.where(place >= 0, classes[place] if len(classes) else 0, CLASSES + shapes)
    new = np.concatenate(([True], rows[1:] != rows[:-1]))
    before = np.concatenate(([0], kind[:-1]))
    before[new] = last[rows[new]]
    final = np.concatenate((new[1:], [True]))
    last[rows[final]] = kind[final]
    return place, before


LISTS = "array<struct<bucket:int,hashes:array<long>,codes:array<smallint>,times:array<int>>>"


def _tail_words(core: Words, classes: np.ndarray, buckets: int):
    """For each piece of text its words outside the core with the class before and their shape."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, PIECE):
            last, found = np.full(batch.num_rows, END), []
            for rows, hashes, shapes in token_slices(batch):
                place, before = contexts(core, classes, rows, hashes, shapes, last)
                tail = place < 0
                found.append((np.zeros(int(tail.sum()), np.int64), hashes[tail], before[tail] * SHAPES + shapes[tail]))
            yield pa.RecordBatch.from_arrays([_by_bucket(found, 1, buckets)], ["tail"])

    return run


def _by_bucket(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, buckets: int) -> pa.Array:
    """For each of n rows its (hash, code) pairs by bucket, with their times."""
    rows, hashes, codes = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.int64, np.uint64, np.int64)))
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((codes, hashes, bucket, rows))
    rows, hashes, codes, bucket = rows[order], hashes[order], codes[order], bucket[order]
    changes = lambda *columns: np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))) if len(rows) else np.zeros(0, np.int64)
    first = changes(codes, hashes, rows)
    times = np.diff(np.concatenate((first, [len(rows)])))
    rows, hashes, codes, bucket = rows[first], hashes[first], codes[first], bucket[first]
    part = changes(bucket, rows)
    inner = pa.array(np.concatenate((part, [len(rows)])), pa.int32())
    lists = [pa.ListArray.from_arrays(inner, x) for x in (pa.array(hashes.view(np.int64)), pa.array(codes.astype(np.int16)), pa.array(times, pa.int32()))]
    struct = pa.StructArray.from_arrays([pa.array(bucket[part], pa.int32()), *lists], ["bucket", "hashes", "codes", "times"])
    outer = np.concatenate(([0], np.cumsum(np.bincount(rows[part], minlength=n))))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), struct)


def runs(items: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """The items in runs whose sizes sum to about ``most``, one item at least."""
    return [r for r in np.split(items, np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // most)) + 1) if len(r)]


def _flat(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [table.column(c).combine_chunks().flatten().to_numpy() for c in columns]


def _tail_classes(core_moves: np.ndarray):
    """(hash, n, class, sums) of a bucket's words; one row has the sums alone: tokens by
    (class before, class) and distinct words by shape."""
    into = core_moves[:, :CLASSES].astype(float)
    held = into.sum(axis=0)

    def run(table: pa.Table) -> pa.Table:
        hashes, codes, times = _flat(table, "hashes", "codes", "times")
        order = np.lexsort((codes, hashes))
        hashes, codes, times = hashes[order], codes[order].astype(np.int64), times[order]
        pair = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (codes[1:] != codes[:-1]))))
        hashes, codes, times = hashes[pair], codes[pair], np.add.reduceat(times, pair)
        word = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        size = np.diff(np.concatenate((word, [len(hashes)])))
        n = np.add.reduceat(times, word)
        kind = np.full(len(word), -1)
        often = np.flatnonzero(n >= LEAST)
        for some in runs(often, size[often], PAIRS):
            count = size[some]
            at = np.repeat(word[some] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            base = into[codes[at] // SHAPES]
            gain = np.add.reduceat(xlogx(base + times[at][:, None]) - xlogx(base), np.cumsum(count) - count)
            kind[some] = (gain - xlogx(held + n[some][:, None]) + xlogx(held)).argmax(axis=1)
        by_pair = np.repeat(kind, size)
        into_class = np.where(by_pair >= 0, by_pair, CLASSES + codes % SHAPES)
        moves = np.bincount(codes // SHAPES * ALL + into_class, times, minlength=ALL * ALL).astype(np.int64)
        shapes = np.bincount((codes[word] % SHAPES)[kind < 0], minlength=SHAPES)
        sums = [None] * len(word) + [np.concatenate((moves, shapes)).tobytes()]
        last = np.arange(len(word) + 1) == len(word)
        column = lambda x, kind: pa.array(np.append(x, 0), kind, mask=last)
        found = pa.table({"hash": column(hashes[word], pa.int64()), "n": column(n, pa.int64()), "class": column(kind, pa.int32()), "sums": pa.array(sums, pa.binary())})
        del hashes, codes, times, order, pair, by_pair
        give_back()
        return found

    return run


def train_model(train: DataFrame) -> tuple[Model, DataFrame, int]:
    """The model of the (text) rows, the table (hash, n, class) of the words outside the
    core, and the number of buckets for it."""
    counts = stage(train.mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "counts")
    ends = train.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n = words + ends
    few = counts.filter((F.col("n") * CLUSTERED >= n) & (F.col("n") >= LEAST)).toArrow()  # at most CLUSTERED rows
    hashes, kept = few.column("hash").to_numpy().view(np.uint64), few.column("n").to_numpy()
    order = np.argsort(hashes)
    core, kept = Words(hashes[order]), kept[order]
    buckets = max(BUCKETS, -(-distinct // BUCKET_WORDS), -(-5 * (words - int(kept.sum())) // 4 // BUCKET_TOKENS))

    ids = stage(train.mapInArrow(_core_ids(core), "ids binary"), "ids")
    classes, moves = cluster_core(ids, core, kept, n)
    pairs = train.mapInArrow(_tail_words(core, classes, buckets), f"tail {LISTS}").select(F.explode("tail").alias("t")).select("t.*")
    core_moves = moves.copy()
    core_moves[:, CLASSES:END] = 0
    tail = stage(pairs.groupBy("bucket").applyInArrow(_tail_classes(core_moves), "hash long, n long, class int, sums binary"), "tail")
    sums = [np.frombuffer(r["sums"], np.int64) for r in tail.filter("sums is not null").toLocalIterator()]
    total = sum(sums, np.zeros(ALL * ALL + SHAPES, np.int64))
    tail = tail.filter("hash is not null").select("hash", "n", "class")

    near = tail.filter(F.col("n") * FREQUENT >= n).toArrow()  # at most FREQUENT rows
    hashes = np.concatenate((core.hashes, near.column("hash").to_numpy().view(np.uint64)))
    order = np.argsort(hashes)
    model = Model(
        n, distinct + (ends > 0), ends, core, classes, Words(hashes[order]), np.concatenate((kept, near.column("n").to_numpy()))[order],
        np.concatenate((classes, near.column("class").to_numpy()))[order].astype(np.int64), core_moves + total[: ALL * ALL].reshape(ALL, ALL), total[ALL * ALL :],
    )
    return model, tail, buckets


SCORED = f"doc_id long, row long, held_out boolean, n_tokens long, known long, base double, score double, rare {LISTS}"


def _score(model: Model, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move, total = model.transitions(), model.unigram_total()
        for batch in text_slices(batches, PIECE):
            n = batch.num_rows
            last = np.full(n, END)
            tokens, known, base, score = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
            rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for rows, hashes, shapes in token_slices(batch):
                _, before = contexts(model.core, model.classes, rows, hashes, shapes, last)
                at = model.frequent.look_up(hashes)
                hit = at >= 0
                tokens += np.bincount(rows, minlength=n)
                rare.append((rows[~hit], hashes[~hit], before[~hit] * SHAPES + shapes[~hit]))
                rows, before, at = rows[hit], before[hit], at[hit]
                if len(rows):
                    kind = np.where(model.emitted_by[at] >= 0, model.emitted_by[at], CLASSES + shapes[hit])
                    plain = (model.counts[at] + 0.5) / total
                    known += np.bincount(rows, minlength=n)
                    base += np.bincount(rows, np.log10(plain), minlength=n)
                    score += np.bincount(rows, np.log10(LAMBDA * move[before, kind] * model.emission(model.counts[at], kind) + (1 - LAMBDA) * plain), minlength=n)
            end = (model.ends + 0.5) / total
            base += np.log10(end)
            score += np.log10(LAMBDA * move[last, END] + (1 - LAMBDA) * end)
            known += model.ends > 0
            columns = [batch.column("doc_id"), batch.column("row"), batch.column("held_out"), *(pa.array(x.astype(np.int64)) for x in (tokens, known)), pa.array(base), pa.array(score), _by_bucket(rare, n, buckets)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "held_out", "n_tokens", "known", "base", "score", "rare"])

    return run


def _meet(model: Model):
    """(row, base, score, known) of a bucket's tokens with the counts and classes of its words."""
    def run(tokens: pa.Table, words: pa.Table) -> pa.Table:
        move, total = model.transitions(), model.unigram_total()
        own = words.column("hash").to_numpy()
        order = np.argsort(own)
        own, n, by = np.append(own[order], 0), np.append(words.column("n").to_numpy()[order], 0), np.append(words.column("class").to_numpy()[order], -1)
        sizes = np.diff(tokens.column("hashes").combine_chunks().offsets.to_numpy())
        parts = [met(tokens.slice(int(r[0]), len(r)), own, n, by, move, total) for r in runs(np.arange(len(sizes)), sizes, RARE)]
        give_back()
        return pa.concat_tables(parts or [met(tokens, own, n, by, move, total)])

    def met(tokens: pa.Table, own: np.ndarray, n: np.ndarray, by: np.ndarray, move: np.ndarray, total: float) -> pa.Table:
        hashes, codes, times = _flat(tokens, "hashes", "codes", "times")
        size = np.diff(tokens.column("hashes").combine_chunks().offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        at = np.searchsorted(own[:-1], hashes)
        at = np.where(own[at] == hashes, at, len(n) - 1)
        count, codes = np.where(own[at] == hashes, n[at], 0), codes.astype(np.int64)
        kind = np.where((count > 0) & (by[at] >= 0), by[at], CLASSES + codes % SHAPES)
        plain = (count + 0.5) / total
        mixed = LAMBDA * move[codes // SHAPES, kind] * model.emission(count, kind) + (1 - LAMBDA) * plain
        per_row = lambda x: np.bincount(row, times * x, minlength=len(size))
        return pa.table({"row": tokens.column("row"), "base": per_row(np.log10(plain)), "score": per_row(np.log10(mixed)), "known": per_row(count > 0).astype(np.int64)})

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of ``docs`` (doc_id, text)."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 1
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), held.alias("held_out"), text_of().alias("text"))
    model, tail, buckets = train_model(rows.filter("not held_out").select("text"))
    scored = stage(rows.mapInArrow(_score(model, buckets), SCORED), "scored")
    ours = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    theirs = tail.filter(F.col("n") * FREQUENT < model.n).select(F.pmod(F.shiftrightunsigned("hash", 20), F.lit(buckets)).cast("int").alias("bucket"), "hash", "n", "class")
    met = ours.groupBy("bucket").cogroup(theirs.groupBy("bucket")).applyInArrow(_meet(model), "row long, base double, score double, known long")
    sums = met.groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("score").alias("more_score"), F.sum("known").alias("more"))
    out = scored.drop("rare").join(sums, "row", "left").fillna(0, ["more_base", "more_score", "more"])
    score = F.col("score") + F.col("more_score")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + F.col("more_base")).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
