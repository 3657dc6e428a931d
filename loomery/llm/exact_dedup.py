"""Exact dedup by composable polynomial fingerprints.

A text is normalised by deleting every blank (space, U+0009 to U+000D). Its
UTF-8 bytes are hashed chunk by chunk modulo four 31-bit primes; the chunk
hashes of a document are independent and combine by length-shifted arithmetic,
``H(A + B) = H(A) * base**len(B) + H(B)``, so a huge document costs one matrix
product over its chunks and its memory is one slice. Documents whose
fingerprints are equal are then compared chunk by chunk: for each fingerprint
and chunk number a streaming aggregate keeps the least and the greatest chunk,
and only where they are one are the texts equal. Where they differ (a
collision) the group is split by SHA-256. The aggregate combines map-side, so a
text that a third of all rows share sends one row per task.

Defined cases: null and blank texts normalise to the empty text and are equal
to each other; rows that repeat a doc_id count as rows of their own, of which
one at most is kept; a null doc_id sorts first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.kernels import NOT_BLANK, text_slices, utf8
from loomery.llm.shared import BLANKS, checked_broadcast, stage, text_of

CHUNK = 1 << 16
#: The four largest primes below 2**31, and a base for each.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
BASES = [911382323, 972663749, 1282917659, 1715172911]
#: Fingerprints of at most so many groups are broadcast (about 40 bytes each); beyond it the join shuffles.
BROADCAST_GROUPS = 200_000

_POWERS = np.ones((CHUNK + 1, 4), np.uint64)
for _i, (_p, _b) in enumerate(zip(PRIMES.tolist(), BASES, strict=True)):
    _x = 1
    for _j in range(1, CHUNK + 1):
        _x = _x * _b % _p
        _POWERS[_j, _i] = _x


def chunk_hash(chunk: np.ndarray) -> tuple[int, ...]:
    """Hashes of up to CHUNK bytes; a product is below 2**40, so the sum fits."""
    n = len(chunk)
    return tuple(((chunk.astype(np.uint64) + np.uint64(1)) @ _POWERS[:n][::-1] % PRIMES).tolist())


def combine(left: tuple[int, tuple[int, ...]], right: tuple[int, tuple[int, ...]]) -> tuple[int, tuple[int, ...]]:
    """(length, hashes) of the concatenation of two pieces; ``right`` is a chunk or any longer piece."""
    n = right[0]
    shift = _POWERS[n].tolist() if n <= CHUNK else [pow(b, n, p) for b, p in zip(BASES, PRIMES.tolist(), strict=True)]
    return left[0] + n, tuple((a * s + b) % p for a, s, b, p in zip(left[1], shift, right[1], PRIMES.tolist(), strict=True))


def fingerprint(data: np.ndarray, size: int = CHUNK) -> tuple[int, tuple[int, ...]]:
    done = (0, (0, 0, 0, 0))
    for a in range(0, len(data), size):
        piece = data[a : a + size]
        done = combine(done, (len(piece), chunk_hash(piece)))
    return done


def _flat(texts: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = utf8(texts)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        part = data[a:b]
        yield part[NOT_BLANK[part]]


def _print_columns(flat: np.ndarray) -> tuple[int, int, int]:
    n, (a, b, c, d) = fingerprint(flat)
    return n, a << 31 | b, c << 31 | d


Print = Callable[[np.ndarray], tuple[int, int, int]]


def _fingerprints(print_of: Print):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = [(*print_of(x), hashlib.sha256(x).hexdigest()) for x in _flat(batch.column("text"))]
            n, f, g, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            keep = [batch.column(k) for k in ("doc_id", "row", "n_points")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "row", "n_points", "n_bytes", "print_a", "print_b", "text_sha256"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows: list[tuple] = []
        size = 0
        keys = list(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True))
        for key, flat in zip(keys, _flat(batch.column("text")), strict=True):
            for no in range(-(-len(flat) // CHUNK)):
                piece = flat[no * CHUNK : (no + 1) * CHUNK].tobytes()
                rows.append((*key, no, piece))
                size += len(piece)
                if size > 4 << 20:
                    yield _chunk_batch(rows)
                    rows, size = [], 0
        yield _chunk_batch(rows)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], [*KEY, "chunk_no", "chunk"])


KEY = ["n_bytes", "print_a", "print_b"]


def collisions(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Keys of the groups of equal fingerprints whose texts aren't all equal, by comparing
    chunks. ``prints``: the staged fingerprints; rows of ``docs`` find theirs by SHA-256."""
    shared = prints.groupBy(*KEY).agg(F.count("*").alias("n_rows")).filter("n_rows > 1").select(*KEY)
    known = stage(prints.join(shared, KEY, "left_semi").select(F.col("text_sha256").alias("_sha"), *KEY).distinct(), "shared")
    known = checked_broadcast(known, BROADCAST_GROUPS)
    texts = docs.select(text_of().alias("text")).withColumn("_sha", F.sha2(F.translate("text", BLANKS, ""), 256))
    chunks = texts.join(known, "_sha").select(*KEY, "text").mapInArrow(_chunks, "n_bytes long, print_a long, print_b long, chunk_no long, chunk binary")
    ends = chunks.groupBy(*KEY, "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return ends.filter("least <> most").select(*KEY).distinct()


def fingerprints(docs: DataFrame, print_of: Print = _print_columns) -> DataFrame:
    """doc_id, row (a number of its own), n_points, the KEY columns and text_sha256 of each row."""
    numbered = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.char_length(text_of()).cast("long").alias("n_points"), text_of().alias("text"))
    return numbered.mapInArrow(_fingerprints(print_of), "doc_id long, row long, n_points long, n_bytes long, print_a long, print_b long, text_sha256 string")


def exact_dedup(docs: DataFrame, print_of: Print = _print_columns) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256,
    n_bytes (normalised), n_points (of the original text).

    Of equal texts the row with the most code points in the original text
    stays, then the one with the smallest doc_id. Needs columns doc_id and text.
    """
    prints = stage(fingerprints(docs, print_of), "prints")
    bad = checked_broadcast(stage(collisions(docs, prints).withColumn("collides", F.lit(True)), "collisions"))
    split = prints.join(bad, KEY, "left").withColumn("split", F.when(F.col("collides"), F.col("text_sha256")).otherwise(""))
    best = F.struct((-F.col("n_points")).alias("less"), "doc_id", "row")
    kept = stage(split.groupBy(*KEY, "split").agg(F.count("*").alias("group_size"), F.min(best).alias("best")), "kept")  # written out, so that a hot text's partition may be split
    out = split.join(kept, [*KEY, "split"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "n_bytes", "n_points")


#: Columns that are added on the way; the names are the package's own.
SHA, POINTS = "_loomery_exact_sha", "_loomery_exact_points"


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    A row is told from others by doc_id, normalised text and code points; only
    if rows repeat in all three are the texts shuffled once more to drop those.
    """
    judged = stage(exact_dedup(docs), "judged")
    same = ["doc_id", "text_sha256", "n_points"]
    kept = judged.filter("kept").select(*same)
    gone = judged.filter("not kept").select(*same).distinct()
    twice = [judged[c].eqNullSafe(F.col(f"_{c}")) for c in same]
    again = judged.filter("not kept").join(kept.toDF(*(f"_{c}" for c in same)), twice, "left_semi")
    marked = docs.withColumns({SHA: F.sha2(F.translate(text_of(), BLANKS, ""), 256), POINTS: F.char_length(text_of()).cast("long")})
    if not again.isEmpty():
        gone = gone.join(kept, [gone[c].eqNullSafe(kept[c]) for c in same], "left_anti")
        marked = marked.dropDuplicates(["doc_id", SHA, POINTS])
    gone = checked_broadcast(stage(gone.toDF("_gone_id", "_gone_sha", "_gone_points"), "dropped"), of=F.lit(120))
    on = marked["doc_id"].eqNullSafe(gone["_gone_id"]) & (marked[SHA] == gone["_gone_sha"]) & (marked[POINTS] == gone["_gone_points"])
    return marked.join(gone, on, "left_anti").select(*(marked[c] for c in docs.columns))
