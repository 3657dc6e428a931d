"""Packing into optimal length buckets.

A length is the number of token ids of the whole text (``token_counts``).
One aggregate gives the global histogram of lengths over all documents, a cell
for each length that occurs. Dynamic programming over its cells picks the
bucket boundaries with the least padding (every document of a bucket is padded
to the bucket's longest), and inside each bucket batches of at most ``budget``
padded tokens are formed.

The boundaries are optimal for every corpus: each length has its own cell.
Lengths that differ sum to at most all tokens T, so there are at most sqrt(2 T)
cells (9 million for 40 trillion tokens, at some 300 bytes of the driver
each); they alone reach the
driver. For one more bucket the best choice up to each cell is the lowest of
lines in the cell's length, kept as a lower envelope, so the programme takes
buckets x cells steps.
A bucket may hold a third of all rows: its documents are dealt by hash into
shards of about ``SHARD`` and numbered inside a shard, so no task sees a whole
bucket; a shard's last batch may be short.

Defined cases: a null text has length 0; documents of length 0 pack like any
(padded length 1 at least, so a batch holds ``budget`` of them at most); one
longer than the budget is a batch of its own; repeated rows pack as rows of
their own; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.kernels import text_slices
from loomery.llm.pieces import SLICE_BYTES, encode_texts
from loomery.llm.shared import stage, text_of
from loomery.llm.token_counts import TOKENIZER

BUCKETS, BUDGET = 16, 65_536
SHARD = 50_000


def best_buckets(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """Indices of the cells that end a bucket, and the padding in all.

    Lengths ascend. best[j], the least padding of the first j cells, is over i
    the least of was[i] + size[j-1] * (n[j] - n[i]) - (t[j] - t[i]), with running
    counts n and lengths t: for each i a line in size[j-1] with slope -n[i].
    """
    m = len(lengths)
    if not m:
        return [], 0
    size = [max(x, 1) for x in lengths]
    n, t = [0, *accumulate(counts)], [0, *accumulate(c * x for c, x in zip(counts, lengths, strict=True))]
    best: list[int | None] = [0] + [None] * m
    back = []
    for _ in range(min(buckets, m)):
        now, at = best.copy(), array("i", [-1]) * (m + 1)
        lines: list[tuple[int, int, int]] = []  # (slope, height, i), slopes falling
        low = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                line = (-n[j - 1], best[j - 1] + t[j - 1], j - 1)
                while len(lines) - low > 1 and _hidden(lines[-2], lines[-1], line):
                    lines.pop()
                lines.append(line)
            x = size[j - 1]
            while len(lines) - low > 1 and lines[low + 1][0] * x + lines[low + 1][1] < lines[low][0] * x + lines[low][1]:
                low += 1
            cost = lines[low][0] * x + lines[low][1] + x * n[j] - t[j]
            if now[j] is None or cost < now[j]:
                now[j], at[j] = cost, lines[low][2]
        back.append(at)
        best = now
    ends, j = [], m
    for at in reversed(back):
        if at[j] >= 0:
            ends.append(j - 1)
            j = at[j]
        if not j:
            break
    return ends[::-1], best[m]


def _hidden(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, SLICE_BYTES):
            counts, _ = encode_texts(batch.column("text"), path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(counts)], ["doc_id", "row", "n_tokens"])

    return run


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, shard, batch, batch_size of each row of ``docs`` (doc_id, text).

    A batch is (bucket, shard, batch); its padded size, batch_size *
    bucket_length, is at most ``budget`` unless it is one document.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    sized = stage(texts.mapInArrow(_lengths(path), "doc_id long, row long, n_tokens long"), "lengths")
    cells = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    lengths, counts = (cells.column(k).to_pylist() for k in ("n_tokens", "n"))
    ends, _ = best_buckets(lengths, counts, buckets)
    return batches(sized, [(lengths[e], sum(counts[b : e + 1])) for b, e in zip([0, *(x + 1 for x in ends)], ends, strict=False)], budget)


def batches(sized: DataFrame, bounds: list[tuple[int, int]], budget: int) -> DataFrame:
    """Batches of (doc_id, row, n_tokens) rows for buckets given as (longest, rows), ascending."""
    bucket, length, shards = F.lit(0), F.lit(1), F.lit(1)
    for k, (longest, rows) in reversed(list(enumerate(bounds))):
        here = F.col("n_tokens") <= longest
        bucket, length, shards = F.when(here, k).otherwise(bucket), F.when(here, max(longest, 1)).otherwise(length), F.when(here, -(-rows // SHARD)).otherwise(shards)
    dealt = sized.select("*", bucket.cast("int").alias("bucket"), length.cast("long").alias("bucket_length"), F.xxhash64("doc_id", "row").alias("_at"), shards.alias("_shards"))
    dealt = dealt.withColumn("shard", F.pmod(F.shiftrightunsigned("_at", 8), F.greatest("_shards", F.lit(1))).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("_at", "row")) - 1
    room = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1))
    held = dealt.withColumn("batch", F.floor(place / room).cast("long"))
    size = F.count("*").over(Window.partitionBy("bucket", "shard", "batch"))
    return held.select("doc_id", "n_tokens", "bucket", "bucket_length", "shard", "batch", size.alias("batch_size"))
