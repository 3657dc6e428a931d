"""Token-id files in coded, independently reset, checksummed blocks.

Documents are dealt by ranges of doc_id and sorted, so file after file holds
them in ascending order; the number of files follows from the bytes of text.
Rows of one doc_id are told apart by a row number, so they may fill many files. Each task tokenizes its range and writes segments:
whole documents, one after the other, each with a closing id 0, until there
are ids enough for ``LANES`` blocks of ``BLOCK`` ids. Blocks are coded by the
range coder (module range_coder), each from a fresh state and with a CRC-32 of
its ids, so a segment is read without any other, and a damaged block is found.
A file is a Parquet file whose rows are segments; the list of documents and
their lengths stands beside the blocks. Only the texts are shuffled, once.

Defined cases: a null text is empty and has the closing id alone; rows that
repeat a doc_id are written one after the other; a null doc_id comes first; a
document longer than a segment is a segment of its own; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.kernels import text_slices
from loomery.llm.pieces import SLICE_BYTES, encode_texts
from loomery.llm.range_coder import BLOCK, checksum, decode, encode
from loomery.llm.shared import scratch_path, text_of
from loomery.llm.token_counts import TOKENIZER

LANES, END_ID = 2048, 0
#: Bytes of text that a file has at most, about, and that suffice for one while cores are free.
MOST_BYTES, LEAST_BYTES = 256 << 20, 4 << 20
SEGMENT = "part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, checks array<long>, blocks array<binary>"


def _segment(part: int, number: int, doc_ids: list, docs: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(docs)
    blocks = [ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)]
    coded = [c for a in range(0, len(blocks), LANES) for c in encode(blocks[a : a + LANES])]
    values = [part, number, len(ids), doc_ids, list(map(len, docs)), list(map(checksum, blocks)), coded]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in SEGMENT.split(", ")])


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int] = []
        docs: list[np.ndarray] = []
        for batch in text_slices(batches, SLICE_BYTES):
            counts, ids = encode_texts(batch.column("text"), path)
            for i, own in zip(batch.column("doc_id").to_pylist(), np.split(ids.astype(np.uint16), np.cumsum(counts)[:-1]), strict=True):
                docs.append(np.append(own, np.uint16(END_ID)))
                doc_ids.append(i)
                size += len(docs[-1])
                if size >= LANES * BLOCK:
                    yield _segment(part, number, doc_ids, docs)
                    number, size, doc_ids, docs = number + 1, 0, [], []
        if docs:
            yield _segment(part, number, doc_ids, docs)

    return run


def write_token_files(docs: DataFrame, at: str, path: str = TOKENIZER) -> None:
    """Write the ids of ``docs`` (doc_id, text) under ``at``; the tokenizer's ids must be below 65536."""
    texts = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    size = docs.select(F.sum(F.octet_length(text_of()))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-size // MOST_BYTES), min(-(-size // LEAST_BYTES), 3 * cores))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    dealt = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(_encode(path), SEGMENT).write.option("compression", "uncompressed").parquet(at)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            sizes = [min(BLOCK, row["n_ids"] - a) for a in range(0, row["n_ids"], BLOCK)]
            ids = [d for a in range(0, len(sizes), LANES) for d in decode(row["blocks"][a : a + LANES], sizes[a : a + LANES])]
            for no, (block, check) in enumerate(zip(ids, row["checks"], strict=True)):
                if checksum(block) != check:
                    raise ValueError(f"block {no} of segment {row['part']}/{row['segment']} is damaged")
            ids, lengths = np.concatenate(ids), np.array(row["lengths"])
            ends = np.cumsum(lengths)
            crcs = [checksum(ids[b - n : b]) for b, n in zip(ends.tolist(), row["lengths"], strict=True)]
            fixed = [pa.array([row[c]] * len(ends), pa.int32()) for c in ("part", "segment")]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_token_files(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""
    docs = segments.mapInArrow(_decode, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = segments.select("part", "segment", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = sizes.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("segment_start")).join(parts, "part")
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("part_start") + F.col("segment_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digests(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Write the files in the shared folder, read them back, and return each document's digest."""
    spark, at = docs.sparkSession, scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, at, path)
    return read_token_files(spark.read.schema(SEGMENT).parquet(at))
