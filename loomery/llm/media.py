"""Media columns in content-defined chunks.

A text becomes a media payload: its UTF-8 bytes, padded with spaces to a
positive multiple of 192, as samples of an 8-bit mono WAV. A rolling gear hash
over the last 32 bytes cuts the WAV (header and all) where its low bits are zero, so equal
passages give equal chunks wherever they stand. A Spark aggregate over SHA-256
digests finds the chunks that occur more than once; those are stored once in a
chunk table, all others inside their medium's row, and each medium is an
ordered chunk list. Reading back joins the lists with the chunk table on the
digest, verifies every chunk against its digest, and computes everything on the
WAV that was read.

Only digests and repeated chunks are shuffled, and those of equal texts once: a
text is known by a 64-bit key (texts that share one merely share their list of
repeated chunks). A chunk that a third of all media share is one stored row;
the join on its digest is one that Spark splits. Media are hashed a megabyte
at a time.

Defined cases: a null text is the empty one, whose payload is 192 spaces; rows
that repeat a doc_id are media of their own; equal texts give equal values; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.kernels import SLICE, mix, text_slices, utf8
from loomery.llm.shared import checked_broadcast, scratch_path, stage, text_of

UNIT, RATE, HEAD = 192, 8000, 44
LEAST, MOST, MASK = 1024, 16_384, np.uint32((1 << 12) - 1)
WINDOW = 32
_GEAR = (mix(np.arange(5001, 5257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

MEDIA = "doc_id long, media_id long, n_bytes long, digests array<binary>, sizes array<int>, inside array<boolean>, blob binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def gear(data: np.ndarray) -> np.ndarray:
    """sum of gear[data[i - k]] << k over the last 32 bytes, by doubling the window."""
    h = _GEAR[data]
    k = 1
    while k < WINDOW:
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h, k = wider, 2 * k
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks: the first marked place LEAST bytes on, MOST bytes on at the latest."""
    marks = []
    for a in range(0, len(data), SLICE):
        from_ = max(0, a - WINDOW)
        h = gear(data[from_ : a + SLICE])
        marks.append(np.flatnonzero((h & MASK) == 0)[()] + from_)
        marks[-1] = marks[-1][marks[-1] >= a]
    places = np.concatenate(marks) + 1 if marks else np.zeros(0, np.int64)
    ends, start = [], 0
    while start < len(data):
        k = int(np.searchsorted(places, start + LEAST))
        end = min(int(places[k]) if k < len(places) else len(data), start + MOST, len(data))
        ends.append(end)
        start = end
    return ends


def chunks_of(medium: bytes) -> Iterator[tuple[bytes, bytes]]:
    a = 0
    for b in chunk_ends(np.frombuffer(medium, np.uint8)):
        yield hashlib.sha256(medium[a:b]).digest(), medium[a:b]
        a = b


def wav(payload: bytes) -> bytes:
    """An 8-bit mono WAV with the payload as its samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples_of(medium: bytes) -> bytes:
    """The samples of a WAV as ``wav`` makes it."""
    kind, _, form, _, _, code, channels, rate, _, _, bits, _, size = struct.unpack("<4sI4s4sIHHIIHH4sI", medium[:HEAD])
    if (kind, form, code, channels, rate, bits, size) != (b"RIFF", b"WAVE", 1, 1, RATE, 8, len(medium) - HEAD):
        raise ValueError("not an 8-bit mono WAV of that length")
    return medium[HEAD:]


def _media(texts: pa.Array) -> Iterator[tuple[int, bytes]]:
    data, at = utf8(texts)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield b - a, wav(payload_of(data[a:b].tobytes()))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = [[d for d, _ in chunks_of(m)] for _, m in _media(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(rows, pa.list_(pa.binary()))], ["text_key", "digests"])


def _pack_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in text_slices(batches):
        rows: list[tuple] = []
        for i, m, shared, (n, medium) in zip(batch.column("doc_id").to_pylist(), batch.column("media_id").to_pylist(), batch.column("shared").to_pylist(), _media(batch.column("text")), strict=True):
            elsewhere = set(shared or ())
            found = list(chunks_of(medium))
            inside = [d not in elsewhere for d, _ in found]
            blob = press.compress(b"".join(c for (_, c), own in zip(found, inside, strict=True) if own))
            rows.append((i, m, n, [d for d, _ in found], [len(c) for _, c in found], inside, blob))
        yield _media_batch(rows)


def _media_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("media_id", pa.int64()), ("n_bytes", pa.int64()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("inside", pa.list_(pa.bool_())), ("blob", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _shared_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        found: dict[bytes, bytes] = {}
        for shared, (_, medium) in zip(batch.column("shared").to_pylist(), _media(batch.column("text")), strict=True):
            wanted = set(shared)
            found |= {d: c for d, c in chunks_of(medium) if d in wanted}
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], ["digest", "chunk"])


def store_media(docs: DataFrame, media_path: str, chunk_path: str) -> None:
    """Write the media of ``docs`` (doc_id, text) and the table of repeated chunks."""
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    index = texts.select("text_key", "text").mapInArrow(_index, "text_key long, digests array<binary>")
    index = stage(index.groupBy("text_key").agg(F.count("*").alias("media"), F.first("digests").alias("digests")), "digests")
    held = index.select("text_key", "media", F.explode("digests").alias("digest"))
    repeated = stage(held.groupBy("digest").agg(F.sum("media").alias("n")).filter("n > 1").select("digest"), "repeated")  # written out, so that a hot chunk's partition may be split
    by_text = held.join(repeated, "digest").groupBy(F.col("text_key").alias("_holder")).agg(F.collect_set("digest").alias("shared"))
    sharers = checked_broadcast(stage(by_text, "sharers"), of=F.size("shared") * 48 + 32)
    on = texts["text_key"] == F.col("_holder")
    numbered = texts.join(sharers, on, "left").select("doc_id", F.monotonically_increasing_id().alias("media_id"), "shared", "text")
    numbered.mapInArrow(_pack_media, MEDIA).write.option("compression", "uncompressed").parquet(media_path)
    bytes_of = texts.join(sharers, on).select("shared", "text").mapInArrow(_shared_chunks, "digest binary, chunk binary")
    bytes_of.groupBy("digest").agg(F.min("chunk").alias("chunk")).write.option("compression", "zstd").parquet(chunk_path)


def feature_of(samples: np.ndarray) -> str:
    """Exact integer sums over the samples: mean, mean square and sign changes about the middle value."""
    total = square = turns = 0
    for a in range(0, len(samples), SLICE):
        x = samples[a : a + SLICE + 1].astype(np.int64) - 128
        own = x[:SLICE]
        total, square = total + int(own.sum()), square + int((own * own).sum())
        turns += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    n = len(samples)
    return f"mean={total / n:.6f};power={square / n:.6f};turns={turns / n:.6f}"


def rebuild(row: dict, unpack: zstandard.ZstdDecompressor) -> bytes:
    """The bytes of a stored medium, every chunk verified against its digest."""
    own, elsewhere = memoryview(unpack.decompress(row["blob"])), {x["digest"]: x["chunk"] for x in row["found"] or ()}
    parts, at = [], 0
    for digest, size, inside in zip(row["digests"], row["sizes"], row["inside"], strict=True):
        part = own[at : at + size] if inside else elsewhere[digest]
        at += size * inside
        if hashlib.sha256(part).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} of medium {row['media_id']} is damaged")
        parts.append(part)
    return b"".join(parts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            medium = rebuild(row, unpack)
            payload = samples_of(medium)
            rows.append((row["doc_id"], row["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(medium), hashlib.sha256(medium).hexdigest(), feature_of(np.frombuffer(payload, np.uint8))))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in FEATURES.split(", ")])


def read_media(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """Features of every stored medium, from the bytes that its chunk list leads to."""
    whole = F.forall("inside", lambda x: x)
    refs = media.filter(~whole).select("media_id", F.explode(F.arrays_zip("digests", "inside")).alias("c")).filter("not c.inside").select("media_id", F.col("c.digests").alias("digest")).distinct()
    found = refs.join(chunks, "digest").groupBy(F.col("media_id").alias("_medium")).agg(F.collect_list(F.struct("digest", "chunk")).alias("found"))
    columns = [c.split()[0] for c in MEDIA.split(", ")]
    apart = media.filter(~whole).join(found, F.col("media_id") == F.col("_medium"), "left").select(*columns, "found")
    own = media.filter(whole).withColumn("found", F.lit(None).cast("array<struct<digest:binary,chunk:binary>>")).select(*columns, "found")
    return own.unionByName(apart).mapInArrow(_read, FEATURES)


def media_features(docs: DataFrame) -> DataFrame:
    """Store the media of ``docs`` in the shared folder, read them back, and return their features."""
    spark = docs.sparkSession
    media_path, chunk_path = scratch_path(spark, "media"), scratch_path(spark, "chunks")
    store_media(docs, media_path, chunk_path)
    return read_media(spark.read.schema(MEDIA).parquet(media_path), spark.read.schema("digest binary, chunk binary").parquet(chunk_path))
