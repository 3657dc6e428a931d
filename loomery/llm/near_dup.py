"""N-gram Jaccard join by MinHash banding.

Words are runs of ASCII letters, digits and non-ASCII characters of the
lower-cased text; a document's n-gram set holds 64-bit hashes of five words in
a row (of all its words, if it has one to four). 24 bands of 5 MinHash rows
find a pair of similarity 0.8 with probability 1 - (1 - 0.8**5)**24 > 0.9999.
Rows are shuffled on band hashes, and every pair that shares one is verified
on the full n-gram sets.

Documents with equal n-gram sets are one representative with a size, so copies
are never expanded. A bucket (band, hash) of m representatives is dealt into
blocks of about ``BLOCK`` by hash, and each pair of blocks is a cell, a task's
unit of work: no cell holds more than two blocks, whatever a bucket's size. In
a cell all pairs are verified by one sparse-to-dense product. What leaves a
cell is one row per representative that has a link (its number of links and
the least representative it is connected with there), never pairs. A pair is
counted in the first band that both share, so no pair is counted twice; a
bucket with the same members as one of an earlier band is left out for that
reason before anything is shipped.

Defined cases: a text without words is in no class but its own, like a null
text; rows that repeat a doc_id count as that many documents, also with
different texts; rows with a null doc_id take part like any others, and only
a class that has no other id has a null one; an empty table gives no rows.
Rows are known by a number that is written out with them first, never by
their doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.kernels import ALNUM, give_back, mix, text_slices, utf8, words
from loomery.llm.shared import checked_broadcast, stage, text_of, without

GRAM, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
BLOCK = 256
#: Column of the row numbers.
ROW = "_loomery_near_row"

_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_PLACE = mix(np.arange(1001, 1001 + GRAM, dtype=np.uint64)) | np.uint64(1)


def gram_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all rows, one row after the other, and their offsets."""
    data, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    found = list(words(data, offsets, ALNUM))
    rows = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
    hashes = np.concatenate([h for _, h in found]) if found else np.zeros(0, np.uint64)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    end = np.cumsum(n)
    whole = len(hashes) - GRAM + 1
    grams = np.zeros(max(whole, 0), np.uint64)
    for k in range(GRAM if whole > 0 else 0):
        grams += hashes[k : k + whole] * _PLACE[k]
    grams = mix(grams)
    sets = []
    for a, b in zip((end - n).tolist(), end.tolist(), strict=True):
        if b - a >= GRAM:
            sets.append(np.unique(grams[a : b - GRAM + 1]))
        elif b > a:
            sets.append(mix((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(grams[:0])
    return np.concatenate([*sets, grams[:0]]), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def band_hashes(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BANDS hashes of each row that has an n-gram, as (rows, BANDS)."""
    starts = offsets[:-1]
    least = np.empty((BANDS * ROWS, len(starts)), np.uint64)
    for k, odd in enumerate(_ODD):
        least[k] = np.minimum.reduceat(grams * odd, starts)
    banded = np.zeros((BANDS, len(starts)), np.uint64)
    for k in range(BANDS * ROWS):
        banded[k // ROWS] = mix(banded[k // ROWS] + least[k])
    return banded.T


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        grams, offsets = gram_sets(batch.column("text"))
        n = np.diff(offsets)
        some = np.flatnonzero(n)
        bands = np.zeros((batch.num_rows, BANDS), np.uint64)
        keys = np.zeros((batch.num_rows, 2), np.uint64)
        if len(some):
            used = np.concatenate((offsets[some], offsets[-1:]))
            bands[some] = band_hashes(grams, used)
            keys[some, 0] = np.add.reduceat(mix(grams), used[:-1])
            keys[some, 1] = np.add.reduceat(mix(grams ^ _PLACE[0]), used[:-1])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
        keys = keys.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(ROW), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], ["doc_id", ROW, "n_grams", "set_a", "set_b", "bands"])


def _ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cells, rep, size, bands, text) to (cells, rep, size, bands, n-gram set as bytes)."""
    for batch in text_slices(batches):
        grams, offsets = gram_sets(batch.column("text"))
        sets = [grams[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("cells", "rep", "size", "bands")), pa.array(sets, pa.binary())], ["cells", "rep", "size", "bands", "grams"])


def cell_links(band: int, same: bool, block: np.ndarray, rep: np.ndarray, size: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, root, links) of a cell's members that have a link in it."""
    n = len(sets)
    total = np.array([len(s) for s in sets])
    shared = np.zeros((n, n), np.float32)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), total)
    rank = np.cumsum(times > 1) - 1
    useful = times[column] > 1
    owner, column = owner[useful], rank[column[useful]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(rank[-1]) + 1 if len(rank) else 0, 4096):  # a strip of the columns at a time
        lo, hi = np.searchsorted(column, (a, a + 4096))
        strip = np.zeros((n, 4096), np.float32)
        strip[owner[lo:hi], column[lo:hi] - a] = 1
        shared += strip @ strip.T
    linked = shared * (1 + threshold) >= threshold * (total[:, None] + total[None, :]) - 1e-3
    np.fill_diagonal(linked, False)
    if not same:
        linked &= block[:, None] != block[None, :]
    for k in range(band):
        linked &= bands[:, k][:, None] != bands[:, k][None, :]
    links = linked @ size
    root = np.arange(n)
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == root).all():
            break
        root = least
    has = np.flatnonzero(links)
    return rep[has], rep[root[has]], links[has]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell; a cell may go on in the next batch."""
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            order = np.argsort(t.column("rep").to_numpy(), kind="stable")
            col = lambda k: t.column(k).to_numpy()[order]
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("grams").take(pa.array(order))]
            bands = np.array(t.column("bands").to_pylist(), np.int64).reshape(len(sets), BANDS)[order]
            i, j = t.column("low")[0].as_py(), t.column("high")[0].as_py()
            out = cell_links(t.column("band")[0].as_py(), i == j, col("block"), col("rep"), col("size"), bands, sets, threshold)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["rep", "root", "links"])

        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(k).to_numpy() for k in ("band", "hash", "low", "high")])
            starts = np.concatenate(([0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, [batch.num_rows]))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                now = tuple(ids[:, a].tolist())
                if held and now != key:
                    yield done(held)
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield done(held)
        give_back()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the (a, b) edges, root the least node it is connected with.

    Each round takes the least label among neighbours (partial aggregation
    keeps hubs cheap), then jumps from label to label's label; tables between
    rounds are written in the shared folder.
    """
    both = stage(edges.select(F.col("a"), F.col("b")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("least"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = stage(least.join(jump, F.col("least") == F.col("_n"), "left").select("node", F.least("least", "_r").alias("root"), "was"), "labels")
        labels = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            return labels


def _numbered(docs: DataFrame) -> DataFrame:
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, rep_id, class_id, n_links, n_grams.

    rep_id: least doc_id with the same n-gram set; class_id: least doc_id that
    links of similarity ``threshold`` or more lead to; n_links: documents this
    one is linked with, those of its own set included.
    """
    numbered = _numbered(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")))
    return row_classes(numbered, threshold).select("doc_id", "rep_id", "class_id", "n_links", "n_grams")


def row_classes(numbered: DataFrame, threshold: float) -> DataFrame:
    """``near_classes`` of a staged table with row numbers, with the row's number
    and that of the one row of its class that stays (the least doc_id's)."""
    texts = numbered.select(F.col("doc_id").cast("long"), ROW, text_of().alias("text"))
    signed = stage(texts.mapInArrow(_signatures, f"doc_id long, {ROW} long, n_grams long, set_a long, set_b long, bands array<long>"), "signatures")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(ROW).alias("rep"), "bands"))
    by_set = signed.filter("n_grams > 0").groupBy("set_a", "set_b").agg(F.count("*").alias("size"), first_row.alias("least"))
    reps = stage(by_set.select("set_a", "set_b", "size", "least.rep", "least.bands", F.struct("least.no_id", "least.doc_id", "least.rep").alias("least")), "reps")

    banded = reps.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.count("*").alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members")).filter("m > 1")
    first = buckets.groupBy("m", "members").agg(F.min(F.struct("band", "hash")).alias("b")).select("b.band", "b.hash", "m")
    cells = banded.join(first, ["band", "hash"]).groupBy("rep").agg(F.collect_list(F.struct("band", "hash", "m")).alias("cells"))
    wanted = stage(cells.join(reps.select("rep", "size", "bands"), "rep"), "wanted")

    shipped = texts.join(checked_broadcast(wanted, of=F.size("cells") * 48 + F.size("bands") * 8 + 64), texts[ROW] == wanted["rep"]).select("cells", "rep", "size", "bands", "text")
    shipped = shipped.mapInArrow(_ship, "cells array<struct<band:int,hash:long,m:long>>, rep long, size long, bands array<long>, grams binary")
    blocks = F.ceil(F.col("c.m") / BLOCK).cast("int")
    spread = shipped.select(F.explode("cells").alias("c"), "rep", "size", "bands", "grams").withColumn("block", F.pmod(F.xxhash64("rep", "c.band"), blocks).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select(F.col("c.band").alias("band"), F.col("c.hash").alias("hash"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "size", "bands", "grams")
    parts = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stage(spread.repartition(parts, "band", "hash", "low", "high").sortWithinPartitions("band", "hash", "low", "high").mapInArrow(_verify(threshold), "rep long, root long, links long"), "links")

    roots = components(found.filter("rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    firsts = stage(roots.join(reps.select("rep", "least"), F.col("node") == F.col("rep")).groupBy("root").agg(F.min("least").alias("first")), "firsts")
    members = roots.join(checked_broadcast(firsts, of=F.lit(64)), "root").select("node", "first")
    known = reps.join(links, "rep", "left").join(members, F.col("rep") == F.col("node"), "left").withColumn("first", F.coalesce("first", "least"))
    known = known.select("set_a", "set_b", F.col("least.doc_id").alias("rep_id"), F.col("first.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("first.rep").alias("stays"))
    out = signed.filter("n_grams > 0").join(known, ["set_a", "set_b"]).select("doc_id", "rep_id", "class_id", "n_links", "n_grams", ROW, "stays")
    alone = signed.filter("n_grams = 0").select("doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_grams", ROW, F.col(ROW).alias("stays"))
    return out.unionByName(alone)


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of ``docs``, that of its least doc_id, with its columns."""
    numbered = _numbered(docs)
    return without(numbered, row_classes(numbered, threshold).filter(f"{ROW} <> stays"), ROW).drop(ROW)
