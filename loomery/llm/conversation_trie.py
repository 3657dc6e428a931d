"""Prefix trie of conversations, by chained digests.

A turn's digest is SHA-256 over its role and text, a prefix's digest SHA-256
over the digest of the prefix before it and its last turn's digest, so equal
digests mean equal turn sequences. Every conversation is walked once, in order,
as a stream of (position, digest) rows; texts are never shuffled. Each step
gives a prefix row; prefix rows grouped by (depth, digest) are the trie's nodes.

Subtree sums: a node's values are exploded to its ancestors and summed there,
partial sums first. Ancestors are taken within bands of ``BAND`` depths, so a
conversation of a million turns doesn't make the square of that: the tops of
the bands make a trie of their own, ``BAND`` times shallower, which is summed
the same way and handed down once to the band above it. Without a conversation
longer than a band this is the plain explosion to all ancestors.

What may be hot: a node that a third of all conversations share is aggregated
map-side; the row of a parent of ``HOT`` children or more is broadcast (there
are nodes / HOT of those at most), the others meet their children in a shuffle;
the ids that end at one node are ordered and joined in slices of a range
partitioning, and only those slices go through the one hash that the result
asks for, as a stream.

Defined cases: null turns come first, a null role or text is empty; turns with
one number are ordered by their digest, repeated rows stay turns of their own;
rows without a conv_id belong to no conversation; a conversation whose first
turns are missing may be turnless, then it is a member of the root and ends
there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.shared import checked_broadcast, stage, text_of, word_count

#: Depths whose ancestors are exploded at once; children from which a parent's row is broadcast; bytes of ids joined before they are hashed.
BAND, HOT, SLICE_BYTES = 32, 10_000, 1 << 20
ROOT = hashlib.sha256(b"").digest()
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest() -> Column:
    """Digest of role and text; the role's length keeps the two apart."""
    role = text_of("role")
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text_of("text")), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, words of all turns."""
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest().alias("digest"), word_count().alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", place.alias("pos"), "digest", "words")


def root_marks(turns: DataFrame) -> DataFrame:
    """A row with pos 0 for each conversation, which stands for the root."""
    return turns.filter("pos = 1").select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))


def rebuilt_turns(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % family;
    h is the unsigned crc32 of c's decimal form, modulo ``most``."""
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string")), F.lit(most))
    own = turns.filter((c % family == 0) | (F.col("pos") > h))
    heads = turns.filter((c % family == 0) & (F.col("pos") < most)).select(c.alias("_base"), "pos", "digest", "words")
    followers = turns.filter("pos = 1").filter(c % family != 0).select("conv_id", (c - c % family).alias("_of"), h.alias("_h"))
    taken = followers.join(heads, (F.col("_of") == F.col("_base")) & (F.col("pos") <= F.col("_h"))).select("conv_id", "pos", "digest", "words")
    return own.unionByName(taken).unionByName(root_marks(turns))


PREFIX = "conv_id long, depth int, digest binary, parent binary, words long, ended boolean, paths array<array<binary>>, ups array<array<binary>>"
_PREFIX_ARROW = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("digest", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("ended", pa.bool_()), ("paths", pa.list_(pa.list_(pa.binary()))), ("ups", pa.list_(pa.list_(pa.binary())))])


def _walk(band: int):
    """Prefix rows of streams ordered by (conv_id, pos). ``paths[l]`` has the prefixes
    above and at this one whose depths are multiples of band^l, back to the last multiple
    of band^(l+1); ``ups[l]`` those of the band before, where this one begins a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        conv = last = None
        depth, history = 0, []

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= least and out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _PREFIX_ARROW.types)], schema=_PREFIX_ARROW)
                out.clear()

        for batch in batches:
            for c, pos, digest, words in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "pos", "digest", "words"))):
                if c != conv:
                    if last is not None:
                        last[5] = True
                        out.append(last)
                    conv, depth, history, last = c, 0, [[ROOT]], [c, 0, ROOT, None, 0, False, [[ROOT]], [[]]]
                    if pos == 0:
                        continue
                out.append(last)
                depth += 1
                now = hashlib.sha256(last[2] + digest).digest()
                paths, ups, level, step = [], [], 0, 1
                while depth % step == 0:
                    if level == len(history):
                        history.append([ROOT])
                    begins = depth // step % band == 0
                    ups.append(history[level] if begins else [])
                    history[level] = [now] if begins else [*history[level], now]
                    paths.append(history[level])
                    level, step = level + 1, step * band
                last = [c, depth, now, last[2], words, False, paths, ups]
                yield from flushed(2048)
        if last is not None:
            last[5] = True
            out.append(last)
        yield from flushed(1)

    return run


def prefixes(sequences: DataFrame, band: int = BAND) -> DataFrame:
    """A row for each prefix of each conversation in ``sequences`` (conv_id, pos, digest, words)."""
    return sequences.select("conv_id", "pos", "digest", "words").repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_walk(band), PREFIX)


def subtree_sums(rows: DataFrame, values: list[str], deepest: int, band: int = BAND, level: int = 0) -> DataFrame:
    """digest, and the sums of ``values`` over its subtree, of ``rows`` (digest, depth, paths, ups, values)."""
    total = [F.sum(v).alias(v) for v in values]
    path = F.coalesce(F.get("paths", F.lit(level)), F.array("digest"))  # only the root has no path above its first level
    here = stage(rows.select(F.explode(path).alias("digest"), *values).groupBy("digest").agg(*total), "sums")
    if deepest // band**level < band:
        return here
    tops = stage(rows.filter(F.col("depth") % band ** (level + 1) == 0).drop(*values).join(here, "digest"), "tops")
    whole = subtree_sums(tops, values, deepest, band, level + 1)
    below = tops.filter("depth > 0").drop(*values).join(whole, "digest").select(F.explode(F.get("ups", F.lit(level))).alias("digest"), *values)
    return stage(here.unionByName(below).groupBy("digest").agg(*total), "sums")


def _slices(size: int):
    """Ids of streams ordered by (digest, conv_id), comma-joined in slices of about ``size`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, ids, width = None, None, [], 0
        made: list[tuple] = []
        for batch in batches:
            for digest, c in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
                if digest != at or width >= size:
                    if ids:
                        made.append((at, first, ",".join(ids)))
                    at, first, ids, width = digest, c, [], 0
                ids.append(str(c))
                width += len(ids[-1]) + 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["digest", "first", "ids"])
                made = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip((at, first, ",".join(ids)))], ["digest", "first", "ids"])

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 over the slices of each digest, in order."""
    at, state, made = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
            if digest == at:
                state.update(b"," + ids.encode())
            else:
                if at is not None:
                    made.append((at, state.hexdigest()))
                at, state = digest, hashlib.sha256(ids.encode())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], ["digest", "ends_sha256"])
            made = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])


def end_hashes(ends: DataFrame, size: int = SLICE_BYTES) -> DataFrame:
    """digest, ends_sha256 of ``ends`` (digest, conv_id): the ids in ascending order, comma-joined and hashed."""
    pieces = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_slices(size), "digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashes, "digest binary, ends_sha256 string")


def trie(sequences: DataFrame, band: int = BAND, hot: int = HOT) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, pos, digest, words; pos 0 marks a conversation):
    digest, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    steps = stage(prefixes(sequences, band), "prefixes")
    nodes = stage(steps.groupBy("depth", "digest", "parent", "words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    children = stage(nodes.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children")), "children")
    nodes = stage(nodes.join(children, "digest", "left").fillna(0, ["n_children"]), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    worth = nodes.select("digest", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    rows = worth.join(steps.select("conv_id", "depth", "paths", "ups"), ["conv_id", "depth"])
    if deepest >= band:
        rows = stage(rows, "rows")
    sums = subtree_sums(rows, ["n_leaves", "saved_tokens"], deepest, band)
    parents = nodes.filter("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") >= hot).alias("_hot"))
    known = checked_broadcast(stage(parents.filter("_hot").drop("_hot"), "parents"))
    with_hot = nodes.join(known, "parent", "left")
    others = parents.filter("not _hot").select("parent", F.col("parent_conv_id").alias("_other"))
    lone = with_hot.filter("parent is null or parent_conv_id is not null")
    rest = with_hot.filter("parent is not null and parent_conv_id is null").drop("parent_conv_id").join(others, "parent").withColumnRenamed("_other", "parent_conv_id")
    ends = end_hashes(steps.filter("ended").select("digest", "conv_id"))
    out = lone.unionByName(rest).join(sums, "digest").join(ends, "digest", "left")
    return out.select("digest", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are."""
    turns = stage(ordered_turns(conversations), "turns")
    return trie(turns.unionByName(root_marks(turns)))


def rebuilt_trie(conversations: DataFrame, band: int = BAND, hot: int = HOT) -> DataFrame:
    """The trie of the conversations that ``rebuilt_turns`` makes of ``conversations``."""
    return trie(rebuilt_turns(stage(ordered_turns(conversations), "turns")), band, hot)
