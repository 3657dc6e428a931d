"""Blocked duplicate clustering of records.

Rows are put in address blocks, rows of equal names in a block are one
signature, verdicts (an evidence table) group signatures into entities, pairs
of entities that no verdict has compared are nominated, their verdicts join
them by connected components, and guards split what must not be together.
Signatures collapse copies before any pair is formed; pairs are formed inside
blocks only. Pairs of a block grow with the square of its *entities*, which the
reference semantics ask for; ``cap`` marks blocks with too many for review.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.functions.similarity import fold_accents, jaro_winkler_of
from loomery.operators.graph import components
from loomery.sources.scratch import staged

NAME_THRESHOLD, TOKEN_THRESHOLD, CAP = 0.85, 0.6, 50
BLOCK = 512
DEPARTMENTS = ["name2", "name3", "name4", "name5"]


def normalize_key(c: Column) -> Column:
    """Folded, lower-cased words; accents go through an Arrow UDF only where a value isn't ASCII."""
    return tx.fold_key(F.when(c.rlike(r"[^\x00-\x7F]"), fold_accents(c)).otherwise(c))


def block_id(country: Column, postal_code: Column, street: Column, house_no: Column, given: Column | None = None, key=normalize_key) -> Column:
    """The given block, else a hash of the folded address."""
    joined = F.concat_ws("|", *(F.coalesce(key(c), F.lit("")) for c in (country, postal_code, street, house_no)))
    derived = F.concat(F.lit("blk-"), F.substring(F.sha1(joined), 1, 12))
    return derived if given is None else F.coalesce(tx.nullify(given), derived)


def cluster_hash(row_ids: Column) -> Column:
    """Content hash of an array of row ids."""
    return F.concat(F.lit("c_"), F.substring(F.sha2(F.array_join(F.array_sort(row_ids), ";"), 256), 1, 12))


def with_keys(rows: DataFrame, key=normalize_key) -> DataFrame:
    """Rows with norm_name1, norm_name2 (folded) and the departments in ``_dept``."""
    departments = tx.department_text([F.col(c) for c in DEPARTMENTS if c in rows.columns])
    return rows.withColumns({"norm_name1": key(F.col("name1")), "_dept": departments}).withColumn("norm_name2", key(F.col("_dept")))


def signatures(rows: DataFrame, key=normalize_key, ids: bool = True) -> DataFrame:
    """One row per (block_id, folded name 1, folded departments): signature_id (s1, s2, ... in order of first rows),
    names of its first row, first non-blank ror_id and lei_id, n_rows, and (``ids``) row_ids, an array
    that grows with the group. Needs ``_seq``."""
    keyed = with_keys(rows, key)
    first = lambda c: F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("_seq", c)))[c]
    listed = [F.transform(F.array_sort(F.collect_list(F.struct("_seq", "row_id"))), lambda x: x["row_id"]).alias("row_ids")] if ids else []
    s = keyed.groupBy("block_id", "norm_name1", "norm_name2").agg(
        F.min("_seq").alias("_first"), F.min(F.struct("_seq", F.trim(F.coalesce("name1", F.lit(""))).alias("v")))["v"].alias("name1"), F.min(F.struct("_seq", "_dept"))["_dept"].alias("name2"),
        first("ror_id").alias("ror_id"), first("lei_id").alias("lei_id"), *listed, F.count("*").alias("n_rows"),
    )
    place = F.row_number().over(Window.partitionBy("block_id").orderBy("_first"))
    return s.withColumn("signature_id", F.concat(F.lit("s"), place.cast("string"))).withColumn("has_name2", F.col("norm_name2") != "")


def split_mixed_departments(members: DataFrame) -> DataFrame:
    """Entities with and without a department fall apart: entity_id gets a suffix for the latter."""
    w = Window.partitionBy("block_id", "entity_id")
    mixed = (F.max(F.col("has_name2").cast("int")).over(w) == 1) & (F.min(F.col("has_name2").cast("int")).over(w) == 0)
    return members.withColumn("_mixed", mixed).withColumn("entity_id", F.when(F.col("_mixed") & ~F.col("has_name2"), F.concat("entity_id", F.lit("/x"))).otherwise(F.col("entity_id"))).drop("_mixed")


def split_conflicting_ids(members: DataFrame) -> DataFrame:
    """Entities with two ROR or two LEI ids fall into single signatures, all uncertain."""
    w = Window.partitionBy("block_id", "entity_id")
    several = lambda c: F.coalesce(F.min(F.nullif(F.col(c), F.lit(""))).over(w) != F.max(F.nullif(F.col(c), F.lit(""))).over(w), F.lit(False))
    out = members.withColumn("_conflict", several("ror_id") | several("lei_id"))
    return out.withColumns({"entity_id": F.when(F.col("_conflict"), F.concat_ws("/", "entity_id", "signature_id")).otherwise(F.col("entity_id")), "uncertain": F.col("uncertain") | F.col("_conflict"), "reasoning": F.when(F.col("_conflict"), "Split: different registry ids indicate different entities").otherwise(F.col("reasoning"))}).drop("_conflict")


def _codes(values: list) -> np.ndarray:
    """Equal values as equal numbers; -1 for what is empty."""
    at: dict = {}
    return np.array([at.setdefault(v, len(at)) if v else -1 for v in values])


def _cell_pairs(rows: list[tuple], name_threshold: float, token_threshold: float) -> Iterator[tuple]:
    """(block_id, a, b, rank, score) of the pairs of one cell that some rule nominates.

    What Jaro-Winkler is at most follows from the letters that two names have in common (no
    more matches than those, none out of place) and their first four; only pairs that may
    reach the threshold go through the kernel.
    """
    rows.sort(key=lambda r: r[1])
    block, idx, cores, has_name2, adjudicated, shard = ([r[k] for r in rows] for k in (0, 1, 2, 5, 6, 7))
    ids = [_codes([r[k] for r in rows]) for k in (3, 4)]
    words, n = [set(c.split()) for c in cores], len(rows)
    letter = {x: k for k, x in enumerate(sorted(set("".join(cores))))}
    counts, first, having = np.zeros((n, max(1, len(letter))), np.int32), np.full((n, 4), -1), {}
    for k, core in enumerate(cores):
        for ch in core:
            counts[k, letter[ch]] += 1
        first[k, : len(core[:4])] = [letter[ch] for ch in core[:4]]
        for w in words[k]:
            having.setdefault(w, []).append(k)
    length, n_words = np.maximum(counts.sum(1), 1), np.array([len(w) for w in words])
    kind, done, shard, one = np.array(has_name2), np.array(adjudicated), np.array(shard), rows[0][8] == rows[0][9]
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[~((kind[j] == kind[i]) & done[j] & done[i]) & (one | (shard[j] != shard[i]))]
        if not len(j):
            continue
        common = np.minimum(counts[i], counts[j]).sum(1)
        jaro = np.where(common > 0, (common / length[i] + common / length[j] + 1) / 3, 0.0)
        prefix = np.cumprod((first[j] == first[i]) & (first[j] >= 0), axis=1).sum(1)
        may = (jaro + 0.1 * prefix * (1 - jaro) + 1e-9 >= name_threshold) & (common > 0)
        shared = np.zeros(n)
        for w in words[i]:
            shared[having[w]] += 1
        both = n_words[i] + n_words[j] - shared[j]
        jaccard = np.where(both > 0, shared[j] / np.maximum(both, 1), 0.0)
        same = np.logical_or(*((x[j] == x[i]) & (x[i] >= 0) for x in ids))
        for k in np.flatnonzero(same | may | (jaccard >= token_threshold)):
            jw = jaro_winkler_of(cores[i], cores[j[k]]) if may[k] and not same[k] else 0.0
            if same[k]:
                yield block[i], idx[i], idx[j[k]], 0, 1.0
            elif jw >= name_threshold:
                yield block[i], idx[i], idx[j[k]], 1, jw
            elif jaccard[k] >= token_threshold:
                yield block[i], idx[i], idx[j[k]], 2, float(jaccard[k])


CELL = ("block_id", "idx", "core", "ror_id", "lei_id", "has_name2", "adjudicated", "_shard", "_low", "_high")


def _all_cells(name_threshold: float, token_threshold: float):
    """Pairs of a stream of units that is ordered by cell; a cell has ``2 * BLOCK`` units or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, out = None, [], []

        def made() -> pa.RecordBatch:
            types = (None, pa.int32(), pa.int32(), pa.int32(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t or pa.string()) for k, t in enumerate(types)], ["block_id", "a", "b", "_rank", "score"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in CELL)):
                if (row[0], row[8], row[9]) != cell:
                    if len(rows) > 1:
                        out += _cell_pairs(rows, name_threshold, token_threshold)
                    cell, rows = (row[0], row[8], row[9]), []
                rows.append(row)
            yield made()
            out.clear()
        if len(rows) > 1:
            out += _cell_pairs(rows, name_threshold, token_threshold)
        yield made()

    return run


def candidate_pairs(units: DataFrame, name_threshold: float = NAME_THRESHOLD, token_threshold: float = TOKEN_THRESHOLD) -> DataFrame:
    """(block_id, a, b, rule, score, place) of pairs to compare: equal ids, else similar names, else shared words.

    units: block_id, idx, name, ror_id, lei_id, has_name2, adjudicated. Pairs
    that a partition verdict has compared already aren't eligible. A block is
    dealt into shards of about ``BLOCK`` units, and each two shards meet in a cell
    of their own, so a block of any size is spread; a cell is worked in numpy, and
    only the pairs that a rule nominates leave it.
    """
    u = units.select("block_id", F.col("idx").cast("int").alias("idx"), tx.strip_legal_suffix(F.col("name")).alias("core"), "ror_id", "lei_id", "has_name2", "adjudicated")
    sizes = staged(u.groupBy("block_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("block_id", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_shards")), "sizes")  # written out, so that a hot block's partition may be split
    u = u.join(sizes, "block_id").withColumn("_shard", F.pmod(F.xxhash64("idx"), F.col("_shards")).cast("int"))
    u = u.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1))).withColumns({"_low": F.least("_shard", "_other"), "_high": F.greatest("_shard", "_other")})
    cells = u.select(*CELL).repartition("block_id", "_low", "_high").sortWithinPartitions("block_id", "_low", "_high")
    pairs = cells.mapInArrow(_all_cells(name_threshold, token_threshold), "block_id string, a int, b int, _rank int, score double")
    place = F.row_number().over(Window.partitionBy("block_id").orderBy("_rank", F.desc("score"), "a", "b"))
    return pairs.select("block_id", "a", "b", F.when(F.col("_rank") == 0, "id").when(F.col("_rank") == 1, "name").otherwise("token").alias("rule"), "score", place.alias("place"))


def capped_blocks(pairs: DataFrame, cap: int = CAP) -> DataFrame:
    """Blocks with more candidate pairs than ``cap``: they go to review as a whole."""
    return pairs.groupBy("block_id").agg(F.count("*").alias("candidates")).filter(F.col("candidates") > cap)


#: Text that says of a merged entity that it shouldn't be one.
NONMERGE_MARKERS = ("should not be merged", "should not merge", "must not be merged", "not be merged", "do not merge", "should be split", "must be split")


def _ids_hash(batches):
    """Rows sorted by cluster and row id: the digest of each cluster's ids, one id at a time."""
    cluster, digest, n = None, None, 0
    for batch in batches:
        done = []
        for c, i in zip(batch.column("cluster").to_pylist(), batch.column("row_id").to_pylist(), strict=True):
            if c != cluster:
                if cluster is not None:
                    done.append((cluster, digest.hexdigest(), n))
                cluster, digest, n = c, hashlib.sha256(), 0
            digest.update((";" if n else "").encode() + i.encode())
            n += 1
        yield _hash_batch(done)
    yield _hash_batch([(cluster, digest.hexdigest(), n)] if cluster is not None else [])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["cluster", "digest", "n"])


def cluster_hashes(rows: DataFrame) -> DataFrame:
    """cluster, hash ('c_' and twelve digits of SHA-256 over the sorted ids, joined by ';'), n
    of (cluster, row_id) rows. The ids of a cluster stream by in order, so a cluster of
    any size takes the memory of one id."""
    r = rows.filter("cluster is not null and row_id is not null").select(F.col("cluster").cast("string"), F.col("row_id").cast("string"))
    found = r.repartition("cluster").sortWithinPartitions("cluster", "row_id").mapInArrow(_ids_hash, "cluster string, digest string, n long")
    return found.select("cluster", F.concat(F.lit("c_"), F.substring("digest", 1, 12)).alias("hash"), "n")


def cluster_rows(rows: DataFrame, partitions: DataFrame | None = None, verdicts: DataFrame | None = None, cap: int = CAP, key=normalize_key, candidates: DataFrame | None = None) -> DataFrame:
    """row_id, block_id, cluster_id, routing, signature_id, entity_id, reasoning of every row.

    partitions: (block_id, signature_id, entity_id, uncertain, reasoning), what
    a reviewer grouped. In a block that has some, signatures that are left out
    are uncertain, and so is the whole block if the reasoning of an entity of
    two signatures or more disowns it. verdicts: (block_id, a, b, decision) on
    candidate pairs of entities named by their first signature; candidates
    (block_id, ...): all pairs that were nominated (the verdicts' pairs where
    they aren't given). A block with more of them than ``cap`` goes to review as
    it is, without merging. Without evidence only equal names cluster.
    """
    s = signatures(rows, key, ids=False)
    s = s.withColumns({"uncertain": F.lit(False), "entity_id": F.col("signature_id"), "adjudicated": F.lit(False), "reasoning": F.lit(None).cast("string")})
    if partitions is not None:
        p = partitions.select("block_id", "signature_id", F.col("entity_id").alias("_e"), F.col("uncertain").alias("_u"), F.col("reasoning").alias("_r"))
        grouped = partitions.select("block_id").distinct().withColumn("_grouped", F.lit(True))
        s = s.join(p, ["block_id", "signature_id"], "left").join(grouped, "block_id", "left")
        missing = F.col("_grouped").isNotNull() & F.col("_e").isNull()
        s = s.withColumns({"entity_id": F.coalesce("_e", "entity_id"), "uncertain": F.coalesce("_u", "uncertain") | missing, "reasoning": F.col("_r"), "adjudicated": F.col("_grouped").isNotNull()}).drop("_e", "_u", "_r", "_grouped")
    s = split_mixed_departments(s)
    if verdicts is not None:
        s = staged(s, "signatures")
        w = Window.partitionBy("block_id", "entity_id").orderBy("_first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        verdicts = staged(verdicts, "verdicts")  # evaluated once, read four times
        over = capped_blocks(candidates if candidates is not None else verdicts, cap).select("block_id", F.col("candidates").alias("_over"))
        verdicts = verdicts.join(over, "block_id", "left_anti")
        s = s.withColumn("unit", F.first("signature_id").over(w))
        node = lambda c: F.concat_ws("|", "block_id", c)
        merged = verdicts.filter(F.lower("decision") == "match").select(node("a").alias("a"), node("b").alias("b"))
        doubted = verdicts.filter(~F.lower("decision").isin("match", "new", "distinct")).select("block_id", F.explode(F.array("a", "b")).alias("unit")).distinct().withColumn("_doubt", F.lit(True))
        roots = components(s.select(node("unit").alias("node")).distinct(), merged)
        s = s.withColumn("node", node("unit")).join(roots, "node").join(doubted, ["block_id", "unit"], "left")
        s = s.withColumns({"entity_id": F.col("root"), "uncertain": F.col("uncertain") | F.coalesce("_doubt", F.lit(False))}).drop("node", "root", "unit", "_doubt")
        marker = F.format_string(f"candidate_cap_exceeded: %d candidate pairs exceed the per-block cap of {cap}; block routed to manual review", "_over")
        s = s.join(over, "block_id", "left").withColumns({"uncertain": F.col("uncertain") | F.col("_over").isNotNull(), "reasoning": F.coalesce("reasoning", F.when(F.col("_over").isNotNull(), marker))}).drop("_over")
    s = split_conflicting_ids(s)
    w = Window.partitionBy("block_id", "entity_id")
    s = s.withColumn("_several", F.count("*").over(w) >= 2)
    says = reduce(lambda a, b: a | b, [F.contains(F.lower("reasoning"), F.lit(m)) for m in NONMERGE_MARKERS])
    s = s.withColumn("uncertain", F.col("uncertain") | (F.max((F.col("_several") & F.coalesce(says, F.lit(False))).cast("int")).over(Window.partitionBy("block_id")) == 1))
    s = s.withColumn("_entity", F.concat_ws("|", "block_id", "entity_id")).select("block_id", "norm_name1", "norm_name2", "signature_id", "entity_id", "uncertain", "reasoning", "_entity")
    out = with_keys(rows, key).select("row_id", "block_id", "norm_name1", "norm_name2").join(s, ["block_id", "norm_name1", "norm_name2"])
    hashes = cluster_hashes(out.select(F.col("_entity").alias("cluster"), "row_id")).filter("n >= 2").select(F.col("cluster").alias("_cluster"), F.col("hash").alias("cluster_id"))
    out = out.join(hashes, F.col("_entity") == F.col("_cluster"), "left")
    routing = F.when(F.col("uncertain"), "manual_review").when(F.col("cluster_id").isNotNull(), "cluster").otherwise("unique")
    return out.select("row_id", "block_id", "cluster_id", routing.alias("routing"), "signature_id", "entity_id", "reasoning")


def confidence(value: Column) -> Column:
    """A number between 0 and 1, whatever was given; null if it isn't one."""
    return F.least(F.greatest(value.cast("string").try_cast("double"), F.lit(0.0)), F.lit(1.0))


def parse_json_object(raw: Column, schema: str) -> Column:
    """The JSON object in a reply: what a code fence holds or the whole, else from the
    first brace to the last; null where that isn't one object."""
    fence = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.trim(F.when(fence != "", fence).otherwise(raw))
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    alone = lambda x: F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))  # a second object behind it is an error there
    sound = lambda x: alone(x).isNotNull() & F.try_variant_get(alone(x), "$[1]", "variant").isNull()
    found = F.when(sound(text), text).when(sound(span), span)
    return F.when(found.startswith("{"), F.from_json(found, schema))
