"""First-match assignment of signatures to entities, as rounds of parallel decisions.

In a block's order a signature is compared with the entities before it: the
first whose verdict decides takes it (*match*) or leaves it doubted, an entity
of its own (*uncertain*); without one it starts an entity. Departments never
meet names without one. What a sequential pass would do is found in rounds: a
signature settles once the least entity that decides on it is known, that is
when all signatures before that one, which might still turn out to be entities,
have settled. A round takes the verdicts on open signatures only, so no block is
one task; rounds follow the longest chain of signatures that wait for each other.

Defined cases: verdicts of a signature with itself, with a later one or across
departments don't count; of several verdicts on a pair the least decision
(lower case) does; a block without verdicts has an entity a signature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.sources.scratch import staged

KEY = ["block_id", "idx"]


def assign_entities(signatures: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(block_id, idx, entity, uncertain): the first signature of each one's entity.

    signatures: block_id, idx (the order), has_name2. verdicts: block_id, a, b, decision (a, the
    earlier signature, stands for its entity)."""
    s = staged(signatures.select("block_id", "idx", "has_name2"), "signatures")
    decided = verdicts.filter("a < b").select("block_id", "a", "b", F.lower("decision").alias("decision")).filter("decision in ('match', 'uncertain')").groupBy("block_id", "a", "b").agg(F.min("decision").alias("decision"))
    side = lambda c: s.select("block_id", F.col("idx").alias(c), F.col("has_name2").alias(f"_{c}"))
    edges = decided.join(side("a"), ["block_id", "a"]).join(side("b"), ["block_id", "b"]).filter(F.col("_a") == F.col("_b"))
    edges = staged(edges.select("block_id", F.col("b").alias("idx"), "a", "decision", F.lit(False).alias("entity")), "verdicts")
    waiting, settled = s.select(*KEY), []
    while True:
        known = F.min(F.when(F.col("entity"), F.struct("a", "decision")))
        unknown = F.min(F.when(~F.col("entity"), F.col("a")))
        seen = waiting.join(edges.groupBy(*KEY).agg(known.alias("known"), unknown.alias("unknown")), KEY, "left")
        takes = F.col("known").isNotNull() & (F.col("unknown").isNull() | (F.col("known.a") < F.col("unknown")))
        alone = F.col("known").isNull() & F.col("unknown").isNull()
        joins = takes & (F.col("known.decision") == "match")
        out = seen.select(*KEY, F.when(joins, F.col("known.a")).when(takes | alone, F.col("idx")).alias("entity"), F.coalesce(takes & ~joins, F.lit(False)).alias("uncertain"))
        out = staged(out, "round")
        new, waiting = out.filter("entity is not null"), out.filter("entity is null").select(*KEY)
        settled.append(new)
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        roles = new.select("block_id", F.col("idx").alias("a"), (F.col("entity") == F.col("idx")).alias("_entity"))
        open_ = edges.join(waiting, KEY, "left_semi").join(roles, ["block_id", "a"], "left")
        edges = staged(open_.filter("_entity is null or _entity").select("block_id", "idx", "a", "decision", (F.col("entity") | F.coalesce("_entity", F.lit(False))).alias("entity")), "verdicts")
