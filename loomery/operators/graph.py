"""Connected components by least label, over tables cut from their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.sources.scratch import staged


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``nodes`` (node), for ``edges`` (a, b): root is the least node it is connected with.

    Rounds take the least label of the neighbours, aggregated map-side, and then
    jump to the label's label, so the number of rounds grows with the logarithm
    of the longest path.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("low"))
        new = staged(step.join(jump, F.col("low") == F.col("_n"), "left").select("node", F.least("low", "_r").alias("root"), "was"))
        labels = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            break
    found = labels.withColumnRenamed("node", "_node")
    return nodes.join(found, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"))


def chains(pointers: DataFrame) -> DataFrame:
    """(node, last, hops, cycle) of every node of ``pointers`` (node, target): where following the pointers ends.

    By doubling: every round a node's jump becomes its jump's jump, so a chain of a thousand
    hops takes ten rounds. A node whose jumps haven't ended after as many steps as there are nodes
    leads into a cycle: ``cycle`` is true, ``last`` the least node on it and ``hops`` null. Of several
    pointers of a node the least counts; null nodes and targets are no pointers; a pointer to
    itself is a cycle of one.
    """
    jumps = pointers.filter("node is not null and target is not null").groupBy("node").agg(F.min("target").alias("at"))
    state = staged(jumps.select("node", "at", F.lit(1).cast("long").alias("hops"), F.col("at").alias("least"), F.lit(False).alias("done")))
    n, steps = state.count(), 1
    while steps <= 2 * n:  # the last round's least is that of a whole turn, whatever the cycle
        ahead = state.select(F.col("node").alias("_n"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("least").alias("_least"))
        met = state.filter("not done").join(ahead, F.col("at") == F.col("_n"), "left")
        ended = F.col("_n").isNull()
        new = met.select("node", F.coalesce("_at", "at").alias("at"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.least("least", F.coalesce("_least", "least")).alias("least"), ended.alias("done"))
        state = staged(state.filter("done").unionByName(new))
        steps *= 2
        if state.filter("not done").isEmpty():
            break
    turning = state.filter("not done").select(F.col("node").alias("_on"), F.col("least").alias("_around"))
    out = state.join(turning, (F.col("at") == F.col("_on")) & ~F.col("done"), "left")
    return out.select("node", F.when(F.col("done"), F.col("at")).otherwise(F.col("_around")).alias("last"), F.when(F.col("done"), F.col("hops")).alias("hops"), (~F.col("done")).alias("cycle"))
