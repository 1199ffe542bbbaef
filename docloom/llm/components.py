"""Connected components of a table of links, by contraction, without a node's links meeting in one task.

In each round every node takes the neighbour (or itself) of smallest random priority as its label;
the links are rewritten to labels, and those inside one label go. The number of labels left falls
by a constant factor a round on any graph, chains and stars included; the priorities change by
round. Minima are pre-aggregated in each task, and the rewriting joins can be split by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """links: columns a, b (long). Returns node, component: the smallest node reachable; a row for each node with a link to another."""
    edges = scratch.table(f"{name}-e0", links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), few=True)
    label, r = None, 0
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
        rank = lambda c: F.struct(F.xxhash64(F.lit(r), c).alias("h"), c.alias("id"))
        step = ends.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m")).select("u", F.least("m", rank(F.col("u")))["id"].alias("p"))
        step = scratch.table(f"{name}-p{r}", step, few=True)
        pa, pb = step.select(F.col("u").alias("a"), F.col("p").alias("pa")), step.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        new = edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        nxt = scratch.table(f"{name}-e{r + 1}", new, few=True)
        if label is None:
            label = step.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            label = label.join(step.select(F.col("u").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
            label = scratch.table(f"{name}-l{r}", label, few=True)
        scratch.drop(f"{name}-e{r}")
        edges, r = nxt, r + 1
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = label.groupBy("label").agg(F.min("node").alias("component"))
    return label.join(least, "label").select("node", "component")
