"""Connected components of an edge table, by hooking to the smallest neighbour and jumping, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saleskiln.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component is the smallest node it reaches.

    Each round hooks every label to the smallest label next to it, lets labels jump to the label of their label, and
    writes the edges that still join two labels; they at least halve the labels that are not yet settled. Loops and
    repeated edges do no harm; no edges give no rows. No group is gathered: sums and minima only.
    """
    live = scratch.write(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    labels = None  # node, component
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("near")))
        hook = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component"))
        hook = scratch.write(hook)
        for _ in range(2):
            up = hook.select(F.col("node").alias("component"), F.col("component").alias("above"))
            hook = hook.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
        hook = scratch.write(hook)
        if labels is None:
            labels = hook
        else:
            up = hook.select(F.col("node").alias("component"), F.col("component").alias("above"))
            moved = labels.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
            labels = scratch.write(moved)
        side = lambda name, to: hook.select(F.col("node").alias(name), F.col("component").alias(to))
        live = scratch.write(
            live.join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left")
            .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b").distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return labels
