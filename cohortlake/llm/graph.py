"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.stage import Scratch


def apart(key: str) -> Column:
    """A second grouping column that depends on the key alone.

    Grouping by it too keeps groups as they are, but a later join on the key shuffles both of its
    sides, and adaptive execution can then split a partition that one key fills.
    """
    return F.hash(key).alias("apart")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for each node of links (columns a, b): the smallest node it reaches.

    Nodes are ordered by a hash. Each round labels a node with the first of itself and its neighbours and
    replaces every link by the link of its ends' labels, until none is left between different labels. Every
    round has fewer nodes than the last (the last of each component's takes another's label), stars around their
    first node vanish in one round, and labels and links of each round are written out, so no lineage grows.
    Links with a null end and links of a node to itself are left out.
    """
    edges = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), f"{name}0")
    labels = []
    while not edges.isEmpty():
        around = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).unionAll(edges.select("high", "low"))
        turn = [F.struct(F.xxhash64(c).alias("turn"), F.col(c).alias("node")) for c in ("node", "other")]
        first = around.groupBy("node", apart("node")).agg(F.min(turn[1]).alias("other")).select("node", F.least(turn[0], "other")["node"].alias("component"))
        first = scratch.keep(first, f"{name}labels{len(labels)}")
        high = first.select(F.col("node").alias("high"), F.col("component").alias("of_high"))
        low = first.select(F.col("node").alias("low"), F.col("component").alias("of_low"))
        between = edges.join(high, "high").join(low, "low").filter("of_high <> of_low")
        between = between.select(F.greatest("of_high", "of_low").alias("high"), F.least("of_high", "of_low").alias("low")).distinct()
        labels.append(first)
        edges = scratch.keep(between, f"{name}{len(labels)}")
    if not labels:
        return edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    found = labels[0]
    for further in labels[1:]:
        step = further.select(F.col("node").alias("component"), F.col("component").alias("then"))
        found = found.join(step, "component", "left").select("node", F.coalesce("then", "component").alias("component"))
    smallest = found.groupBy("component", apart("component")).agg(F.min("node").alias("smallest")).select("component", "smallest")
    return found.join(smallest, "component").select("node", F.col("smallest").alias("component"))
