"""Connected components of a table of links, by alternating star contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.tables import materialize


def contract(links: DataFrame, larger: bool) -> DataFrame:
    """Every node passes its smallest neighbour on to its larger (or its other smaller) neighbours."""
    both = links.union(links.select("b", "a")) if larger else links
    both = both.toDF("u", "v")  # without ``larger``: u > v
    # written, so that the join has no aggregate on its key below it and Spark can split a node with very many neighbours
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    met = both.join(least, "u")
    # larger: v > u joins m; else: v joins m, and so does u itself
    out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if larger else met.select("v", "m").union(least).toDF("a", "b")
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b), the component named by its smallest node.

    Each round writes its links to the shared folder, so the plan stays short and a lost executor costs a read. The number
    of rounds grows with the logarithm of the longest chain. Links of a node with itself and repeated links change nothing.
    """
    links = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == state or not now[0]:
            break
        state = now
        links = materialize(contract(contract(links, True), False).distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
