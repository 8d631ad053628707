"""Connected components by repeated contraction, as Spark joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeloom.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that appears in ``links`` (a, b); linked nodes have the same root.

    Each round every node moves to its neighbour, or stays, whichever comes first in a random order that
    is new in each round; links are relabelled and those inside one node vanish. The expected number of
    rounds is logarithmic in the length of the longest chain. A hub is reduced inside each task first.
    Self links give a node that is its own root; an empty table gives an empty table.
    """
    links = materialise(links.select("a", "b").distinct(), "links")
    roots = materialise(links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                        .select("node", F.col("node").alias("root")), "roots")
    links, turn = links.filter("a <> b"), 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("place"), c.alias("node"))  # noqa: E731, B023
        first = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("o"))
        moves = materialise(first.select(F.col("a").alias("node"),
                                         F.least("o", order(F.col("a")))["node"].alias("to")), "moves")
        there = lambda c: moves.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        links = materialise(links.join(there("a"), "a").join(there("b"), "b")
                            .select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
                            .filter("a <> b").distinct(), "links")
        roots = materialise(roots.join(there("root"), "root", "left")
                            .select("node", F.coalesce("root_to", "root").alias("root")), "roots")
        turn += 1
    return roots
