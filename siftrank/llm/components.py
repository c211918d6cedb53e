"""Connected components of a graph given as edges, by alternating stars.

In a large step every node's larger neighbours are hung on its least neighbour, in a
small step its smaller ones; a chain is halved each time. Each step is an aggregate
with map-side minima and a join on nodes, written to the shared folder, so neither the
plan nor the work after a lost executor grows with the steps. Nothing but a count and
a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftrank.llm.common import stored


def _hung(links: DataFrame, kept: Column) -> DataFrame:
    """The neighbours ``b`` of each node ``a`` that are ``kept``, on the least one."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    return links.join(least, "a").where(kept).select(F.col("b").alias("from"), F.least("a", "least").alias("to"))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """For edges ``(a, b)``: each node with the least node it is connected with.

    Columns ``node`` and ``root``. Loops and repeated edges do no harm; nodes without
    an edge to another are not listed.
    """

    def directed(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = stored(directed(edges), "edges")
    seen = _checksum(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hung(both, F.col("b") > F.col("a"))
        now = stored(directed(large.select(F.col("from").alias("a"), F.col("to").alias("b"))), "edges")
        small = _hung(now, F.lit(True)).unionByName(
            now.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("from"), "to")
        )
        now = stored(directed(small.select(F.col("from").alias("a"), F.col("to").alias("b"))), "edges")
        before, seen = seen, _checksum(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
