"""Connected components by min-neighbour hooking, pointer jumping and contraction, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddone.llm.common import staged_keys


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the undirected ``edges(a, b)``; the root is the component's least node.

    Every round hooks each node to its least neighbour, follows these pointers to their ends and contracts the
    graph, so the edges left shrink at least by half. Minima are aggregated before the shuffle: a hub costs
    one row per task. Loops and repeated edges are allowed; no edges give no rows. All joins are of keyed
    tables and merge: a broadcast for each small round would stay on the executors until the driver's next
    garbage collection.
    """
    left = staged_keys(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        pointer = staged_keys(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "pointers")
        while True:
            ends = pointer.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = staged_keys(pointer.join(ends.hint("merge"), "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "pointers")
            pointer = jumped.select("a", "p")
            if jumped.filter("moved").isEmpty():
                break
        if found is None:
            found = pointer.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            found = (found.join(pointer.withColumnRenamed("a", "root").hint("merge"), "root", "left")
                     .select("node", F.coalesce("p", "root").alias("root")))
        found = staged_keys(found, "components")
        to = pointer.select(F.col("a").alias("b"), F.col("p").alias("q"))
        left = staged_keys(left.join(pointer.hint("merge"), "a").select(F.col("p").alias("a"), "b").join(to.hint("merge"), "b")
                      .select("a", F.col("q").alias("b")).filter("a <> b").distinct(), "edges")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
