"""Connected components of a graph given as links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is one node of its
    component, the same for all of them.

    In each round every node points to its smallest neighbour, pointers are followed one
    step further, and the links are rewritten to the nodes pointed at; loops vanish.
    Rounds grow with the logarithm of the longest chain. Each round is written to the
    shared folder, so lost executors cost one round at most. Links may repeat and be
    loops; an empty table gives an empty result.
    """
    edges = materialize(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "cc-links",
    )
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = roots.withColumn("root", F.col("node"))
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        step = both.groupBy("a").agg(F.least("a", F.min("b")).alias("up"))
        far = step.select(F.col("a").alias("up"), F.col("up").alias("top"))
        jump = materialize(
            step.join(far, "up", "left").select("a", F.coalesce("top", "up").alias("up")), "cc-jump"
        )
        ends = jump.select(F.col("a").alias("b"), F.col("up").alias("up_b"))
        edges = materialize(
            edges.join(jump, "a")
            .join(ends, "b")
            .select(F.least("up", "up_b").alias("a"), F.greatest("up", "up_b").alias("b"))
            .where("a <> b")
            .distinct(),
            "cc-links",
        )
        # Only stored tables are joined, so the chain of joins has no depth to speak of.
        roots = roots.join(jump.withColumnRenamed("a", "root"), "root", "left").select(
            "node", F.coalesce("up", "root").alias("root")
        )
    return materialize(roots, "cc-roots")
