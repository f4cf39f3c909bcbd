"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwise.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): the smallest node it can reach.

    Each round every node turns to its smallest neighbour, these pointers are followed to
    their end, and the graph shrinks to what the ends still have in common. Minima merge
    before they are shuffled; the joins look nodes up in a table with one row per node, so a
    node with very many links only makes a long other side, which Spark splits. Each round's
    tables are written to the shared folder, so a lost executor repeats one step.
    """
    both = links.where("a <> b").select("a", "b")
    edges = materialize(both.union(both.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        turn = materialize(
            edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
            .select("node", F.least("node", "to").alias("to")), "turns",
        )
        moved = True
        while moved:
            onward = turn.select(F.col("node").alias("to"), F.col("to").alias("next"))
            turn = materialize(turn.join(onward, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "jumps")
            moved = not turn.where("moved").isEmpty()
            turn = turn.drop("moved")
        if labels is None:
            labels = turn.select("node", F.col("to").alias("root"))
        else:
            new = turn.select(F.col("node").alias("root"), "to")
            labels = labels.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = materialize(labels, "labels")
        side_a = turn.select(F.col("node").alias("a"), F.col("to").alias("x"))
        side_b = turn.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = edges.join(side_a, "a").join(side_b, "b").where("x <> y")
        edges = materialize(left.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if labels is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels
