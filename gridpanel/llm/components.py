"""Connected components of an undirected graph of longs, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm.scratch import delete, materialise


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, comp) of every node of edges (a, b) and of the labels so far; comp is the least node reached.

    Every round takes the least label among neighbours, whose counts are combined before the
    shuffle, and then the label of that label. Rounds are written, so lineage does not grow.
    """
    both = materialise(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct().toDF("node", "other"), "edges"
    )
    nodes = both.select("node").distinct()
    if labels is None:
        now = materialise(nodes.select("node", F.col("node").alias("comp")), "labels")
    else:
        now = materialise(
            labels.union(nodes.join(labels, "node", "left_anti").select("node", F.col("node"))), "labels"
        )
    while True:
        # Labels of both ends meet, so that components known before grow together as a whole.
        seen = (
            both.join(now.select(F.col("node").alias("other"), F.col("comp").alias("to")), "other")
            .join(now, "node")
            .where("to < comp")
            .groupBy("comp")
            .agg(F.min("to").alias("to"))
        )
        moves = materialise(seen, "moves")
        if moves.isEmpty():
            delete(both, moves)
            return now
        # A component moves to the least neighbour; if that one moves too, follow it as well.
        then = moves.select(F.col("comp").alias("to"), F.col("to").alias("then"))
        jump = moves.join(then, "to", "left").select("comp", F.coalesce("then", "to").alias("to"))
        before, now = now, materialise(
            now.join(jump, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels"
        )
        delete(before, moves)
