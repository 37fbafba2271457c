"""Connected components of a large graph by contraction, in DataFrame joins.

Each round every node moves to the neighbour that precedes it most in that round's order, if any does;
edges are rewritten and loops dropped. In the first two rounds and every other one after them that is the order
of ids, by which stars around their least node are gone in one round; in the others it is random: by these the
expected number of nodes falls by a constant factor, whatever the shape (a chain as well as a star). Every round
costs the driver the plans and task metrics of two jobs, so few are wanted. No node's neighbours ever
meet in one task: their least one is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources import freeze


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``, whose ids are bigints; a component
    is named by its least node. Loops and repeated edges do no harm. Rounds are cut by tables
    in the shared folder; only whether edges are left reaches the driver."""
    left = freeze(edges.filter("a <> b").select("a", "b").distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        by_id = len(moves) < 2 or len(moves) % 2 == 1
        order = lambda c, seed=None if by_id else len(moves): F.col(c) if seed is None else F.xxhash64(F.col(c), F.lit(seed))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min_by("b", order("b")).alias("b"))
        move = freeze(
            first.select(
                F.col("a").alias("node"),
                F.when(order("b") < order("a"), F.col("b")).otherwise(F.col("a")).alias("to"),
            )
        )
        moves.append(move)
        to = lambda end: move.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))  # noqa: B023, E731
        moved = left.join(to("a"), "a").join(to("b"), "b")
        left = freeze(
            moved.filter("a_to <> b_to")
            .select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
            .distinct()
        )
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    placed = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("node").alias("to"), F.col("to").alias("next"))
        placed = placed.join(step, "to", "left").select(
            "node", F.coalesce("next", "to").alias("to")
        )
    placed = freeze(placed)
    least = freeze(placed.groupBy("to").agg(F.min("node").alias("component")))
    return freeze(placed.join(least, "to").select("node", "component"))
