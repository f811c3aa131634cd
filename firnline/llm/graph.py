"""Connected components of a link table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_frequent, packed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of `links`, root the smallest node that it reaches.

    Every node points to a smaller one of its component. Each round looks at what the neighbours' roots
    point to; a smaller one becomes the root of the node and of the node's root, so whole trees move at
    once and the number of rounds grows with the logarithm of a component's size, long paths included.
    Every round is cut to the shared checkpoint folder. Nodes with very many neighbours, and roots of
    very many nodes, are joined by broadcast. Tables have partitions by their rows, so a round of few links is few tasks. Links with a null end and links of a node to itself add
    nothing; no links give an empty table.
    """
    one = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("node"), F.col(b).alias("next"))
    both = cut(one.union(one.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct())
    n = both.count()
    both = packed(both, n)
    found = both.groupBy("node").agg(F.min("next").alias("low")).select("node", F.least("node", "low").alias("root"))
    found = cut(packed(found.withColumn("up", F.col("root")), n))
    while True:
        near = packed(join_frequent(both, found.select(F.col("node").alias("next"), F.col("up").alias("near")), "next"), n).groupBy("node").agg(F.min("near").alias("near"))
        nothing = F.lit(None).cast(found.schema["node"].dataType)
        seen = cut(packed(found.join(near, "node"), n))
        moves = seen.select("node", F.least("root", "up", "near").alias("to"), F.col("root").alias("was"), F.col("up").alias("was_up"))
        moves = moves.union(seen.select("root", "near", nothing, nothing))
        moved = cut(packed(moves.groupBy("node").agg(F.min("to").alias("root"), F.max("was").alias("was"), F.max("was_up").alias("was_up")), n))
        above = moved.select(F.col("node").alias("root"), F.col("root").alias("up"))
        found = cut(packed(join_frequent(moved, above, "root").select("node", "root", "up", "was", "was_up"), n))
        done = found.where("root <> was or up <> was_up").isEmpty()
        found = found.select("node", "root", "up")
        if done:
            return found.select("node", "root")
