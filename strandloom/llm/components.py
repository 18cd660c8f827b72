"""Connected components of a table of edges, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import drop_stash, join_hot, stash


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
    return join_hot(both, least, "u", 2 * total).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """edges: v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    joined = join_hot(edges, least, "u", total)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node that it is connected with.

    Each round is a large star and a small star. Both combine the smallest neighbour before the shuffle; a node with more
    than a thousandth of the edges gets it by broadcast, so its edges aren't gathered in one task. Rounds grow with the
    logarithm of the nodes; each is written to the shared folder, so that lineage stays short, and the one before is
    deleted. Loops don't count. Edges without rows give no rows.
    """
    def settled(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    now = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = settled(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        large = stash(_large_star(now, mark[0]).distinct())
        after = stash(_small_star(large, large.count()).distinct())
        drop_stash(large)
        drop_stash(now)
        now = after
        before, mark = mark, settled(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
