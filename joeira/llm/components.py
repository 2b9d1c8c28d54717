"""Connected components of a table of links, as a few joins per round.

Large-star and small-star rounds (Kiveris and others, "Connected components in
MapReduce and beyond", 2014): every node hangs its larger, then its smaller
neighbours on the smallest one it knows.  The smallest neighbour comes from a
grouped minimum, which is combined before the shuffle, so a node with very many
links is no heavy group; the join that hands it on is one that Spark splits
where it is uneven.  The links of a round are written to the shared folder,
which keeps plans short and survives a lost executor; nothing but one number
per round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from joeira.llm.common import Scratch

ROUNDS = 60


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a``, ``b``), the component being its smallest node."""
    step = scratch.save(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(ROUNDS):
        both = step.select("u", "v").unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Now every u is larger than its v, so the smaller neighbours of a node are its links.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.save(hung.distinct())
        sums = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        scratch.drop(step)
        step = after
        if (sums.n, sums.h) == before:
            break
        before = (sums.n, sums.h)
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    roots = step.select(F.col("v").alias("node")).distinct()
    return step.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
