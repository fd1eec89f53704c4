"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import drop, written

#: Each round at least halves the depth of the trees, so 64 rounds suffice for 2**64 nodes.
ROUNDS = 64


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: every node has one ``low``, which is no node itself."""
    ends = links.select(F.col("node").alias("v"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    ends = ends.union(links.select("low", F.lit(0), F.lit(1)))
    found = ends.groupBy("v").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return found.where("above > 1 or above > 0 and below > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, low) for every node above its component's smallest node ``low``.

    ``links`` has long columns a and b. Minima are taken by partial
    aggregation and joined back, so a hub's neighbours are never gathered in
    one task. Every round is written to the shared folder, which keeps the
    plan short and survives lost executors.
    """
    now = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low")).distinct()
    )
    for _ in range(ROUNDS):
        if _settled(now):
            return now
        both = now.union(now.select("low", "node")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("node"), F.col("m").alias("low"))
        large = large.distinct()
        low = large.groupBy("node").agg(F.min("low").alias("m"))
        small = (
            large.join(low, "node")
            .where("low <> m")
            .select(F.col("low").alias("node"), F.col("m").alias("low"))
            .union(low.select("node", F.col("m").alias("low")))
            .distinct()
        )
        after = written(small)
        drop(now)
        now = after
    raise RuntimeError("components did not settle")
