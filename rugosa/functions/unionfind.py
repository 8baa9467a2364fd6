"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import cut


SALTS = 32


def _joined(pairs: DataFrame, where: str = "true") -> DataFrame:
    """pairs (u, v) that meet `where`, with m: the least v of all pairs of the same u."""
    part = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    low = part.groupBy("u", "part").agg(F.min("v").alias("m"))
    low = low.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("part").alias("parts"))  # at most SALTS entries
    return part.where(where).join(low.select("u", "m", F.explode("parts").alias("part")), ["u", "part"])


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v), v < u, are stars: every u has one v, which is no u itself. Then v is u's least node."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
    return ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).where("leaf + root > 1").limit(1).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): each node of the edges with the smallest node that it can reach.

    Distributed union-find by alternating large-star and small-star steps. Each step is a
    grouped minimum (partial minima before the shuffle) and a join back. The neighbours of a node are
    dealt into SALTS parts, by which they are joined as well, so that those of a hub are never in one
    task. Ends when the edges are stars, which one grouped count tells. Null ends and loops are left out.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u is not null and v is not null and u <> v").distinct()
    e = cut(e)

    for done in range(rounds + 1):
        if _settled(e):
            break
        if done == rounds:
            raise RuntimeError(f"the components did not settle in {rounds} rounds")
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined(both, "v > u").selectExpr("v as u", "least(m, u) as v").where("u <> v").distinct()
        small = _joined(large).selectExpr("inline(array(struct(u as u, m as v), struct(v as u, m as v)))").where("u <> v").distinct()
        e = cut(small)
    leaves = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return leaves.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
