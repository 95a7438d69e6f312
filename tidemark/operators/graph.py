"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize


def _stars(pairs: DataFrame, keep) -> DataFrame:
    """Link each pair's far end (where ``keep`` holds) to the least node around the near end."""
    least = pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return pairs.join(least, "u").filter(keep)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's least node.

    Each round is written to the shared folder, so lost executors cost at most
    one round. Neighbourhoods are never gathered: minima are partial aggregates
    and hubs are equi-joins that Spark can split. Self-loops and repeated edges
    are allowed; an empty table gives an empty result.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, mark = materialize(pairs, "components"), None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        near = _stars(large, F.lit(True))
        small = near.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs = materialize(small.filter("u != v").distinct(), "components")
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct())
