"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encoscope.llm.common import written


def _toward_minimum(links: DataFrame, node: str, other: str) -> DataFrame:
    """Each ``other`` of a node linked to the least of the node and its others."""
    least = links.groupBy(node).agg(F.min(other).alias("_min"))
    least = least.select(node, F.least(F.col(node), F.col("_min")).alias("_min"))
    return links.join(least, node)


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node that a link names; root is the smallest node of its component.

    Alternates two steps until nothing changes: every larger neighbour of a node is linked to the least
    node around it, then every smaller one. Nodes with many links are summed map-side, and their joins
    are split by adaptive execution. Each round is written to the shared folder, so lost executors cost
    one round at most. Links with a null end and links to itself are left out.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(around, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("_min").alias("v"))
        large = large.where("u <> v").distinct()
        met = _toward_minimum(large, "u", "v")
        small = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("_min").alias("v")), F.struct("u", F.col("_min").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        found = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if found == mark:
            break
        mark = found
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
