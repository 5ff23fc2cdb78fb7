"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds m, the least of u and its neighbours; sums by key before it joins, so hubs split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("k", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links to (node, root): each linked node with its component's least node.

    Each round writes its edges to the shared folder. Self links and repeated
    links are ignored; an empty table has no components.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        now = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "edges",
        )
    raise RuntimeError(f"components did not settle in {rounds} rounds")
