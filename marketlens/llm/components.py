"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins on the node; nothing is gathered on the driver but a count and
a checksum per round.  Rounds are written to the shared scratch folder, so the plan does not grow.
Defined results: self-loops and repeated edges change nothing; null ends are dropped; no edges, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import discard, stored


def _starred(sides: DataFrame, large: bool) -> DataFrame:
    """Hook neighbours of each node to the least node around it."""
    least = sides.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    both = sides.join(least, "u")
    if large:
        return both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return both.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node."""
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = stored(edges.dropna(subset=[a, b]).where(F.col(a) != F.col(b)).select(high, low).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        seen = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = _starred(both, large=True).distinct()
        # After the large star each edge points from a node to a smaller one, as the small star wants.
        then = stored(_starred(wide, large=False).where(F.col("u") != F.col("v")).distinct(), "edges")
        discard(now)
        now = then
