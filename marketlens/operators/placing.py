"""Windows over groups of any size: rows are sorted in ranges, and what a range needs of those before it is carried over.

A window over one group is one task, however large the group.  Here rows are dealt by ranges of (group, order), so a hot
group is many ranges; within a range a window runs as usual, and between ranges one row each is carried.  The order
must tell rows apart (ties may stand in any order, but a range holds all rows of a tie).  Null groups are one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlens.operators.rounds import settled

_BEFORE = (W.unboundedPreceding, -1)


def ranged(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` checkpointed in the given order, with their range (``part``) and ``at_``, ascending within a range."""
    made = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    return settled(made.withColumn("part", F.shiftright("at_", 33)))


def numbered(rows: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """``rows`` with their place (1, 2, ...) in the given order."""
    made = ranged(rows, order)
    before = made.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("n"))  # a row a range
    return made.join(F.broadcast(before), "part").withColumn(name, F.col("n") + F.col("at_").bitwiseAND((1 << 33) - 1) + 1).drop("part", "at_", "n")


def ranked(rows: DataFrame, by: str, order: list, name: str = "pos") -> DataFrame:
    """``rows`` with their place (1, 2, ...) in their group, in the given order."""
    return running(ranged(rows.withColumn("one_", F.lit(1)), [by, *order]), by, "one_", name).drop("part", "at_", "one_")


def previous(made: DataFrame, by: str, columns: dict[str, str]) -> DataFrame:
    """``made`` (from :func:`ranged` by group, then order) with columns of the row before in the group (``columns`` name
    them: new name to column); null for a group's first row."""
    whole = F.struct(F.col(by).alias("by"), *[F.col(c).alias(new) for new, c in columns.items()])
    last = made.groupBy("part").agg(F.max_by(whole, "at_").alias("edge_"))
    edge = last.select("part", F.lag("edge_").over(W.orderBy("part")).alias("edge_"))  # a row a range
    before = F.coalesce(F.lag(whole).over(W.partitionBy("part").orderBy("at_")), F.col("edge_"))
    out = made.join(F.broadcast(edge), "part").withColumn("before_", before)
    same = F.col("before_").isNotNull() & F.col("before_.by").eqNullSafe(F.col(by))
    return out.withColumns({new: F.when(same, F.col("before_")[new]) for new in columns}).drop("before_", "edge_")


def running(made: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``made`` (from :func:`ranged` by group, then order) with the sum of ``value`` over the group's rows up to each."""
    parts = made.groupBy("part", F.col(by).alias("by_")).agg(F.sum(value).alias("n"))
    order = W.partitionBy("by_").orderBy("part")  # the ranges that a group lies in
    carried = parts.withColumn("carried_", F.sum("n").over(order.rowsBetween(*_BEFORE))).where("carried_ is not null").withColumnRenamed("part", "part_").drop("n")
    # A range continues at most one group, its first, so at most one row a range is carried.
    out = made.withColumn("sum_", F.sum(value).over(W.partitionBy("part", by).orderBy("at_").rowsBetween(W.unboundedPreceding, 0)))
    out = out.join(F.broadcast(carried), (F.col("part") == F.col("part_")) & F.col(by).eqNullSafe(F.col("by_")), "left")
    return out.withColumn(name, F.col("sum_") + F.coalesce("carried_", F.lit(0))).drop("sum_", "carried_", "part_", "by_")
