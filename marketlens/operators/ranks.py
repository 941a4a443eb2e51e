"""Exact middle values of groups of any size, without bringing a group's values to one task.

A sketch of each group brackets its middle; values below the bracket are counted, those inside it (some ten-thousandths
of the group) are reduced to counts per value and ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Accuracy of the sketch: a rank is off by at most a group's rows over this.
ACCURACY = 20_000
#: Rows of a group up to which one sort of it is no long task.
SMALL = 65_536


def middles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n_values, lower, upper): the two middle values of each group (equal for an odd number); nulls do not count."""
    v = F.col(value)
    kept = rows.where(v.isNotNull()).select(*by, v.alias("v"))
    edge = 3 / ACCURACY
    bracket = kept.groupBy(*by).agg(F.count("*").alias("n_values"), F.percentile_approx("v", F.array(F.lit(0.5 - edge), F.lit(0.5 + edge)), F.lit(ACCURACY)).alias("q"))
    met = kept.join(bracket, by) if by else kept.crossJoin(F.broadcast(bracket))  # one row
    inside = met.where(F.col("v") <= F.col("q")[1]).groupBy(*by, F.when(F.col("v") >= F.col("q")[0], F.col("v")).alias("v")).agg(F.count("*").alias("n"), F.max("n_values").alias("n_values"))
    # Per group the bracket's values and one row for all below it.
    up = W.partitionBy(*by).orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = inside.withColumn("upto", F.sum("n").over(up))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    return ranked.groupBy(*by).agg(F.max("n_values").alias("n_values"), at(F.floor((F.col("n_values") + 1) / 2)).alias("lower"), at(F.floor(F.col("n_values") / 2) + 1).alias("upper"))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n_values, median): the mean of the two middle values, as a double."""
    return middles(rows, by, value).select(*by, "n_values", ((F.col("lower").cast("double") + F.col("upper").cast("double")) / 2).alias("median"))


def is_small(rows: DataFrame, by: list[str]) -> bool:
    """Whether no group of ``rows`` has more than ``SMALL`` rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).isEmpty()


def with_middles(rows: DataFrame, by: list[str], value: str, small: bool) -> DataFrame:
    """``rows`` with the two middle values of their group, ``lower`` and ``upper`` (null where a group has no value).

    Groups that are all ``small`` (see :func:`is_small`) are sorted whole; otherwise :func:`middles` finds them.
    """
    if not small:
        return rows.join(middles(rows, by, value).select(*by, "lower", "upper"), by, "left")
    along = W.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())  # SMALL rows at most
    whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = rows.withColumns({"at_": F.row_number().over(along), "n_": F.count(value).over(whole)})
    at = lambda rank: F.max(F.when((F.col("at_") == rank) & (F.col("n_") > 0), F.col(value))).over(whole)
    return ranked.withColumns({"lower": at(F.floor((F.col("n_") + 1) / 2)), "upper": at(F.floor(F.col("n_") / 2) + 1)}).drop("at_", "n_")


def with_median(rows: DataFrame, by: list[str], value: str, small: bool, name: str = "median") -> DataFrame:
    """``rows`` with the mean of the two middle values of their group, as a double; see :func:`with_middles`."""
    return with_middles(rows, by, value, small).withColumn(name, (F.col("lower").cast("double") + F.col("upper").cast("double")) / 2).drop("lower", "upper")
