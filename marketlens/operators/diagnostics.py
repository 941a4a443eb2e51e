"""Figures of a run's stages, taken beside the jobs that compute them: no stage is run again to be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Diagnostics:
    """Stages that are watched, in order.

    A stage's figures are there when a job has computed it, and :meth:`figures` waits for that.  A stage that one plan uses
    several times should be written first (see rounds), so that it is computed, and counted, once.
    """

    def __init__(self):
        self._stages: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str, **counts: Column) -> DataFrame:
        """``df``, whose next job also takes the aggregates ``counts`` of it."""
        seen = Observation(stage)
        self._stages.append((stage, seen))
        return df.observe(seen, *[c.cast("long").alias(name) for name, c in counts.items()])

    def figures(self, spark: SparkSession) -> DataFrame:
        """(seq, stage, figure, value) of all stages: a row per aggregate that was asked for."""
        rows = [(i, stage, name, value) for i, (stage, seen) in enumerate(self._stages) for name, value in seen.get.items()]
        return spark.createDataFrame(rows, "seq int, stage string, figure string, value bigint")
