"""Steps that run in rounds: each round's table is written, so its plan does not grow with the rounds before it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder (spark.checkpoint.dir; on one machine, where none is set, one of our own).

    Columns are packed and read apart, so steps that take a few of them read no more than those.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    path = f"{context.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
