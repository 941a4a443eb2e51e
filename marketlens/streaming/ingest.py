"""Directory ingest of exports as a stream: new files become listing rows once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlens.sources import exports

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, path: str, glob: str = "*.{csv,tsv,tab,txt}") -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path").alias("file"), F.when(F.col("length") <= exports.MAX_BYTES, F.col("content")).alias("content"))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write the listing rows of all files not seen before to ``out``, then stop.

    Batches are written under their number, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        exports.listings(exports.records(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return file_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
