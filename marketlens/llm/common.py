"""Helpers shared by the corpus operators: scratch tables, table reading, bounded batches, byte normalisation."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table: A-Z to a-z, everything else unchanged.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: What a worker turns into Python objects at once: rows, and bytes of text (one row at least).
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, SparkSession] = {}
_own: list[str] = []


def slices(batches: Iterator, column: str | None = None, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator:
    """Arrow batches (or arrays) in slices that are bounded by rows and by the bytes of their texts.

    Spark bounds the batches themselves by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    for batch in batches:
        if not len(batch):
            yield batch
            continue
        size = pc.fill_null(pc.binary_length(batch if column is None else batch[column]), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(size, dtype=np.int64), 0
        while at < len(batch):
            before = upto[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + most, "right"))))
            yield batch.slice(at, end - at)
            at = end


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named, a folder of our own, on one machine only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


def stored(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared scratch folder and read it back.

    Cuts the lineage: whatever is lost later is read again from shared storage, and the shuffle files of the write
    are freed when it is done.  Tables go with :func:`discard`, what is left of them with :func:`sweep` or when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_at_exit)
    _made[path] = spark
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables made by :func:`stored` that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)
        _made.pop(df.scratch_path, None)


def sweep() -> None:
    """Delete all scratch tables that are left.  For when the results that read them have been written."""
    while _made:
        path, spark = _made.popitem()
        _delete(spark, path)


def _at_exit() -> None:
    # The session may be gone already; then its folder is the cluster's to clear.
    with contextlib.suppress(Exception):
        sweep()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other characters untouched."""
    return F.translate(c, UPPER, LOWER)


def residue(c: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]
