"""The corpus pipeline: quality, near-duplicates, long repeats, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and gives the columns of
``documents`` again, the last one the tokenised form.  Between stages the rows are written to the shared
scratch folder and read back.

Defined results: null and empty texts pass through every stage (as quality and duplicates judge them); columns
beside those of ``documents`` are dropped; an empty table stays empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marketlens.llm import bpe, copies, decontaminate, quality, suffixes
from marketlens.llm.common import stored, table
from marketlens.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    docs = docs.select(COLUMNS)
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights, out="quality_").where(F.col("quality_") >= quality.THRESHOLD).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity 0.8 or more) stays: the one of smallest id (null ids last)."""
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_")), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("null_"), F.col("doc_id").alias("id_"), "row_")
    found = copies.near_copies(rows.select(key.alias("key_"), "text"), "text", "key_")
    stays = found.where(F.col("key_") == F.col("component_id")).select(F.col("key_.row_").alias("row_"))
    return rows.join(stays, "row_", "left_semi").select(COLUMNS)


@F.arrow_udf(StringType())
def _as_text(kept: pa.Array) -> pa.Array:
    """UTF-8 bytes as text; what is left of a character that was cut goes as well."""
    return pa.array([None if b is None else b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long repeats go from the texts; a text may become empty, its document stays."""
    deduped = suffixes.dedup(docs.select(COLUMNS), out="dedup_").withColumn("kept_", _as_text("dedup_.kept"))
    changed = F.col("dedup_.n_removed") > 0
    text = F.when(changed, F.col("kept_")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept_").cast("long")).otherwise(F.col("n_chars"))
    return deduped.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    hits = decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), out="hits_")
    return hits.where(~decontaminate.contaminated("hits_")).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian u32) of what is left, with their count and the digests of ids and decoded text."""
    made = bpe.encode(docs.select("doc_id", "text"), vocabulary(), out="bpe_")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "bpe_.n_tokens", "bpe_.ids", digest("bpe_.ids").alias("ids_sha256"), digest("bpe_.decoded").alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("benchmark decontamination", benchmark_stage),
    ("bpe encoding", token_stage),
]

#: A trained classifier and 64-bit shingle hashes are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
