"""From raw documents to pieces for training: quality, near-duplicates, contamination, personal data, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns them with the
columns of documents; the last returns the pieces. Rows are judged each for itself, with a null or repeated doc_id too.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oncolattice.llm import decontaminate, neardup, pieces, pii, quality
from oncolattice.llm.arrays import written

BROADCAST = 1_000_000  # so many 8-byte keys may be broadcast; more are joined by a shuffle


def _free(docs: DataFrame) -> str:
    """A column name that `docs` does not use, in any case."""
    taken = {c.lower() for c in docs.columns}
    return next(name for name in (f"row{k}" for k in itertools.count()) if name not in taken)


def _without(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`docs` without the rows whose key is among `keys`."""
    keys = written(keys.select(key).where(F.col(key).isNotNull()).distinct())
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, key, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality(docs).where("kept").select("__doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8): that of smallest doc_id, a null last.

    Rows are named by a number of their own, written once; of rows that share the smallest id, the one with the least hash stays.
    """
    row = _free(docs)
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    found = neardup.near_duplicates(keyed, k=5, percent=80, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), F.col(row).alias("row"))
    placed = written(found.join(keyed.select(row, place.alias("place")), row))
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    return _without(keyed, placed.join(first, "component_id").where("place.row != first.row"), row).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    row = _free(docs)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = decontaminate.contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return _without(keyed, found.where("n_hit > 0").select(F.col("doc_id").alias(row)), row).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and words that reveal it, taken out of the text; n_chars follows."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document."""
    return pieces.encode(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("personal_data", personal_data), ("encode", encode)]

ORACLE_SQL = None  # tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
