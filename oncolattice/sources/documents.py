"""Document sources: Markdown folders, page texts, corpus manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import lits, strip


def read_markdown(spark: SparkSession, folder: str, exclude=(), priority=()) -> DataFrame:
    """SRC1: one row per Markdown file with its place in the reading order.

    ``priority`` names the files to read first, in order; ``exclude`` those to leave out.
    """
    files = (spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
             .select(F.col("_metadata.file_name").alias("source_doc"), F.col("value").alias("text")))
    return reading_order(files, exclude, priority)


def reading_order(docs: DataFrame, exclude=(), priority=()) -> DataFrame:
    """Drop excluded documents; sort by (priority_rank, source_doc) to get the reading order."""
    rank = F.array_position(lits(list(priority)), F.col("source_doc")) if priority else F.lit(0)
    return docs.filter(~F.col("source_doc").isin(list(exclude))).withColumn(
        "priority_rank", F.when(rank > 0, rank - 1).otherwise(len(priority)).cast("bigint"))


def page_texts(pages: DataFrame) -> DataFrame:
    """SRC2: page rows (source_doc, page_num, text) without blank pages."""
    return pages.filter(strip(F.col("text")) != "")


def manifest(spark: SparkSession, folder: str, patterns: dict[str, str], exclude=()) -> DataFrame:
    """SRC3: {path, format, name} of the entries of a folder, files or folders of files; contents are never read.

    ``patterns`` maps a format name to a glob of entry names. A folder without files is no entry.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = system.makeQualified(hadoop(folder)).toString().rstrip("/")
    parts = spark.createDataFrame([], "path string, format string, name string")
    for kind, glob in patterns.items():
        if not system.globStatus(hadoop(folder, glob)):  # Spark reads no glob without a match
            continue
        # in braces a glob is one to Spark even if it names a single entry
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder.rstrip('/')}/{{{glob}}}").select("path")
        name = F.split_part(F.substring("path", len(root) + 2, 1 << 30), F.lit("/"), F.lit(1))
        parts = parts.unionByName(files.select(name.alias("name")).distinct().select(F.concat(F.lit(root + "/"), "name").alias("path"), F.lit(kind).alias("format"), "name"))
    return parts.filter(~F.col("name").isin(list(exclude)))
