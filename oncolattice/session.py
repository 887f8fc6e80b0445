"""Session settings and lineage helpers."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "oncolattice", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; the cluster's own settings win elsewhere."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: spark.checkpoint.dir, or the one given to setCheckpointDir.

    On a cluster one of them must be set. In local mode, as in tests, a folder is made where none is.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not path and named.isDefined():
        path = named.get()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="oncolattice-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan with fewer partitions than cores before costly row-wise work.

    For a plain scan only. A large input has more splits than cores and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(df: DataFrame, *keys: str, rows: int = 250_000, of: DataFrame | None = None) -> DataFrame:
    """Rows dealt out by keys into tasks of about ``rows`` rows, which are counted first, in ``of`` if given: a plain scan with as many rows.

    An aggregate holds its groups in memory, and a task is given as many rows as a split or a coalesced shuffle holds. With the
    number of tasks set by the rows, what a task holds stays the same as the input grows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, math.ceil((df if of is None else of).count() / rows)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably and drop lineage (used between rounds of a bounded loop)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as Parquet in the shared folder: smaller, for large tables of which only some columns are read again."""
    path = f"{shared_dir(df.sparkSession)}/oncolattice-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
