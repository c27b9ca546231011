"""Inputs: any DataFrame with a text column will do; these read the tables the queries use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Below so many bytes for each core, an input has too few row groups to keep the cores busy.
SMALL = 16 << 20


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table stored as one Parquet file or folder, or some columns of it; Spark's reader prunes columns and pushes filters down."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return found.select(*columns) if columns else found


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt over all cores; larger ones, which have row groups enough, are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if cores > 1 and size < cores * SMALL else df


def shared(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; on a local master without it, in a
    temporary folder; elsewhere its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tamarack-")
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def texts(spark: SparkSession, *items: str | None) -> DataFrame:
    """Strings in memory as a table (doc_id, text)."""
    return spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")
