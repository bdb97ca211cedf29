"""Helpers shared by the operators: sessions, written tables, ranks and Arrow batches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in an Arrow batch; bounds a Python worker's memory for documents of usual length.
BATCH_ROWS = 512


def tuned(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches and adaptive execution."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is set, on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='vertexloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Whether shuffle files go when their query ends; what written() wrote needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vertexloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc: every row of docs, whatever its columns are called, as a struct with a number of its own; written, so that the numbers stay."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "numbered")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with _rank, each row's 0-based place within its group; group columns must not be null.

    A distributed prefix count: rows are range-partitioned on group and order, so that even one
    huge group spreads over many partitions; each partition counts its own rows, and only one
    count for a (partition, group) is added up in a window.
    """
    keys = [*group, *order]
    rows = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(parts, ["_part", *group]).withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_n", "_before")


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def texts(column: pa.Array) -> list[str]:
    """The column's strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def per_worker(key: str, make: Callable[[], Any]) -> Any:
    """A value that this Python worker process keeps for all its tasks (functions come anew with each task, and their globals too), until it is asked for another one."""
    held = sys.modules.setdefault("_vertexloom_worker", types.ModuleType("_vertexloom_worker")).__dict__
    if held.get("key") != key:
        held.pop("value", None)
        held["key"], held["value"] = key, make()
    return held["value"]
