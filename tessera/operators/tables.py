"""Tables that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset a new local one, which only a local master may use."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not d:
        if not (sc.master or "local").startswith("local") or "cluster" in sc.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        d = sc.getCheckpointDir()
    return d


_SCRATCH: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes the tables written so far. Call it when no result that reads them is still wanted."""
    while _SCRATCH:
        p = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again. With `by` a folder for each value of that column, so that a filter on it reads those files only."""
    path = f"{shared_dir(df.sparkSession)}/tessera-table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _SCRATCH.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def workers(spark: SparkSession) -> int:
    """Into how many parts rows are dealt so that all workers have some."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
