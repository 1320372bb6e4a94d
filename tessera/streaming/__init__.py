"""Continuous upkeep: files as they arrive, put into a bucketed store by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import content_hash
from tessera.operators.graph import changed_files, first_by
from tessera.operators.tables import materialize
from tessera.sources.buckets import Store


def upsert(batch: DataFrame, table: str, version: int) -> dict[str, int]:
    """Puts a batch of files (path, content, ts) into a store and says what changed.

    Only the buckets of the batch's paths are read and written. What is stored notes its batch, so one that runs again, because
    an executor or the driver was lost, finds what it did and does the rest.
    """
    store = Store(batch.sparkSession, table)
    last = first_by(batch, ["path"], F.desc("ts"), F.desc("content")).select("path", "content", content_hash(F.col("content")).alias("content_hash"))
    stored = store.read("files", last.select("path"))
    stored = last.limit(0).withColumns({"batch": F.lit(0), "status": F.lit("")}) if stored is None else stored
    done = materialize(stored.where(F.col("batch") == version).select("path", "status"))
    changed = materialize(changed_files(last, stored).join(done, "path", "left_anti"))
    if not changed.isEmpty():
        rows = last.join(changed, "path").withColumn("batch", F.lit(version))
        store.commit({"files": ("path", "path", rows, None)})
    return {r.status: r.n for r in changed.unionByName(done).groupBy("status").agg(F.count("*").alias("n")).collect()}


def current(spark: SparkSession, table: str) -> DataFrame:
    """(path, content, content_hash): the last version of each file."""
    return Store(spark, table).read("files").select("path", "content", "content_hash")


def compact(spark: SparkSession, table: str) -> None:
    """Writes each bucket of several segments as one, and deletes what no reader of the last version needs."""
    store = Store(spark, table)
    store.compact()
    store.vacuum()


def watch(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: str = "path string, content string, ts timestamp", source: str = "parquet", files_a_batch: int = 1000) -> StreamingQuery:
    """Starts a stream that takes files as they land and puts them into the store; it ends when nothing is left."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(source).load(landing)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: upsert(df, table, i) and None).start()
