"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters outside this class (space, tab, newline, vertical tab, form feed, return).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def id_text(c: Column) -> Column:
    """An id as text; a null id is the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clear_of(columns: list[str], added: list[str]) -> list[str]:
    """The columns' names, those that clash with an added name (in any case) ending in _in."""
    taken, out = {c.lower() for c in [*columns, *added]}, []
    for c in columns:
        name = c
        if c.lower() in {a.lower() for a in added}:
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
        out.append(name)
    return out


def beside(columns: list[str], row: Column, added: list[str]) -> list[Column]:
    """The columns of a table, taken from a struct of them, under names that are clear of the added ones."""
    return [row[c].alias(n) for c, n in zip(columns, clear_of(columns, added), strict=True)]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where that is unset a new local one, which only a local master may use."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master or "local").startswith("local") or "cluster" in sc.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = sc.getCheckpointDir()
    return found


_SCRATCH: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there and any executor can read it.

    Nothing refers to the shuffles behind it any more, but their files stay on the executors until the driver
    collects its garbage; so that is asked for, when the listeners have let go of the finished job, and once more before
    the next table is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    spark._jvm.System.gc()
    df.write.parquet(path)
    _SCRATCH.append(path)
    try:
        spark._jsc.sc().listenerBus().waitUntilEmpty(2000)
    except Py4JJavaError:  # they are slow; the files go later
        pass
    spark._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def written() -> int:
    """How many tables materialize() has written that are not released; a mark for release()."""
    return len(_SCRATCH)


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes what materialize() wrote after a mark, but for the tables to keep. Call it when no result that reads it is still wanted."""
    kept = {k.scratch_path for k in keep}
    for path in [p for p in _SCRATCH[since:] if p not in kept]:
        _SCRATCH.remove(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def may_be_among(rows: DataFrame, key: Column, keys: DataFrame, column: str, name: str, most_bits: int = 25) -> DataFrame:
    """rows with a boolean column: false where the key (a hash, long) is surely not in the column of keys.

    Keys set bits of a table of 2 ** most_bits at most, 16 a key while they fit, which is broadcast as words
    of 64 bits (8 MB at most): with very many keys it tells less, and what it lets through is right still.
    """
    m = 1 << max(10, min(most_bits, (16 * keys.count()).bit_length()))
    spot = lambda k: F.pmod(k, F.lit(m))
    words = keys.select(spot(F.col(column)).alias("s")).groupBy(F.shiftright("s", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("__bits"))
    at = rows.withColumn("__spot", spot(key)).withColumn("__at", F.shiftright("__spot", 6))
    out = at.join(F.broadcast(words), F.col("__at") == F.col("__word"), "left")  # 2 ** (most_bits - 6) rows at most
    hit = F.expr("coalesce(shiftright(__bits, cast(__spot % 64 as int)) & 1L, 0L) = 1L")
    return out.withColumn(name, hit).select(*rows.columns, name)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps the memory of a Python worker low where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
