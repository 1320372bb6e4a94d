"""Versioned tables in hash buckets, merged on read: what keeps a graph up to date without writing all of it again.

A table is dealt into buckets by the hash of a key. A commit writes one segment a table, which holds the rows of the owners that
changed (a file owns its facts, edges and nodes) and a marker where an owner's rows were before, and then one
manifest that names the segments of every bucket. Readers take the latest manifest: a commit that dies before its manifest is
written has changed nothing. Of a bucket's rows those of an owner's last segment count. A bucket of many segments is written
anew, as one.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class Store:
    """Tables of one folder. rows_read and buckets_read count what reads have been given to scan, by the manifest."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, most_segments: int = 8):
        self.spark, self.root, self.most_segments = spark, root, most_segments
        self.rows_read = self.buckets_read = 0
        found = self._manifests()
        self.manifest = json.loads(self._text(found[-1])) if found else {"version": -1, "buckets": buckets, "tables": {}}

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        p, fs = self._path(f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        return sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).endswith(".json"))

    def _text(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{name}").collect())

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.manifest["buckets"])).cast("int")

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame | None:
        """The rows of a table as of the latest commit; with keys (a table of one column) only theirs, from their buckets alone. None if there is no such table."""
        if table not in self.manifest["tables"]:
            return None
        t = self.manifest["tables"][table]
        wanted = list(t["segments"])
        if keys is not None:
            keys = keys.select(keys[keys.columns[0]].cast("string").alias("__k")).where("__k is not null").distinct()
            of = {str(r.b) for r in keys.select(self.bucket(F.col("__k")).alias("b")).distinct().collect()}  # as many as buckets at most
            wanted = [b for b in wanted if b in of]
        out = self._merged(table, wanted)
        self.buckets_read += len(wanted)
        self.rows_read += sum(rows for b in wanted for _, rows in t["segments"][b])
        if keys is not None:
            out = out.join(keys, out[t["key"]].cast("string") == keys["__k"], "left_semi")
        return out

    def _merged(self, table: str, buckets: list[str]) -> DataFrame:
        t = self.manifest["tables"][table]
        schema = StructType.fromJson(json.loads(t["schema"]))
        paths = [f"{self.root}/data/{table}/{n}/bucket={b}" for b in buckets for n, _ in t["segments"][b]]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("__version", "__live")
        rows = self.spark.read.schema(schema).parquet(*paths)
        if any(len(t["segments"][b]) > 1 for b in buckets):
            rows = rows.withColumn("__bucket", self.bucket(F.col(t["key"])))
            last = rows.groupBy(F.col(t["owner"]).alias("__owner"), F.col("__bucket").alias("__b")).agg(F.max("__version").alias("__last"))
            same = rows[t["owner"]].eqNullSafe(last["__owner"]) & (rows["__bucket"] == last["__b"]) & (rows["__version"] == last["__last"])
            rows = rows.join(last, same, "left_semi").drop("__bucket")
        return rows.where("__live").drop("__version", "__live")

    def commit(self, changes: dict[str, tuple[str, str, DataFrame, DataFrame | None]]) -> int:
        """Puts a version on top. changes: by table its key, its owner, all new rows of the owners that changed, and (owner, key) of the rows they had before. Returns the version."""
        new = json.loads(json.dumps(self.manifest))
        new["version"] += 1
        name = f"v{new['version']:09d}-{uuid.uuid4().hex[:8]}"
        self._add_all(new, [(table, name, *x) for table, x in changes.items()])
        self._publish(new)
        full = {t: [b for b, s in x["segments"].items() if len(s) > self.most_segments] for t, x in self.manifest["tables"].items()}
        if any(full.values()):
            self.compact({t: b for t, b in full.items() if b})
        return self.version

    def _add_all(self, new: dict, of: list[tuple]) -> None:
        """Writes the tables' segments, some at a time: they are small jobs that don't wait for each other."""
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda x: self._add(new, *x), of))

    def _add(self, new: dict, table: str, name: str, key: str, owner: str, rows: DataFrame, gone: DataFrame | None, replace: list[str] | None = None) -> None:
        rows = rows.withColumns({"__version": F.lit(new["version"]), "__live": F.lit(True)})
        if gone is not None:
            mark = gone.select(*dict.fromkeys((owner, key))).distinct()
            rows = rows.unionByName(mark.withColumns({"__version": F.lit(new["version"]), "__live": F.lit(False)}), allowMissingColumns=True)
        path = f"{self.root}/data/{table}/{name}"
        rows.withColumn("bucket", self.bucket(F.col(key))).repartition("bucket").write.partitionBy("bucket").parquet(path)
        kept = StructType.fromJson(json.loads(rows.schema.json()))
        for f in kept.fields:
            f.nullable = True
        n = {str(r.bucket): r.n for r in self.spark.read.schema(StructType([*kept.fields, StructField("bucket", IntegerType())])).parquet(path).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        t = new["tables"].setdefault(table, {"key": key, "owner": owner, "schema": "", "segments": {}})
        t["schema"] = kept.json()
        for b in replace or []:
            t["segments"].pop(b, None)
        for b, count in n.items():
            t["segments"].setdefault(b, []).append([name, count])

    def _publish(self, new: dict) -> None:
        """The manifest comes last, written whole under another name and renamed; who finds its version taken has lost a race."""
        name = f"{self.root}/manifests/{new['version']:09d}.json"
        p, fs = self._path(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(p, True)
        out.write(json.dumps(new).encode())
        out.close()
        to, _ = self._path(name)
        if fs.exists(to) or not fs.rename(p, to):
            fs.delete(p, False)
            raise RuntimeError(f"version {new['version']} of {self.root} was written by another")
        self.manifest = new

    def compact(self, buckets: dict[str, list[str]] | None = None) -> None:
        """Writes these buckets of tables (all that have several segments) as one segment each."""
        buckets = buckets or {t: [b for b, s in x["segments"].items() if len(s) > 1] for t, x in self.manifest["tables"].items()}
        new = json.loads(json.dumps(self.manifest))
        new["version"] += 1
        name, tables = f"v{new['version']:09d}-{uuid.uuid4().hex[:8]}", self.manifest["tables"]
        self._add_all(new, [(t, name, tables[t]["key"], tables[t]["owner"], self._merged(t, of), None, of) for t, of in buckets.items() if of])
        self._publish(new)

    def vacuum(self) -> int:
        """Deletes segments that the manifest does not name, and earlier manifests; how many segments went. Call it when no reader of an earlier version is left."""
        gone = 0
        for table in self.manifest["tables"]:
            named = {n for s in self.manifest["tables"][table]["segments"].values() for n, _ in s}
            p, fs = self._path(f"{self.root}/data/{table}")
            for s in fs.listStatus(p):
                if s.getPath().getName() not in named:
                    gone += fs.delete(s.getPath(), True)
        for name in self._manifests()[:-1]:
            p, fs = self._path(f"{self.root}/manifests/{name}")
            fs.delete(p, False)
        return gone


def stores(spark: SparkSession, base: str) -> list[tuple[str, int]]:
    """Name and version of each store in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
    return [(n, v) for n in names if (v := Store(spark, f"{base}/{n}").version) >= 0]


def delete_store(spark: SparkSession, base: str, name: str) -> bool:
    """Deletes a store of a folder, its manifests first, so that no reader finds half of it. Whether there was one."""
    if "/" in name or name in ("", ".", ".."):
        raise ValueError("a store's name is one folder's")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p, "manifests"), True)
    return fs.delete(p, True)
