"""Nearest vectors for a table of query vectors: coarse lists, searched in blocks, with bounds that make the result exact.

Vectors of length one are dealt to the nearest of some centroids. A query searches its nearest lists; what it has found then
bounds, by the triangle inequality with each list's radius, which other lists can hold anything nearer, and those are
searched too. Where vectors lie in clusters that is a small part of them all; where they do not it is more, but never less than is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vector import dot, doubles
from tessera.operators.tables import materialize

SLACK = 1e-6  # for rounding, in distances of at most 2


@dataclass
class Index:
    """lists: (id, v, list, far); centroids, and the radius and size of each list."""

    lists: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    size: np.ndarray


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy().reshape(-1, dim)


def _unit(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of length one; nulls, zeros and those with a null go."""
    v = doubles(F.col(vector_col))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    rows = rows.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))).where("norm > 0")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def centroids_of(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """n centroids of length one, by a few rounds of k-means."""
    r = np.random.default_rng(seed)
    c = sample[r.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def build(vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", n_lists: int | None = None, sample: int = 20_000, most_lists: int = 1024) -> Index:
    """An index of all vectors (id, embedding) of one length. Centroids are fitted on `sample` of them, which a hash of the vector picks; every vector is indexed."""
    rows = materialize(_unit(vectors, id_col, vector_col))
    n = rows.count()
    if not n:
        return Index(rows.withColumns({"list": F.lit(0), "far": F.lit(0.0)}), np.zeros((1, 1)), np.zeros(1), np.zeros(1, np.int64))
    share = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.lit(min(1 << 20, max(1, (sample << 20) // n)))
    got = rows.where(share).orderBy(F.xxhash64("v"), "id").limit(sample).select("v").toArrow().column("v")  # the sample's bound
    if not len(got):
        got = rows.limit(1).select("v").toArrow().column("v")
    dim = len(got[0])
    points = np.unique(_matrix(got, dim), axis=0)
    c = centroids_of(points, min(len(points), n_lists or min(most_lists, max(1, round(n**0.5)))))
    shared = rows.sparkSession.sparkContext.broadcast(c)  # most_lists vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1), dim)
                near = v @ shared.value.T
                own = near.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(own)), own])))], names=["id", "v", "list", "far"])

    lists = materialize(rows.mapInArrow(assign, f"id {dict(rows.dtypes)['id']}, v array<double>, list int, far double"))
    radius, size = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for x in lists.groupBy("list").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect():  # a row a list
        radius[x.list], size[x.list] = x.r, x.n
    return Index(lists, c, radius, size)


def _probes(index: Index, dim: int, probes: int | None) -> Callable:
    """(qid, v, list): a query with each list to search: the nearest ones, or with `probes` unset those that its bound leaves and the nearest were not."""
    c, radius, size = index.centroids, index.radius, index.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            far = np.sqrt(np.maximum(0, 2 - 2 * (_matrix(b.column(1), dim) @ c.T)))
            far[:, size == 0] = np.inf
            order = np.argsort(far, axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
            if probes is not None:
                wanted = place < probes
            else:
                done, bound = b.column(2).to_numpy()[:, None], b.column(3).to_numpy()[:, None]
                wanted = (place >= done) & (far - radius[None, :] <= bound + SLACK)
            q, k = np.nonzero(wanted & (size > 0)[None, :])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), b.column(1).take(pa.array(q)), pa.array(k.astype(np.int32))], names=["qid", "v", "list"])

    return run


def _search(index: Index, asked: DataFrame, kind: str, id_kind: str, dim: int, k: int, block: int) -> DataFrame:
    """(qid, id, score): up to k nearest of each list for each query that asks it, in blocks of vectors and of queries."""
    n_asked = {x.list: x.n for x in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    parts = [(i, -(-int(index.size[i]) // block), -(-n // block)) for i, n in sorted(n_asked.items())]
    spark = asked.sparkSession
    if not parts:
        return spark.createDataFrame([], f"qid {kind}, id {id_kind}, score double")
    of = F.broadcast(spark.createDataFrame(parts, "list int, a int, b int"))  # a row a list
    vectors = index.lists.join(of, "list").select("list", F.pmod(F.xxhash64("id"), F.col("a")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("y"), "id", "v")
    queries = asked.join(of, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("x"), F.pmod(F.xxhash64("qid"), F.col("b")).cast("int").alias("y"), "qid", F.col("v").alias("qv"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = _matrix(right.column("qv"), dim) if right.num_rows else None, _matrix(left.column("v"), dim) if left.num_rows else None
        rows, cols, scores = [], [], []
        for i in range(0, right.num_rows if v is not None else 0, 512):
            near = np.round(q[i : i + 512] @ v.T, 9)
            most = min(k, near.shape[1])
            bound = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most]
            a, b = np.nonzero((near >= bound[:, None]) & (near > 0))  # ties with the last stay, ids decide later
            rows.append(a + i)
            cols.append(b)
            scores.append(near[a, b])
        take = lambda t, name, at: t.column(name).combine_chunks().take(pa.array(np.concatenate(at) if at else np.empty(0, np.int64)))
        return pa.Table.from_arrays([take(right, "qid", rows), take(left, "id", cols), pa.array(np.concatenate(scores) if scores else np.empty(0))], names=["qid", "id", "score"])

    by = ["list", "x", "y"]
    vectors = vectors.withColumn("x", F.col("x").cast("int"))
    return vectors.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(best, f"qid {kind}, id {id_kind}, score double")


def nearest(index: Index, queries: DataFrame, id_col: str = "id", vector_col: str = "embedding", k: int = 10, probes: int = 4, block: int = 4096) -> DataFrame:
    """(qid, rank, id, score): the k indexed vectors of greatest cosine with each query (id, embedding), above 0; ties (to nine places) by id.

    Queries without a direction have no rows. The result does not depend on the lists or on `probes`.
    """
    asked = materialize(_unit(queries, id_col, vector_col).withColumnRenamed("id", "qid"))
    kind, id_kind, dim = dict(asked.dtypes)["qid"], dict(index.lists.dtypes)["id"], index.centroids.shape[1]
    if not index.size.sum():
        return asked.limit(0).join(index.lists.limit(0).select("id"), F.lit(False), "left").select("qid", F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score"))
    first = lambda df: df.withColumn("rank", F.expr("row_number() over (partition by qid order by score desc, id)")).where(F.col("rank") <= k)
    asks = f"qid {kind}, v array<double>, list int"
    near = materialize(first(_search(index, materialize(asked.mapInArrow(_probes(index, dim, probes), asks)), kind, id_kind, dim, k, block)))
    last = near.groupBy("qid").agg(F.min("score").alias("last"), F.count("*").alias("n"))
    # fewer than k so far: everything of a positive cosine is nearer than the square root of 2
    bound = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("last")))).otherwise(F.lit(2.0**0.5))
    rest = asked.join(last, "qid", "left").select("qid", "v", F.lit(probes).alias("done"), F.coalesce(bound, F.lit(2.0**0.5)).alias("bound"))
    more = _search(index, materialize(rest.mapInArrow(_probes(index, dim, None), asks)), kind, id_kind, dim, k, block)
    return first(near.drop("rank").unionByName(more)).select("qid", "rank", "id", "score")
