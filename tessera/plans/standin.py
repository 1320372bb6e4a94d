"""Graph P: a graph of files, functions and classes made of the relational tables, so that graph operators run on them.

Regions and nations stand for files, suppliers for classes, parts for functions. Regions contain nations,
nations suppliers; suppliers import the parts of first order lines; the part of an order's first line calls
that of its second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.rank import EDGE_WORTH


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")

    def part(table: str, i: int, kind: str, prefix: str, key: str, name: str) -> DataFrame:
        t = read(spark, d, table)
        own = table == "part"
        return t.select(
            F.concat(F.lit(f"{prefix}:"), key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), (F.array("p_type", "p_brand") if own else none).alias("tags"),
            (F.col("p_type") if own else F.lit("")).alias("summary"), (F.col("p_brand") if own else F.col(name)).alias("file_path"), (F.lit(i * 10**12) + F.col(key)).cast("long").alias("ord"),
        )

    a = part("region", 0, "file", "r", "r_regionkey", "r_name").unionByName(part("nation", 1, "file", "n", "n_nationkey", "n_name"))
    return a.unionByName(part("supplier", 2, "class", "s", "s_suppkey", "s_name")).unionByName(part("part", 3, "function", "p", "p_partkey", "p_name"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    i = lambda p, c: F.concat(F.lit(f"{p}:"), c)
    n, s, lines = (read(spark, d, t) for t in ("nation", "supplier", "lineitem"))
    one, two = (lines.where(F.col("l_linenumber") == k).select("l_orderkey", F.col("l_partkey").alias(f"p{k}")) for k in (1, 2))
    parts = [
        ("contains", n.select(i("r", F.col("n_regionkey")).alias("source"), i("n", F.col("n_nationkey")).alias("target"))),
        ("contains", s.select(i("n", F.col("s_nationkey")).alias("source"), i("s", F.col("s_suppkey")).alias("target"))),
        ("imports", lines.where("l_linenumber = 1").select(i("s", F.col("l_suppkey")).alias("source"), i("p", F.col("l_partkey")).alias("target")).distinct()),
        ("calls", one.join(two, "l_orderkey").where("p1 <> p2").select(i("p", F.col("p1")).alias("source"), i("p", F.col("p2")).alias("target")).distinct()),
    ]
    out = None
    for k, x in parts:
        order = F.concat(F.lit(f"{('contains', 'imports', 'calls').index(k)}\x01"), "source", F.lit("\x01"), "target")
        x = x.select("source", "target", F.lit(k).alias("type"), F.lit(EDGE_WORTH[k]).alias("weight"), order.alias("ord"))
        out = x if out is None else out.unionByName(x)
    return out


NODES_SQL = """
nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'file' AS type, r_name AS name, []::VARCHAR[] AS tags, '' AS summary, r_name AS file_path, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'file', n_name, [], '', n_name, 1000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'class', s_name, [], '', s_name, 2000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'function', p_name, [p_type, p_brand], p_type, p_brand, 3000000000000 + p_partkey FROM part)"""
EDGES_SQL = """
plain_edges AS (
  SELECT 'r:' || n_regionkey AS source, 'n:' || n_nationkey AS target, 'contains' AS type, 0.5::DOUBLE AS weight, '0' AS k FROM nation
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'contains', 0.5, '0' FROM supplier
  UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey, 'imports', 0.7::DOUBLE, '1' FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT DISTINCT 'p:' || a.l_partkey, 'p:' || b.l_partkey, 'calls', 1.0::DOUBLE, '2'
    FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_partkey <> b.l_partkey),
edges AS (SELECT source, target, type, weight, k || chr(1) || source || chr(1) || target AS ord FROM plain_edges),
links AS (
  SELECT source AS node, target AS other, weight AS worth, ord FROM edges
  UNION ALL SELECT target, source, weight, ord FROM edges)"""


def score_sql(tokens: list[str]) -> str:
    """The keyword score of the columns of nodes."""

    def one(t: str) -> str:
        return (
            f"((CASE WHEN lower(name) = '{t}' THEN 0.4::DOUBLE WHEN contains(lower(name), '{t}') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"
            f" + (CASE WHEN list_contains([lower(x) FOR x IN tags], '{t}') THEN 0.3::DOUBLE WHEN len([x FOR x IN tags IF contains(lower(x), '{t}')]) > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)"
            f" + (CASE WHEN contains(lower(summary), '{t}') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)"
            f" + (CASE WHEN contains(lower(file_path), '{t}') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END))"
        )

    each = [one(t) for t in tokens]
    best = f"greatest({', '.join(each)})" if len(each) > 1 else each[0]
    return f"least({best} * 0.7::DOUBLE + ({' + '.join(each)}) / {len(each)}.0::DOUBLE * 0.3::DOUBLE, 1.0::DOUBLE)"


#: Two hops from seeds (id, rank), as tables step1, new1, best1, step2, new2 and grown.
GROW_SQL = """
front0 AS (SELECT id, 1.0::DOUBLE AS score, rank FROM seeds),
step1 AS (
  SELECT l.other AS id, f.score * 0.7::DOUBLE + l.worth * 0.3::DOUBLE + 0.0::DOUBLE AS score, -f.score AS p, f.rank AS prank, l.ord
  FROM links l JOIN front0 f ON l.node = f.id WHERE l.other NOT IN (SELECT id FROM front0)),
new1 AS (SELECT * FROM step1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, prank, ord, score) = 1),
best1 AS (
  SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, p, prank, ord) AS rank FROM new1 WHERE score >= 0.2
  QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, p, prank, ord) <= 5),
step2 AS (
  SELECT l.other AS id, f.score * 0.7::DOUBLE + l.worth * 0.3::DOUBLE + 0.0::DOUBLE AS score, -f.score AS p, f.rank AS prank, l.ord
  FROM links l JOIN best1 f ON l.node = f.id WHERE l.other NOT IN (SELECT id FROM front0 UNION SELECT id FROM new1)),
new2 AS (SELECT * FROM step2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, prank, ord, score) = 1),
grown AS (SELECT id, score FROM front0 UNION ALL SELECT id, score FROM new1 UNION ALL SELECT id, score FROM new2)"""
