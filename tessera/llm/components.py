"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release, written


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge; root is the least node of the component.

    Self loops, repeated edges and null ends are ignored; no edges give no rows. Each round is written
    to the shared folder, so a lost executor costs one round. Links stay distributed throughout. A node with more
    than a thousandth of all links, of which there are 2,000 at most, is joined by broadcast, so its links are
    not gathered in one task.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    e = materialize(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    said = _print_of(e)
    for _ in range(max_rounds):
        if not said[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _joined(both, least, said[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _joined(large, floor, said[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        since = written()
        e = materialize(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(e.sparkSession, since - 1, (e,))  # the edges of the round before
        now = _print_of(e)
        if now == said:
            break
        said = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _joined(links: DataFrame, nodes: DataFrame, total: int, many: int = 1_000_000) -> DataFrame:
    """links (u, v) with m of nodes (u, m, n); of very many links those of hubs meet their nodes where they are."""
    if total < many:
        return links.join(nodes.drop("n"), "u")
    hubs = F.broadcast(nodes.where(F.col("n") > 2 * total // 1000).drop("n"))  # 2 * total link ends make 1,000 of these at most, and as many again in `large`
    rest = nodes.where(F.col("n") <= 2 * total // 1000).drop("n")
    return links.join(hubs, "u").unionByName(links.join(hubs.drop("m"), "u", "left_anti").join(rest, "u"))


def _print_of(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
