"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, id_text, materialize

#: Weights that sources take in turn, by code point order of their names, null last.
WEIGHTS = (5.0, 2.0, 1.0)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with target: share of the total by weight, at most `most` times a source's size.

    The excess over a cap goes to the others by weight until none is above its cap. With sources in
    order of cap / weight the level is where the first one stays under its cap, so windows over the
    sources give it without rounds. One row a source: this table does not grow with the documents.
    """
    n = F.row_number().over(W.orderBy(F.asc_nulls_last("source")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    by = W.orderBy((F.col("cap") / F.col("weight")), F.asc_nulls_last("source"))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    total = F.lit(share) * F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (total - F.col("before")) / F.col("rest"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(W.partitionBy())["level"]
    return s.select("source", "source_size", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")).alias("target"))


def odds(x: Column) -> Column:
    return F.ln(x / (F.lit(1.0) - x))


def pareto_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5, most: float = 2.0, preference: Column | None = None, seed: int = 42, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row; keep names columns of docs to add, as struct `kept`.

    A row of a source with target / size = r is expected r times (with a preference column: more for
    preferred rows, at most `most`). Its whole part is taken for certain. For the rest the rows are
    ranked by random odds over inclusion odds (Pareto order sampling) and taken in that order up to the
    source's target, to the nearest row: the sample's size in words is fixed, the inclusion
    probabilities are unequal where expectations are. Null and empty texts have size 0; a null source
    is a source; repeated rows are rows of their own; an empty table gives no rows.

    No source is sorted as a whole: two histograms of ranks find the small bucket in which the cut
    falls, and only that is ordered (some 1 / 500,000 of a source's rows).
    """
    pref = F.lit(1.0) if preference is None else preference.cast("double")
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), pref.alias("pref"),
        uniform(id_text(F.col(id_col)), seed).alias("u"), *[F.struct(*keep).alias("kept")] * bool(keep),
    )
    rows = materialize(rows, "sizes")
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("pref")).alias("wanted"))
    goal = targets(stats.select("source", "source_size"), weights, share, most)
    goal = goal.withColumnRenamed("source", "s").join(stats.select("source", "wanted"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    goal = materialize(goal, "targets")

    def per_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        r = right.withColumnRenamed("source", "s")
        return left.join(r, left["source"].eqNullSafe(r["s"]), how).drop("s")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    expected = ratio if preference is None else F.least(F.lit(most), F.when(F.col("wanted") > 0, ratio * F.col("pref") * F.col("source_size") / F.col("wanted")).otherwise(ratio))
    ranked = per_source(rows, goal).withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn("chance", F.col("expected") - F.col("whole"))
    ranked = ranked.withColumn("rank", F.when(F.col("chance") > 0, odds(F.col("u")) - odds(F.col("chance"))))
    ranked = ranked.withColumn("b1", F.floor(F.col("rank") * 32)).withColumn("b2", F.floor(F.col("rank") * (32 * 4096)))
    wanted = ranked.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("extra"))

    def cut(buckets: DataFrame, b: str, already: Column) -> DataFrame:
        """source, the bucket in which the extra words run out, and the words before it."""
        w = W.partitionBy("source").orderBy(b)
        upto = buckets.withColumn("upto", already + F.sum("words").over(w)).withColumn("before", F.col("upto") - F.col("words"))
        return upto.where("before < extra and upto >= extra").groupBy("source").agg(F.min(b).alias(f"at_{b}"), F.min("before").alias(f"before_{b}"), F.max("extra").alias("extra"))

    lot = ranked.where("rank is not null")
    first = per_source(lot.groupBy("source", "b1").agg(F.sum("size").alias("words")), wanted)
    cut1 = materialize(cut(first, "b1", F.lit(0)), "cut")
    second = per_source(lot, cut1).where("b1 = at_b1").groupBy("source", "b2").agg(F.sum("size").alias("words"), F.max("before_b1").alias("start"), F.max("extra").alias("extra"))
    cut2 = materialize(cut(second, "b2", F.col("start")), "cut")
    cuts = wanted.select("source", F.col("extra").alias("of_extra"))
    cuts = per_source(per_source(cuts, cut1.select("source", "at_b1"), "left"), cut2.select("source", "at_b2", "before_b2"), "left")
    cuts = materialize(cuts, "cuts")
    out = per_source(ranked, cuts)
    w = W.partitionBy("source").orderBy("rank", "id", "size")
    edge = out.where("b2 = at_b2").withColumn("middle", F.col("before_b2") + F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2)
    edge = edge.withColumn("more", F.when(F.col("middle") <= F.col("of_extra"), 1).otherwise(0))
    # without a cut bucket nothing more is wanted, or all is
    inside = F.when(F.col("rank").isNull(), 0).when(F.col("at_b2").isNull(), F.when(F.col("of_extra") > 0, 1).otherwise(0)).when(F.col("b2") < F.col("at_b2"), 1).otherwise(0)
    rest = out.where("not (b2 <=> at_b2) or rank is null").withColumn("more", inside)
    cols = [*["kept"] * bool(keep), "id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).cast("long").alias("copies")]
    both = rest.select(*cols).unionByName(edge.select(*cols))
    return both.select(*["kept"] * bool(keep), F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
