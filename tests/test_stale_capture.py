"""stale_capture moves its lines once, and counts exactly."""

from pyspark.sql import functions as F

from tessera.operators import detect
from tessera.plans import queries


def test_counts_are_those_of_distinct_counts(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("file"), (F.col("id") % 11).cast("string").alias("var"), F.when(F.col("id") % 13 > 0, F.col("id") % 5).alias("fn"), F.when(F.col("id") % 17 > 0, F.col("id") % 3 == 0).alias("write"))
    rows = rows.unionByName(spark.createDataFrame([(None, "x", 1, True), (1, None, None, True), (1, None, 2, False)], rows.schema))
    w = F.col("write")
    want = rows.groupBy("file", "var").agg(F.count_if(w), F.countDistinct(F.when(w, F.col("fn"))), F.countDistinct(F.when(~w, F.col("fn"))))
    for at_once in (100, 500_000):
        assert sorted(map(str, detect.variable_stats(rows, at_once=at_once).collect())) == sorted(map(str, want.toDF("file", "var", "n_reassigned", "n_writers", "n_readers").collect()))


def test_lines_are_read_once(spark, sf_dir):
    plan = queries.stale_capture(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("RepartitionByExpression") == 1  # the lines were counted twice, each row several times over
