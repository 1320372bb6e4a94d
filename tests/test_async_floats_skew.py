"""Unawaited calls of the project's own async functions, by names that few or very many calls have."""

from tessera.operators import detect


def test_frequent_names_are_not_dealt_by_name(spark):
    rows = [(f"f{i}.js", i, api) for i in range(300) for api in ("log", "load", f"own{i % 7}", None)] + [("f0.js", 0, "load")]
    calls = spark.createDataFrame(rows, "file string, line int, api string")
    names = spark.createDataFrame([("load",), ("load",), ("own3",), ("own5",), ("never",), (None,)], "name string")
    known = spark.createDataFrame([("f1.js", 1, "load"), ("f3.js", 3, "own3")], "file string, line int, api string")
    want = sorted(r for r in rows if r[2] in ("load", "own3", "own5") and r not in (("f1.js", 1, "load"), ("f3.js", 3, "own3")))
    assert sorted(map(tuple, detect.user_async_floats(calls, names, known).collect())) == want
    got = detect.user_async_floats(calls, names, known, often=100)
    assert sorted(map(tuple, got.select("file", "line", "api").collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan  # all calls of "log" met in one task
