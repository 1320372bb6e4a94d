import json

from tessera.plans import code_queries
from tessera.sources import sinks


def test_json_report_in_parts(spark):
    n = 2000
    found = spark.range(n).selectExpr("if(id % 3 = 0, 'listener_parity', 'own') detector", "'low' severity", "'one.js' file", "cast(id as int) line", "concat('s', id) subject")
    best = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "pattern_id string, confidence double")
    parts = sinks.json_report(found, best, most=100).collect()
    reports = [json.loads(p.report) for p in parts]
    size = lambda r: sum(map(len, r["findings"].values()))
    assert len(parts) == 20 and max(map(size, reports)) < 200  # no task holds more, though all are of one file
    whole = json.loads(sinks.json_report(found, best).first().report)
    assert {r["verdict"] for r in reports} == {"EVIDENCE"} and all(r["patterns"] == whole["patterns"] for r in reports)
    rows = lambda r: [(d, json.dumps(x, sort_keys=True)) for d, xs in r["findings"].items() for x in xs]
    assert sorted(x for r in reports for x in rows(r)) == sorted(rows(whole))
    assert [(r.part, r.report) for r in sinks.json_report(found.limit(0), best, most=100).collect()] == [(0, sinks.json_report(found.limit(0), best).first().report)]


def test_query_reads_parts(spark, sf_dir, monkeypatch):
    seen, real = [], sinks.json_report
    monkeypatch.setattr(sinks, "json_report", lambda *a, **k: seen.append(k) or real(*a, **{**k, "most": 50}))
    got = {r.detector: r.n for r in code_queries.code_json_report(spark, sf_dir).collect()}
    assert seen[0]["most"] <= 10_000  # all findings were one value
    assert got == {r.detector: r["count"] for r in code_queries.code_findings(spark, sf_dir).groupBy("detector").count().collect()}
