import json

from tessera.sources import sinks


def test_sarif_in_parts(spark):
    n = 2000
    found = spark.range(n).selectExpr("if(id % 3 = 0, 'listener_parity', 'own') detector", "'low' severity", "'one.js' file", "cast(id as int) line", "concat('s', id) subject")
    parts = sinks.sarif(found, "tessera", "1", most=100).collect()
    logs = [json.loads(p.report) for p in parts]
    assert len(parts) == 20 and max(len(x["runs"][0]["results"]) for x in logs) < 200  # no task holds more, though all are of one file
    whole = json.loads(sinks.sarif(found, "tessera", "1").first().report)["runs"][0]
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(key(r) for x in logs for r in x["runs"][0]["results"]) == sorted(map(key, whole["results"]))
    assert {key(r) for x in logs for r in x["runs"][0]["tool"]["driver"]["rules"]} == {key(r) for r in whole["tool"]["driver"]["rules"]}
    assert sinks.sarif(found.limit(0), "tessera", "1", most=100).count() == 0
