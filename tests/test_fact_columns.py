"""Facts lie in typed columns: reading one kind parses nothing and reads its own columns only, with the values that the extractor gave."""

from tessera.operators.tables import materialize
from tessera.plans import mixed, services
from tessera.sources import extract, javascript

TEXT = mixed.HEAD + "".join(t.replace("{o}", str(i)) for i, (t, *_) in enumerate(mixed.FRAGMENTS)) + "import * as fs from 'fs';\nexport class Box {\n  constructor(c) { this.c = c; }\n}\nconst box = new Box(row10), got = make(`é\\n`);\nwindow.x['\\u0041'] = 1;\n"


def test_fields_are_those_of_the_extractor(spark):
    facts = materialize(extract.extract_facts(spark.createDataFrame([("a.js", TEXT)], "path string, content string")), by="fact")
    said = javascript.extract(TEXT)
    assert len({f for f, _ in said}) > 18
    for kind, columns in extract.PLACES.items():
        rows = [tuple(f.get(c) for c in columns) for k, f in said if k == kind]
        want = rows if kind == "hook" else set(rows)
        got = extract.table(facts, kind)
        assert got.columns == ["file", *columns]
        assert sorted(map(str, (tuple(r)[1:] for r in got.collect()))) == sorted(map(str, want)), kind


def test_a_kind_is_read_without_parsing(spark):
    facts = materialize(extract.extract_facts(spark.createDataFrame([("a.js", TEXT)], "path string, content string")), by="fact")
    plan = extract.table(facts, "access").select("var")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan  # all fields of a row were parsed each time that one was read
    assert f"ReadSchema: struct<{extract.PLACES['access']['var']}:string>" in plan


def test_other_extractors(spark):
    def own(_):
        return [
            ("export", {"name": "a", "line": "no number", "is_default": 1}), ("export", {"name": "b", "line": 1 << 40}), ("export", {"line": 3, "name": "c", "more": []}), ("class", {"name": "\ud800"}),
            ("hook", {"hook": "useX", "deps": ["a", 1]}), ("hook", {"hook": "useX", "deps": ["a"]}), ("own", {"a": [1]}), ("own", {"a": [1]}),
        ]

    facts = extract.extract_facts(spark.createDataFrame([("a.js", "")], "path string, content string"), own)
    assert sorted(map(str, (tuple(r) for r in extract.table(facts, "export").collect()))) == sorted(map(str, [("a.js", "a", None, None), ("a.js", "b", None, None), ("a.js", "c", 3, None)]))
    assert [r.deps for r in extract.table(facts, "hook").collect()] in ([None, ["a"]], [["a"], None])
    assert [r.name for r in extract.table(facts, "class").collect()] == ["?"]
    assert [r.fields for r in facts.where("fact = 'own'").collect()] == ['{"a": [1]}'] and facts.where("error is not null").isEmpty()


def test_findings_of_kinds_read_columns_only(spark):
    found = services.findings(services.load(spark.createDataFrame([("src/a.jsx", TEXT)], "path string, content string"), services.FINDING_FACTS))
    assert "from_json" not in found._jdf.queryExecution().executedPlan().toString()
    assert {"strict_comparison", "global_write_race", "state_mutation"} <= {r.detector for r in found.collect()}
