"""Extraction, detectors on real sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import streaming
from tessera.operators import patterns
from tessera.plans import services
from tessera.sources import extract, files, javascript, sinks

CTX = "let tenant = null;\nexport let cache = make();\nexport function setTenant(t) { tenant = t; }\nexport function getTenant() { return tenant; }\nexport function reset() { cache = {}; }\nexport async function save(x) { return x; }\n"
MAIN = """import { setTenant, getTenant, cache, save } from './ctx.js';
import { Holder } from './holder.js';
let last = 0;
const held = getTenant();
const holder = new Holder(cache);
export async function handle(req) {
  last = req.id;
  try { setTenant(req.t); await check(req); } catch (e) { log(e); }
  save(req);
}
async function safe(x) { await save(x); last = x; }
function isAdult(x) { return x.age > 18; }
items.forEach((i) => { items.delete(i); grow(i); });
function grow(i) { items.add(i); }
el.addEventListener('click', onClick, { capture: true });
el.removeEventListener('click', onClick);
el.addEventListener('move', onMove);
"""
HOLDER = "export class Holder {\n  constructor(c) { this.cache = c; }\n}\n"
REACT = """import React, { useState, useEffect } from 'react';
export function View() {
  const [items, setItems] = useState([]);
  const opts = {};
  useEffect(() => { const t = setInterval(tick, 100); });
  useEffect(() => { load(); return () => stop(); }, [opts]);
  items.push(1);
  setItems([...items, 2]);
}
"""


@pytest.fixture(scope="module")
def project(spark):
    return services.load(files.inline_files(spark, [{"name": "src/ctx.js", "content": CTX}, {"name": "src/main.js", "content": MAIN}, {"name": "src/holder.js", "content": HOLDER}, {"name": "src/View.jsx", "content": REACT}, {"name": "notes.md", "content": "x"}, {"name": "empty.js", "content": ""}]))


@pytest.fixture(scope="module")
def found(project):
    out = {}
    for x in services.findings(project).collect():
        out.setdefault(x.detector, set()).add((x.file, x.line, x.subject))
    return out


def test_races(found):
    assert found["global_write_race"] == {("src/main.js", 7, "last"), ("src/main.js", 8, "setTenant (UNRESOLVED)")} or found["global_write_race"] == {("src/main.js", 8, "setTenant (UNRESOLVED)")}
    assert ("src/main.js", 11, "last") not in found["global_write_race"]


def test_captures(found):
    assert found["constructor_capture"] == {("src/main.js", 5, "cache")}
    assert found["stale_module_capture"] == {("src/main.js", 4, "held")}


def test_loops_and_listeners(found):
    assert ("src/main.js", 13, "items") in found["foreach_mutation"]
    assert found["listener_parity"] == {("src/main.js", 15, "click")}
    assert found["orphan_listener"] == {("src/main.js", 17, "move")}


def test_promises_and_predicates(found):
    assert ("src/main.js", 9, "save") in found["floating_promise"] and ("src/main.js", 11, "save") not in found["floating_promise"]
    assert found["strict_comparison"] == {("src/main.js", 12, "isAdult")}


def test_react(project, found):
    assert ("src/View.jsx", 7, "items") in found["state_mutation"]
    kinds = {(json.loads(x.details)["type"], x.line) for x in services.findings(project).where("detector = 'react_pattern'").collect()}
    assert {("effect_without_cleanup", 5), ("effect_without_deps", 5), ("unstable_dependency", 6), ("state_hook", 3)} <= kinds and ("effect_without_cleanup", 6) not in kinds


def test_map_and_analysis(spark, project):
    nodes, edges, hashes = services.build_map(project)
    got = {(x.source, x.target, x.type) for x in edges.collect()}
    assert ("file:src/main.js", "file:src/ctx.js", "imports") in got and ("file:src/ctx.js", "func:src/ctx.js:setTenant", "contains") in got
    assert ("func:src/main.js:handle", "func:src/ctx.js:save", "calls") in got
    assert hashes.count() == 6 and nodes.where("type = 'class'").count() == 1
    a = services.analyze(project, "tenant race in handle", patterns.starters(spark))
    assert "global_write_race" in {x.pattern_id for x in a["patterns"].collect()}
    assert a["files"].orderBy("rank").first().file_path in ("src/main.js", "src/ctx.js")
    again, counts = services.refresh(spark, project.files, (nodes, edges, hashes))
    assert counts == {} and again[0] is nodes


def test_refresh_equals_build(spark, project):
    old = services.build_map(project)
    changed = project.files.withColumn("content", F.when(F.col("path") == "src/holder.js", F.lit("export function fresh() {}")).otherwise(F.col("content")))
    (nodes, edges, hashes), counts = services.refresh(spark, changed, old)
    want = services.build_map(services.load(changed))
    assert counts == {"changed": 1}
    for x, y in zip((nodes, edges, hashes), want, strict=True):
        assert sorted(map(str, x.select(*sorted(y.columns)).collect())) == sorted(map(str, y.select(*sorted(y.columns)).collect()))


def test_claims(spark, project):
    rows = [
        (1, "in src/main.js L8 the tenant is set too early", ["h"], ["main.js L8: `setTenant(req.t); await check(req);`"], "main.js", 8, 0.9),
        (2, "in nowhere.js L3", ["h"], ["`not in any file`"], "nowhere.js", 3, 0.9),
        (3, "no citation", ["h"], [], None, None, 0.9),
        (4, "src/main.js:8", [], [], None, None, 0.9),
        (5, "src/main.js:8", ["h"], [], "main.js", 500, 0.9),
    ]
    c = spark.createDataFrame(rows, "claim_id int, root_cause string, hypotheses array<string>, evidence array<string>, location_file string, location_line int, confidence double")
    got = {x.claim_id: (x.status, round(x.adjusted, 2)) for x in services.check_claims(c, project.files).collect()}
    assert got == {1: ("PASSED", 0.9), 2: ("REJECTED", 0.4), 3: ("PROTOCOL_VIOLATION", 0.9), 4: ("PROTOCOL_VIOLATION", 0.9), 5: ("FAILED", 0.6)}


def test_scanner():
    code = "const s = 'a // b'; /* { */ let r = /[/{]/.test(`x ${f(1)} }`); // }\n"
    src = [t.text for t in javascript.scan(code)]
    assert "'a // b'" in src and "/[/{]/" in src and "f" in src
    assert not [d for f, d in javascript.extract(code) if f == "parse" and d["errors"]]
    for bad in ("", "{{{", "function (", "a => ", "`${", "/*", "class", "import", "export {", "x = ", "'", "const {", ")]}"):
        javascript.extract(bad)


def test_destructuring_and_members():
    w = {d["var"] for f, d in javascript.extract("function f() { a.b.c = 1; x[0] += 2; ({ p, q: z } = o); [m, n] = o; k++; }") if f == "access" and d["kind"] == "write"}
    assert {"a.b.c", "x[]", "k"} <= w


def test_failing_extractor_keeps_the_row(spark):
    def bad(code):
        raise RuntimeError("no")

    got = extract.extract_facts(spark.createDataFrame([("a.js", "x"), ("b.md", "y")], "path string, content string"), bad).collect()
    assert [(x.file, x.fact, x.error) for x in got] == [("a.js", None, "RuntimeError: no")]


def test_regex_bridge(spark):
    code = "import a from 'm1';\nexport * from \"m2\";\nconst b = require('m3'); /* c\n */ // d\nimport('m4');\nexport { x as y, z };\nexport class K {}\n"
    r = spark.createDataFrame([(code,)], "c string").select(extract.import_sources(F.col("c")).alias("i"), extract.exported_names(F.col("c")).alias("e"), extract.class_names(F.col("c")).alias("k"), extract.without_comments(F.col("c")).alias("w")).first()
    assert sorted(r.i) == ["m1", "m2", "m3", "m4"] and set(r.e) == {"y", "z", "K"} and r.k == ["K"]
    assert r.w.count("\n") == code.count("\n") and " c" not in r.w.split("m3")[1].split("m4")[0] and "d" not in r.w.split("\n")[3]


def test_scan_and_documents(spark, tmp_path):
    for p, c in {"src/a.js": "x", "src/a.test.js": "x", "node_modules/m.js": "x", "src/big.js": "y" * 600_000, "src/b.txt": "x", "a/b/c/d/e/f/g.js": "x", "test/t.js": "x", "README.md": "# hi"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    assert {x.path for x in files.scan_directory(spark, str(tmp_path)).collect()} == {"src/a.js"}
    assert files.scan_directory(spark, str(tmp_path), include=["nothing"]).count() == 0
    docs = files.context_files(files.texts(spark, str(tmp_path), "*.md"))
    assert [(x.content, x.trust) for x in docs.collect()] == [("# hi", "medium")]
    deps = spark.createDataFrame([("package.json", '{"dependencies":{"a":"1","b":"2"},"devDependencies":{"c":"1"}}'), ("requirements.txt", "x==1")], "path string, content string")
    assert {(x.kind, tuple(x.names)) for x in files.dependencies(deps).collect()} == {("runtime", ("a", "b")), ("development", ("c",))}
    with pytest.raises(ValueError, match="no files"):
        files.resolve_source(spark)


def test_sinks(spark, project, tmp_path):
    found = services.findings(project)
    report = json.loads(sinks.sarif(found, "tessera", "1").first().report)
    assert report["version"] == "2.1.0" and len(report["runs"][0]["results"]) == found.count()
    m = spark.createDataFrame([("p", 0.9)], "pattern_id string, confidence double")
    assert json.loads(sinks.json_report(found, m).first().report)["verdict"] == "EVIDENCE"
    assert json.loads(sinks.json_report(found.limit(0), m).first().report)["verdict"] == "STATIC_BLIND"
    assert sinks.text_report(found).count() == found.select("detector").distinct().count()
    g = services.build_map(project)
    sinks.save_graph(*g, str(tmp_path / "g"))
    back = files.load_graph(spark, str(tmp_path / "g"))
    assert [x.count() for x in back] == [x.count() for x in g]
    assert sinks.mermaid(g[1]).first().diagram.startswith("graph LR\n")
    assert sinks.project_overview(*g[:2]).count() > 0


def test_stream_upserts(spark, tmp_path):
    t = str(tmp_path / "t")
    b = lambda *r: spark.createDataFrame(r, "path string, content string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    assert streaming.upsert(b(("a", "1", 0), ("b", "1", 0), ("b", "2", 5)), t, 0) == {"added": 2}
    assert streaming.upsert(b(("a", "1", 6), ("b", "3", 6), ("c", None, 6)), t, 1) == {"changed": 1, "added": 1}
    assert streaming.upsert(b(("a", "1", 6), ("b", "3", 6), ("c", None, 6)), t, 1) == {"changed": 1, "added": 1}
    assert {(x.path, x.content) for x in streaming.current(spark, t).collect()} == {("a", "1"), ("b", "3"), ("c", None)}


def test_closures_of_any_depth(spark):
    """A variable seven functions up is captured, and so are all on the way."""
    head = "".join(f"{'  ' * k}function f{k}() {{\n{'  ' * k}  let v{k} = {k};\n" for k in range(8))
    source = head + "  " * 8 + "return v0 + v1 + v6 + v7;\n" + "".join("  " * k + "}\n" for k in range(7, -1, -1))
    p = services.load(spark.createDataFrame([("src/deep.js", source)], "path string, content string"))
    got = {x.fn: x.vars for x in services.closures(p).collect()}
    assert got["f7"] == ["v0", "v1", "v6"]
