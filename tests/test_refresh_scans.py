"""A refresh with the project of before scans changed files only, and gives the graph of a full build."""

from tessera.operators.tables import materialize
from tessera.plans import services
from tessera.sources import extract


def test_only_changed_files_are_scanned(spark, monkeypatch):
    table = lambda c: spark.createDataFrame(sorted(c.items()), "path string, content string")
    old = {f"src/f{i}.js": f"import {{ go }} from './f{(i + 1) % 12}.js';\nexport function go() {{ go{i}(); }}\n" for i in range(12)}
    new = {**old, "src/f3.js": "export function stay() { go(); }\n", "src/new.js": "import { go } from './f3.js';\ngo();\n"}
    del new["src/f5.js"]
    before = services.load(table(old), extract.MAP_FACTS)
    stored = tuple(materialize(x) for x in services.build_map(before, keep=True))
    scanned, real = [], extract.extract_facts
    monkeypatch.setattr(extract, "extract_facts", lambda files, *a, **k: scanned.extend(r.path for r in files.select("path").collect()) or real(files, *a, **k))
    got, counts = services.refresh(spark, table(new), stored, before)
    assert counts == {"changed": 1, "added": 1, "deleted": 1} and sorted(scanned) == ["src/f3.js", "src/new.js"]  # all twelve were
    want = services.build_map(services.load(table(new), extract.MAP_FACTS))
    for g, w in list(zip(got, want, strict=True))[1:]:
        cols = sorted(w.columns)
        assert sorted(map(str, g.select(*cols).collect())) == sorted(map(str, w.select(*cols).collect()))
    assert sorted(r.id for r in got[0].collect()) == sorted(r.id for r in want[0].collect())
