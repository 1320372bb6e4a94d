"""What a source means is looked for once a folder, and frequent sources do not meet in one task."""

from tessera.operators import crossfile


def test_sources_are_resolved_once_a_folder(spark, monkeypatch):
    files = spark.createDataFrame([(p, p) for p in ("src/a.js", "src/b/index.ts", "src/b/a.js", "lib/zed.ts")], "path string, ord string")
    said = [("./a", "src/a.js", "src/b/a.js"), ("./b", "src/b/index.ts", None), ("../lib/zed", "lib/zed.ts", "lib/zed.ts"), ("react", None, None), (None, None, None), ("./none", None, None)]
    rows = [(f"{at}/f{i}.js", "x", s, 1, (a, b)[at == "src/b"]) for i in range(30) for at in ("src", "src/b") for s, a, b in said]
    imports = spark.createDataFrame([r[:4] for r in rows], "file string, local_name string, source string, line int")
    looked_for = []
    real = crossfile.materialize
    monkeypatch.setattr(crossfile, "materialize", lambda df: looked_for.append(df.count()) or real(df))
    for often in (10, 10_000):
        monkeypatch.setattr(crossfile, "OFTEN", often)
        out = crossfile.resolve_paths(imports, files)
        assert out.columns == ["file", "source", "local_name", "line", "target"]
        assert sorted(map(str, out.select("file", "source", "target").collect())) == sorted(f"Row(file={f!r}, source={s!r}, target={t!r})" for f, _, s, _, t in rows)
    assert looked_for == [8, 8]  # of two folders; it was every file's sources, 240
