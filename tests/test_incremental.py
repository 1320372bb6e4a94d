"""The bucketed store, and updates against full builds."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import incremental
from tessera.plans import services
from tessera.sources import buckets


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_last_segment_of_an_owner_counts(spark, tmp_path):
    s = buckets.Store(spark, str(tmp_path / "s"), buckets=4, most_segments=3)
    make = lambda xs: spark.createDataFrame(xs, "file string, k string, n int")
    want, r = {}, random.Random(1)
    assert s.read("t") is None and s.version == -1
    for v in range(7):
        owners = [f"f{r.randrange(8)}" for _ in range(2)]
        new = [(o, f"k{r.randrange(10)}", v) for o in set(owners) for _ in range(r.randrange(4))]
        gone = [x for o in set(owners) for x in want.get(o, [])]
        s.commit({"t": ("k", "file", make(new), make(gone))})
        for o in owners:
            want[o] = [x for x in new if x[0] == o]
        all_rows = sorted(x for xs in want.values() for x in xs)
        s = buckets.Store(spark, str(tmp_path / "s"))  # a reader that comes later
        s.most_segments = 3
        assert sorted(map(tuple, s.read("t").collect())) == all_rows
        got = s.read("t", make([("", "k3", 0), ("", "k4", 0)]).select("k"))
        assert sorted(map(tuple, got.collect())) == [x for x in all_rows if x[1] in ("k3", "k4")]
    assert max(len(x) for x in s.manifest["tables"]["t"]["segments"].values()) <= 4 and s.version > 6
    s.compact()
    assert all(len(x) == 1 for x in s.manifest["tables"]["t"]["segments"].values())
    assert sorted(map(tuple, s.read("t").collect())) == all_rows and s.vacuum() > 0
    assert sorted(map(tuple, buckets.Store(spark, str(tmp_path / "s")).read("t").collect())) == all_rows


def test_reads_take_their_buckets_only(spark, tmp_path):
    s = buckets.Store(spark, str(tmp_path / "s"), buckets=16)
    s.commit({"t": ("k", "k", spark.range(1000).select(F.col("id").cast("string").alias("k")), None)})
    one = s.read("t", spark.createDataFrame([("17",)], "k string"))
    assert [x.k for x in one.collect()] == ["17"] and s.buckets_read == 1 and s.rows_read < 150
    assert len(one.inputFiles()) == 1


def test_a_commit_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    t = lambda n: {"t": ("k", "k", spark.createDataFrame([(n,)], "k string"), None)}
    s = buckets.Store(spark, root, buckets=2)
    s.commit(t("a"))
    monkeypatch.setattr(buckets.Store, "_publish", lambda self, new: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.commit(t("b"))
    monkeypatch.undo()
    again = buckets.Store(spark, root)
    assert again.version == 0 and [x.k for x in again.read("t").collect()] == ["a"]
    other = buckets.Store(spark, root)
    again.commit(t("c"))
    with pytest.raises(RuntimeError, match="another"):
        other.commit(t("d"))
    assert sorted(x.k for x in buckets.Store(spark, root).read("t").collect()) == ["a", "c"]
    assert again.vacuum() == 2  # what died and what lost


def test_stores_are_listed_and_deleted(spark, tmp_path):
    for n in ("one", "two"):
        buckets.Store(spark, f"{tmp_path}/{n}", buckets=2).commit({"t": ("k", "k", spark.createDataFrame([(n,)], "k string"), None)})
    (tmp_path / "none").mkdir()
    assert buckets.stores(spark, str(tmp_path)) == [("one", 0), ("two", 0)]
    assert buckets.delete_store(spark, str(tmp_path), "one") and buckets.stores(spark, str(tmp_path)) == [("two", 0)]
    with pytest.raises(ValueError, match="folder"):
        buckets.delete_store(spark, str(tmp_path), "../x")


def script(r, names, files):
    """A script that imports, defines and calls some of a few names."""
    out = []
    for f in r.sample(files, 2):
        source = "./" + f.removeprefix("src/").removesuffix(r.choice([".js", "", "/index.js"]))
        out.append(f"import {{ {r.choice(names)}, {r.choice(names)} }} from '{source}';")
    for n in r.sample(names, 2):
        out.append(f"{r.choice(['', 'export ', 'async '])}function {n}(a) {{ {r.choice(names)}(a); return {r.choice(names)}(a); }}".replace("async function", "export async function"))
    if r.random() < 0.3:
        out.append(f"class C{r.randrange(3)} {{ go() {{ {r.choice(names)}(); }} }}")
    return "\n".join(out) + "\n"


def test_updates_equal_full_builds(spark, tmp_path):
    """Random edits, additions and deletions, one version after another; what is not touched is not scanned."""
    r = random.Random(11)
    names = ["alpha", "beta", "gamma", "delta", "eps"]
    paths = [f"src/{a}.js" for a in "abcdef"] + ["src/lib/index.js", "src/lib/a.js", "src/solo.ts"]
    content = {p: script(r, names, paths) for p in paths[:7]}
    store = buckets.Store(spark, str(tmp_path / "g"), buckets=4, most_segments=2)
    table = lambda c: spark.createDataFrame(sorted(c.items()), "path string, content string")
    for step in range(4):
        done = incremental.update(store, table(content))
        want = services.build_map(services.load(table(content)))
        got = incremental.stored_graph(store)
        for x, y in zip(got, want, strict=True):
            cols = sorted(set(y.columns) & set(x.columns))
            assert rows(x, *cols) == rows(y, *cols), step
        assert done.scanned == sum(n for s, n in done.changes.items() if s != "deleted")
        if step == 1:
            again = incremental.update(store, table(content))
            assert not again.changes and again.scanned == again.linked == 0
        p = paths[(3 * step) % len(paths)]
        if p in content and step % 2:
            del content[p]
        else:
            content[p] = script(r, names, paths)
        if step == 2:
            content["src/solo.ts"] = script(r, names, paths)


def test_a_part_of_the_files_is_enough(spark, tmp_path):
    table = lambda *xs: spark.createDataFrame(xs, "path string, content string")
    store = buckets.Store(spark, str(tmp_path / "g"), buckets=4)
    main = ("src/main.js", "import { go } from './go.js';\nfunction run() { go(); }\n")
    incremental.update(store, table(main, ("src/go.js", "export function go() {}\n"), ("src/far.js", "function far() {}\n")))
    done = incremental.update(store, table(("src/go.js", "export function stop() {}\n")), complete=False)
    assert done.changes == {"changed": 1} and done.scanned == 1 and done.linked == 2  # and who called what is gone
    assert store.read("edge").where("type = 'calls'").count() == 0
    done = incremental.update(store, table(("src/go.js", None)), complete=False)
    assert done.changes == {"deleted": 1} and done.scanned == 0
    assert store.read("edge").where("type = 'imports'").count() == 0 and store.read("node").where("file = 'src/go.js'").count() == 0
    assert store.read("info").count() == 2
