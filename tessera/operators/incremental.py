"""Upkeep of a stored graph: what a few changed files mean for it, by joins of their facts with stored ones.

Facts are kept by file in a bucketed store, with a reverse index for each way in which a file depends on another:
by name (who calls a function of that name, who defines it), by stem (who imports something that a path could be,
which paths there are) and by file (who points at it). An update scans the changed files, follows the index from what changed in them,
and resolves, links and describes anew just the files that it finds. The full build is the update of an empty store.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import basename, content_hash, directory, lit_array, stem
from tessera.operators import crossfile, graph
from tessera.operators.tables import materialize
from tessera.sources import extract
from tessera.sources.buckets import Store

INFO = "file string, content_hash string, n_lines int, doc string, fn_names array<string>, sources array<string>, n_async long"
IMPORT = "file string, local_name string, original_name string, source string, line int, target string"
CALL = "file string, fn string, callee string"
EDGE = "file string, source string, target string, type string, direction string, weight double, trust_level string"
NODE = "file string, id string, type string, name string, file_path string, line_start int, line_end int, trust_level string, tags array<string>, complexity string, summary string"
#: Fields of the tables; the reverse indices have a key and the file.
TABLES = {"info": INFO, "import": IMPORT, "call": CALL, "edge": EDGE, "node": NODE, **{t: "k string, file string" for t in ("defined", "called", "wanted", "path", "pointed")}}


@dataclass
class Update:
    """What an update did: changes by status, files scanned, files linked anew, files described anew, rows that reads were given."""

    version: int
    changes: dict[str, int]
    scanned: int
    linked: int
    described: int
    rows_read: int


def path_keys(path: Column) -> Column:
    """Under which names a path can be meant: its stem, and an index file's folder."""
    return F.when(stem(path) == "index", F.array(stem(path), basename(directory(path)))).otherwise(F.array(stem(path)))


def import_keys(file: Column, source: Column) -> Column:
    """The names that a relative import can mean, as path_keys() has them."""
    at = directory(file)
    base = crossfile.folded(F.when(at != "", F.concat(at, F.lit("/"), source)).otherwise(source))
    relative = source.startswith(".") | source.startswith("/")
    return F.when(relative, F.array_distinct(F.array(stem(source), stem(base), basename(base)))).otherwise(lit_array([]))


def _except(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select(F.col(files.columns[0]).alias("file")), "file", "left_anti")


def _only(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select(F.col(files.columns[0]).alias("file")), "file", "left_semi")


def _file_of(node_id: Column) -> Column:
    return F.substring(node_id, 6, 10**6)


def update(store: Store, files: DataFrame, complete: bool = True) -> Update:
    """Brings the stored graph up to date with files (path, content), and says what that took.

    complete: the files are all there are, so stored ones that are missing were deleted; otherwise only these changed, and a null
    content deletes. Files of unchanged content are hashed, not scanned. Equal paths: one of them counts. An update that
    dies leaves the version before; repeated, it does the same again.
    """
    spark, read_before = store.spark, store.rows_read
    empty = lambda t: spark.createDataFrame([], TABLES[t])

    def stored(table: str, keys: DataFrame | None = None) -> DataFrame:
        out = store.read(table, keys)
        return empty(table) if out is None else out

    files = files.dropDuplicates(["path"])
    now = files.where("content is not null").select("path", content_hash(F.col("content")).alias("content_hash"))
    was = stored("info", None if complete else files.select("path")).select(F.col("file").alias("path"), "content_hash")
    changed = materialize(graph.changed_files(now, was).select(F.col("path").alias("file"), "status"))
    counts = {r.status: r.n for r in changed.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Update(store.version, {}, 0, 0, 0, store.rows_read - read_before)
    # facts of the changed files, old and new
    fresh = materialize(files.join(changed.where("status <> 'deleted'").select(F.col("file").alias("path")), "path", "left_semi"))
    facts = materialize(extract.extract_facts(fresh, kinds=extract.MAP_FACTS), by="fact")
    t = lambda k: extract.table(facts, k)
    fn = materialize(t("function").select("file", "name", F.col("line").alias("line_start"), "line_end").dropDuplicates(["file", "name"]))
    cls = t("class").select("file", "name", F.col("line").alias("line_start"), "line_end").dropDuplicates(["file", "name"])
    calls = materialize(t("call").select("file", "fn", "callee").distinct())
    old_nodes, old_imports, old_calls = (materialize(stored(x, changed)) for x in ("node", "import", "call"))
    # imports: those of the changed files, and those that an added or deleted path can be meant by
    moved = changed.where("status <> 'changed'").select("file")
    names_moved = materialize(moved.select("file", F.explode(path_keys(F.col("file"))).alias("k")))
    touched = _except(stored("wanted", names_moved.select("k")).select("file").distinct(), changed)
    before = materialize(stored("import", touched))
    ask = t("import").select("file", "local_name", "original_name", "source", "line").unionByName(before.drop("target"))
    keys = materialize(ask.select("file", F.explode(import_keys(F.col("file"), F.col("source"))).alias("k")).distinct())
    known = _except(stored("path", keys.select("k")).select("file").distinct(), changed.where("status = 'deleted'")).unionByName(fresh.select(F.col("path").alias("file"))).distinct()
    imports = materialize(crossfile.resolve_paths(ask, known.select(F.col("file").alias("path"), F.col("file").alias("ord"))))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("file", "local_name", "original_name", "source", "line", "target")]
    redirected = before.alias("b").join(imports.alias("i"), same, "left_anti").select("file").distinct()
    # links: files that call a name whose definitions changed, too
    was_defined = old_nodes.where("type = 'function'").select(F.col("name").alias("k"), "file")
    is_defined = fn.select(F.col("name").alias("k"), "file")
    names = was_defined.exceptAll(is_defined).unionByName(is_defined.exceptAll(was_defined)).select("k").distinct()
    callers = _except(stored("called", names).select("file").distinct(), changed)
    others = materialize(redirected.unionByName(callers).distinct())
    linked = materialize(others.unionByName(fresh.select(F.col("path").alias("file"))))
    all_calls = materialize(calls.unionByName(stored("call", others)))
    rest = _except(others, redirected)
    all_imports = materialize(_only(imports, linked).unionByName(stored("import", rest)))
    defined = materialize(_except(stored("defined", all_calls.select("callee")), changed).unionByName(is_defined))
    old_edges = materialize(stored("edge", changed.select("file").unionByName(others)))
    edges = materialize(_edges(linked, fn, cls, old_edges, changed, all_imports, all_calls, defined))
    # descriptions: files whose number of edges can have changed, too
    ends = lambda e: e.where("type = 'imports'").select(_file_of(F.col("target")).alias("file"))
    near = linked.unionByName(ends(old_edges)).unionByName(ends(edges)).distinct()
    described = materialize(near.join(changed.where("status = 'deleted'").select("file"), "file", "left_anti"))
    far = _except(described, linked)
    outside = stored("edge", far)
    inward = _except(stored("pointed", described), old_edges.select("file").unionByName(linked).distinct())
    mine = edges.unionByName(outside).where("type <> 'calls'").select(_file_of(F.col("source")).alias("file"))
    degree = mine.unionByName(ends(edges)).unionByName(inward.select(F.col("k").alias("file"))).groupBy("file").agg(F.count("*").alias("degree"))
    info = materialize(_info(fresh, fn, t("function"), t("import_source")))
    all_info = info.unionByName(_except(stored("info", described), changed))
    nodes = materialize(_nodes(all_info, degree, described, fn, cls, _except(stored("node", described), changed)))
    pairs = lambda df, k: df.select(F.col(k).alias("k"), "file").distinct()
    paths = lambda df: df.select(F.explode(path_keys(F.col("file"))).alias("k"), "file")
    wants = lambda df: df.select(F.explode(import_keys(F.col("file"), F.col("source"))).alias("k"), "file").distinct()
    points = lambda e: e.where("type = 'imports'").select(_file_of(F.col("target")).alias("k"), "file").distinct()
    was_there = changed.where("status <> 'added'").select("file")
    version = store.commit({
        "info": ("file", "file", info, was_there), "import": ("file", "file", _only(imports, redirected.unionByName(fresh.select(F.col("path").alias("file")))).select(*empty("import").columns), was_there.unionByName(redirected)),
        "call": ("file", "file", calls, was_there), "edge": ("file", "file", edges, was_there.unionByName(others)), "node": ("file", "file", nodes, was_there.unionByName(far).unionByName(others)),
        "defined": ("k", "file", is_defined, was_defined), "called": ("k", "file", pairs(calls, "callee"), pairs(old_calls, "callee")), "wanted": ("k", "file", wants(t("import")), wants(old_imports)),
        "path": ("k", "file", paths(moved.join(fresh.select(F.col("path").alias("file")), "file", "left_semi")), paths(moved)), "pointed": ("k", "file", points(edges), points(old_edges)),
    })
    return Update(version, counts, fresh.count(), linked.count(), described.count(), store.rows_read - read_before)


def _edges(linked: DataFrame, fn: DataFrame, cls: DataFrame, old: DataFrame, changed: DataFrame, imports: DataFrame, calls: DataFrame, defined: DataFrame) -> DataFrame:
    """All edges of the linked files; what unchanged ones contain is as it was."""
    path = lambda df: df.withColumnRenamed("file", "path")
    resolved = imports.where("target is not null").select(F.col("file").alias("path"), "local_name", "target")
    named = resolved.select("path", F.col("local_name").alias("stem"), "target").dropDuplicates(["path", "stem"])
    of = path(calls)
    index = graph.function_index(defined.select(F.col("k").alias("name"), F.col("file").alias("path")))
    far = graph.resolve_callees(of, named, index)
    near = of.join(defined.select(F.col("file").alias("path"), F.col("k").alias("callee")), ["path", "callee"], "left_semi").withColumn("callee_file", F.col("path"))
    found = far.unionByName(near).where("fn <> callee or path <> callee_file").join(defined.select(F.col("file").alias("callee_file"), F.col("k").alias("callee")), ["callee_file", "callee"], "left_semi")
    ids = lambda p, n: F.concat(F.lit("func:"), p, F.lit(":"), n)
    found = found.select("path", ids("path", "fn").alias("caller_id"), ids("callee_file", "callee").alias("callee_id")).distinct()
    none = linked.limit(0).select(F.col("file").alias("path"))
    _, edges = graph.build_graph(none, path(fn), path(cls), resolved.select("path", "target").distinct(), found.select("caller_id", "callee_id"))
    owner = F.when(F.col("type") == "calls", F.col("__caller")).otherwise(_file_of(F.col("source")))  # what contains or imports is a file
    whose = found.select("path", F.col("caller_id").alias("source")).distinct()
    edges = edges.join(whose.withColumnRenamed("path", "__caller"), "source", "left").withColumn("file", owner).select(*_names(EDGE))
    return edges.unionByName(_except(old.where("type = 'contains'"), changed))


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.replace("array<string>", "a").split(", ")]


def _info(fresh: DataFrame, fn: DataFrame, functions: DataFrame, sources: DataFrame) -> DataFrame:
    names = fn.groupBy("file").agg(F.array_sort(F.collect_list("name")).alias("fn_names"))
    used = sources.groupBy("file").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    n_async = functions.where("is_async").groupBy("file").agg(F.count("*").alias("n_async"))
    own = fresh.select(F.col("path").alias("file"), content_hash(F.col("content")).alias("content_hash"), F.size(F.split("content", "\n")).alias("n_lines"), extract.doc_summary(F.col("content")).alias("doc"))
    out = own.join(names, "file", "left").join(used, "file", "left").join(n_async, "file", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"fn_names": F.coalesce("fn_names", none), "sources": F.coalesce("sources", none), "n_async": F.coalesce("n_async", F.lit(0).cast("long"))}).select(*_names(INFO))


def _nodes(info: DataFrame, degree: DataFrame, described: DataFrame, fn: DataFrame, cls: DataFrame, old: DataFrame) -> DataFrame:
    """All nodes of the described files: the files' own with their description, and of unchanged files the others as they were."""
    path = lambda df: df.withColumnRenamed("file", "path")
    nodes, _ = graph.build_graph(path(described), path(fn), path(cls), described.limit(0).select(F.col("file").alias("path"), F.col("file").alias("target")), described.limit(0).select(F.col("file").alias("caller_id"), F.col("file").alias("callee_id")))
    meta = path(_only(info, described)).join(path(degree), "path", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    meta = extract.node_metadata(meta).select(F.col("path").alias("file_path"), F.lit("file").alias("type"), "tags", "complexity", "summary")
    none = F.array().cast("array<string>")
    nodes = nodes.join(meta, ["file_path", "type"], "left").withColumns({"tags": F.coalesce("tags", none), "summary": F.coalesce("summary", F.lit("")), "file": F.col("file_path")}).select(*_names(NODE))
    return nodes.unionByName(old.where("type <> 'file'").select(*_names(NODE)))


def stored_graph(store: Store) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, hashes) of a store, as services.build_map() has them."""
    nodes = store.read("node").drop("file").withColumn("ord", F.concat_ws("\x01", "file_path", "id"))
    edges = store.read("edge").drop("file").withColumn("ord", F.concat_ws("\x01", "type", "source", "target"))
    return nodes, edges, store.read("info").select(F.col("file").alias("path"), "content_hash")
