"""Resolution across files: paths, symbols, accesses and risks.

imports (file, local_name, from_file, original_name, line), exports (file, name, line), accesses (file,
var, kind write or read, fn, line, ...), timing (file, api, callback, fn, line, is_awaited).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import basename, directory, lit_array, slashes, stem
from tessera.operators.graph import first_by
from tessera.operators.tables import materialize

# Extensions and index files that an import may leave out, in order.
SUFFIXES = ("", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx")
# Stems so common that a file is not looked for by them.
AMBIGUOUS_STEMS = ["index", "types", "utils", "helpers", "constants", "common", "shared", "base", "config", "main", "core", "hooks", "styles", "theme", "api", "model", "models", "service", "services"]
#: Imports of one source from one folder, beyond which what it means is known to all workers.
OFTEN = 10_000
# Names of calls that give promises.
ASYNC_CALLS = ["fetch", "axios", "got", "request", "then", "catch", "finally", "readFile", "writeFile", "readdir", "connect", "query", "findOne", "save", "create", "send", "post", "put", "patch"]


def folded(path: Column) -> Column:
    """A path without . and .. segments; .. at the top is dropped."""
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), lit_array([]), step), "/")


def resolve_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file, source) with target, null if none: the file (path, ord) that a relative source means.

    The folded path itself, then with each extension, then an index file; else the first file of its stem, or
    base name, unless the stem is too common. Candidates are joined, best first, not compared with every file.
    What a source means depends on the folder that it is written in, so it is looked for once a folder, however many files have it;
    sources that more than OFTEN imports have are known to all workers.
    """
    keys = ["__at", "source"]
    relative = F.coalesce(F.col("source").startswith(".") | F.col("source").startswith("/"), F.lit(False))
    asked = imports.where(relative).withColumn("__at", directory(F.col("file")))
    written = asked.groupBy(*keys).agg(F.count("*").alias("uses"))
    at = F.col("__at")
    base = folded(F.when(at != "", F.concat(at, F.lit("/"), "source")).otherwise(F.col("source")))
    exact = written.select(*keys, "uses", F.posexplode(F.transform(lit_array(SUFFIXES), lambda s: F.concat(base, s))).alias("p", "key"))
    known = files.select(F.col("path").alias("target"), "ord")
    hits = exact.join(known, exact["key"] == known["target"]).select(*keys, "uses", "p", "ord", "target")
    loose = written.where(~stem(F.col("source")).isin(*AMBIGUOUS_STEMS)).select(*keys, "uses", stem(F.col("source")).alias("key"))
    by_stem = loose.join(known.withColumn("key", stem(F.col("target"))), "key").select(*keys, "uses", F.lit(len(SUFFIXES)).alias("p"), "ord", "target")
    best = hits.unionByName(by_stem).groupBy(*keys, "uses").agg(F.min(F.struct("p", "ord", "target")).alias("b")).select(*keys, "uses", "b.target")
    best = materialize(written.join(best, [*keys, "uses"], "left"))
    often = F.broadcast(best.where(F.col("uses") > OFTEN).drop("uses"))  # as many as all imports by OFTEN at most
    rest = asked.join(often.select(*keys), keys, "left_anti").join(best.where(F.col("uses") <= OFTEN).drop("uses"), keys)
    none = imports.where(~relative).withColumn("target", F.lit(None).cast(known.schema["target"].dataType))
    columns = ["file", "source", *[c for c in imports.columns if c not in ("file", "source")], "target"]
    return asked.join(often, keys).select(*columns).unionByName(rest.select(*columns)).unionByName(none.select(*columns))


def is_external(source: Column) -> Column:
    """Whether a source is a package by its form alone: scoped or bare names are, relative and aliased ones not; of several segments: null."""
    return F.when(source.rlike(r"^(\.|/|~|@/)"), False).when(source.startswith("@"), True).when(~F.contains(source, F.lit("/")), True)


def external_modules(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(source, external): bare paths of several segments are internal if a file has their last segment as its stem."""
    stems = files.select(stem(F.col("path")).alias("k")).distinct().withColumn("found", F.lit(True))
    s = sources.select("source").distinct().withColumn("k", stem(F.col("source")))
    return s.join(stems, "k", "left").select("source", F.coalesce(is_external(F.col("source")), F.col("found").isNull()).alias("external"))


def symbol_origins(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, name, line, imported_by): exported symbols and who imports them."""
    e = exports.select(F.col("file").alias("from_file"), F.col("name").alias("original_name"), F.col("line").alias("at"))
    j = imports.join(e, ["from_file", "original_name"])
    by = F.array_sort(F.collect_list(F.struct("file", "local_name", "line")))
    return j.groupBy("from_file", "original_name", "at").agg(by.alias("imported_by")).select(F.col("from_file").alias("file"), F.col("original_name").alias("name"), F.col("at").alias("line"), "imported_by")


def expand_chains(accesses: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Accesses of imported or exported variables, with the origin (origin_file, origin_var, origin_line); local ones go.

    An import decides before an export of the same name.
    """
    origin = exports.select(F.col("file").alias("origin_file"), F.col("name").alias("origin_var"), F.col("line").alias("origin_line"))
    i = imports.select("file", F.col("local_name").alias("var"), F.col("from_file").alias("origin_file"), F.col("original_name").alias("origin_var"))
    imported = accesses.join(i, ["file", "var"]).join(origin, ["origin_file", "origin_var"])
    rest = accesses.join(i.select("file", "var"), ["file", "var"], "left_anti")
    own = rest.join(origin, (rest["file"] == origin["origin_file"]) & (rest["var"] == origin["origin_var"]))
    cols = [*accesses.columns, "origin_file", "origin_var", "origin_line"]
    return imported.select(*cols).unionByName(own.select(*cols))


def risk_cross_file_mutation(chains: DataFrame) -> DataFrame:
    return chains.where("kind = 'write' and file <> origin_file").select(F.lit("cross_file_mutation").alias("type"), F.col("origin_var").alias("subject"), F.col("file"), "line", "fn")


def risk_async_state_race(chains: DataFrame, timing: DataFrame) -> DataFrame:
    """Writes in a function that has, or is, the callback of an async call in its file."""
    fns = timing.select("file", F.explode(F.array("fn", "callback")).alias("fn")).where("fn is not null").distinct()
    return chains.where("kind = 'write'").join(fns, ["file", "fn"], "left_semi").select(F.lit("async_state_race").alias("type"), F.col("origin_var").alias("subject"), "file", "line", "fn")


def risk_unawaited_promise(timing: DataFrame) -> DataFrame:
    return timing.where((F.col("is_awaited") == F.lit(False)) & F.col("api").isin(*ASYNC_CALLS)).select(F.lit("unawaited_promise").alias("type"), F.col("api").alias("subject"), "file", "line", "fn")


def dedupe_risks(risks: DataFrame, order: str = "fn") -> DataFrame:
    """The first risk of each type, subject, file and line."""
    return first_by(risks, ["type", "subject", "file", "line"], order)


def call_graph(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(caller, callee, function, line): calls (file, callee, receiver, line) of, or on, an imported name; the first line of each."""
    i = imports.select("file", F.col("local_name").alias("name"), F.col("from_file").alias("target")).distinct()
    by = calls.select("file", "callee", "line", F.explode(F.array_distinct(F.array_compact(F.array("callee", "receiver")))).alias("name"))
    return by.join(i, ["file", "name"]).groupBy(F.col("file").alias("caller"), F.col("target").alias("callee"), F.col("callee").alias("function")).agg(F.min("line").alias("line"))


def cross_file(files: DataFrame, imports: DataFrame, exports: DataFrame, accesses: DataFrame, timing: DataFrame, calls: DataFrame) -> dict[str, DataFrame] | None:
    """Origins, chains, risks and the call graph of a project; none for fewer than two files."""
    if files.limit(2).count() < 2:
        return None
    chains = expand_chains(accesses, imports, exports)
    risks = risk_cross_file_mutation(chains).unionByName(risk_async_state_race(chains, timing)).unionByName(risk_unawaited_promise(timing))
    return {"origins": symbol_origins(imports, exports), "chains": chains, "risks": dedupe_risks(risks), "call_graph": call_graph(calls, imports)}


def import_closure(start: DataFrame, imports: DataFrame, depth: int = 2) -> DataFrame:
    """(file, hops): a file and what it imports, level by level."""
    out = front = start.select("file", F.lit(0).alias("hops"))
    for d in range(1, depth + 1):
        front = front.join(imports.select("file", "from_file"), "file").select(F.col("from_file").alias("file"), F.lit(d).alias("hops")).distinct().join(out, "file", "left_anti")
        out = out.unionByName(front)
    return out


def path_matches(names: DataFrame, paths: DataFrame) -> DataFrame:
    """(name, path): each name's files (path, ord): the same path, else the same base name, else a suffix either way; the first."""
    n, p = names.select(F.col("name"), basename(F.col("name")).alias("b")).distinct(), paths.select("path", "ord", basename(F.col("path")).alias("b"))
    x, y = slashes(F.col("name")), slashes(F.col("path"))
    rank = F.when(x == y, 0).when(F.col("name") == F.col("b"), 1).when(x.endswith(F.concat(F.lit("/"), y)) | y.endswith(F.concat(F.lit("/"), x)), 2)
    return n.join(p, "b").withColumn("r", rank).where("r is not null").groupBy("name").agg(F.min(F.struct("r", "ord", "path")).alias("m")).select("name", "m.path")
