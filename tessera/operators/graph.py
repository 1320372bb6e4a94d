"""Building and maintaining the graph of files, functions and classes.

nodes (id, type, name, file_path, ...), edges (source, target, type, ...), hashes (path, content_hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import basename, content_hash, contains_any, language_of, slashes, stem

# Weights that are stored with edges, by type.
STORED_WEIGHT = {"contains": 1.0, "imports": 0.7, "calls": 0.8}
# Layers in the order in which they are tried, with what their paths contain.
LAYERS = [
    ("API Layer", ["route", "controller", "handler", "endpoint", "api"], "What answers requests from outside"),
    ("Service Layer", ["service", "usecase", "use-case", "business"], "What the application does for its users"),
    ("Data Layer", ["model", "entity", "schema", "database", "db", "migration", "repository", "repo"], "What is stored, and how it is reached"),
    ("UI Layer", ["component", "view", "page", "screen", "layout", "widget", "ui"], "What people see and touch"),
    ("Middleware Layer", ["middleware", "interceptor", "guard", "filter", "pipe"], "What stands between a request and its answer"),
    ("Utility Layer", ["util", "helper", "lib", "common", "shared"], "Small tools that other files share"),
    ("Test Layer", ["test", "spec"], "What holds the code to its promises"),
    ("Configuration Layer", ["config", "setting", "env"], "What can be set from outside the code"),
    ("Core Layer", ["core", "engine", "pipeline"], "The engine, and the order of its steps"),
]


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, content_hash) of files (path, content)."""
    return files.select("path", content_hash(F.col("content")).alias("content_hash"))


def build_graph(files: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of facts: files (path), functions and classes (path, name, line_start, line_end), imports (path, target), calls (caller_id, callee_id)."""
    blank = F.lit(None).cast("int")
    node = lambda df, kind, i, name: df.select(i.alias("id"), F.lit(kind).alias("type"), name.alias("name"), F.col("path").alias("file_path"), *(("line_start", "line_end") if "line_start" in df.columns else (blank.alias("line_start"), blank.alias("line_end"))), F.lit("AST_VERIFIED").alias("trust_level"))
    fid, sub = F.concat(F.lit("file:"), "path"), lambda k: F.concat(F.lit(f"{k}:"), "path", F.lit(":"), "name")
    nodes = node(files, "file", fid, basename(F.col("path"))).unionByName(node(functions, "function", sub("func"), F.col("name"))).unionByName(node(classes, "class", sub("class"), F.col("name")))
    edge = lambda df, kind, a, b: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), F.lit("forward").alias("direction"), F.lit(STORED_WEIGHT[kind]).alias("weight"), F.lit("AST_VERIFIED").alias("trust_level"))
    edges = edge(functions, "contains", fid, sub("func")).unionByName(edge(classes, "contains", fid, sub("class")))
    edges = edges.unionByName(edge(imports, "imports", fid, F.concat(F.lit("file:"), "target"))).unionByName(edge(calls, "calls", F.col("caller_id"), F.col("callee_id")))
    return nodes, edges


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status): added, changed or deleted, of hashes (path, content_hash) against stored ones. Nulls are equal to nulls."""
    c, s = current.select("path", F.col("content_hash").alias("now"), F.lit(1).alias("c")), stored.select("path", F.col("content_hash").alias("was"), F.lit(1).alias("s"))
    status = F.when(F.col("s").isNull(), "added").when(F.col("c").isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("was")), "changed")
    return c.join(s, "path", "full").select("path", status.alias("status")).where("status is not null")


def should_patch(changed: int, total: int, threshold: float = 0.3) -> bool:
    """Whether a few files changed, so that a patch is better than a rebuild."""
    return 0 < changed < threshold * total


def merge_graph(nodes: DataFrame, edges: DataFrame, hashes: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, new_hashes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph without the nodes of changed files (path) and the edges at them, with the new rows and hashes.

    Edges from unchanged files into changed ones go too; a caller that wants them back gives them in
    new_edges (resolve_callees and resolve_paths over all facts make them).
    """
    gone = nodes.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    kept = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti")
    n = nodes.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(*nodes.columns).unionByName(new_nodes)
    h = hashes.join(new_hashes.select("path").unionByName(changed.select("path")).distinct(), "path", "left_anti").select(*hashes.columns).unionByName(new_hashes)
    return n, kept.select(*edges.columns).unionByName(new_edges), h


def function_index(functions: DataFrame) -> DataFrame:
    """(name, files): where each function name is defined."""
    return functions.groupBy("name").agg(F.array_sort(F.collect_set("path")).alias("files"))


def import_map(imports: DataFrame) -> DataFrame:
    """(path, stem, target): what a file's imports (path, source, target, ord) call their files.

    The stem of the resolved path names it (the last import wins), else the stem of what is written (the first wins).
    """
    by_target = imports.where("target is not null").select("path", stem(F.col("target")).alias("stem"), F.lit(0).alias("p"), (-F.col("ord")).alias("o"), "target")
    by_source = imports.where("target is not null").select("path", stem(F.col("source")).alias("stem"), F.lit(1).alias("p"), F.col("ord").alias("o"), "target")
    return by_target.unionByName(by_source).groupBy("path", "stem").agg(F.min(F.struct("p", "o", "target")).alias("b")).select("path", "stem", "b.target")


def resolve_callees(calls: DataFrame, imports: DataFrame, index: DataFrame) -> DataFrame:
    """calls (path, callee, ...) with callee_file: by an import of that name, else the only file that defines it, never the caller's; others go."""
    i = imports.select("path", F.col("stem").alias("callee"), F.col("target").alias("imported"))
    only = index.where(F.size("files") == 1).select(F.col("name").alias("callee"), F.col("files")[0].alias("defined"))
    found = calls.join(i, ["path", "callee"], "left").join(only, "callee", "left").withColumn("callee_file", F.coalesce("imported", "defined"))
    return found.where("callee_file is not null and callee_file <> path").select(*calls.columns, "callee_file")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): both ends count."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def connected_nodes(edges: DataFrame) -> DataFrame:
    return degrees(edges).select("id")


def hubs(edges: DataFrame, top: int = 50) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(top)


def count_call_edges(edges: DataFrame) -> int:
    return edges.where(F.col("type").isin("calls", "call")).count()


def layer_name(path: Column) -> Column:
    """The first layer one of whose words is in a folder or the file's stem; Core if none is."""
    p = F.split(F.lower(slashes(path)), "/")
    parts = F.concat(F.slice(p, 1, F.size(p) - 1), F.array(F.regexp_replace(F.element_at(p, -1), r"\.[^.]+$", "")))
    out = F
    for name, words, _ in LAYERS:
        out = out.when(_exists_any(parts, words), name)
    return out.otherwise("Core")


def _exists_any(parts: Column, words: list[str]) -> Column:
    return F.exists(parts, lambda s: contains_any(s, words))


def detect_layers(nodes: DataFrame) -> DataFrame:
    """(layer_id, name, description, node_ids) of file nodes."""
    said = F.coalesce(*[F.when(F.col("name") == n, d) for n, _, d in LAYERS], F.lit("All other files"))
    files = nodes.where("type = 'file'").select("id", layer_name(F.col("file_path")).alias("name"))
    g = files.groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("node_ids"))
    return g.select(F.concat(F.lit("layer:"), F.regexp_replace(F.lower("name"), r"\s+", "-")).alias("layer_id"), "name", said.alias("description"), "node_ids")


def apply_layers(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """(id, name): file nodes by given layers (name, pattern, ord): a path that starts with the pattern or has it as a folder; Other if none."""
    f = nodes.where("type = 'file'").select("id", "file_path")
    hit = F.col("file_path").startswith(F.col("pattern")) | F.contains("file_path", F.concat(F.lit("/"), "pattern"))
    best = f.join(F.broadcast(layers), hit).groupBy("id").agg(F.min(F.struct("ord", "name")).alias("b"))  # a handful of layers, written by hand
    return f.join(best, "id", "left").select("id", F.coalesce("b.name", F.lit("Other")).alias("name"))


def project_key(names: DataFrame) -> DataFrame:
    """One row (project_key): a hash of the sorted names (name), joined by bars."""
    return names.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("name")), "|"), 256).alias("project_key"))


def freshness(current: DataFrame, stored: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: changed, added and deleted files, and embedded nodes of changed files, which are stale."""
    ch = changed_files(current, stored)
    n = lambda s: F.count_if(F.col("status") == s)
    stale = nodes.where("embedding is not null").join(ch.where("status = 'changed'").select(F.col("path").alias("file_path")), "file_path", "left_semi").agg(F.count("*").alias("stale_embeddings"))
    return ch.agg(n("changed").alias("changed"), n("added").alias("added"), n("deleted").alias("deleted")).crossJoin(stale)  # two single rows


def mark_stale(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """nodes with embedding_status stale_file_changed where the file (path) changed and there is an embedding."""
    c = changed.select(F.col("path").alias("file_path"), F.lit(True).alias("__c")).distinct()
    status = F.when(F.col("__c") & F.col("embedding").isNotNull(), "stale_file_changed").otherwise(F.col("embedding_status") if "embedding_status" in nodes.columns else F.lit(None).cast("string"))
    out = nodes.join(c, "file_path", "left").withColumn("embedding_status", status)
    return out.select(*nodes.columns, *["embedding_status"] * ("embedding_status" not in nodes.columns))


def reachable(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, target): pairs joined by a path of directed edges, of `depth` edges at most or of any number.

    To a depth, a step a round. Without one, the paths found so far are joined with each other, which doubles their
    length, until nothing is new: a path of n edges takes some log2(n) rounds, and none is left out.
    """
    from tessera.operators.tables import materialize

    step = edges.select("source", "target").distinct()
    seen = new = materialize(step)
    rounds = 0
    while depth is None or rounds < depth - 1:
        on = seen if depth is None else step
        further = new.select("source", F.col("target").alias("m")).join(on.select(F.col("source").alias("m"), "target"), "m").select("source", "target")
        if depth is None:  # a new path may be the second half, too
            further = further.unionByName(on.select("source", F.col("target").alias("m")).join(new.select(F.col("source").alias("m"), "target"), "m").select("source", "target"))
        new = materialize(further.distinct().join(seen, ["source", "target"], "left_anti"))
        if new.isEmpty():
            break
        seen, rounds = materialize(seen.unionByName(new)), rounds + 1
    return seen


def strong_components(edges: DataFrame, at_once: int = 1_000_000, trims: int = 2) -> DataFrame:
    """(id, component): nodes that lie on a cycle, with the least node that each is in a cycle with; a loop is a cycle.

    Nodes without incoming or outgoing edges are taken away a few times. Then colours spread forward: each node
    takes the greatest node that reaches it. The nodes of a colour that reach its namesake backward are a component; edges between
    colours are on no cycle and go, and so on with what is left. Once `at_once` edges are left at most (32 MB of a task),
    one task ends the work by depth-first search, so chains of any length take no rounds of their own.
    """
    from tessera.operators.tables import materialize

    e = materialize(edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")).where("source is not null and target is not null").distinct())
    found = []
    while (n := e.count()) > at_once:
        for _ in range(trims):
            inner = materialize(e.select(F.col("target").alias("id")).intersect(e.select(F.col("source").alias("id"))))
            e = materialize(e.join(inner.withColumnRenamed("id", "source"), "source", "left_semi").join(inner.withColumnRenamed("id", "target"), "target", "left_semi"))
            m = e.count()
            if m == n:
                break
            n = m
        if not n:
            break
        colour = materialize(e.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            sent = e.join(colour.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max("colour").alias("sent"))
            new = materialize(colour.join(sent, "id", "left").select("id", F.greatest("colour", "sent").alias("colour"), (F.coalesce("sent", "colour") > F.col("colour")).alias("moved")))
            colour = new.select("id", "colour")
            if new.where("moved").isEmpty():
                break
        same = e.join(colour.select(F.col("id").alias("source"), F.col("colour").alias("c")), "source").join(colour.select(F.col("id").alias("target"), F.col("colour").alias("d")), "target")
        same = materialize(same.where("c = d").select("source", "target", "c"))
        back = front = materialize(same.where("target = c").select(F.col("source").alias("id"), "c").distinct())
        while not front.isEmpty():
            front = materialize(same.join(front.select(F.col("id").alias("target")), "target").select(F.col("source").alias("id"), "c").distinct().join(back, "id", "left_anti").select("id", "c"))
            back = materialize(back.unionByName(front))
        found.append(_least_of_each(back))
        e = materialize(same.join(back.select(F.col("id").alias("source")), "source", "left_anti").join(back.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target"))
    out = e.groupBy(F.lit(0).alias("all")).applyInArrow(_depth_first, "id string, component string")
    for f in found:
        out = out.unionByName(f)
    return out


def _least_of_each(nodes: DataFrame) -> DataFrame:
    """(id, component) of nodes (id, c): the least id of each c."""
    from tessera.operators.tables import materialize

    return materialize(nodes.join(nodes.groupBy("c").agg(F.min("id").alias("component")), "c").select("id", "component"))


def _depth_first(edges):
    """Components by the path of open nodes: a node closes a component if nothing below it reaches further back."""
    import pyarrow as pa

    after: dict[str, list[str]] = {}
    loops = set()
    for a, b in zip(edges.column("source").to_pylist(), edges.column("target").to_pylist(), strict=True):
        after.setdefault(a, []).append(b)
        if a == b:
            loops.add(a)
    order, low, path, on_path, ids, component = {}, {}, [], set(), [], []
    for root in after:
        if root in order:
            continue
        work = [(root, iter(after[root]))]
        order[root] = low[root] = len(order)
        path.append(root)
        on_path.add(root)
        while work:
            node, rest = work[-1]
            for b in rest:
                if b not in order:
                    order[b] = low[b] = len(order)
                    path.append(b)
                    on_path.add(b)
                    work.append((b, iter(after.get(b, ()))))
                    break
                if b in on_path:
                    low[node] = min(low[node], order[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    group = [path.pop()]
                    while group[-1] != node:
                        group.append(path.pop())
                    on_path.difference_update(group)
                    if len(group) > 1 or node in loops:
                        ids += group
                        component += [min(group)] * len(group)
    return pa.table({"id": pa.array(ids, pa.string()), "component": pa.array(component, pa.string())})


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(id): nodes on a cycle of directed edges; those on paths between cycles are not."""
    return strong_components(edges).select(F.col("id").cast(edges.schema["source"].dataType))


def codex_hints(nodes: DataFrame, codex: DataFrame) -> DataFrame:
    """(id, hints): memory entries (task_id, discoveries) whose text names the node's file; 200 characters of three lines of the section.

    Names are taken out of the texts and joined, so no node is compared with every text.
    """
    words = F.array_distinct(F.regexp_extract_all(F.col("discoveries"), F.lit(r"([\w\-]+(?:\.[\w\-]+)+)"), 1))
    named = codex.select("task_id", "discoveries", F.explode(words).alias("base"))
    lines = F.array_join(F.slice(F.filter(F.split("discoveries", "\n"), lambda x: F.trim(x) != ""), 1, 3), "\n")
    return nodes.select("id", basename(F.col("file_path")).alias("base")).join(named, "base").groupBy("id").agg(F.array_sort(F.collect_set(F.concat("task_id", F.lit(": "), F.left(lines, F.lit(200))))).alias("hints"))


def out_of_scope(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, tags, summary): up to four tags and 80 characters of summary of each path's file node, where known."""
    n = nodes.where("type = 'file'").select(F.col("file_path").alias("path"), F.slice("tags", 1, 4).alias("tags"), F.left("summary", F.lit(80)).alias("summary"))
    return paths.join(n, "path", "left")


def sample_files(files: DataFrame, top: int = 5) -> DataFrame:
    """Files whose base names tell most of a project: index, main, app, server, config, then others."""
    b = F.lower(basename(F.col("path")))
    order = F.coalesce(*[F.when(b.startswith(p), i) for i, p in enumerate(("index", "main", "app", "server", "config"))], F.lit(5))
    return files.orderBy(order, "path").limit(top)


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def stamp(meta: DataFrame, schema_version: str, engine_version: str, built_at: Column) -> DataFrame:
    return meta.withColumns({"schema_version": F.lit(schema_version), "engine_version": F.lit(engine_version), "built_at": built_at})


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
