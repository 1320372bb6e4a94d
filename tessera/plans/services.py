"""The three entry points as plans: a map of a project, the evidence for a symptom, and the check of claims."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import content_hash
from tessera.operators import crossfile, detect, graph, incremental, memory, patterns, rank, verify
from tessera.operators.tables import materialize
from tessera.sources import extract
from tessera.sources.buckets import Store


@dataclass
class Project:
    """A project's files (path, content, ...), its facts (of some kinds or all), and its imports with the files they mean."""

    files: DataFrame
    facts: DataFrame
    imports: DataFrame
    kinds: frozenset[str] | None = None

    def table(self, fact: str) -> DataFrame:
        if self.kinds is not None and fact not in self.kinds:
            raise ValueError(f"the project was loaded without facts of kind {fact}")
        return extract.table(self.facts, fact)


# The kinds of facts that findings() and fixes' callers read; those of build_map() are extract.MAP_FACTS.
FINDING_FACTS = frozenset({
    "access", "call", "timing", "module_let", "hook", "declarator", "listener", "state_var", "callback", "function", "statement", "new_expr", "class_capture", "call_expr", "loop",
    "comparison", "export", "import",
})
CALL_FACTS = frozenset({"call", "import"})


def load(files: DataFrame, kinds: frozenset[str] | None = None, before: Project | None = None, changed: DataFrame | None = None) -> Project:
    """Extracts the facts of all files once, into a folder for each kind of fact; with kinds these alone, and imports.

    With the project of before, which has these kinds at least, only changed files (path) are scanned: a file's facts depend on its text alone.
    """
    kinds = None if kinds is None else kinds | {"import"}
    if before is None or before.kinds is not None and (kinds is None or not kinds <= before.kinds):
        facts = materialize(extract.extract_facts(files, kinds=kinds), by="fact")
    else:
        fresh = extract.extract_facts(files.join(changed.select("path"), "path", "left_semi"), kinds=kinds)
        kept = before.facts.join(changed.select(F.col("path").alias("file")), "file", "left_anti")
        facts = kept.select(*before.facts.columns).unionByName(materialize(fresh, by="fact"))
    known = files.select("path", F.col("path").alias("ord"))  # a project is read in the order of its paths
    imports = crossfile.resolve_paths(extract.table(facts, "import"), known)
    return Project(files, facts, materialize(imports.withColumnRenamed("target", "from_file")), kinds)


def build_map(project: Project, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, hashes): files, functions and classes, what contains, imports and calls what. Calls are resolved by import, else by the only file that defines the name.

    keep: edges are written at once, for callers that want nodes, too: these have the edges' degrees, and edges would be found twice.
    """
    fn = project.table("function").select(F.col("file").alias("path"), "name", F.col("line").alias("line_start"), F.col("line_end").alias("line_end")).dropDuplicates(["path", "name"])
    cls = project.table("class").select(F.col("file").alias("path"), "name", F.col("line").alias("line_start"), "line_end").dropDuplicates(["path", "name"])
    resolved = project.imports.where("from_file is not null")
    imports = resolved.select(F.col("file").alias("path"), F.col("from_file").alias("target")).distinct()
    named = resolved.select(F.col("file").alias("path"), F.col("local_name").alias("stem"), F.col("from_file").alias("target")).dropDuplicates(["path", "stem"])
    calls = project.table("call").select(F.col("file").alias("path"), "fn", "callee").distinct()
    far = graph.resolve_callees(calls, named, graph.function_index(fn))
    near = calls.join(fn.select("path", F.col("name").alias("callee")), ["path", "callee"], "left_semi").withColumn("callee_file", F.col("path"))
    ids = lambda p, n: F.concat(F.lit("func:"), p, F.lit(":"), n)
    edges = far.unionByName(near).where("fn <> callee or path <> callee_file")
    edges = edges.join(fn.select(F.col("path").alias("callee_file"), F.col("name").alias("callee")), ["callee_file", "callee"], "left_semi").select(ids("path", "fn").alias("caller_id"), ids("callee_file", "callee").alias("callee_id")).distinct()
    nodes, edges = graph.build_graph(project.files.select("path"), fn, cls, imports, edges)
    edges = materialize(edges) if keep else edges
    names = fn.groupBy(F.col("path")).agg(F.array_sort(F.collect_list("name")).alias("fn_names"))
    sources = project.table("import_source").groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    n_async = project.table("function").where("is_async").groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n_async"))
    degree = graph.degrees(edges).where("id like 'file:%'").select(F.substring("id", 6, 10**6).alias("path"), "degree")
    meta = project.files.select("path", "content").join(names, "path", "left").join(sources, "path", "left").join(n_async, "path", "left").join(degree, "path", "left")
    none = F.array().cast("array<string>")
    meta = meta.withColumns({"fn_names": F.coalesce("fn_names", none), "sources": F.coalesce("sources", none), "n_async": F.coalesce("n_async", F.lit(0)), "degree": F.coalesce("degree", F.lit(0)), "n_lines": F.size(F.split("content", "\n"))})
    meta = extract.node_metadata(meta).select(F.col("path").alias("file_path"), F.lit("file").alias("type"), "tags", "complexity", "summary")
    nodes = nodes.join(meta, ["file_path", "type"], "left").withColumns({"tags": F.coalesce("tags", none), "summary": F.coalesce("summary", F.lit("")), "ord": F.concat_ws("\x01", "file_path", "id")})
    return nodes, edges.withColumn("ord", F.concat_ws("\x01", "type", "source", "target")), graph.file_hashes(project.files)


def findings(project: Project) -> DataFrame:
    """What all detectors find, in one shape: detector, severity, file, line, subject, details."""
    t = project.table
    accesses, calls, timing = t("access"), t("call"), t("timing")
    resolved = project.imports.where("from_file is not null").select("file", "local_name", "from_file", "original_name", "line")
    lets = t("module_let").select("file", "var")
    out = []
    hooks = t("hook").dropDuplicates(["file", "line", "hook"])
    out.append(detect.as_findings(detect.react_patterns(hooks, t("declarator")), "react_pattern", "medium", "subject"))
    listeners = t("listener")
    added, removed = listeners.where("added").drop("added"), listeners.where("not added").drop("added")
    out.append(detect.as_findings(detect.listener_parity(added, removed), "listener_parity", "high", "event", "add_line"))
    out.append(detect.as_findings(detect.orphan_listeners(added, removed), "orphan_listener", "high", "event"))
    out.append(detect.as_findings(detect.state_mutations(accesses, calls, t("state_var")), "state_mutation", "high", "var"))
    floats = detect.floating_promises(calls, t("callback"))
    out.append(detect.as_findings(floats, "floating_promise", "medium", "api"))
    unawaited = calls.where("not is_awaited and statement").select("file", "line", F.col("callee").alias("api"))
    users = detect.user_async_floats(unawaited, t("function").where("is_async").select("name").distinct(), floats)
    out.append(detect.as_findings(users.distinct(), "floating_promise", "medium", "api"))
    races = detect.write_before_await(t("statement"), keep=("line", "write_kind"))
    out.append(detect.as_findings(races.withColumn("subject", F.when(F.col("write_kind") == "imported setter", F.concat("write_subject", F.lit(" (UNRESOLVED)"))).otherwise(F.col("write_subject"))), "global_write_race", "critical", "subject"))
    new = t("new_expr").select("file", "class", "arg", "arg_idx", "line")
    reassigned = accesses.where("kind = 'write' and write_type = 'reassigned'").select("file", "var").distinct()
    out.append(detect.as_findings(detect.captured_references(new, resolved, lets, reassigned, t("class_capture").select("file", "class", "param_idx", "field")), "constructor_capture", "medium", "arg"))
    stats = accesses.join(lets, ["file", "var"], "left_semi").groupBy("file", "var").agg(F.count_if(F.col("write_type") == "reassigned").alias("n_reassigned"), F.countDistinct(F.when(F.col("kind") == "write", F.col("fn"))).alias("n_writers"), F.countDistinct(F.when(F.col("kind") == "read", F.col("fn"))).alias("n_readers"), F.min("line").alias("ord"))
    out.append(detect.as_findings(detect.stale_captures(t("call_expr"), resolved, stats), "stale_module_capture", "medium", "local_var"))
    mutations = calls.where("receiver is not null").select("file", "fn", "receiver", F.col("callee").alias("method"))
    loops = detect.foreach_mutations(t("loop"), mutations, calls.select("file", F.col("fn").alias("caller"), "callee").distinct())
    out.append(detect.as_findings(loops, "foreach_mutation", F.col("severity"), "collection"))
    out.append(detect.as_findings(detect.strict_comparisons(t("comparison")), "strict_comparison", "low", "fn"))
    triggers = timing.where(F.col("api").isin("fetch", "then", "catch", "finally") & F.col("callback").isNotNull()).select("file", F.col("callback").alias("fn"), "api", "line")
    chains = detect.causal_chains(triggers, calls.where(F.col("callee").rlike("^set[A-Z]|^dispatch$")).select("file", "fn", F.col("callee").alias("var"), "line"), accesses.where("kind = 'read'"))
    out.append(detect.as_findings(chains.where("not guarded"), "causal_chain", "medium", "var", "write_line"))
    cross = crossfile.expand_chains(accesses, resolved.drop("line"), t("export").select("file", "name", "line").dropDuplicates(["file", "name"]))
    risks = crossfile.dedupe_risks(crossfile.risk_cross_file_mutation(cross).unionByName(crossfile.risk_async_state_race(cross, timing)).unionByName(crossfile.risk_unawaited_promise(timing)))
    out.append(detect.as_findings(risks, "cross_file_risk", "high", "subject"))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def signals(project: Project, found: DataFrame) -> DataFrame:
    """One row of the facts that the pattern store reads."""
    n = lambda d: F.count_if(F.col("detector") == d)
    f = found.agg(
        n("global_write_race").alias("n_global_races"), n("state_mutation").alias("n_state_mutations"), n("foreach_mutation").alias("n_foreach_mutations"), n("floating_promise").alias("n_floating"), n("react_pattern").alias("n_react"), F.lit(0).alias("n_react_direct"),
        F.count_if((F.col("detector") == "cross_file_risk") & F.contains("details", F.lit('"cross_file_mutation"'))).alias("n_cross_file_mutations"), F.count_if((F.col("detector") == "cross_file_risk") & F.contains("details", F.lit('"async_state_race"'))).alias("n_async_races"),
    )
    a = project.table("access").agg(F.count_if(F.col("conditional")).alias("n_conditional_writes"))
    t = project.table("timing").agg(F.array_sort(F.collect_set("api")).alias("timing_apis"))  # a dozen names, and events of listeners
    c = closures(project).agg(F.count("*").alias("n_closures"))
    return f.crossJoin(a).crossJoin(t).crossJoin(c)  # four single rows


def closures(project: Project) -> DataFrame:
    """(file, fn, vars): what functions capture of the functions around them."""
    scopes = materialize(project.table("scope").select("file", "scope_id", "parent_id"))
    own = scopes.select("file", "scope_id", F.col("scope_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    up = materialize(scopes.where("parent_id >= 0").select("file", "scope_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth")))
    reach = 1
    while not up.where(F.col("depth") == reach).isEmpty():  # functions in functions to any depth, twice as deep each round
        further = up.where(F.col("depth") == reach).join(up.select("file", F.col("scope_id").alias("ancestor_id"), F.col("ancestor_id").alias("above"), F.col("depth").alias("more")), ["file", "ancestor_id"])
        up = materialize(up.unionByName(further.select("file", "scope_id", F.col("above").alias("ancestor_id"), (F.col("depth") + F.col("more")).alias("depth"))))
        reach *= 2
    all_ = own.unionByName(up)
    return detect.closure_captures(project.table("use").where("scope_id >= 0"), project.table("binding"), all_)


def analyze(project: Project, symptom: str, store: DataFrame) -> dict[str, DataFrame]:
    """Evidence for a symptom: findings, patterns, cross-function variables, routed files, warnings."""
    found = materialize(findings(project))
    events = patterns.extract_events(signals(project, found))
    nodes, edges, _ = build_map(project)
    races = found.where(F.col("detector") == "global_write_race").select("file", F.col("subject").alias("var"))
    return {
        "findings": found,
        "patterns": patterns.match_patterns(events, store).orderBy(F.desc("confidence"), "pattern_id").limit(5),
        "variables": detect.cross_function_filter(project.table("access"), forced=races, names=True),
        "files": rank.route(materialize(nodes), materialize(edges), symptom),
        "warnings": verify.file_completeness(project.files),
    }


def check_claims(claims: DataFrame, files: DataFrame) -> DataFrame:
    """claims (claim_id, root_cause, hypotheses, evidence array, location_file, location_line, confidence) with status, penalty and adjusted confidence.

    Files are known by path, base name or suffix; evidence must stand in some file.
    """
    known = files.select("path", F.col("path").alias("ord"), F.size(F.split("content", "\n")).alias("n_lines"))
    gate = F.coalesce(verify.hypothesis_gate(F.col("hypotheses")), verify.citation_gate(F.col("root_cause")))
    p = r"([\w\-./\\]+\.(?:js|jsx|ts|tsx|mjs|cjs|py|vue|svelte))\s*(?::|\s+L|\s+line\s+)?\s*(\d+)?"
    c = claims.withColumn("gate", gate).withColumn("root_file", F.regexp_extract("root_cause", p, 1)).withColumn("root_line", F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(root_cause, '[\\w./-]+\\.(js|jsx|ts|tsx|mjs|cjs|py|vue|svelte)\\s*(:|\\s+L|\\s+line\\s+)\\s*(\\d+)', 3), '') as int)"), F.lit(0)))
    names = c.select(F.explode(F.array("root_file", "location_file")).alias("name")).where("name <> ''").distinct()
    match = crossfile.path_matches(names, known.select("path", "ord")).join(known.select("path", "n_lines"), "path").select("name", "n_lines")
    # claims that name no file would all meet in one task: they are dealt by their ids, and no match has the name ""
    for k, n in (("root", "root_lines"), ("location", "file_lines")):
        name = F.coalesce(f"{k}_file", F.lit(""))
        c = c.withColumn("__name", F.struct(name.alias("name"), F.when(name == "", F.xxhash64("claim_id")).otherwise(F.lit(0)).alias("of")))  # one key: of two a fixed one is taken out of the join
        c = c.join(match.select(F.struct("name", F.lit(0).cast("long").alias("of")).alias("__name"), F.col("n_lines").alias(n)), "__name", "left").drop("__name")
    said = claims.select("claim_id", F.posexplode("evidence").alias("i", "text")).select(F.concat_ws(":", "claim_id", "i").alias("claim_id"), F.col("claim_id").alias("of"), "text")
    hits = verify.literal_exists(said, files).select("claim_id").distinct()
    misses = said.join(hits, "claim_id", "left_anti").where(F.size(verify.literal_candidates(F.col("text"))) > 0).groupBy(F.col("of").alias("claim_id")).agg(F.count("*").alias("n_literal_misses"))
    zero, false = F.lit(0), F.lit(False)
    c = c.join(misses, "claim_id", "left").withColumns({
        "n_literal_misses": F.coalesce("n_literal_misses", zero), "n_unknown_evidence": zero, "location_known": (F.coalesce("location_file", F.lit("")) == "") | F.col("file_lines").isNotNull(),
        "file_lines": F.coalesce("file_lines", zero + 10**9), "root_known": F.col("root_lines").isNotNull(), "root_lines": F.coalesce("root_lines", zero), "cross_repo": false, "whitelisted": false, "n_missing_callers": zero, "n_unknown_security": zero,
        "location_line": F.coalesce("location_line", zero),
    })
    out = verify.claim_penalty(c)
    status = F.when(F.col("gate").isNotNull(), F.col("gate")).when(F.col("rejected"), "REJECTED").when(F.col("penalty") > 0, "FAILED").otherwise("PASSED")
    return out.select(*claims.columns, status.alias("status"), "penalty", "adjusted")


def learn(store: DataFrame, matched: DataFrame, passed: bool) -> DataFrame:
    """The pattern store after a verdict."""
    return patterns.reinforce(store, matched) if passed else patterns.penalize(store, matched)


def refresh(spark: SparkSession, files: DataFrame, stored: tuple[DataFrame, DataFrame, DataFrame], before: Project | None = None) -> tuple[tuple[DataFrame, DataFrame, DataFrame], dict[str, int]]:
    """The stored graph, patched where few files changed and built anew otherwise, with the numbers of changes.

    For maps that are kept as three tables. All files are scanned, or with the project that the stored graph was built of the changed ones alone. Edges come from the facts of all files, so what unchanged files import and call of changed ones is not lost.
    """
    now = files.select("path", content_hash(F.col("content")).alias("content_hash"))
    changed = materialize(graph.changed_files(now, stored[2]))
    counts = {r.status: r.n for r in changed.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return stored, counts
    new = build_map(load(files, extract.MAP_FACTS, before, changed))
    if not graph.should_patch(sum(counts.values()), files.count()):
        return new, counts
    own = new[0].join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(*new[0].columns)
    hashes = new[2].join(changed.select("path"), "path", "left_semi")
    nodes, _, h = graph.merge_graph(stored[0].select(*new[0].columns), stored[1].limit(0), stored[2], changed, own, stored[1].limit(0), hashes)
    return (nodes, new[1], h), counts


def update_map(store: Store, files: DataFrame, complete: bool = True) -> tuple[tuple[DataFrame, DataFrame, DataFrame], incremental.Update]:
    """(nodes, edges, hashes) of a stored map brought up to date, and what that took: only changed files are scanned."""
    done = incremental.update(store, files, complete)
    return incremental.stored_graph(store), done


def memory_hints(archive: DataFrame, codex: DataFrame, symptom: str, now, vector: list[float] | None = None) -> dict[str, DataFrame]:
    """What past diagnoses and notes say about a symptom."""
    out = {"codex": memory.search_codex(codex, symptom, now)}
    if vector is not None:
        out["archive"] = memory.search_archive(archive, vector)
    return out
