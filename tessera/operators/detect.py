"""Detectors as queries over fact tables. Lines are ints; fn is the enclosing function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import lit_array
from tessera.operators.crossfile import ASYNC_CALLS, OFTEN
from tessera.operators.graph import first_by
from tessera.operators.tables import materialize

# Methods that change an array, map or set in place.
STATE_MUTATORS = ["push", "pop", "shift", "unshift", "splice", "sort", "reverse", "fill", "copyWithin", "delete", "set", "add", "clear"]
# Of these, those that change what a running forEach visits.
LOOP_MUTATORS = ["delete", "add", "set", "clear", "push", "pop", "shift", "unshift", "splice"]
# Iterators that drop the promises of their callbacks, and receivers that are never asynchronous.
VOID_ITERATORS = ["forEach", "find", "findIndex", "some", "every", "filter", "reduce"]
SYNC_RECEIVERS = ["Object", "Array", "Math", "JSON", "Promise", "Symbol", "Number", "String", "Boolean"]
# Variable names that say nothing across functions.
NOISE_NAMES = ["i", "j", "k", "n", "m", "x", "y", "_", "a", "b", "c", "d", "f", "g", "h", "p", "q", "r", "s", "t", "v", "w", "z", "err", "error", "e", "res", "result", "temp", "tmp", "key", "val", "value", "item", "el", "elem", "node", "cb", "fn", "idx", "len", "count", "index", "event", "evt", "ctx", "resolve", "reject"]
# Names of predicates.
PREDICATE = r"^(is[A-Z_]|can[A-Z_]|has[A-Z_]|should[A-Z_]|meets?[A-Z_]?$|meets[A-Z_]|passes?[A-Z_]?$|passes[A-Z_]|eligible[A-Z_]?$|ready[A-Z_]?$|allows?[A-Z_]?$|allows[A-Z_]|permits?[A-Z_]?$|permits[A-Z_]|qualifies?[A-Z_]?$)"
PREDICATE_SNAKE = r"^(is_|can_|has_|should_|meets_|passes_|eligible_|allows_|permits_|qualifies_)"
SETTER = r"^(set|clear|reset|init)[A-Z]"


def react_patterns(hooks: DataFrame, declarators: DataFrame) -> DataFrame:
    """hooks (file, line, hook, n_args, has_timing, has_await, has_cleanup, deps array) and declarators (file, name, unstable) to (type, file, line, subject)."""
    effect, memo = F.col("hook").isin("useEffect", "useLayoutEffect"), F.col("hook").isin("useMemo", "useCallback")
    kinds = [
        ("state_hook", F.col("hook") == "useState"),
        ("effect_without_cleanup", effect & F.col("has_timing") & ~F.col("has_cleanup")),
        ("effect_async_without_cleanup", effect & F.col("has_await") & ~F.col("has_cleanup")),
        ("effect_without_deps", effect & F.col("deps").isNull()),
        ("memo_without_deps", memo & F.col("deps").isNull()),
    ]
    found = hooks.select("file", "line", F.col("hook").alias("subject"), F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in kinds]))).alias("type"))
    deps = hooks.where("deps is not null").select("file", "line", F.explode("deps").alias("subject"))
    unstable = deps.join(declarators.where("unstable").select("file", F.col("name").alias("subject")).distinct(), ["file", "subject"])
    return found.select("type", "file", "line", "subject").unionByName(unstable.select(F.lit("unstable_dependency").alias("type"), "file", "line", "subject"))


def listener_parity(added: DataFrame, removed: DataFrame) -> DataFrame:
    """(file, event, add_line, remove_line, type): differences between each added listener and the first removal of its event and handler.

    Both have file, event, handler, line, capture, passive (null: not given) and has_options. An add without a
    removal says nothing here (see orphan_listeners).
    """
    r = first_by(removed, ["file", "event", "handler"], "line").select("file", "event", "handler", F.col("line").alias("remove_line"), *[F.col(c).alias(f"r_{c}") for c in ("capture", "passive", "has_options")])
    j = added.join(r, ["file", "event", "handler"])
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    kinds = F.array_compact(F.array(
        F.when(off("capture") != off("r_capture"), "capture_mismatch"),
        F.when(F.col("passive").isNotNull() & F.col("r_passive").isNotNull() & (off("passive") != off("r_passive")), "passive_asymmetric"),
        F.when(F.col("has_options") & ~F.col("r_has_options"), "options_omitted"),
    ))
    return j.select("file", "event", F.col("line").alias("add_line"), "remove_line", F.explode(kinds).alias("type"))


def orphan_listeners(added: DataFrame, removed: DataFrame) -> DataFrame:
    return added.join(removed.select("file", "event", "handler"), ["file", "event", "handler"], "left_anti")


def state_mutations(accesses: DataFrame, calls: DataFrame, state_vars: DataFrame) -> DataFrame:
    """(file, line, var, how): writes to members of state variables (file, var), and mutator calls on them (calls: file, receiver, callee, line)."""
    w = accesses.where("kind = 'write' and (var like '%.%' or computed)").select("file", "line", F.regexp_extract("var", r"^([^.\[]+)", 1).alias("var"), F.lit("assignment").alias("how"))
    c = calls.where(F.col("callee").isin(*STATE_MUTATORS)).select("file", "line", F.col("receiver").alias("var"), F.col("callee").alias("how"))
    return w.unionByName(c).join(state_vars.select("file", "var"), ["file", "var"], "left_semi")


def floating_promises(calls: DataFrame, callbacks: DataFrame) -> DataFrame:
    """(file, line, fn, api, why): unawaited async calls (file, line, fn, callee, receiver, is_awaited), and async callbacks (file, line, fn, method, is_async) of iterators that drop promises."""
    ok = F.col("callee").isin(*ASYNC_CALLS) & ~F.col("is_awaited") & ~F.coalesce(F.col("receiver").isin(*SYNC_RECEIVERS), F.lit(False))
    a = calls.where(ok).select("file", "line", "fn", F.col("callee").alias("api"), F.lit("not awaited").alias("why"))
    b = callbacks.where(F.col("is_async") & F.col("method").isin(*VOID_ITERATORS)).select("file", "line", "fn", F.col("method").alias("api"), F.lit("async callback").alias("why"))
    return a.unionByName(b)


def write_before_await(statements: DataFrame, keys: tuple[str, ...] = ("file", "block_id"), order: str = "stmt_idx", write: str = "write_subject", await_line: str = "await_line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each write with the line of the first later statement of its block that awaits; writes without one go.

    A window over a block's statements finds it, forward; blocks are functions' bodies, which are short.
    """
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    s = statements.withColumn("first_await", F.min(await_line).over(w))
    return s.where(F.col(write).isNotNull() & F.col("first_await").isNotNull()).select(*keys, order, write, *keep, "first_await")


def setter_tag(name: Column, is_local: Column) -> Column:
    """A written subject's name; an imported name that looks like a setter is marked as not resolved."""
    return F.when(~is_local & name.rlike(SETTER), F.concat(name, F.lit(" (UNRESOLVED)"))).otherwise(name)


def causal_chains(triggers: DataFrame, writes: DataFrame, reads: DataFrame, guards: list[str] | None = None, write_like: str | None = r"^set[A-Z]|^dispatch$|^setState$", guard_like: str = r"(?i)abort|cancel|mounted|stale|ignore") -> DataFrame:
    """(file, fn, trigger, trigger_line, var, write_line, guarded, confidence): async triggers and the later state writes in their function.

    A read of a guard's name after the trigger and up to the write guards it. A function's rows are swept once by
    line: a write learns how many triggers are open before it and where the last guard stood. It then meets triggers by
    their number, so rows are made for chains alone, and the chains of a long function lie in many tasks.
    Triggers and writes that occur twice give a chain each time; rows without file, function or line give none.
    """
    row = lambda df, kind, name: df.where("file is not null and fn is not null and line is not null").select("file", "fn", "line", F.lit(kind).alias("kind"), name.alias("name"))
    g = reads.where(F.col("var").isin(*guards) if guards else F.col("var").rlike(guard_like))
    w = writes.where(F.col("var").rlike(write_like)) if write_like else writes
    # of rows on one line a guard comes first, for it guards the write there, and a trigger last, for it is not open yet
    rows = row(g, 0, F.lit(None).cast("string")).unionByName(row(w, 1, F.col("var"))).unionByName(row(triggers, 2, F.col("api")))
    so_far = W.partitionBy("file", "fn").orderBy("line", "kind", "name").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = rows.withColumn("n", F.count(F.when(F.col("kind") == 2, 1)).over(so_far)).withColumn("guard", F.last(F.when(F.col("kind") == 0, F.col("line")), ignorenulls=True).over(so_far))
    opened = swept.where("kind = 2").select("file", "fn", "n", F.col("name").alias("trigger"), F.col("line").alias("trigger_line"))
    later = swept.where("kind = 1 and n > 0").select("file", "fn", F.col("name").alias("var"), F.col("line").alias("write_line"), "guard", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("n"))
    out = opened.join(later, ["file", "fn", "n"]).withColumn("guarded", F.coalesce(F.col("guard") > F.col("trigger_line"), F.lit(False)))
    out = out.select("file", "fn", "trigger", "trigger_line", "var", "write_line", "guarded")
    return out.withColumn("confidence", F.when(F.col("guarded"), None).when(F.col("trigger").isin("then", "fetch"), "high").otherwise("low"))


def multi_source_races(chains: DataFrame, keys: tuple[str, ...] = ("file", "var")) -> DataFrame:
    """Variables that two or more unguarded chains write, from two or more triggers."""
    g = chains.where("not guarded").groupBy(*keys).agg(F.count("*").alias("n_chains"), F.countDistinct("trigger").alias("n_triggers"), F.array_sort(F.collect_set("trigger")).alias("triggers"))
    return g.where("n_chains >= 2 and n_triggers >= 2")


def captured_references(new_exprs: DataFrame, imports: DataFrame, lets: DataFrame, reassigned: DataFrame, captures: DataFrame) -> DataFrame:
    """Constructor arguments that keep an imported, reassigned module variable.

    new_exprs (file, class, arg, arg_idx, line), imports (file, local_name, from_file, original_name), lets and
    reassigned (file, var), captures (file, class, param_idx, field): the class's own file or the one it is imported from.
    """
    a = new_exprs.join(imports.select("file", F.col("local_name").alias("arg"), F.col("from_file").alias("source"), F.col("original_name").alias("var")), ["file", "arg"])
    a = a.join(lets.select(F.col("file").alias("source"), "var"), ["source", "var"], "left_semi").join(reassigned.select(F.col("file").alias("source"), "var"), ["source", "var"], "left_semi")
    own = captures.select("file", "class", F.col("param_idx").alias("arg_idx"), F.col("field").alias("own"))
    cls = imports.select("file", F.col("local_name").alias("class"), F.col("from_file").alias("cf"), F.col("original_name").alias("cn"))
    far = cls.join(captures.select(F.col("file").alias("cf"), F.col("class").alias("cn"), F.col("param_idx").alias("arg_idx"), F.col("field").alias("far")), ["cf", "cn"]).select("file", "class", "arg_idx", "far")
    out = a.join(own, ["file", "class", "arg_idx"], "left").join(far, ["file", "class", "arg_idx"], "left").withColumn("field", F.coalesce("own", "far"))
    return out.where("field is not null").select("file", "line", "class", "arg", "source", "var", "field")


def variable_stats(accesses: DataFrame, keys: tuple[str, ...] = ("file", "var"), fn: str = "fn", write: str = "write", at_once: int = 500_000) -> DataFrame:
    """(keys, n_reassigned, n_writers, n_readers) of accesses (keys, fn, write): writes, and the functions that write or read each variable, counted exactly.

    Rows are dealt by variable and function, some at_once a task, and counted there; the functions of a variable are added up after that.
    Distinct counts in one aggregate would send each row several times over.
    """
    n = max(int(accesses.sparkSession.conf.get("spark.sql.shuffle.partitions")), accesses.count() // at_once)
    each = accesses.repartition(n, *keys, fn).groupBy(*keys, fn).agg(F.count_if(F.col(write)).alias("w"), F.count_if(~F.col(write)).alias("r"))
    some = lambda k: F.count_if((F.col(k) > 0) & F.col(fn).isNotNull())
    return each.groupBy(*keys).agg(F.sum("w").alias("n_reassigned"), some("w").alias("n_writers"), some("r").alias("n_readers"))


def stale_captures(call_exprs: DataFrame, imports: DataFrame, stats: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Module constants that keep the result of an imported function over a variable its file changes later.

    call_exprs (file, local_var, callee, line); stats (file, var, n_reassigned, n_writers, n_readers, ord, keep). Of the
    variables that are reassigned, written and read there, one named in the callee, else the first.
    """
    j = call_exprs.join(imports.select("file", F.col("local_name").alias("callee"), F.col("from_file").alias("source")), ["file", "callee"])
    s = stats.where("n_reassigned >= 1 and n_writers >= 1 and n_readers >= 1").select(F.col("file").alias("source"), "var", "ord", *[c for c in keep if c != "ord"])
    j = j.join(s, "source").withColumn("named", F.contains(F.lower("callee"), F.lower("var")))
    return first_by(j, ["file", "local_var", "line"], F.desc("named"), "ord", "var").select("file", "local_var", "callee", "line", "source", "var", *keep)


def foreach_mutations(loops: DataFrame, mutations: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, line, collection, methods, severity): loops (file, line, collection, callback) whose callback, or a function it calls, changes the collection.

    mutations (file, fn, receiver, method); calls (file, caller, callee). Critical if it deletes and also adds.
    """
    m = mutations.where(F.col("method").isin(*LOOP_MUTATORS)).select("file", "fn", F.col("receiver").alias("collection"), "method")
    direct = loops.select("file", "line", "collection", F.col("callback").alias("fn"))
    deeper = direct.join(calls.select("file", F.col("caller").alias("fn"), "callee"), ["file", "fn"]).select("file", "line", "collection", F.col("callee").alias("fn"))
    hit = direct.unionByName(deeper).distinct().join(m, ["file", "fn", "collection"])
    g = hit.groupBy("file", "line", "collection").agg(F.array_sort(F.collect_set("method")).alias("methods"), F.bool_or(F.col("method") == "delete").alias("d"), F.bool_or(F.col("method").isin("add", "set", "push")).alias("a"))
    return g.select("file", "line", "collection", "methods", F.when(F.col("d") & F.col("a"), "critical").otherwise("high").alias("severity"))


def strict_comparisons(comparisons: DataFrame) -> DataFrame:
    """Comparisons (file, fn, line, op) by < or > in functions named like predicates."""
    return comparisons.where(F.col("op").isin("<", ">") & (F.col("fn").rlike(PREDICATE) | F.col("fn").rlike(PREDICATE_SNAKE)))


def user_async_floats(unawaited: DataFrame, async_functions: DataFrame, known: DataFrame, often: int = OFTEN) -> DataFrame:
    """Unawaited calls (file, line, api) of any project function that is async (name), but for findings known already.

    Calls and functions meet on names; what is called more than `often` times is known to all workers, so that no task has all calls of a name.
    """
    names = async_functions.select(F.col("name").alias("api")).distinct().withColumn("is_async", F.lit(True))
    used = unawaited.groupBy("api").agg(F.count("*").alias("uses")).join(names, "api", "left")
    used = materialize(used.where(F.col("is_async") | (F.col("uses") > often)))
    common = used.where(F.col("uses") > often)  # as many as all calls by `often` at most
    rare = unawaited.join(F.broadcast(common.select("api")), "api", "left_anti").join(used.where(F.col("is_async") & (F.col("uses") <= often)).select("api"), "api", "left_semi")
    calls = rare.unionByName(unawaited.join(F.broadcast(common.where("is_async").select("api")), "api", "left_semi"))
    return calls.join(known.select("file", "line", "api"), ["file", "line", "api"], "left_anti")


def cross_function_filter(accesses: DataFrame, keys: tuple[str, ...] = ("file", "var"), forced: DataFrame | None = None, noise: list[str] | None = None, names: bool = False) -> DataFrame:
    """(keys, n_writers, n_readers, n_only_read): variables that some function reads and another writes. Forced ones (keys) always stay, noise names go.

    Functions are counted; with `names` the sorted arrays writers and readers are added, for code, where they are short.
    """
    each = accesses.groupBy(*keys, "fn").agg(F.bool_or(F.col("kind") == "write").alias("w"), F.bool_or(F.col("kind") == "read").alias("r"))
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col(k), F.col("fn"))))
    g = each.groupBy(*keys).agg(
        F.count_if("w").alias("n_writers"), F.count_if("r").alias("n_readers"), F.count_if(F.col("r") & ~F.col("w")).alias("n_only_read"),
        *[of(k).alias(n) for k, n in (("w", "writers"), ("r", "readers")) if names],
    )
    ok = (F.col("n_writers") > 0) & (F.col("n_only_read") > 0)
    if noise is None or noise:
        ok = ok & ~F.col(keys[-1]).isin(*(noise or NOISE_NAMES))
    if forced is None:
        return g.where(ok)
    f = forced.select(*keys).distinct().withColumn("__f", F.lit(True))
    return g.join(f, list(keys), "left").where(ok | F.col("__f")).drop("__f")


def is_critical(findings: DataFrame, matches: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row (critical): any race, any floating promise, or a pattern at the threshold."""
    a = findings.agg(F.coalesce(F.bool_or(F.col("detector").isin("global_write_race", "floating_promise")), F.lit(False)).alias("x"))
    b = matches.agg(F.coalesce(F.bool_or(F.col("confidence") >= threshold), F.lit(False)).alias("y"))
    return a.crossJoin(b).select((F.col("x") | F.col("y")).alias("critical"))  # two single rows


def known_findings(findings: DataFrame, categories: list[str], dropped_rules: list[str]) -> DataFrame:
    """Findings of other analyzers: two categories, without some rules and level none, by severity, file and line."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, i) for i, s in enumerate(("critical", "high", "medium", "low"))], F.lit(4))
    return findings.where(F.col("category").isin(*categories) & ~F.col("rule_id").isin(*dropped_rules) & (F.col("level") != "none")).orderBy(rank, "file", "line")


def parse_quality(files: DataFrame) -> DataFrame:
    """files (error_nodes, total_nodes) with parse_status: skip above 40 % errors, partial above 10 %, for over 20 nodes."""
    r = F.col("error_nodes") / F.col("total_nodes")
    return files.withColumn("parse_status", F.when(F.col("total_nodes") <= 20, "ok").when(r > 0.4, "skip").when(r > 0.1, "partial").otherwise("ok"))


def closure_captures(uses: DataFrame, bindings: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(file, fn, vars): names used in a function (file, scope_id, fn, name), not bound there but in an outer scope other than the module's.

    bindings (file, scope_id, name, kind); ancestors (file, scope_id, ancestor_id, depth).
    """
    own = bindings.select("file", "scope_id", "name")
    free = uses.join(own, ["file", "scope_id", "name"], "left_anti")
    outer = ancestors.where("depth > 0").join(bindings.select("file", F.col("scope_id").alias("ancestor_id"), "name", "kind"), ["file", "ancestor_id"])
    found = free.join(outer, ["file", "scope_id", "name"]).groupBy("file", "scope_id", "fn", "name").agg(F.min_by("kind", "depth").alias("kind"))
    return found.where(~F.col("kind").isin("module", "hoisted")).groupBy("file", "fn").agg(F.array_sort(F.collect_set("name")).alias("vars"))


def as_findings(df: DataFrame, detector: str, severity: str | Column, subject: str, line: str = "line") -> DataFrame:
    """One shape for all detectors: detector, severity, file, line, subject and the rest as JSON."""
    return df.select(F.lit(detector).alias("detector"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), "file", F.col(line).cast("int").alias("line"), F.col(subject).cast("string").alias("subject"), F.to_json(F.struct(*df.columns)).alias("details"))


def names_any(c: Column, names: list[str]) -> Column:
    return F.exists(lit_array(names), lambda n: c == n)
