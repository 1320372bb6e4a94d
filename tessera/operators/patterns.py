"""A weighted store of event patterns: extraction, matching and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import fnv_signature, lit_array
from tessera.operators.graph import first_by
from tessera.operators.tables import materialize

# The patterns a new store holds (id, events, type, severity, CWE, weight).
STARTERS = [
    ("race_condition_write_await_read", ["write_shared", "await_boundary", "read_shared"], "race_condition", "critical", "CWE-362", 0.95),
    ("global_write_race", ["global_write", "await_expression"], "race_condition", "critical", "CWE-362", 0.90),
    ("foreach_collection_mutation", ["forEach_loop", "collection_mutate"], "foreach_mutation", "high", "CWE-362", 0.90),
    ("stale_closure_async_delay", ["closure_capture", "async_delay", "stale_var_access"], "stale_closure", "high", "CWE-416", 0.85),
    ("orphan_listener", ["addEventListener", "no_removeEventListener"], "orphan_listener", "high", "CWE-401", 0.88),
    ("ghost_reference_constructor", ["constructor_capture", "module_reassign"], "ghost_reference", "medium", "CWE-476", 0.80),
    ("react_direct_state_mutation", ["state_property_write", "no_setState"], "direct_state_mutation", "high", "CWE-362", 0.88),
    ("zustand_array_mutation", ["state_array_push", "zustand_store"], "direct_state_mutation", "high", "CWE-362", 0.90),
    ("floating_promise", ["async_call", "no_await", "expression_statement"], "floating_promise", "medium", "CWE-362", 0.75),
    ("cross_file_mutation", ["exported_var", "mutation_in_importer"], "cross_file_mutation", "high", "CWE-362", 0.85),
    ("interval_without_clear", ["setInterval", "no_clearInterval"], "orphan_listener", "high", "CWE-401", 0.85),
    ("numeric_string_strict_compare", ["string_input", "strict_numeric_comparison"], "type_confusion", "high", "CWE-704", 0.87),
    ("unvalidated_user_input", ["req_query_access", "no_type_check", "downstream_numeric"], "trusted_input", "high", "CWE-20", 0.88),
    ("use_effect_no_cleanup", ["useEffect_call", "addEventListener_inside", "no_return_cleanup"], "orphan_listener", "high", "CWE-401", 0.82),
    ("conditional_state_mutation", ["conditional_write", "shared_state"], "race_condition", "medium", "CWE-362", 0.70),
    ("non_reactive_read_after_write", ["state_write", "immediate_state_read", "async_context"], "race_condition", "medium", "CWE-362", 0.72),
    ("promise_all_no_catch", ["promise_all_call", "no_catch_handler"], "floating_promise", "medium", "CWE-390", 0.72),
    ("dynamic_require_in_loop", ["loop_body", "require_call"], "performance", "low", "CWE-400", 0.60),
    ("missing_async_return", ["async_function", "conditional_branch", "missing_return"], "floating_promise", "medium", "CWE-252", 0.68),
    ("mutable_default_argument", ["function_param_default", "mutable_object_literal", "param_mutation"], "stale_closure", "medium", "CWE-375", 0.65),
]
SCHEMA = "id string, hash string, signature array<string>, bug_type string, description string, severity string, cwe string, weight double, hit_count int"


def descriptions() -> list[str]:
    """What each starter is about, in the words of its id and events: symptoms are held against these words."""
    return [f"{i.replace('_', ' ')}: {' '.join(s).replace('_', ' ')}" for i, s, *_ in STARTERS]


def starters(spark: SparkSession) -> DataFrame:
    rows = [(i, fnv_signature(s), s, t, said, sev, cwe, w, 0) for (i, s, t, sev, cwe, w), said in zip(STARTERS, descriptions(), strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def overlay(*layers: DataFrame) -> DataFrame:
    """Pattern tables on top of each other by hash, the last wins; rows without hash or signature go."""
    out = None
    for i, x in enumerate(layers):
        x = x.where(F.col("hash").isNotNull() & F.col("signature").isNotNull()).withColumn("__l", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return first_by(out, ["hash"], F.desc("__l"), "id").drop("__l")


def extract_events(facts: DataFrame) -> DataFrame:
    """(events): the events that each row of facts gives; see events_column."""
    return facts.select(events_column().alias("events"))


def events_column() -> Column:
    """The events that the facts of a row give, as an array.

    facts: n_conditional_writes, n_global_races, n_closures, n_state_mutations, n_foreach_mutations, n_floating,
    n_react, n_react_direct, n_cross_file_mutations, n_async_races as numbers, timing_apis as an array.
    """
    any_ = lambda c: F.col(c) > 0
    api = lambda s: F.array_contains("timing_apis", s)
    listens = lambda s: F.exists("timing_apis", lambda a: F.contains(a, F.lit(s)))
    delay = api("setTimeout") | api("setInterval")
    rules = {
        "conditional_write": any_("n_conditional_writes"),
        "global_write": any_("n_global_races"), "await_expression": any_("n_global_races"),
        "write_shared": any_("n_global_races") | any_("n_async_races"), "read_shared": any_("n_global_races") | any_("n_async_races"),
        "await_boundary": (F.size("timing_apis") > 0) | any_("n_async_races"),
        "async_delay": delay, "setInterval": api("setInterval"), "no_clearInterval": delay & ~api("clearInterval"),
        "addEventListener": listens("addEventListener"), "no_removeEventListener": listens("addEventListener") & ~listens("removeEventListener"),
        "closure_capture": any_("n_closures"), "stale_var_access": any_("n_closures") & any_("n_global_races") & delay,
        "state_array_push": any_("n_state_mutations"), "state_property_write": any_("n_state_mutations") | any_("n_react_direct"),
        "collection_mutate": any_("n_state_mutations") | any_("n_foreach_mutations"), "forEach_loop": any_("n_foreach_mutations"),
        "async_call": any_("n_floating"), "no_await": any_("n_floating"), "expression_statement": any_("n_floating"),
        "useEffect_call": any_("n_react"), "no_setState": any_("n_react_direct"),
        "exported_var": any_("n_cross_file_mutations"), "mutation_in_importer": any_("n_cross_file_mutations"),
    }
    return F.array_compact(F.array(*[F.when(c, e) for e, c in rules.items()]))


def match_patterns(subjects: DataFrame, patterns: DataFrame, min_weight: float = 0.3, min_coverage: float = 0.7) -> DataFrame:
    """subjects (..., events) with pattern_id, coverage and confidence for each pattern of which enough events occur.

    Candidates come from match_candidates; a subject without events or a pattern without any matches nothing.
    """
    s, p, columns = subjects, patterns.where(F.col("weight") >= min_weight), subjects.columns
    hit = match_candidates(s, p.select(F.col("id").alias("pattern_id"), "signature", "weight"), min_coverage)
    coverage = F.size(F.filter("signature", lambda e: F.array_contains("events", e))) / F.size("signature")
    out = hit.withColumn("coverage", coverage).where(F.col("coverage") >= min_coverage)
    return out.select(*columns, "pattern_id", "coverage", F.least(F.col("weight") * F.col("coverage"), F.lit(1.0)).alias("confidence"))


def match_candidates(subjects: DataFrame, patterns: DataFrame, min_coverage: float) -> DataFrame:
    """Each subject (..., events) beside each pattern (signature, ...) that it may cover by min_coverage, once.

    A pattern of n events of which k must occur shares, with any subject that has k, one of its n - k + 1 rarest. So the
    join is by those events only, and one that most subjects have is no key but for patterns made of such alone. Subjects
    with fewer distinct events than a pattern needs go before the join's rows are made; a pair met by several events is kept at
    the rarest, so nothing is shuffled again to drop repeats.
    """
    n = F.size("signature")
    each = patterns.where(n > 0).withColumn("__id", F.monotonically_increasing_id()).withColumn("__need", F.greatest(F.ceil(n * F.lit(float(min_coverage)) - 1e-9), F.lit(1)).cast("int"))
    each = materialize(each)  # the numbers of rows must not change between the uses
    names = each.select(F.explode("signature").alias("__e")).distinct()
    own = subjects.select(F.explode(F.array_distinct("events")).alias("__e"))
    often = names.join(own.join(names, "__e", "left_semi").groupBy("__e").agg(F.count("*").alias("__f")), "__e", "left").fillna(0, ["__f"])
    ranked = each.select("__id", F.explode("signature").alias("__e")).join(often, "__e").groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("__f", "__e")))["__e"].alias("__rare"))
    p = each.join(ranked, "__id").withColumn("__rare", F.array_distinct(F.slice("__rare", F.lit(1), F.size("signature") - F.col("__need") + 1)))
    p = p.drop("__id").withColumn("__e", F.explode("__rare"))
    s = subjects.withColumn("__has", F.size(F.array_distinct("events"))).withColumn("__e", F.explode(F.array_distinct("events"))).join(names, "__e", "left_semi")
    hit = s.join(p, "__e").where((F.col("__has") >= F.col("__need")) | (F.size(F.array_distinct("signature")) < F.size("signature")))
    first = F.get(F.filter("__rare", lambda e: F.array_contains("events", e)), F.lit(0))
    return hit.where(F.col("__e") == first).drop("__e", "__has", "__need", "__rare")


def reinforce(patterns: DataFrame, matched: DataFrame, step: float = 0.05) -> DataFrame:
    """patterns after a verified diagnosis: matched ones (pattern_id) weigh more, 1 at most, and count a hit."""
    m = matched.select(F.col("pattern_id").alias("id")).distinct().withColumn("__m", F.lit(True))
    out = patterns.join(m, "id", "left")
    return out.withColumn("weight", F.when(F.col("__m"), F.least(F.lit(1.0), F.col("weight") + step)).otherwise(F.col("weight"))).withColumn("hit_count", F.when(F.col("__m"), F.col("hit_count") + 1).otherwise(F.col("hit_count"))).select(*patterns.columns)


def penalize(patterns: DataFrame, matched: DataFrame, step: float = 0.03, floor: float = 0.3) -> DataFrame:
    """patterns after a diagnosis that failed: matched ones weigh less, the floor at least."""
    m = matched.select(F.col("pattern_id").alias("id")).distinct().withColumn("__m", F.lit(True))
    return patterns.join(m, "id", "left").withColumn("weight", F.when(F.col("__m"), F.greatest(F.lit(floor), F.col("weight") - step)).otherwise(F.col("weight"))).select(*patterns.columns)


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each pattern of a versioned table (hash, version, ...)."""
    return first_by(versions, ["hash"], F.desc("version"))


def hints(matches: DataFrame, threshold: float = 0.65, top: int = 5) -> DataFrame:
    return matches.where(F.col("confidence") >= threshold).orderBy(F.desc("confidence"), "pattern_id").limit(top)


def with_events(df: DataFrame, events: list[str]) -> DataFrame:
    return df.withColumn("events", lit_array(events))
