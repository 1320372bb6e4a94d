"""Verification of claims against the source text, and what a confidence may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import contains_any, lit_array
from tessera.operators.literals import MAX_BYTES, literal_hits

# Penalties of failed checks.
PENALTY = {"evidence": 0.2, "location": 0.3, "line": 0.15, "cross_repo": 0.05, "completeness": 0.15, "security": 0.2}
# Words that point to a layer above the code.
UPSTREAM = [
    "keycode", "key code", "keyboard", "keybinding", "key event", "keyboardevent", "keyboard layout", "keyboard mapping", "scancode", "raw event", "native event", "os event", "input event",
    "operating system", "os layout", "os keyboard", "macos", "windows", "eurkey", "keyboard driver", "layout translation",
    "browser event", "electron", "nativekeymap", "chromium", "web api", "dom event", "platform api", "external api", "third-party api", "upstream service", "network response", "server response",
]
# Phrases of the error classes, in order.
PACKAGE_PHRASES = ["cannot find package", "module not found", "cannot resolve module", "err_package_path", "err_module_not_found", "cannot find module", "failed to resolve", "workspace:"]
BUILD_PHRASES = ["compilation failed", "build failed", "typescript error", "ts error", "webpack", "esbuild", "tsconfig", "cannot find name", "property does not exist on type"]
TYPE_PHRASES = ["typeerror", "is not a function", "cannot read propert", "is not defined", "undefined is not", "null is not"]
# Texts that read like instructions.
INJECTION = r"(?i)ignore\s+(previous|above|all)\s+instructions|you\s+are\s+now|system\s+prompt|\[INST\]|<instructions>|new\s+role:|act\s+as\s+a"
CITATION = r"(?i)[\w\-./\\]+\.(?:js|jsx|ts|tsx|mjs|cjs|py|vue|svelte)\b.{0,40}?(?:\bL|:)\s*\d+"


def hypothesis_gate(hypotheses: Column) -> Column:
    return F.when(F.coalesce(F.size(hypotheses), F.lit(0)) <= 0, "PROTOCOL_VIOLATION")


def citation_gate(root_cause: Column) -> Column:
    """A root cause must name a file and a line."""
    return F.when(~F.coalesce(root_cause, F.lit("")).rlike(CITATION), "PROTOCOL_VIOLATION")


def normalized(text: Column) -> Column:
    """Typographic quotes as plain ones, white space as single blanks."""
    # any run of white space but a single blank, which may stay and is what most runs are
    return F.trim(F.regexp_replace(F.translate(text, "‘’“”`", "''\"\"'"), r"[^\S ]\s*| \s+", " "))


def without_citation(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*[\w\-./\\]+\.\w+\s*(?::|\s+L|\s+line\s+)?\s*\d*(?:\s*[-–]\s*\d+)?\s*[:\-–]?\s*", "")


def literal_candidates(text: Column) -> Column:
    """What of an evidence text may stand in the code: all of it, without its citation, and quoted parts of five characters or more."""
    quoted = [F.regexp_extract_all(text, F.lit(p), 1) for p in (r"`([^`]{5,})`", r'"([^"]{5,})"', r"'([^']{5,})'")]
    all_ = F.concat(F.array(text, without_citation(text)), *quoted)
    return F.array_distinct(F.filter(F.transform(all_, normalized), lambda s: F.length(s) >= 5))


def literal_exists(claims: DataFrame, files: DataFrame, claim_id: str = "claim_id", text: str = "text", path: str = "path", content: str = "content", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(claim_id, path): files in which a literal of the claim stands, both with normalized quotes and blanks. See literal_hits."""
    lits = claims.select(F.col(claim_id).alias("claim_id"), F.explode(literal_candidates(F.col(text))).alias("lit")).distinct()
    docs = files.select(F.col(path).alias("path"), normalized(F.col(content)).alias("content"))
    return literal_hits(docs, lits, max_bytes=max_bytes).join(lits, "lit").select("claim_id", "path").distinct()


def fill_down(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "filled") -> DataFrame:
    """rows with the last value that is not null up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def file_line_pairs(tokens: DataFrame, keys: tuple[str, ...] = ("claim_id",)) -> DataFrame:
    """(keys, file, line): each line number with the last file named before it. tokens (keys, offset, file, line), one of file and line null."""
    return fill_down(tokens, list(keys), ["offset"], F.col("file"), "of").where("line is not null and of is not null").select(*keys, F.col("of").alias("file"), "line").distinct()


def claim_penalty(claims: DataFrame) -> DataFrame:
    """claims with penalty, rejected and adjusted confidence.

    Columns: confidence, n_unknown_evidence, n_literal_misses, location_known, location_line, file_lines, root_known,
    cross_repo, whitelisted, root_line, root_lines, n_missing_callers, n_unknown_security.
    """
    c, p = F.col, PENALTY
    rejected = ~c("root_known") & ~c("whitelisted") & ~c("cross_repo")
    total = (
        p["evidence"] * (c("n_unknown_evidence") + c("n_literal_misses"))
        + F.when(~c("location_known"), p["location"]).when(c("location_line") > c("file_lines") + 6, p["location"]).otherwise(0.0)
        + F.when(~c("root_known") & c("cross_repo") & ~c("whitelisted"), p["cross_repo"]).otherwise(0.0)
        + F.when(c("root_known") & (c("root_line") > c("root_lines") + 10), p["line"]).otherwise(0.0)
        + p["completeness"] * c("n_missing_callers") + p["security"] * c("n_unknown_security")
    )
    out = claims.withColumn("penalty", total).withColumn("rejected", rejected)
    return out.withColumn("adjusted", F.greatest(F.lit(0.0), c("confidence") - c("penalty")))


def verdict(rejected: Column, failures: Column) -> Column:
    return F.when(~rejected & (failures == 0), "PASSED").when(rejected, "REJECTED").otherwise("FAILED")


def fix_completeness(fixes: DataFrame, call_graph: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(claim_id, function, caller): callers of a function whose declaration a fix removes (claim_id, function, file) that the claim names nowhere (claim_id, file); not components, not the file itself."""
    j = fixes.join(call_graph.select("caller", F.col("callee").alias("file"), "function"), ["file", "function"]).where("caller <> file")
    j = j.where(~F.col("caller").rlike(r"(?i)\.(jsx|tsx)$"))
    return j.join(mentioned.select("claim_id", F.col("file").alias("caller")), ["claim_id", "caller"], "left_anti").select("claim_id", "function", "caller").distinct()


def name_forms(name: Column) -> Column:
    """Ways in which a variable may be written."""
    bare = F.regexp_replace(name, r"[`'\"()\[\];]", "")
    last = F.element_at(F.split(bare, r"\."), -1)
    return F.array_distinct(F.array(name, bare, F.trim(bare), F.regexp_replace(bare, r"^this\.", ""), F.regexp_replace(bare, r"\[\]$", ""), F.split(bare, r"\.")[0], last, F.lower(bare)))


def unknown_variables(claimed: DataFrame, known: DataFrame) -> DataFrame:
    """Claimed variables (claim_id, name) none of whose forms is a known name (name)."""
    forms = claimed.select("claim_id", "name", F.explode(name_forms(F.col("name"))).alias("form"))
    ok = forms.join(known.select(F.col("name").alias("form")).distinct(), "form", "left_semi").select("claim_id", "name").distinct()
    return claimed.join(ok, ["claim_id", "name"], "left_anti")


def error_class(symptom: Column) -> Column:
    """PACKAGE_RESOLUTION, BUILD_CONFIG, RUNTIME_TYPE or RUNTIME_LOGIC, in that order."""
    s = F.lower(F.coalesce(symptom, F.lit("")))
    has = lambda w: F.contains(s, F.lit(w))
    package = contains_any(s, PACKAGE_PHRASES) | has("package.json") & (has("missing") | has("dependency"))
    build = contains_any(s, BUILD_PHRASES) | has("type error") & (has("compile") | has("build")) | has("vite") & has("error")
    return F.when(package, "PACKAGE_RESOLUTION").when(build, "BUILD_CONFIG").when(contains_any(s, TYPE_PHRASES), "RUNTIME_TYPE").otherwise("RUNTIME_LOGIC")


def layer_boundary(root_cause: Column, symptom: Column, rejected: Column, cites_provided: Column, n_refs: Column) -> Column:
    """Confidence that a cause lies above the code, null if it does not: upstream words in cause or symptom decide."""
    text = F.lower(F.concat_ws(" ", root_cause, symptom))
    n = F.size(F.filter(lit_array(UPSTREAM), lambda w: F.contains(text, w)))
    no = rejected | cites_provided | error_class(symptom).isin("PACKAGE_RESOLUTION", "BUILD_CONFIG") | (n == 0)
    return F.when(~no, F.least(F.lit(0.95), F.lit(0.7) + F.lit(0.05) * n + F.when(n_refs == 0, 0.1).otherwise(0.0)))


def boundary_shape_ok(verdict: Column, confidence: Column, layer: Column, reason: Column, suggested: Column) -> Column:
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return full(verdict) & full(layer) & full(reason) & full(suggested) & F.coalesce(confidence.between(0, 1), F.lit(False))


def has_injection(content: Column) -> Column:
    return F.coalesce(content, F.lit("")).rlike(INJECTION)


def coverage_alert(symptom: Column) -> Column:
    """Why a symptom seems to describe several behaviors: a numbered list, bullets, or a stated number; else null."""
    lines = F.filter(F.transform(F.split(symptom, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    stated = r"(?i)\b(two|three|four|2|3|4)\s+(independent|separate)\s+(bugs?|issues?|problems?|failures?|scenarios?|modes?|root causes?)\b"
    return F.when(F.length(symptom) < 50, None).when(count(r"^\d+[.)]") >= 2, "numbered list").when(count("^[-*•]") >= 2, "bullet list").when(symptom.rlike(stated), "stated number")


def recalibrate(confidence: Column, unverifiable: Column, chain_incomplete: Column, elimination: Column, n_survivors: Column, independent: Column) -> Column:
    """A confidence under the caps that hold: .70 if a hypothesis cannot be verified, .70 if the causal chain has gaps, .75 or .82
    if the survivor won by default or weakly (elimination DEFAULT or WEAK), and for several survivors .85 if they are independent causes, else .65."""
    cap = F.least(
        F.when(unverifiable, 0.70).otherwise(1.0), F.when(chain_incomplete, 0.70).otherwise(1.0),
        F.when(elimination == "DEFAULT", 0.75).when(elimination == "WEAK", 0.82).otherwise(1.0),
        F.when((n_survivors > 1) & independent, 0.85).when(n_survivors > 1, 0.65).otherwise(1.0),
    )
    return F.least(confidence, cap)


def pairwise_disjoint(sets: Column) -> Column:
    """Whether no two of an array of arrays share an element: their union is as large as their sum."""
    distinct = F.transform(sets, F.array_distinct)
    return F.aggregate(distinct, F.lit(0), lambda n, s: n + F.size(s)) == F.size(F.array_distinct(F.flatten(distinct)))


def severity_cap(severity: Column, confidence: Column) -> Column:
    return F.when(confidence < 0.7, "INFORMATIONAL").otherwise(severity)


def resource_cap(files: DataFrame, order: list[str], size: str, max_files: int = 25, max_chars: int = 1_500_000, least: int = 500, content: str | None = None) -> DataFrame:
    """The first files up to a number and a total size, with kept_chars; the one that overflows is cut if over `least` characters are left.

    Only max_files rows are put in order: a top-k, then a running sum over these few.
    """
    top = files.orderBy(*order).limit(max_files)
    w = W.orderBy(*order)
    top = top.withColumn("before", F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    room = F.lit(max_chars) - F.col("before")
    top = top.withColumn("kept_chars", F.when(F.col(size) <= room, F.col(size)).when(room > least, room)).where("kept_chars is not null").drop("before")
    return top.withColumn(content, F.left(content, F.col("kept_chars"))) if content else top


def file_completeness(files: DataFrame) -> DataFrame:
    """(path, warning): HTML that is short or not closed, and files with three more opening than closing braces."""
    html = F.lower("path").endswith(".html")
    open_ = F.regexp_count("content", F.lit(r"\{")) - F.regexp_count("content", F.lit(r"\}"))
    w = F.when(html & (F.length("content") < 50), "html too short").when(html & ~F.contains(F.lower("content"), F.lit("</html>")), "html not closed").when(~html & (open_ > 2), "braces not closed")
    return files.select("path", w.alias("warning")).where("warning is not null")


def score_diagnosis(rows: DataFrame) -> DataFrame:
    """Totals of graded runs (rca, pfr, cfr, hallucination, verify_passed, top_k_hit)."""
    return rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("rca", "pfr", "cfr")], *[F.count_if(F.col(c)).alias(c) for c in ("hallucination", "verify_passed", "top_k_hit")])


# Phrases by which a fix says that it lies elsewhere.
ABSENT_PHRASES = [
    "not provided in the files", "not provided in the provided files", "is not provided", "injected dependency", "implementation is not available", "implementation is not included",
    "not included in the", "cannot see the implementation", "which is not in the", "file was not provided", "files were not provided",
]
# Complaints about events; growth with use; moves between pages; files that control them.
EVENT_PHRASES = ["not firing", "never fires", "never triggered", "not triggered", "event not", "doesn't fire", "doesn't trigger", "not called", "not working", "doesn't work", "never called"]
GROWTH = r"(?i)grows?\s+with\s+(session|navigation|page|route|usage)|increases?\s+with\s+(navigation|page|route|each)|accumulate|scales?\s+with|per\s+(navigation|page\s+navigation|route\s+change)|each\s+time\s+(i\s+)?(navigate|visit|go\s+to)|\d+\s*(?:pages?|navigations?|routes?|visits?)\s*(?:has|have|→|->|=|causes?)?\s*\d*x\b|[nx]\s*(?:times?|events?|listeners?|calls?)\s+(?:per|after|with)|count\s+grows|more\s+(?:events?|listeners?|calls?)\s+(?:per|after|with|each)|\d+x\s+the\s+expected"
NAVIGATION = r"(?i)\bnavigate\b|\bnavigation\b|\bpage\s+change\b|\broute\s+change\b|\bunmount\b|\bswitch\s+(?:pages?|routes?|views?)\b|\bgo\s+(?:back|forward|to\s+another)\b"
ROUTER_FILE = r"(?i)router|routes?|app\.(jsx?|tsx?)|layout\.(jsx?|tsx?)|parent"


def contradictions(symptoms: DataFrame, files: DataFrame, accesses: DataFrame, timing: DataFrame) -> DataFrame:
    """(symptom_id, alert, subject): where a symptom (symptom_id, text) and the facts disagree.

    listener_gap: an event said not to fire has a listener; listener_present: others have; crash_site: a function that is
    accused only reads; lifecycle_context: a count grows with navigation and no file controls it.
    """
    listens = timing.where(F.col("api").startswith("addEventListener")).select(F.lower(F.regexp_extract("api", r'\("([^"]+)"\)', 1)).alias("event")).distinct()
    events = listens.agg(F.array_sort(F.collect_set("event")).alias("events"))  # the names that an alert lists
    s = symptoms.select("symptom_id", "text", F.lower("text").alias("low")).crossJoin(events)  # one row
    named = F.filter("events", lambda e: (e != "") & F.contains(F.col("low"), e))
    complains = contains_any(F.col("low"), EVENT_PHRASES) & (F.size("events") > 0)
    a = s.where(complains).select("symptom_id", F.when(F.size(named) > 0, "listener_gap").otherwise("listener_present").alias("alert"), F.array_join(F.when(F.size(named) > 0, named).otherwise(F.col("events")), ",").alias("subject"))
    accused = symptoms.select("symptom_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(\)"), 1))).alias("fn"))
    of = lambda k: accesses.where(F.col("kind") == k).select("fn").distinct()
    b = accused.join(of("read"), "fn", "left_semi").join(of("write"), "fn", "left_anti").select("symptom_id", F.lit("crash_site").alias("alert"), F.col("fn").alias("subject"))
    routers = files.agg(F.coalesce(F.bool_or(F.col("path").rlike(ROUTER_FILE)), F.lit(False)).alias("r"))
    c = symptoms.where(F.col("text").rlike(GROWTH) & F.col("text").rlike(NAVIGATION)).crossJoin(F.broadcast(routers)).where("not r")  # one row
    return a.unionByName(b).unionByName(c.select("symptom_id", F.lit("lifecycle_context").alias("alert"), F.lit("").alias("subject")))


def missing_fix_target(fixes: DataFrame, files: DataFrame, most: int = 3) -> DataFrame:
    """(claim_id, reason, needed): fixes (claim_id, minimal_fix, code_location) that lie in files that were not given: by phrase, or all places named are unknown."""
    known = files.select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("b")).distinct()
    refs = lambda c: F.transform(file_refs(c), F.lower)
    f = fixes.select("claim_id", contains_any(F.lower("minimal_fix"), ABSENT_PHRASES).alias("phrase"), refs(F.col("code_location")).alias("at"), refs(F.col("minimal_fix")).alias("said"), F.array_distinct(F.regexp_extract_all("minimal_fix", F.lit(r"\b(\w+(?:Service|Provider|Impl|Manager|Handler|Repository))\b"), 1)).alias("services"))
    names = f.select("claim_id", F.posexplode(F.concat("at", "said", F.transform("services", lambda x: F.concat(F.lower(x), F.lit(".ts"))))).alias("i", "b"))
    unknown = names.join(known, "b", "left_anti").groupBy("claim_id", "b").agg(F.min("i").alias("i")).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("u"))
    at_known = f.select("claim_id", F.explode("at").alias("b")).join(known, "b", "left_semi").select("claim_id").distinct().withColumn("k", F.lit(True))
    j = f.join(unknown, "claim_id", "left").join(at_known, "claim_id", "left")
    elsewhere = (F.size("at") > 0) & F.col("k").isNull()
    needed = F.slice(F.transform(F.coalesce("u", F.array().cast("array<struct<i:int,b:string>>")), lambda x: x["b"]), 1, most)
    out = j.where(F.col("phrase") | elsewhere).select("claim_id", F.when(F.col("phrase"), "phrase").otherwise("location").alias("reason"), needed.alias("needed"), "phrase")
    return out.where(F.col("phrase") | (F.size("needed") > 0)).drop("phrase")


def file_refs(text: Column) -> Column:
    from tessera.functions.text import file_references

    return F.coalesce(file_references(text), F.array().cast("array<string>"))


def external_fix_target(claims: DataFrame) -> DataFrame:
    """Claims (claim_id, cross_repo, whitelisted) whose root cause lies in another repository."""
    return claims.where(F.col("cross_repo") & ~F.col("whitelisted")).select("claim_id", F.lit("external").alias("reason"))


def unverifiable(claims: DataFrame, most: int = 3) -> DataFrame:
    """(claim_id, hypothesis_id, needed): the first hypothesis of evidence_map (hypothesis_id, verdict, missing) that cannot be verified, with the files it needs."""
    first = F.get(F.filter("evidence_map", lambda e: e["verdict"] == "UNVERIFIABLE"), F.lit(0))
    return claims.select("claim_id", first.alias("e")).where(F.size("e.missing") > 0).select("claim_id", F.col("e.hypothesis_id").alias("hypothesis_id"), F.slice("e.missing", 1, most).alias("needed"))
