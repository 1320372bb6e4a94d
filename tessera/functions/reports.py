"""Reports that models write: older ones brought up to date, summaries with defaults, sections on request, and what a run may take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import lit_map

SCHEMA_VERSION = "2.0"
HYPOTHESIS = "struct<id:string,text:string,status:string,falsifiableIf:array<string>,eliminationQuality:string>"
REPORT = (
    "struct<causalChain:array<string>,causalCompleteness:boolean,adversarialCheck:string,wasReentered:boolean,multipleHypothesesSurvived:boolean,"
    f"evidenceMap:array<string>,fixInvariantViolations:array<string>,relatedRisks:array<string>,hypothesisTree:array<{HYPOTHESIS}>>"
)
# The columns of a report that each section asks for, in order.
SECTIONS = {
    "rootCause": ["rootCause", "codeLocation", "bugType", "confidence", "evidence", "uncertainties", "hypotheses", "hypothesisTree", "proximate_crash_site", "additionalRootCauses", "uncoveredSymptoms"],
    "minimalFix": ["minimalFix", "whyFixWorks", "diffBlock"],
    "aiPrompt": ["aiPrompt"],
    "reproduction": ["symptom", "reproduction"],
    "variableState": ["variableState", "variableStateEdges"],
    "timeline": ["timeline", "timelineEdges"],
    "conceptExtraction": ["conceptExtraction"],
    "invariants": ["invariants"],
    "hypotheses": [],
}
# The sections of each preset; full has all.
PRESETS = {
    "quick": ["rootCause", "minimalFix", "aiPrompt"],
    "developer": ["rootCause", "minimalFix", "aiPrompt", "reproduction", "variableState", "timeline"],
    "full": list(SECTIONS),
    "custom": [],
}
# What a preset, a provider and a mode multiply a run's time by.
PRESET_FACTOR = {"quick": 0.6, "developer": 0.85, "full": 1.0, "custom": 0.9}
PROVIDER_FACTOR = {"google": 0.7, "anthropic": 1.0, "openai": 1.1}
MODE_FACTOR = {"debug": 1.0, "explain": 0.85, "security": 1.15}
# How complex a file can be said to be.
COMPLEXITIES = ["simple", "moderate", "complex"]


def migrated(response: Column) -> Column:
    """The report in a JSON response as a struct; one of an older schema version, or of none, has defaults for what later versions added."""
    version = F.coalesce(F.get_json_object(response, "$._provenance.schemaVersion"), F.get_json_object(response, "$.report._provenance.schemaVersion"))
    old = version.isNull() | (version < SCHEMA_VERSION)
    r = F.from_json(F.coalesce(F.get_json_object(response, "$.report"), response), REPORT)
    none, quality = F.array().cast("array<string>"), F.lit("DEFAULT")
    default = {
        "causalChain": none, "adversarialCheck": F.lit(""), "wasReentered": F.lit(False), "multipleHypothesesSurvived": F.lit(False),
        "evidenceMap": none, "fixInvariantViolations": none, "relatedRisks": none,
    }
    hypothesis = lambda h: h.withField("falsifiableIf", F.coalesce(h["falsifiableIf"], none)).withField("eliminationQuality", F.coalesce(h["eliminationQuality"], quality))
    filled = [F.coalesce(r[k], v).alias(k) for k, v in default.items()]
    new = F.struct(filled[0], r["causalCompleteness"].alias("causalCompleteness"), *filled[1:], F.transform(r["hypothesisTree"], hypothesis).alias("hypothesisTree"))
    return F.when(response.isNotNull(), F.when(old, new).otherwise(F.struct(*[r[k].alias(k) for k in ("causalChain", "causalCompleteness", *list(default)[1:], "hypothesisTree")])))


def _strings(v: Column, path: str) -> Column:
    """The strings of an array in a variant; none if it is no array."""
    items = F.try_variant_get(v, path, "array<variant>")
    text = F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(text, lambda x: F.try_variant_get(x, "$", "string"))


def _string(v: Column, path: str, default: Column) -> Column:
    """A string in a variant; the default if there is something else, or nothing."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string")).otherwise(default)


def file_summary(response: Column) -> Column:
    """(summary, tags, complexity, notes) of a model's JSON about a file, whatever is missing or of another type; null if it is no object."""
    v = F.try_parse_json(response)
    said = _string(v, "$.complexity", F.lit("moderate"))
    complexity = F.when(said.isin(*COMPLEXITIES), said).otherwise("moderate")
    fields = F.struct(_string(v, "$.fileSummary", F.lit("")).alias("summary"), _strings(v, "$.tags").alias("tags"), complexity.alias("complexity"), _string(v, "$.languageNotes", F.lit(None).cast("string")).alias("notes"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), fields)


def project_summary(response: Column) -> Column:
    """(description, frameworks, layers) of a model's JSON about a project; layers without a name go; null if it is no object."""
    v = F.try_parse_json(response)
    items = F.coalesce(F.try_variant_get(v, "$.layers", "array<variant>"), F.array().cast("array<variant>"))
    layer = lambda x: F.struct(_string(x, "$.name", F.lit(None).cast("string")).alias("name"), _string(x, "$.description", F.lit("")).alias("description"), _strings(x, "$.filePatterns").alias("patterns"))
    layers = F.filter(F.transform(items, layer), lambda x: x["name"].isNotNull())
    fields = F.struct(_string(v, "$.description", F.lit("")).alias("description"), _strings(v, "$.frameworks").alias("frameworks"), layers.alias("layers"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), fields)


def section_columns(sections: list[str] | str, known: list[str]) -> list[str]:
    """The columns of a report that sections (or a preset) ask for, of those that there are: for a select, which reads no others."""
    wanted = [c for s in (PRESETS[sections] if isinstance(sections, str) else sections) for c in SECTIONS.get(s, [])]
    return [c for c in dict.fromkeys(wanted) if c in known]


def runtime_estimate(files: Column, lines: Column, provider: Column, preset: Column, source: Column, mode: Column) -> Column:
    """What a run may take, in words: files, lines and where they come from, times what preset, provider and mode cost."""
    # The base in seconds by source, seconds a file up to a limit, lines a second up to a limit.
    base = F.when(source == "github", 45).otherwise(15) + F.least(files * 4, F.lit(45)) + F.least(lines / 150, F.lit(30.0))
    for c, table in ((preset, PRESET_FACTOR), (provider, PROVIDER_FACTOR), (mode, MODE_FACTOR)):
        base = base * F.coalesce(F.element_at(lit_map(table), c), F.lit(1.0))
    least, most = (F.floor(base * x + 0.5).cast("long") for x in (0.75, 1.4))
    a, b = F.floor(least / 60), F.ceil(most / 60)
    minutes = F.when(a == b, F.format_string("~%d min", a)).otherwise(F.format_string("~%d–%d min", a, b))
    return F.when(most < 60, F.format_string("~%d–%d sec", least, most)).otherwise(minutes)


