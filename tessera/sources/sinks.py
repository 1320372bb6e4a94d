"""Sinks: tables, and reports as JSON and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import materialize

# Rules of the report, by detector: id, name, level.
RULES = {
    "global_write_race": ("RACE_CONDITION", "GlobalWriteRace", "error"),
    "floating_promise": ("FLOATING_PROMISE", "FloatingPromise", "error"),
    "stale_module_capture": ("STALE_MODULE_CAPTURE", "StaleModuleCapture", "warning"),
    "constructor_capture": ("CONSTRUCTOR_CAPTURE", "ConstructorCapture", "warning"),
    "foreach_mutation": ("FOREACH_MUTATION", "ForEachMutation", "warning"),
    "listener_parity": ("LISTENER_PARITY", "ListenerParity", "warning"),
    "orphan_listener": ("ORPHAN_LISTENER", "OrphanListener", "warning"),
}


def save_graph(nodes: DataFrame, edges: DataFrame, hashes: DataFrame, root: str) -> None:
    for t, df in (("nodes", nodes), ("edges", edges), ("file_hashes", hashes)):
        df.write.mode("overwrite").parquet(f"{root}/{t}")


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def append_diagnosis(entries: DataFrame, path: str) -> None:
    """Entries without an embedding are not kept: nothing could find them."""
    entries.where(F.col("embedding").isNotNull()).write.mode("append").parquet(path)


def _part(n: int, most: int) -> Column:
    """The part of a report that a finding is in, of n dealt out by `most`: by all columns, so that a file or detector of very many findings is in many parts, too."""
    return F.pmod(F.xxhash64("file", "line", "detector", "subject"), F.lit(max(-(-n // most), 1)))


def sarif(findings: DataFrame, tool: str, version: str, most: int | None = None) -> DataFrame:
    """(report): findings (detector, severity, file, line, subject) as SARIF 2.1.0. One row, which is one value in one task; with `most` (part, report):
    logs of about that many results, each whole by itself, and none if there are no findings."""
    rule = lambda i: F.coalesce(*[F.when(F.col("detector") == d, r[i]) for d, r in RULES.items()], F.col("detector"))
    level = F.coalesce(*[F.when(F.col("detector") == d, r[2]) for d, r in RULES.items()], F.lit("note"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(rule(0).alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(": ", rule(1), "subject").alias("text")).alias("message"), F.array(place).alias("locations"))
    rules = F.array_sort(F.collect_set(F.struct(rule(0).alias("id"), rule(1).alias("name"))))
    if most:
        findings = materialize(findings)
        findings = findings.withColumn("part", _part(findings.count(), most))
    all_ = findings.groupBy(*["part"] * bool(most)).agg(F.array_sort(F.collect_list(F.struct("file", "line", result.alias("r")))).alias("rs"), rules.alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules")).alias("driver")).alias("tool"), F.transform("rs", lambda x: x["r"]).alias("results"))
    return all_.select(*["part"] * bool(most), F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("report"))


def json_report(findings: DataFrame, matches: DataFrame, top: int = 5, most: int | None = None) -> DataFrame:
    """(report): findings by detector, and the best patterns. One row, which is one value in one task; with `most` (part, report):
    reports of about that many findings, each whole by itself, and a single one if there are no findings."""
    if most:
        findings = materialize(findings.select("detector", "file", "line", "severity", "subject"))
        findings = findings.withColumn("part", _part(findings.count(), most))
        if findings.isEmpty():
            return json_report(findings, matches, top).select(F.lit(0).cast("long").alias("part"), "report")
    part = ["part"] * bool(most)
    by = findings.groupBy(*part, "detector").agg(F.array_sort(F.collect_list(F.struct("file", "line", "severity", "subject"))).alias("found"))
    a = by.groupBy(*part).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector", "found")))).alias("findings"))
    best = matches.orderBy(F.desc("confidence"), "pattern_id").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "pattern_id", "confidence"))).alias("m"))
    patterns = F.transform("m", lambda x: F.struct(x["pattern_id"].alias("pattern_id"), x["confidence"].alias("confidence"))).alias("patterns")
    both = a.crossJoin(F.broadcast(best))  # a single row, with a single one or with each part
    return both.select(*part, F.to_json(F.struct("findings", patterns, F.when(F.size("findings") == 0, "STATIC_BLIND").otherwise("EVIDENCE").alias("verdict"))).alias("report"))


def text_report(findings: DataFrame) -> DataFrame:
    """(detector, section): a section of lines for each detector."""
    line = F.format_string("  %s:%d [%s] %s", "file", "line", "severity", F.coalesce("subject", F.lit("")))
    g = findings.groupBy("detector").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("file", "line", line.alias("l")))).alias("ls"))
    return g.select("detector", F.concat(F.format_string("%s (%d)\n", "detector", "n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("section"))


def cross_file_text(chains: DataFrame) -> DataFrame:
    """(origin_file, origin_var, section): variables that some file other than their own reads or writes."""
    line = F.format_string("  %s %s:%s", "kind", F.col("file").cast("string"), F.col("line").cast("string"))
    g = chains.groupBy("origin_file", "origin_var").agg(F.bool_or(F.col("file") != F.col("origin_file")).alias("crosses"), F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("section"))
    return g.where("crosses").drop("crosses")


def project_overview(nodes: DataFrame, edges: DataFrame, top: int = 12) -> DataFrame:
    """(file_path, degree, summary): the files with most edges."""
    from tessera.operators.graph import degrees

    return nodes.where("type = 'file'").join(degrees(edges), "id").orderBy(F.desc("degree"), "file_path").limit(top).select("file_path", "degree", "summary")


def with_notes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(content): an overview (content) with the Notes section of the old one."""
    notes = F.regexp_extract(F.col("o"), r"(?s)(\n## Notes\b.*)\z", 1)
    body = F.regexp_replace(F.col("content"), r"(?s)\n## Notes\b.*\z", "")
    return new.crossJoin(old.select(F.col("content").alias("o"))).select(F.concat(body, F.when(notes != "", notes).otherwise(F.regexp_extract("content", r"(?s)(\n## Notes\b.*)\z", 1))).alias("content"))  # two single rows


def mermaid(edges: DataFrame) -> DataFrame:
    """One row (diagram): edges (source, target, type) as a Mermaid graph."""
    line = F.format_string('  %s["%s"] -->|%s| %s["%s"]', F.concat(F.lit("n"), F.hex(F.xxhash64("source"))), "source", "type", F.concat(F.lit("n"), F.hex(F.xxhash64("target"))), "target")
    return edges.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("diagram"))


def diagnostics_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: nodes, embedded nodes, edges by type."""
    kinds = edges.agg(F.count("*").alias("edges"), *[F.count_if(F.col("type") == k).alias(f"{k}_edges") for k in ("contains", "imports", "calls")])
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("embedding").isNotNull()).alias("embedded") if "embedding" in nodes.columns else F.lit(0).cast("long").alias("embedded"))
    return n.crossJoin(kinds)  # two single rows
