"""Search in past findings: an archive by similarity, a codex by words, similarity and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import basename, lit_array, memory_tokens
from tessera.functions.vector import cosine


def recency(date: Column, now: Column) -> Column:
    """1 / (1 + days / 30); a half for no date; days before now only."""
    days = F.greatest(F.lit(0.0), (F.unix_millis(now.cast("timestamp")) - F.unix_millis(date.cast("timestamp"))) / 86_400_000)
    return F.when(date.isNull(), 0.5).otherwise(1 / (1 + days / 30))


def search_archive(archive: DataFrame, vector: list[float], threshold: float = 0.75, top: int = 3) -> DataFrame:
    """archive with score: the entries most like the vector, from the threshold."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return archive.withColumn("score", cosine(F.col("embedding"), q)).where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(top)


def search_codex(index: DataFrame, symptom: str, now: Column, semantic: DataFrame | None = None, bodies: DataFrame | None = None, top: int = 3) -> DataFrame:
    """index (task_id, problem, tags, dt) with kw, semantic, recency and score, the best few.

    A word counts 2 if a tag has it, 1 if the problem does. With semantic scores (task_id, score) the blend is
    .35 words, .45 similarity, .20 age, kept from .3 or two points; without, .80 and .20 from two points. Entries
    without a body (task_id, discoveries) go after the top is taken.
    """
    tokens = index.sparkSession.range(1).select(memory_tokens(F.lit(symptom)).alias("t")).first().t
    tags, problem = F.transform(F.coalesce("tags", lit_array([])), F.lower), F.lower(F.coalesce("problem", F.lit("")))
    point = lambda t: F.when(F.exists(tags, lambda x: F.contains(x, t)), 2).when(F.contains(problem, t), 1).otherwise(0)
    kw = F.aggregate(F.transform(lit_array(tokens), point), F.lit(0), lambda a, x: a + x)
    rows = index.withColumn("kw", kw).withColumn("recency", recency(F.col("dt"), now))
    share = F.col("kw") / float(max(1, 2 * len(tokens)))
    if semantic is None:
        rows = rows.withColumn("semantic", F.lit(0.0)).withColumn("score", share * 0.8 + F.col("recency") * 0.2).where("kw >= 2")
    else:
        rows = rows.join(semantic.select("task_id", F.col("score").alias("semantic")), "task_id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
        rows = rows.withColumn("score", share * 0.35 + F.col("semantic") * 0.45 + F.col("recency") * 0.2).where("score >= 0.3 or kw >= 2")
    best = rows.orderBy(F.desc(F.round("score", 9)), "task_id").limit(top)
    return best if bodies is None else best.join(bodies, "task_id")


def index_rows(texts: DataFrame, content: str = "content") -> DataFrame:
    """(task_id, problem, tags, dt): rows of Markdown pipe tables with three cells or more, without heads and rules."""
    lines = texts.select(F.explode(F.split(F.col(content), "\n")).alias("line")).where(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.select(cells.alias("c")).where((F.size("c") >= 3) & ~F.col("c")[0].rlike("^:?-+:?$") & (F.lower(F.col("c")[0]) != "task id") & (F.col("c")[0] != ""))
    return rows.select(F.col("c")[0].alias("task_id"), F.col("c")[1].alias("problem"), F.filter(F.transform(F.split(F.col("c")[2], ","), lambda x: F.trim(x)), lambda t: t != "").alias("tags"), F.try_to_date(F.get("c", F.lit(3))).alias("dt"))


def markdown_section(content: Column, title: str) -> Column:
    """What stands under a second-level heading, up to the next."""
    return F.regexp_extract(content, rf"(?s)## {title}\s*\n(.*?)(?=\n## |\z)", 1)


def discovery_metadata(content: Column) -> Column:
    """The JSON object in the section of discovery metadata, as text; null if there is none."""
    return F.nullif(F.regexp_extract(markdown_section(content, "Discovery Metadata"), r"(?s)(\{.*\})", 1), F.lit(""))


def doctor(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """entries (task_id, path, content_hash, failed_uses, status) with state: stale if the file is missing or other, unreliable without metadata, after three failed uses or by status, else ok."""
    h = hashes.select("path", F.col("content_hash").alias("now"))
    stale = F.col("now").isNull() | (F.col("now") != F.col("content_hash"))
    bad = F.col("content_hash").isNull() | (F.coalesce("failed_uses", F.lit(0)) >= 3) | F.coalesce(F.col("status").isin("unreliable", "stale"), F.lit(False))
    return entries.join(h, "path", "left").withColumn("state", F.when(F.col("content_hash").isNotNull() & stale, "stale").when(bad, "unreliable").otherwise("ok")).drop("now")


def attach_metadata(discoveries: DataFrame, files: DataFrame) -> DataFrame:
    """discoveries (task_id, file) with the current path and hash of the first file (path, content_hash) of that base name."""
    f = files.groupBy(basename(F.col("path")).alias("b")).agg(F.min(F.struct("path", "content_hash")).alias("f"))
    return discoveries.join(f, basename(discoveries["file"]) == f["b"], "left").select(*discoveries.columns, F.col("f.path").alias("path"), F.col("f.content_hash").alias("content_hash"))


def seed_entry(evidence: DataFrame, n_tags: int = 6) -> DataFrame:
    """(task_id, file, lines, tags): what a diagnosis (task_id, symptom, evidence array) teaches, by the files and lines it cites."""
    cited = evidence.select("task_id", "symptom", F.explode("evidence").alias("e"))
    p = r"([\w\-./\\]+\.(?:js|jsx|ts|tsx|mjs|cjs|py))\s*(?::|\s+L)\s*(\d+)"
    c = cited.select("task_id", "symptom", basename(F.regexp_extract("e", p, 1)).alias("file"), F.regexp_extract("e", p, 2).cast("int").alias("line")).where("file <> ''")
    words = F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower("symptom"), r"[^a-z0-9]+", " "), " ")), lambda w: F.length(w) > 3)
    return c.groupBy("task_id", "symptom", "file").agg(F.array_sort(F.collect_set("line")).alias("lines")).select("task_id", "file", "lines", F.slice(words, 1, n_tags).alias("tags"))
