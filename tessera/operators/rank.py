"""Search and ranking over a graph of nodes and edges.

nodes: id, name, tags array<string>, summary, file_path, type, ord. edges: source, target, type,
weight, ord. ord gives the order in which ties resolve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import SECTION_STOP_WORDS, lit_array, search_tokens, slashes, symptom_words
from tessera.functions.vector import cosine, fuse
from tessera.operators.literals import literal_hits
from tessera.operators.tables import materialize

# What an edge is worth to a ranking, by type; another type has its own weight, or a half.
EDGE_WORTH = {"calls": 1.0, "mutates": 0.95, "async-calls": 0.85, "imports": 0.7, "contains": 0.5}


def keyword_score(tokens: list[str], name: Column, tags: Column, summary: Column, path: Column) -> Column:
    """70 % of the best token's score and 30 % of their mean, 1 at most. Repeated tokens count each time."""
    if not tokens:
        return F.lit(0.0)
    name, summary, path = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, summary, slashes(path)))
    tags = F.transform(F.coalesce(tags, lit_array([])), lambda t: F.lower(F.coalesce(t, F.lit(""))))

    def one(t: str) -> Column:
        t = F.lit(t)
        return (
            F.when(name == t, 0.4).when(F.contains(name, t), 0.3).otherwise(0.0)
            + F.when(F.array_contains(tags, t), 0.3).when(F.exists(tags, lambda x: F.contains(x, t)), 0.2).otherwise(0.0)
            + F.when(F.contains(summary, t), 0.2).otherwise(0.0)
            + F.when(F.contains(path, t), 0.1).otherwise(0.0)
        )

    each = [one(t) for t in tokens]
    best = F.greatest(*each) if len(each) > 1 else each[0]
    total = each[0]
    for x in each[1:]:
        total = total + x
    return F.least(best * 0.7 + total / len(each) * 0.3, F.lit(1.0))


def score_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """nodes with score."""
    return nodes.withColumn("score", keyword_score(search_tokens(query), F.col("name"), F.col("tags"), F.col("summary"), F.col("file_path")))


def search(nodes: DataFrame, query: str, limit: int = 15, min_score: float = 0.1, types: list[str] | None = None) -> DataFrame:
    """The best nodes for a query, by score and then ord."""
    n = nodes.where(F.col("type").isin(*types)) if types else nodes
    return score_nodes(n, query).where(F.col("score") >= min_score).orderBy(F.desc("score"), "ord").limit(limit)


def ends_swapped(edges: DataFrame) -> DataFrame:
    """(node, other, worth, ord): each edge from both its ends."""
    worth = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in EDGE_WORTH.items()], F.col("weight").cast("double"), F.lit(0.5))
    e = edges.select("source", "target", worth.alias("worth"), "ord")
    return e.select(F.col("source").alias("node"), F.col("target").alias("other"), "worth", "ord").unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("other"), "worth", "ord"))


def one_hop(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the seeds and their neighbours."""
    near = ends_swapped(edges).join(seeds.select(F.col("id").alias("node")), "node").select(F.col("other").alias("id"))
    return seeds.select("id").unionByName(near).distinct()


def expand(seeds: DataFrame, edges: DataFrame, semantic: DataFrame | None = None, hops: int = 2, beam: int = 5, floor: float = 0.2) -> DataFrame:
    """(id, score) of the seeds (id, ord) and what lies within some hops.

    A seed scores 1 + 0.4 of its semantic score. A neighbour scores 0.7 of the node it is first reached
    from, 0.3 of the edge and 0.4 of its own semantic score: nodes reach out in order of score, over edges in
    order, and a node keeps its first score. After a hop the best `beam` of the new nodes go on.
    """
    sem = semantic.select(F.col("id").alias("sid"), F.col("score").alias("sem")) if semantic is not None else None

    def bonus(df: DataFrame, key: str) -> DataFrame:
        if sem is None:
            return df.withColumn("bonus", F.lit(0.0))
        return df.join(sem, df[key] == sem["sid"], "left").withColumn("bonus", F.coalesce("sem", F.lit(0.0)) * 0.4).drop("sid", "sem")

    front = bonus(seeds.select("id", F.col("ord").cast("long").alias("rank")), "id").select("id", (F.lit(1.0) + F.col("bonus")).alias("score"), "rank")
    reached, links = front.select("id", "score"), ends_swapped(edges)
    for hop in range(hops):
        front = front.select(F.col("id").alias("node"), F.col("score").alias("parent"), F.col("rank").alias("prank"))
        step = bonus(links.join(front, "node").join(reached.select(F.col("id").alias("other")), "other", "left_anti"), "other")
        step = step.withColumn("score", F.col("parent") * 0.7 + F.col("worth") * 0.3 + F.col("bonus"))
        # the first to reach a node: best parent, then edge; a struct's minimum needs no sort of a hub's edges
        first = step.groupBy("other").agg(F.min(F.struct((-F.col("parent")).alias("p"), "prank", "ord", "score")).alias("f"))
        new = materialize(first.select(F.col("other").alias("id"), "f.score", "f.p", "f.prank", "f.ord"))
        reached = reached.unionByName(new.select("id", "score"))
        if hop + 1 < hops:
            best = new.where(F.col("score") >= floor).orderBy(F.desc(F.round("score", 9)), "p", "prank", "ord").limit(beam)
            front = _local(best.select("id", "score").collect(), edges)  # `beam` rows, in order
    return reached


def _local(rows: list, like: DataFrame) -> DataFrame:
    """A few rows (id, score) as a table with their place as rank."""
    kind, spark = dict(like.dtypes)["source"], like.sparkSession
    if not rows:
        return spark.createDataFrame([], f"id {kind}, score double, rank long")
    items = [F.struct(F.lit(r.id).cast(kind).alias("id"), F.lit(float(r.score)).alias("score"), F.lit(i).cast("long").alias("rank")) for i, r in enumerate(rows)]
    return spark.range(1).select(F.inline(F.array(*items)))


def route(nodes: DataFrame, edges: DataFrame, symptom: str, max_files: int = 12, semantic: DataFrame | None = None) -> DataFrame:
    """(rank, file_path, score): the files to read first for a symptom.

    Hits of the whole text (20, from 0.1) and of each token (5, from 0.25) are seeds; a file scores its best
    node after expansion, and a file with a hit 1.5 and the hit's score at least. No hits give no files.
    """
    # one scan of the nodes scores all passes; what scores in none goes
    passes = [(symptom, 20, 0.1), *((t, 5, 0.25) for t in search_tokens(symptom))]
    fields = [F.col(c) for c in ("name", "tags", "summary", "file_path")]
    scored = nodes.select("id", "ord", *[keyword_score(search_tokens(q), *fields).alias(f"s{i}") for i, (q, _, _) in enumerate(passes)])
    scored = materialize(scored.where(F.greatest(*[F.col(f"s{i}") for i in range(len(passes))], F.lit(0.0)) > 0))
    hits = None
    for i, (_, most, least) in enumerate(passes):
        top = scored.select("id", F.col(f"s{i}").alias("score"), F.lit(i).alias("pass"), "ord").where(F.col("score") >= least).orderBy(F.desc("score"), "ord").limit(most)
        hits = top if hits is None else hits.unionByName(top)
    hits = hits.groupBy("id").agg(F.min(F.struct("pass", -F.col("score"), "ord", "score")).alias("h")).select("id", "h.score", "h.pass", "h.ord")
    rows = hits.orderBy("pass", F.desc("score"), "ord").collect()  # 20 + 5 a token at most
    seeds = _local(rows, edges).withColumnRenamed("rank", "ord")
    grown = expand(seeds, edges, semantic)
    own = seeds.select("id", F.col("score").alias("own"))
    if semantic is not None:
        own = own.join(semantic.select("id", F.col("score").alias("sem")), "id", "left").select("id", (F.col("own") + F.coalesce("sem", F.lit(0.0)) * 0.4).alias("own"))
    best = grown.join(own, "id", "left").select("id", F.greatest("score", F.coalesce("own", F.lit(0.0))).alias("score"))
    both = best.unionByName(seeds.select("id", (F.col("score") + 1.5).alias("score")))
    files = nodes.where(F.coalesce(F.col("file_path"), F.lit("")) != "").select("id", "file_path", F.col("ord").alias("node_ord"))
    ranked = both.join(files, "id").groupBy("file_path").agg(F.max("score").alias("score"), F.min("node_ord").alias("o"))
    top = ranked.orderBy(F.desc(F.round("score", 9)), "o").limit(max_files)
    return top.select(F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "o")).alias("rank"), "file_path", "score")  # max_files rows


def semantic_scores(nodes: DataFrame, vector: list[float]) -> DataFrame:
    """(id, score) of the nodes whose embedding is on the query vector's side."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return nodes.where(F.col("embedding").isNotNull()).select("id", cosine(F.col("embedding"), q).alias("score")).where("score > 0")


def visual_route(nodes: DataFrame, image: list[float], text: list[float] | None = None, max_files: int = 5) -> DataFrame:
    """(file_path, score): files by their best node against an image, fused with a text if there is one."""
    q = lambda v: F.array(*[F.lit(float(x)) for x in v])
    query = fuse(q(image), q(text)) if text is not None else q(image)
    s = nodes.where(F.col("embedding").isNotNull()).select("file_path", F.round(cosine(F.col("embedding"), query), 3).alias("score"), "ord")
    return s.where("score > 0").groupBy("file_path").agg(F.max("score").alias("score"), F.min("ord").alias("o")).orderBy(F.desc("score"), "o").limit(max_files).drop("o")


def symptom_boosts(patterns: DataFrame, symptom: str) -> DataFrame:
    """(id, confidence) of patterns whose type or a longer word of whose description is in the symptom: 0.6 of the weight."""
    s = F.lit(symptom.lower())
    words = F.filter(F.split(F.lower("description"), r"\W+"), lambda w: F.length(w) > 4)
    hit = F.contains(s, F.replace(F.col("bug_type"), F.lit("_"), F.lit(" "))) | F.exists(words, lambda w: F.contains(s, w))
    return patterns.where(hit).select("id", "bug_type", (F.col("weight") * 0.6).alias("confidence"))


def symptom_boosts_of(patterns: DataFrame, symptoms: DataFrame) -> DataFrame:
    """(qid, id, bug_type, confidence) of symptoms (qid, text), as symptom_boosts gives for each: the patterns' words are looked for in all texts in one scan."""
    long_words = F.filter(F.split(F.lower("description"), r"\W+"), lambda w: F.length(w) > 4)
    said = patterns.select("id", "bug_type", "weight", F.explode(F.array_distinct(F.array_append(long_words, F.replace(F.col("bug_type"), F.lit("_"), F.lit(" "))))).alias("lit"))
    hits = literal_hits(symptoms.select("qid", F.lower("text").alias("text")), said, "qid", "text")
    return hits.join(said, "lit").select("qid", "id", "bug_type", (F.col("weight") * 0.6).alias("confidence")).distinct()


def node_boosts(nodes: DataFrame, matches: DataFrame, top: int = 5) -> DataFrame:
    """(id, score): half the best confidence of the top matches that share a word of their type with the node's name."""
    m = matches.orderBy(F.desc("confidence"), "id").limit(top).select(F.filter(F.split(F.lower("bug_type"), "_"), lambda w: F.length(w) > 3).alias("ws"), "confidence")
    m = m.agg(F.collect_list(F.struct("ws", "confidence")).alias("ms"))  # one row of `top` structs
    hits = F.transform(F.filter("ms", lambda x: F.exists(x["ws"], lambda w: F.contains(F.lower("name"), w))), lambda x: x["confidence"] * 0.5)
    return nodes.crossJoin(F.broadcast(m)).select("id", F.array_max(hits).alias("score")).where("score is not null")


def frontier(files: DataFrame, imports: DataFrame, calls: DataFrame, symptom: str, chains: DataFrame | None = None, max_files: int = 15, depth: int = 3) -> DataFrame:
    """(file): the files to read for a symptom, from the import and call graphs.

    files (file, content, ord); imports (file, from_file); calls (caller, callee); chains (var, file). Up to
    max_files files: all. Else the best by words (5 for one in the name, 1 in the content) and importers (2 each)
    is the seed; imports, importers and calls are followed in whole steps to the depth while fewer than
    max_files are chosen; files of variables named in the symptom join; below three, the best by score.
    """
    spark = files.sparkSession
    if files.limit(max_files + 1).count() <= max_files:
        return files.select("file")
    words = [w for w in spark.range(1).select(symptom_words(F.lit(symptom)).alias("w")).first().w]
    scored = frontier_scores(files, imports, words)
    seed = files.sparkSession.createDataFrame(scored.orderBy(F.desc("score"), "ord").limit(1).select("file").collect(), scored.select("file").schema)  # one row
    known = files.select("file")
    links = imports.select(F.col("file").alias("a"), F.col("from_file").alias("b")).unionByName(calls.select(F.col("caller").alias("a"), F.col("callee").alias("b")))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(known.withColumnRenamed("file", "b"), "b", "left_semi")
    links = materialize(links)
    chosen = front = seed
    for _ in range(depth):
        if chosen.count() >= max_files:
            break
        front = links.join(front.withColumnRenamed("file", "a"), "a").select(F.col("b").alias("file")).distinct().join(chosen, "file", "left_anti")
        front = materialize(front)
        chosen = chosen.unionByName(front)
    if chains is not None and words:
        chosen = chosen.unionByName(chains.where(F.exists(lit_array(words), lambda w: F.contains(F.lower("var"), w))).select("file")).distinct()
    if chosen.count() < 3:
        return scored.orderBy(F.desc("score"), "ord").limit(max_files).select("file")
    return chosen


def frontier_scores(files: DataFrame, imports: DataFrame, words: list[str]) -> DataFrame:
    """files with score."""
    name, content = F.lower(F.regexp_replace(F.element_at(F.split(slashes(F.col("file")), "/"), -1), r"\.\w+$", "")), F.lower(F.coalesce("content", F.lit("")))
    n = lambda c: F.size(F.filter(lit_array(words), lambda w: F.contains(c, w)))
    importers = imports.groupBy(F.col("from_file").alias("file")).agg(F.count("*").alias("importers"))
    return files.join(importers, "file", "left").withColumn("score", 5 * n(name) + n(content) + 2 * F.coalesce("importers", F.lit(0)))


def sections(docs: DataFrame, id_col: str, content_col: str, query: str, budget: int = 2500) -> DataFrame:
    """(id, pos, section, score): the parts of Markdown texts that say most of the query, within a budget of characters.

    A part is a heading and what follows; its score is the number of distinct query words in it. Parts are
    taken best first until one does not fit.
    """
    words = sorted({w for w in docs.sparkSession.range(1).select(symptom_words(F.lit(query)).alias("w")).first().w if w not in SECTION_STOP_WORDS})
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(content_col), r"(?m)(?=^#{1,6} )")).alias("pos", "section"))
    parts = parts.withColumn("score", F.size(F.filter(lit_array(words), lambda w: F.contains(F.lower("section"), w)))).where("score > 0")
    order = W.partitionBy("id").orderBy(F.desc("score"), "pos")
    parts = parts.withColumn("upto", F.sum(F.length("section")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return parts.where(F.col("upto") <= budget).select("id", "pos", "section", "score")


def call_edges_by_relevance(calls: DataFrame, query: str, top: int = 25) -> DataFrame:
    """Call edges (caller, callee, function) by the number of query words they name."""
    words = search_tokens(query)
    text = F.lower(F.concat_ws(" ", "caller", "callee", "function"))
    return calls.withColumn("score", F.size(F.filter(lit_array(words), lambda w: F.contains(text, w)))).orderBy(F.desc("score"), "caller", "callee", "function").limit(top)


def line_window(texts: DataFrame, marks: DataFrame, reach: int = 3) -> DataFrame:
    """(id, mark_line, line, content): lines around marks (id, line). texts (id, content); lines count from 1."""
    lines = texts.select("id", F.posexplode(F.split("content", "\n")).alias("p", "content")).select("id", (F.col("p") + 1).alias("line"), "content")
    near = marks.select("id", F.col("line").alias("mark_line"), F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("line"))
    return near.join(lines, ["id", "line"]).select("id", "mark_line", "line", "content")


def snippets(texts: DataFrame, marks: DataFrame, reach: int = 3, most: int = 8) -> DataFrame:
    """(id, line, snippet): windows of lines around marks, the first of overlapping ones, `most` at most in all."""
    w = W.partitionBy("id").orderBy("line")
    apart = marks.distinct().withColumn("gap", F.col("line") - F.lag("line").over(w))
    first = apart.where(F.col("gap").isNull() | (F.col("gap") > 2 * reach)).orderBy("id", "line").limit(most)
    win = line_window(texts, first.select("id", "line"), reach)
    return win.groupBy("id", "mark_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("snippet")).withColumnRenamed("mark_line", "line")


def query_class(query: Column) -> Column:
    """feasibility, factual or analytical, in that order."""
    q = F.lower(F.coalesce(query, F.lit("")))
    feasible = r"\bcan i\b|\bcould i\b|\bwhat would break\b|\bif i\b|\bwould it\b|\bshould i\b|\bsafe to\b|\brefactor\b"
    factual = r"\bwhere (is|are|does)\b|\bwhat is\b|\bwhat does\b|\bshow me\b|\bfind\b|\bwhich file\b|\bdefined\b"
    return F.when(q.rlike(feasible), "feasibility").when(q.rlike(factual), "factual").otherwise("analytical")


def readiness(graph: Column, ast: Column, cross_file: Column, archive: Column, codex: Column) -> Column:
    """core of 3 and memory of 2 active layers, as a struct."""
    n = lambda *cs: sum((c.cast("int") for c in cs[1:]), cs[0].cast("int"))
    return F.struct(n(graph, ast, cross_file).alias("core"), n(archive, codex).alias("memory"))
