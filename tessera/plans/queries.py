"""Queries over the reference's operators on the given tables, which stand in for code facts, and their SQL.

The docstring of each query names the stand-in. Every query runs over its whole tables; what limits it keeps
are its operator's own top-k reports.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import streaming
from tessera.functions import text as T
from tessera.functions import vector as V
from tessera.operators import crossfile, detect, graph, memory, patterns, rank, search, tables, verify
from tessera.plans import standin
from tessera.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from tessera.plans.standin import EDGES_SQL, GROW_SQL, NODES_SQL, read, score_sql
from tessera.sources import extract, sinks
from tessera.sources.buckets import Store

SYMPTOM = "red widget promo"


def long_(c):
    return F.col(c).cast("long").alias(c) if isinstance(c, str) else c.cast("long")


# Hashes, graph maintenance


@query("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Documents stand for files."""
    return read(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def _hashes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Current and stored hashes: when these were stored, German documents had other texts, those of src3 were not there, and benchmark items were."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "lang", "source")
    now = graph.file_hashes(docs.withColumnRenamed("text", "content"))
    then = docs.where("source <> 'src3'").withColumn("content", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    items = read(spark, d, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("path"), F.col("text").alias("content"))
    return now, graph.file_hashes(then.select("path", "content").unionByName(items))


CHANGED_SQL = """
WITH now AS (SELECT doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS h FROM documents),
was AS (
  SELECT doc_id::VARCHAR AS path, sha256(coalesce(CASE WHEN lang = 'de' THEN text || '!' ELSE text END, '')) AS h FROM documents WHERE source <> 'src3'
  UNION ALL SELECT 'item' || item_id, sha256(coalesce(text, '')) FROM benchmark),
cmp AS (
  SELECT coalesce(now.path, was.path) AS path, CASE WHEN was.path IS NULL THEN 'added' WHEN now.path IS NULL THEN 'deleted' WHEN now.h <> was.h THEN 'changed' END AS status
  FROM now FULL JOIN was ON now.path = was.path)
"""


@query(CHANGED_SQL + "SELECT path, status FROM cmp WHERE status IS NOT NULL")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return graph.changed_files(*_hashes(spark, d))


@query(CHANGED_SQL + """
SELECT count(*) FILTER (status = 'changed')::BIGINT AS changed, count(*) FILTER (status = 'added')::BIGINT AS added, count(*) FILTER (status = 'deleted')::BIGINT AS deleted,
  (SELECT count(*) FROM documents) AS total, count(*) FILTER (status IS NOT NULL) > 0 AND count(*) FILTER (status IS NOT NULL) < 0.3::DOUBLE * (SELECT count(*) FROM documents) AS patch FROM cmp""")
def incremental_gate(spark: SparkSession, d: str) -> DataFrame:
    now, was = _hashes(spark, d)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = graph.changed_files(now, was).agg(n("changed"), n("added"), n("deleted"), F.count("*").alias("all")).first()
    total = read(spark, d, "documents").count()
    row = (counts["changed"], counts["added"], counts["deleted"], total, graph.should_patch(counts["all"], total))
    return spark.createDataFrame([row], "changed long, added long, deleted long, total long, patch boolean")


@query("""
WITH n AS (SELECT 'c:' || c_custkey AS id, 'v1' AS version FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'n:' || n_nationkey, 'v1' FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'v2' FROM customer WHERE c_mktsegment = 'BUILDING'),
e AS (SELECT 'c:' || c_custkey AS source, 'n:' || c_nationkey AS target, CASE WHEN c_mktsegment = 'BUILDING' THEN 'v2' ELSE 'v1' END AS version FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'v1' FROM nation),
h AS (SELECT 'c:' || c_custkey AS path, CASE WHEN c_mktsegment = 'BUILDING' THEN 'v2' ELSE 'v1' END AS version FROM customer)
SELECT 'node' AS kind, id AS source, '' AS target, version FROM n UNION ALL SELECT 'edge', source, target, version FROM e UNION ALL SELECT 'hash', path, '', version FROM h""")
def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    """Customers and nations stand for files with one node each; customers of one segment changed."""
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    cid, v = F.concat(F.lit("c:"), "c_custkey"), lambda x: F.lit(x).alias("version")
    customer = lambda df, ver: df.select(cid.alias("id"), cid.alias("file_path"), v(ver))
    link = lambda df, ver: df.select(cid.alias("source"), F.concat(F.lit("n:"), "c_nationkey").alias("target"), v(ver))
    new = c.where("c_mktsegment = 'BUILDING'")
    nid = F.concat(F.lit("n:"), "n_nationkey")
    nodes = customer(c, "v1").unionByName(n.select(nid.alias("id"), nid.alias("file_path"), v("v1")))
    edges = link(c, "v1").unionByName(n.select(nid.alias("source"), F.concat(F.lit("r:"), "n_regionkey").alias("target"), v("v1")))
    hashes = lambda df, ver: df.select(cid.alias("path"), F.lit(ver).alias("content_hash"))
    n2, e2, h2 = graph.merge_graph(nodes, edges, hashes(c, "v1"), new.select(cid.alias("path")), customer(new, "v2"), link(new, "v2"), hashes(new, "v2"))
    rows = n2.select(F.lit("node").alias("kind"), F.col("id").alias("source"), F.lit("").alias("target"), "version")
    rows = rows.unionByName(e2.select(F.lit("edge").alias("kind"), "source", "target", "version"))
    return rows.unionByName(h2.select(F.lit("hash").alias("kind"), F.col("path").alias("source"), F.lit("").alias("target"), F.col("content_hash").alias("version")))


@query("""
WITH e(source, target, type) AS (
  SELECT 'file:' || n_name, 'func:' || n_name || ':' || s_name, 'contains' FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'file:' || n_name, 'class:' || n_name || ':' || c_name, 'contains' FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'file:' || n_name, 'file:' || r_name, 'imports' FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'func:' || n_name || ':' || s_name, 'file:' || n_name, 'calls' FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 0)
SELECT 'edge' AS kind, source AS id, type, target, CASE type WHEN 'contains' THEN 1.0 WHEN 'imports' THEN 0.7 ELSE 0.8 END::DOUBLE AS weight FROM e
UNION ALL SELECT 'node', 'file:' || n_name, 'file', n_name, NULL FROM nation UNION ALL SELECT 'node', 'file:' || r_name, 'file', r_name, NULL FROM region
UNION ALL SELECT 'node', 'func:' || n_name || ':' || s_name, 'function', n_name, NULL FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'node', 'class:' || n_name || ':' || c_name, 'class', n_name, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def graph_nodes_edges(spark: SparkSession, d: str) -> DataFrame:
    """Nations and regions stand for files, suppliers for functions, customers for classes; nations import their regions, and every second supplier calls."""
    n, r, s, c = (read(spark, d, t) for t in ("nation", "region", "supplier", "customer"))
    files = n.select(F.col("n_name").alias("path")).union(r.select("r_name"))
    part = lambda df, key, name: df.join(n, df[key] == n["n_nationkey"]).select(F.col("n_name").alias("path"), F.col(name).alias("name"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    imports = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("path"), F.col("r_name").alias("target"))
    calls = part(s.where("s_suppkey % 2 = 0"), "s_nationkey", "s_name").select(F.concat(F.lit("func:"), "path", F.lit(":"), "name").alias("caller_id"), F.concat(F.lit("file:"), "path").alias("callee_id"))
    nodes, edges = graph.build_graph(files, part(s, "s_nationkey", "s_name"), part(c, "c_nationkey", "c_name"), imports, calls)
    rows = nodes.select(F.lit("node").alias("kind"), "id", "type", F.col("file_path").alias("target"), F.lit(None).cast("double").alias("weight"))
    return rows.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), "type", "target", F.col("weight").cast("double").alias("weight")))


@query("""
WITH calls AS (SELECT DISTINCT a.p_brand AS path, b.p_name AS callee FROM lineitem x JOIN lineitem y USING (l_orderkey) JOIN part a ON a.p_partkey = x.l_partkey JOIN part b ON b.p_partkey = y.l_partkey WHERE x.l_linenumber = 1 AND y.l_linenumber = 2),
idx AS (SELECT p_name AS callee, min(p_brand) AS f FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) = 1),
imp AS (SELECT DISTINCT p_brand AS path, p_name AS callee, min(p_brand) OVER (PARTITION BY p_name) AS f FROM part),
r AS (SELECT c.path, c.callee, coalesce(i.f, x.f) AS callee_file FROM calls c LEFT JOIN imp i ON i.path = c.path AND i.callee = c.callee LEFT JOIN idx x ON x.callee = c.callee)
SELECT path, callee, callee_file FROM r WHERE callee_file IS NOT NULL AND callee_file <> path""")
def callee_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Brands stand for files, part names for functions; a brand imports the names that it has from the least brand with it."""
    p, li = read(spark, d, "part"), read(spark, d, "lineitem")
    one, two = (li.where(F.col("l_linenumber") == k).select("l_orderkey", F.col("l_partkey").alias("p_partkey")) for k in (1, 2))
    callers, callees = one.join(p, "p_partkey").select("l_orderkey", F.col("p_brand").alias("path")), two.join(p, "p_partkey").select("l_orderkey", F.col("p_name").alias("callee"))
    calls = callers.join(callees, "l_orderkey").select("path", "callee").distinct()
    index = graph.function_index(p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("path")))
    imports = p.select(F.col("p_brand").alias("path"), F.col("p_name").alias("stem")).distinct().join(p.groupBy(F.col("p_name").alias("stem")).agg(F.min("p_brand").alias("target")), "stem")
    return graph.resolve_callees(calls, imports, index)


@query(f"WITH {EDGES_SQL} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 50")
def node_degree_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.hubs(standin.edges(spark, d))


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, 0::BIGINT AS embedded, count(*) AS edges, count(*) FILTER (type = 'contains') AS contains_edges, count(*) FILTER (type = 'imports') AS imports_edges, count(*) FILTER (type = 'calls') AS calls_edges FROM edges")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges by type, as a project report counts them."""
    return sinks.diagnostics_report(standin.nodes(spark, d), standin.edges(spark, d))


LANG_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())


@query(f"SELECT page_id, CASE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([^.]*)$', 1)) {LANG_CASE} ELSE 'unknown' END AS language FROM pages")
def language_of_path(spark: SparkSession, d: str) -> DataFrame:
    """Addresses without query and fragment stand for paths."""
    return read(spark, d, "pages").select("page_id", T.language_of(F.regexp_replace("url", r"[?#].*$", "")).alias("language"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS source FROM pages")
def import_sources(spark: SparkSession, d: str) -> DataFrame:
    """Links, written as imports, stand for imports."""
    written = F.regexp_replace("html", 'href="([^"]+)"', "import '$1'")
    return read(spark, d, "pages").select("page_id", F.explode(extract.import_sources(written)).alias("source"))


RESOLVE_SQL = r"""
WITH i AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '') AS file, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS source FROM pages),
known AS (SELECT path, min(page_id) AS ord FROM (SELECT regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '') AS path, page_id FROM pages
  UNION ALL SELECT '/lib/' || p_name || '.js', 1000000 + p_partkey FROM part UNION ALL SELECT '/' || (SELECT 'The') || '.ts', 2000000) GROUP BY path),
s(p, suffix) AS (VALUES (0, ''), (1, '.js'), (2, '.ts'), (3, '.jsx'), (4, '.tsx'), (5, '.mjs'), (6, '.cjs'), (7, '/index.js'), (8, '/index.ts'), (9, '/index.jsx'), (10, '/index.tsx')),
dirs AS (SELECT file, source, array_to_string(string_split(file, '/')[1:len(string_split(file, '/')) - 1], '/') AS dir FROM i WHERE source LIKE './%' OR source LIKE '/%' OR source LIKE '.%'),
base AS (SELECT file, source, CASE WHEN dir <> '' THEN dir || '/' || source ELSE source END AS b FROM dirs),
e AS (SELECT base.file, base.source, s.p, known.ord, known.path FROM base, s JOIN known ON known.path = base.b || s.suffix),
l AS (SELECT base.file, base.source, 11 AS p, known.ord, known.path FROM base JOIN known ON regexp_replace(list_last(string_split(known.path, '/')), '\.[^.]+$', '') = regexp_replace(list_last(string_split(base.source, '/')), '\.[^.]+$', '')
  WHERE regexp_replace(list_last(string_split(base.source, '/')), '\.[^.]+$', '') NOT IN ('index', 'types', 'utils', 'helpers', 'constants', 'common', 'shared', 'base', 'config', 'main', 'core', 'hooks', 'styles', 'theme', 'api', 'model', 'models', 'service', 'services')),
best AS (SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM l) QUALIFY row_number() OVER (PARTITION BY file, source ORDER BY p, ord, path) = 1)
SELECT i.file, i.source, best.path AS target FROM i LEFT JOIN best USING (file, source)"""


@query(RESOLVE_SQL)
def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of addresses stand for files, links for imports; parts are files of a library."""
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*", ""), r"[?#].*$", "")
    pages = read(spark, d, "pages")
    imports = pages.select(path.alias("file"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("source")).distinct()
    files = pages.select(path.alias("path"), long_("page_id").alias("ord")).unionByName(read(spark, d, "part").select(F.concat(F.lit("/lib/"), "p_name", F.lit(".js")).alias("path"), (F.lit(1000000) + F.col("p_partkey")).alias("ord")))
    files = files.unionByName(spark.createDataFrame([("/The.ts", 2000000)], "path string, ord long")).groupBy("path").agg(F.min("ord").alias("ord"))
    return crossfile.resolve_paths(imports, files)


def _layer_sql(parts: str) -> str:
    out = "CASE"
    for name, words, _ in graph.LAYERS:
        test = " OR ".join(f"contains(s, '{w}')" for w in words)
        out += f" WHEN len([s FOR s IN {parts} IF {test}]) > 0 THEN '{name}'"
    return out + " ELSE 'Core' END"


@query(f"""
WITH p AS (SELECT page_id, string_split(lower(url), '/') AS s FROM pages),
t AS (SELECT page_id, list_concat(s[1:len(s) - 1], [regexp_replace(s[-1], '\\.[^.]+$', '')]) AS parts FROM p)
SELECT {_layer_sql("parts")} AS layer, count(*) AS n, sum(page_id)::BIGINT AS ids, sum(page_id * page_id % 1000003)::BIGINT AS squares FROM t GROUP BY 1""")
def layers(spark: SparkSession, d: str) -> DataFrame:
    """Addresses stand for file paths."""
    named = read(spark, d, "pages").select("page_id", graph.layer_name(F.col("url")).alias("layer"))
    return named.groupBy("layer").agg(F.count("*").alias("n"), F.sum("page_id").alias("ids"), F.sum(F.col("page_id") * F.col("page_id") % 1000003).alias("squares"))


# Search


@query(f"WITH {NODES_SQL} SELECT id, round({score_sql(SYMPTOM.split())}, 6) AS score FROM nodes WHERE type = 'function'")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    n = rank.score_nodes(standin.nodes(spark, d).where("type = 'function'"), SYMPTOM)
    return n.select("id", F.round("score", 6).alias("score"))


@query(f"""
WITH {NODES_SQL}, s AS (SELECT *, {score_sql(SYMPTOM.split())} AS score FROM nodes)
SELECT row_number() OVER (ORDER BY score DESC, ord) AS rank, id AS node_id, name, round(score, 6) AS score FROM s WHERE score >= 0.1 ORDER BY rank LIMIT 12""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    hits = rank.search(standin.nodes(spark, d), SYMPTOM, limit=12)
    return hits.select(long_(F.row_number().over(W.orderBy(F.desc("score"), "ord"))).alias("rank"), F.col("id").alias("node_id"), "name", F.round("score", 6).alias("score"))


SEEDS_SQL = f"""
{NODES_SQL}, {EDGES_SQL},
hits AS (
  SELECT id, score, 0 AS pass, ord FROM (SELECT *, {score_sql(SYMPTOM.split())} AS score FROM nodes) WHERE score >= 0.1 QUALIFY row_number() OVER (ORDER BY score DESC, ord) <= 20
  {"".join(f" UNION ALL SELECT id, score, {i + 1}, ord FROM (SELECT *, {score_sql([t])} AS score FROM nodes) WHERE score >= 0.25 QUALIFY row_number() OVER (ORDER BY score DESC, ord) <= 5" for i, t in enumerate(SYMPTOM.split()))}),
first_hits AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY pass, score DESC, ord) = 1),
seeds AS (SELECT id, score AS own, row_number() OVER (ORDER BY pass, score DESC, ord) AS rank FROM first_hits)"""


@query(f"""
WITH {NODES_SQL}, {EDGES_SQL}, s AS (SELECT *, {score_sql(SYMPTOM.split())} AS score FROM nodes),
seeds AS (SELECT id, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (ORDER BY score DESC, ord) <= 3), {GROW_SQL}
SELECT id, round(score, 6) AS score FROM grown""")
def graph_beam(spark: SparkSession, d: str) -> DataFrame:
    hits = rank.search(standin.nodes(spark, d), SYMPTOM, limit=3).collect()
    seeds = spark.createDataFrame([(x.id, i) for i, x in enumerate(hits)], "id string, ord long")
    return rank.expand(seeds, tables.materialize(standin.edges(spark, d))).select("id", F.round("score", 6).alias("score"))


@query(f"""
WITH {SEEDS_SQL}, {GROW_SQL},
best AS (SELECT g.id, greatest(g.score, coalesce(s.own, 0.0)) AS score FROM grown g LEFT JOIN seeds s USING (id)),
pool AS (SELECT * FROM best UNION ALL SELECT id, own + 1.5::DOUBLE FROM seeds),
files AS (SELECT file_path, max(score) AS score, min(ord) AS o FROM pool JOIN nodes USING (id) WHERE coalesce(file_path, '') <> '' GROUP BY file_path)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, o) AS rank, file_path, round(score, 6) AS score FROM files ORDER BY rank LIMIT 12""")
def route_files(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: which files to read for a symptom."""
    return rank.route(standin.nodes(spark, d), tables.materialize(standin.edges(spark, d)), SYMPTOM).select(long_("rank"), "file_path", F.round("score", 6).alias("score"))


#: Every hundredth part's name and type is a question; points of each token at each node.
QUESTIONS_SQL = f"""
{NODES_SQL}, {EDGES_SQL},
asked AS (SELECT p_partkey AS qid, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS token, generate_subscripts(string_split(p_name || ' ' || p_type, ' '), 1) AS pos FROM part WHERE p_partkey % 100 = 0),
points AS (
  SELECT * FROM (SELECT token, id, ord, CASE WHEN lower(name) = token THEN 0.4::DOUBLE WHEN contains(lower(name), token) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN len([x FOR x IN tags IF lower(x) = token]) > 0 THEN 0.3::DOUBLE WHEN len([x FOR x IN tags IF contains(lower(x), token)]) > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN contains(lower(summary), token) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(lower(file_path), token) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS points
    FROM (SELECT DISTINCT token FROM asked WHERE token <> ''), nodes) WHERE points > 0),
n AS (SELECT qid, count(*) AS n FROM asked WHERE token <> '' GROUP BY qid),
scored AS (
  SELECT qid, id, min(ord) AS ord, least(max(points) * 0.7::DOUBLE + list_reduce(list(points ORDER BY pos), lambda a, b: a + b) / any_value(n)::DOUBLE * 0.3::DOUBLE, 1.0::DOUBLE) AS score
  FROM asked JOIN points USING (token) JOIN n USING (qid) GROUP BY qid, id)"""


def _questions(spark: SparkSession, d: str) -> tuple[Store, DataFrame]:
    store = Store(spark, f"{tables.shared_dir(spark)}/tessera-index-{uuid.uuid4().hex}", buckets=16)
    search.write_index(store, standin.nodes(spark, d))
    return store, read(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", "p_type").alias("text"))


@query(f"""
WITH {QUESTIONS_SQL}
SELECT qid, row_number() OVER w AS rank, id, round(score, 6) AS score FROM scored WHERE score >= 0.1 WINDOW w AS (PARTITION BY qid ORDER BY score DESC, ord) QUALIFY row_number() OVER w <= 15""")
def search_many(spark: SparkSession, d: str) -> DataFrame:
    """The best nodes for a table of questions, by postings of grams."""
    store, q = _questions(spark, d)
    return search.search_many(store, q).select("qid", long_("rank"), "id", F.round("score", 6).alias("score"))


@query(f"""
WITH {QUESTIONS_SQL},
hits AS (
  SELECT qid, id, score, 0 AS pass, ord FROM scored WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) <= 20
  UNION ALL SELECT qid, id, least(points * 0.7::DOUBLE + points * 0.3::DOUBLE, 1.0::DOUBLE), pos, ord FROM asked JOIN (SELECT * FROM points WHERE points * 0.7::DOUBLE + points * 0.3::DOUBLE >= 0.25 QUALIFY row_number() OVER (PARTITION BY token ORDER BY points * 0.7::DOUBLE + points * 0.3::DOUBLE DESC, ord) <= 5) USING (token)),
first_hits AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY pass, score DESC, ord) = 1),
seeds AS (SELECT qid, id, score AS own, row_number() OVER (PARTITION BY qid ORDER BY pass, score DESC, ord) AS rank FROM first_hits),
step1 AS (SELECT s.qid, l.other AS id, 0.7::DOUBLE + l.worth * 0.3::DOUBLE AS score, s.rank AS prank, l.ord FROM links l JOIN seeds s ON l.node = s.id WHERE (s.qid, l.other) NOT IN (SELECT (qid, id) FROM seeds)),
new1 AS (SELECT * FROM step1 QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY prank, ord, score) = 1),
best1 AS (
  SELECT qid, id, score, row_number() OVER w AS rank FROM new1 WHERE score >= 0.2 WINDOW w AS (PARTITION BY qid ORDER BY round(score, 9) DESC, prank, ord) QUALIFY row_number() OVER w <= 5),
step2 AS (
  SELECT b.qid, l.other AS id, b.score * 0.7::DOUBLE + l.worth * 0.3::DOUBLE AS score, -b.score AS p, b.rank AS prank, l.ord FROM links l JOIN best1 b ON l.node = b.id
  WHERE (b.qid, l.other) NOT IN (SELECT (qid, id) FROM seeds UNION ALL SELECT (qid, id) FROM new1)),
new2 AS (SELECT * FROM step2 QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY p, prank, ord, score) = 1),
pool AS (
  SELECT qid, id, greatest(1.0::DOUBLE, own + 1.5::DOUBLE) AS score FROM seeds UNION ALL SELECT qid, id, score FROM new1 UNION ALL SELECT qid, id, score FROM new2),
files AS (SELECT qid, file_path, max(score) AS score, min(ord) AS o FROM pool JOIN nodes USING (id) WHERE coalesce(file_path, '') <> '' GROUP BY qid, file_path)
SELECT qid, row_number() OVER w AS rank, file_path, round(score, 6) AS score FROM files WINDOW w AS (PARTITION BY qid ORDER BY round(score, 9) DESC, o) QUALIFY row_number() OVER w <= 12""")
def route_many(spark: SparkSession, d: str) -> DataFrame:
    """The files to read first, for a table of questions in one plan."""
    store, q = _questions(spark, d)
    return search.route_many(store, tables.materialize(standin.edges(spark, d)), q).select("qid", long_("rank"), "file_path", F.round("score", 6).alias("score"))


FRONTIER_SQL = f"""
WITH {NODES_SQL}, {EDGES_SQL},
w(w) AS (VALUES ('red'), ('widget'), ('promo')),
f AS (SELECT n.id AS file, n.ord, 5 * (SELECT count(*) FROM w WHERE contains(regexp_replace(lower(n.id), '\\.\\w+$', ''), w.w)) + (SELECT count(*) FROM w WHERE contains(lower(n.name || ' ' || n.summary), w.w))
  + 2 * (SELECT count(*) FROM edges e WHERE e.type = 'imports' AND e.target = n.id) AS score FROM nodes n),
c0 AS (SELECT file FROM f ORDER BY score DESC, ord LIMIT 1),
adj AS (SELECT DISTINCT node AS a, other AS b FROM links WHERE ord NOT LIKE '0%'),
c1 AS (SELECT file FROM c0 UNION SELECT b FROM adj JOIN c0 ON a = file WHERE (SELECT count(*) FROM c0) < 15),
c2 AS (SELECT file FROM c1 UNION SELECT b FROM adj JOIN c1 ON a = file WHERE (SELECT count(*) FROM c1) < 15),
c3 AS (SELECT file FROM c2 UNION SELECT b FROM adj JOIN c2 ON a = file WHERE (SELECT count(*) FROM c2) < 15),
top AS (SELECT file FROM f ORDER BY score DESC, ord LIMIT 15)
SELECT file FROM c3 WHERE (SELECT count(*) FROM c3) >= 3 UNION ALL SELECT file FROM top WHERE (SELECT count(*) FROM c3) < 3"""


@query(FRONTIER_SQL)
def frontier_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of graph P stand for files, with their names and summaries as contents."""
    n, e = standin.nodes(spark, d), tables.materialize(standin.edges(spark, d))
    files = n.select(F.col("id").alias("file"), F.concat_ws(" ", "name", "summary").alias("content"), "ord")
    imports = e.where("type = 'imports'").select(F.col("source").alias("file"), F.col("target").alias("from_file"))
    return rank.frontier(files, imports, e.where("type = 'calls'").select(F.col("source").alias("caller"), F.col("target").alias("callee")), SYMPTOM)


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n_nationkey, 100 + n_regionkey FROM nation),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS v FROM r WHERE a = b)
SELECT DISTINCT v AS id FROM (SELECT v FROM c UNION SELECT x.b FROM r x JOIN c ON x.a = c.v JOIN r y ON y.a = x.b JOIN c c2 ON c2.v = y.b)""")
def cycle_test(spark: SparkSession, d: str) -> DataFrame:
    """Some nations lead to others, all to their regions; nodes of cycles and between them are left."""
    n = read(spark, d, "nation")
    e = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("target"))
    return graph.cycle_nodes(e.unionByName(n.select(F.col("n_nationkey").alias("source"), (F.col("n_regionkey") + 100).alias("target"))))


# Vectors


def _first_vectors(spark: SparkSession, d: str, n: int) -> list[list[float]]:
    return [r.embedding for r in read(spark, d, "embeddings").orderBy("vec_id").limit(n).collect()]


COS_SQL = "greatest(0.0::DOUBLE, list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))))"


@query(f"""
WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round({COS_SQL.format(a="embedding", b="(SELECT v FROM q)")}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The archive entries most like the first vector."""
    q = F.array(*[F.lit(float(x)) for x in _first_vectors(spark, d, 1)[0]])
    return read(spark, d, "embeddings").select("vec_id", F.round(V.cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"""
WITH q AS (SELECT list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: x[1] * 0.6::DOUBLE + x[2] * 0.4::DOUBLE) AS v
  FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET 1) b),
s AS (SELECT vec_id, label, round({COS_SQL.format(a="embedding", b="(SELECT v FROM q)")}, 3) AS score FROM embeddings)
SELECT label, max(score) AS score FROM s WHERE score > 0 GROUP BY label""")
def fused_topk(spark: SparkSession, d: str) -> DataFrame:
    """Labels stand for files, the first two vectors for an image and a text."""
    image, text = _first_vectors(spark, d, 2)
    nodes = read(spark, d, "embeddings").select(F.col("label").alias("file_path"), "embedding", F.col("vec_id").alias("ord"))
    return rank.visual_route(nodes, image, text, max_files=1_000_000).select(F.col("file_path").alias("label"), "score")


# Across files


@query("""
SELECT o_orderkey AS file, o_custkey AS name, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, md5(string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_partkey, l_linenumber)) AS imported_by
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def symbol_origins(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for exports, their lines for imports."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    exports = o.select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("name"), F.lit(0).alias("line"))
    own = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    imports = own.select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("local_name"), F.col("l_orderkey").alias("from_file"), F.col("o_custkey").alias("original_name"), F.col("l_linenumber").alias("line"))
    by = F.array_join(F.transform(F.array_sort(F.transform("imported_by", lambda x: F.struct(x["file"].alias("f"), x["line"].alias("l")))), lambda x: F.concat(x["f"], F.lit(":"), x["l"])), ",")
    r = crossfile.symbol_origins(imports, exports)
    return r.select("file", "name", F.size("imported_by").cast("long").alias("n"), F.aggregate("imported_by", F.lit(0).cast("long"), lambda a, x: a + x["line"]).alias("lines"), F.md5(by.cast("binary")).alias("imported_by"))


CHAIN_SQL = """
WITH acc AS (SELECT l_suppkey AS file, l_partkey AS var, CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS kind, l_linestatus AS fn, l_orderkey AS line FROM lineitem),
imp AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS var, s_nationkey AS origin_file FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'A'),
exp AS (SELECT DISTINCT s_nationkey AS origin_file, l_partkey AS origin_var FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE p_size <= 10),
a AS (SELECT acc.*, imp.origin_file, acc.var AS origin_var FROM acc JOIN imp USING (file, var) JOIN exp ON exp.origin_file = imp.origin_file AND exp.origin_var = acc.var),
b AS (SELECT acc.*, acc.file AS origin_file, acc.var AS origin_var FROM acc JOIN exp ON exp.origin_file = acc.file AND exp.origin_var = acc.var WHERE (acc.file, acc.var) NOT IN (SELECT (file, var) FROM imp)),
c AS (SELECT * FROM a UNION ALL SELECT * FROM b)
"""


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for files, parts for variables; returned lines write, and accepted ones import from the nation's file, which exports the small parts that it supplies."""
    li, s, p = (read(spark, d, t) for t in ("lineitem", "supplier", "part"))
    acc = li.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("var"), F.when(F.col("l_returnflag") == "R", "write").otherwise("read").alias("kind"), F.col("l_linestatus").alias("fn"), F.col("l_orderkey").alias("line"))
    imp = li.where("l_returnflag = 'A'").join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("local_name"), F.col("s_nationkey").cast("long").alias("from_file"), F.col("l_partkey").alias("original_name")).distinct()
    small = li.select("l_suppkey", "l_partkey").distinct().join(p.where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    exp = small.join(s, small["l_suppkey"] == s["s_suppkey"]).select(F.col("s_nationkey").cast("long").alias("file"), F.col("l_partkey").alias("name"), F.lit(0).alias("line")).distinct()
    return crossfile.expand_chains(acc, imp, exp)


@query(CHAIN_SQL + "SELECT origin_file::BIGINT AS origin_file, origin_var, count(*) FILTER (kind = 'write') AS writes, count(*) FILTER (kind = 'read') AS reads, count(DISTINCT file) AS files FROM c GROUP BY ALL")
def chain_expansion(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return _chains(spark, d).groupBy("origin_file", "origin_var").agg(n("write").alias("writes"), n("read").alias("reads"), F.countDistinct("file").alias("files"))


@query(CHAIN_SQL + "SELECT 'cross_file_mutation' AS type, origin_var AS subject, file, line, min(fn) AS fn FROM c WHERE kind = 'write' AND file <> origin_file GROUP BY ALL")
def cross_file_risks(spark: SparkSession, d: str) -> DataFrame:
    return crossfile.dedupe_risks(crossfile.risk_cross_file_mutation(_chains(spark, d)))


@query("""
SELECT l_suppkey AS caller, s_nationkey AS callee, p_name AS function, min(l_orderkey) AS line
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT DISTINCT s_suppkey, s_nationkey FROM supplier) ON s_suppkey = l_suppkey WHERE p_type = 'PROMO' GROUP BY ALL""")
def call_graph(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for calling files, nations for called ones; they import the names of promoted parts."""
    li, p, s = (read(spark, d, t) for t in ("lineitem", "part", "supplier"))
    j = li.join(p, li["l_partkey"] == p["p_partkey"])
    calls = j.select(F.col("l_suppkey").alias("file"), F.col("p_name").alias("callee"), F.lit(None).cast("string").alias("receiver"), F.col("l_orderkey").alias("line"), "p_type")
    imports = j.where("p_type = 'PROMO'").join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("l_suppkey").alias("file"), F.col("p_name").alias("local_name"), F.col("s_nationkey").alias("from_file")).distinct()
    return crossfile.call_graph(calls.where("p_type = 'PROMO'").drop("p_type"), imports)


# Detectors


@query("""
SELECT user_id, event_id, ts, first_error FROM (
  SELECT *, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS first_error FROM events)
WHERE event_type = 'purchase' AND first_error IS NOT NULL""")
def write_before_await(spark: SparkSession, d: str) -> DataFrame:
    """A user's events stand for the statements of a block, purchases for writes and errors for awaits."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("write_subject"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("await_line"))
    return detect.write_before_await(e, keys=("user_id",), order="at", keep=("event_id", "ts")).select("user_id", "event_id", "ts", F.col("first_await").alias("first_error"))


CAUSAL_SQL = """
WITH ev AS (SELECT user_id, date_trunc('day', ts) AS day, event_type, event_id FROM events),
c AS (
  SELECT a.user_id, a.day, a.event_type AS trig, a.event_id AS trigger_line, b.event_id AS write_line,
    EXISTS (SELECT 1 FROM ev g WHERE g.user_id = a.user_id AND g.day = a.day AND g.event_type = 'signup' AND g.event_id > a.event_id AND g.event_id <= b.event_id) AS guarded
  FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.day = b.day AND b.event_id > a.event_id WHERE a.event_type IN ('click', 'view') AND b.event_type = 'purchase')
"""


def _causal(spark: SparkSession, d: str) -> DataFrame:
    """A user's day stands for a function, clicks and views for async triggers, purchases for writes, signups for guards."""
    e = read(spark, d, "events").select(F.col("user_id").alias("file"), F.date_trunc("day", "ts").alias("fn"), F.col("event_type").alias("api"), F.col("event_type").alias("var"), F.col("event_id").alias("line"))
    return detect.causal_chains(e.where(F.col("api").isin("click", "view")), e.where("var = 'purchase'"), e, guards=["signup"], write_like=None)


@query(CAUSAL_SQL + "SELECT user_id, trig, trigger_line, write_line, guarded FROM c")
def causal_chains(spark: SparkSession, d: str) -> DataFrame:
    return _causal(spark, d).select(F.col("file").alias("user_id"), F.col("trigger").alias("trig"), "trigger_line", "write_line", "guarded")


@query(CAUSAL_SQL + "SELECT user_id, count(*) AS n_chains, count(DISTINCT trig) AS n_triggers, string_agg(DISTINCT trig, ',' ORDER BY trig) AS triggers FROM c WHERE NOT guarded GROUP BY user_id HAVING count(*) >= 2 AND count(DISTINCT trig) >= 2")
def multi_source_race(spark: SparkSession, d: str) -> DataFrame:
    return detect.multi_source_races(_causal(spark, d)).select(F.col("file").alias("user_id"), "n_chains", "n_triggers", F.array_join("triggers", ",").alias("triggers"))


@query("""
SELECT DISTINCT o_orderkey AS file, l_linenumber::BIGINT AS line, l_suppkey AS arg, s_nationkey AS source, r_name AS field
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = s_nationkey AND l_returnflag = 'R'""")
def captured_reference(spark: SparkSession, d: str) -> DataFrame:
    """Order lines stand for constructor calls, suppliers for imported variables, nations for their files: reassigned where the customer lives there."""
    li, o, s, n, r, c = (read(spark, d, t) for t in ("lineitem", "orders", "supplier", "nation", "region", "customer"))
    lines = li.where("l_returnflag = 'R'").join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"])
    new = lines.select(F.col("o_orderkey").alias("file"), F.col("c_nationkey").alias("class"), F.col("l_suppkey").alias("arg"), F.lit(0).alias("arg_idx"), F.col("l_linenumber").alias("line")).distinct()
    imports = lines.join(s, F.col("l_suppkey") == s["s_suppkey"]).where("c_nationkey = s_nationkey").select(F.col("o_orderkey").alias("file"), F.col("l_suppkey").alias("local_name"), F.col("s_nationkey").alias("from_file"), F.col("l_suppkey").alias("original_name")).distinct()
    lets = s.select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("var"))
    field = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    captures = new.select("file", "class").distinct().join(field, F.col("class") == field["n_nationkey"]).select("file", "class", F.lit(0).alias("param_idx"), F.col("r_name").alias("field"))
    out = detect.captured_references(new, imports, lets, lets, captures)
    return out.select("file", long_("line"), "arg", "source", "field").distinct()


@query("""
WITH st AS (SELECT l_suppkey AS file, p_partkey AS var, p_name, count(*) FILTER (l_returnflag = 'R') AS r, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS w, count(DISTINCT l_orderkey) FILTER (l_returnflag <> 'R') AS rd FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT s_suppkey AS supplier, first(var ORDER BY p_name = 'red widget' DESC, var) AS part FROM st JOIN supplier ON s_suppkey = file WHERE r >= 1 AND w >= 1 AND rd >= 1 GROUP BY s_suppkey""")
def stale_capture(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for files, their parts for variables, orders for functions."""
    li, p, s = (read(spark, d, t) for t in ("lineitem", "part", "supplier"))
    lines = li.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("ord"), F.col("l_orderkey").alias("fn"), (F.col("l_returnflag") == "R").alias("write"))
    st = detect.variable_stats(lines, ("file", "ord")).join(p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("var")), "ord")
    calls = s.select(F.col("s_suppkey").alias("file"), F.lit("x").alias("local_var"), F.lit("make red widget").alias("callee"), F.lit(0).alias("line"))
    imports = s.select(F.col("s_suppkey").alias("file"), F.lit("make red widget").alias("local_name"), F.col("s_suppkey").alias("from_file"))
    return detect.stale_captures(calls, imports, st, keep=("ord",)).select(F.col("file").alias("supplier"), F.col("ord").alias("part"))


@query("""
WITH m AS (SELECT user_id, date_trunc('day', ts) AS day, event_type FROM events WHERE event_type IN ('purchase', 'error', 'signup'))
SELECT user_id, day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS methods, CASE WHEN bool_or(event_type = 'error') AND bool_or(event_type IN ('purchase', 'signup')) THEN 'critical' ELSE 'high' END AS severity FROM m GROUP BY ALL""")
def foreach_severity(spark: SparkSession, d: str) -> DataFrame:
    """A user's day stands for a loop over a collection; errors delete, purchases and signups add."""
    method = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "push").when(F.col("event_type") == "signup", "set")
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.date_trunc("day", "ts").alias("line"), F.lit("c").alias("collection"), F.lit("f").alias("callback"), method.alias("method"), "event_type").where("method is not null")
    loops = e.select("file", "line", "collection", F.date_format("line", "yyyy-MM-dd").alias("callback")).distinct()
    muts = e.select("file", F.date_format("line", "yyyy-MM-dd").alias("fn"), F.col("collection").alias("receiver"), "method")
    out = detect.foreach_mutations(loops, muts, spark.createDataFrame([], "file string, caller string, callee string"))
    names = F.array_sort(F.transform("methods", lambda m: F.when(m == "delete", "error").when(m == "push", "purchase").otherwise("signup")))
    return out.select(F.col("file").cast("long").alias("user_id"), F.col("line").alias("day"), F.array_join(names, ",").alias("methods"), "severity")


@query("""
WITH a AS (SELECT user_id, event_id AS add_line, value > 10 AS capture FROM events WHERE event_type = 'signup'),
r AS (SELECT user_id, event_id AS remove_line, value > 10 AS capture FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT a.user_id, a.add_line, r.remove_line, 'capture_mismatch' AS type FROM a JOIN r USING (user_id) WHERE a.capture <> r.capture""")
def listener_parity(spark: SparkSession, d: str) -> DataFrame:
    """Signups stand for added listeners, purchases for removed ones; dear ones capture."""
    e = read(spark, d, "events").select(F.col("user_id").alias("file"), F.lit("e").alias("event"), F.lit("h").alias("handler"), F.col("event_id").alias("line"), (F.col("value") > 10).alias("capture"), F.lit(None).cast("boolean").alias("passive"), F.lit(True).alias("has_options"), "event_type")
    out = detect.listener_parity(e.where("event_type = 'signup'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"))
    return out.select(F.col("file").alias("user_id"), "add_line", "remove_line", "type")


@query("""
SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""")
def user_async_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Lines stand for unawaited calls, promoted parts for async functions, lines of finished orders for known findings."""
    li, p, o = (read(spark, d, t) for t in ("lineitem", "part", "orders"))
    calls = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("api")).distinct()
    known = calls.join(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("file")), "file", "left_semi")
    out = detect.user_async_floats(calls, p.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("name")), known)
    return out.select(F.col("file").alias("l_orderkey"), long_("line").alias("l_linenumber"), F.col("api").alias("l_partkey"))


@query("""
WITH a AS (SELECT json_extract_string(props, '$.k') AS var, user_id, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS kind FROM events),
g AS (SELECT var, coalesce(list_sort(list_distinct(list(user_id) FILTER (kind = 'write'))), []) AS w, coalesce(list_sort(list_distinct(list(user_id) FILTER (kind = 'read'))), []) AS r FROM a GROUP BY var)
SELECT var, len(w) AS n_writers, len(r) AS n_readers, len([x FOR x IN r IF NOT list_contains(w, x)]) AS n_only_read FROM g WHERE len(w) > 0 AND len([x FOR x IN r IF NOT list_contains(w, x)]) > 0""")
def cross_function_filter(spark: SparkSession, d: str) -> DataFrame:
    """The key of an event's properties stands for a variable, users for functions, purchases for writes."""
    e = read(spark, d, "events").select(F.get_json_object("props", "$.k").alias("var"), F.col("user_id").alias("fn"), F.when(F.col("event_type") == "purchase", "write").otherwise("read").alias("kind"))
    out = detect.cross_function_filter(e, keys=("var",), noise=[])
    return out.select("var", "n_writers", "n_readers", "n_only_read")


# Patterns

PATTERN_SQL = """
WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS races, count(*) FILTER (event_type = 'signup') AS closures, count(*) FILTER (event_type = 'error' AND value > 15) AS floats, count(*) FILTER (event_type = 'click' AND value > 20) AS timers, count(*) FILTER (event_type = 'view' AND value > 30) AS muts FROM events GROUP BY user_id),
e AS (SELECT user_id, list_filter([
  CASE WHEN races > 0 THEN 'global_write' END, CASE WHEN races > 0 THEN 'await_expression' END, CASE WHEN races > 0 THEN 'write_shared' END, CASE WHEN races > 0 THEN 'read_shared' END,
  CASE WHEN timers > 0 THEN 'await_boundary' END, CASE WHEN timers > 0 THEN 'async_delay' END, CASE WHEN timers > 0 THEN 'setInterval' END, CASE WHEN timers > 0 THEN 'no_clearInterval' END,
  CASE WHEN closures > 0 THEN 'closure_capture' END, CASE WHEN closures > 0 AND races > 0 AND timers > 0 THEN 'stale_var_access' END,
  CASE WHEN muts > 0 THEN 'collection_mutate' END, CASE WHEN muts > 0 THEN 'forEach_loop' END,
  CASE WHEN floats > 0 THEN 'async_call' END, CASE WHEN floats > 0 THEN 'no_await' END, CASE WHEN floats > 0 THEN 'expression_statement' END], lambda x: x IS NOT NULL) AS events FROM f)
"""
STARTER_SQL = "p(id, sig, weight) AS (VALUES " + ", ".join(f"('{i}', {s!r}, {w}::DOUBLE)" for i, s, _, _, _, w in patterns.STARTERS) + ")"


def _user_events(spark: SparkSession, d: str) -> DataFrame:
    """A user's events stand for a project's facts: purchases for races, signups for closures, and so on."""
    e = read(spark, d, "events")
    k = lambda t, v=-1e9: F.count_if((F.col("event_type") == t) & (F.col("value") > v))
    zero = lambda n: F.lit(0).alias(n)
    f = e.groupBy("user_id").agg(k("purchase").alias("n_global_races"), k("signup").alias("n_closures"), k("error", 15).alias("n_floating"), k("click", 20).alias("timers"), k("view", 30).alias("n_foreach_mutations"))
    f = f.select("*", F.when(F.col("timers") > 0, F.array(F.lit("setInterval"))).otherwise(F.array().cast("array<string>")).alias("timing_apis"), *map(zero, ("n_conditional_writes", "n_state_mutations", "n_react", "n_react_direct", "n_cross_file_mutations", "n_async_races")))
    return f.select("user_id", patterns.events_column().alias("events"))


@query(PATTERN_SQL + "SELECT user_id, array_to_string(list_sort(events), ',') AS events FROM e")
def event_signature(spark: SparkSession, d: str) -> DataFrame:
    return _user_events(spark, d).select("user_id", F.array_join(F.array_sort("events"), ",").alias("events"))


MATCH_SQL = f", {STARTER_SQL}, m AS (SELECT user_id, id AS pattern_id, len([x FOR x IN sig IF list_contains(events, x)])::DOUBLE / len(sig) AS coverage, weight FROM e, p WHERE weight >= 0.3)"


@query(PATTERN_SQL + MATCH_SQL + "SELECT user_id, pattern_id, round(coverage, 6) AS coverage, round(least(weight * coverage, 1.0), 6) AS confidence FROM m WHERE coverage >= 0.7")
def pattern_match(spark: SparkSession, d: str) -> DataFrame:
    m = patterns.match_patterns(_user_events(spark, d), patterns.starters(spark))
    return m.select("user_id", "pattern_id", F.round("coverage", 6).alias("coverage"), F.round("confidence", 6).alias("confidence"))


@query(PATTERN_SQL + MATCH_SQL + """, hit AS (SELECT DISTINCT pattern_id FROM m WHERE coverage >= 0.7)
SELECT id, round(CASE WHEN id IN (FROM hit) THEN least(1.0, weight + 0.05) ELSE weight END, 6) AS after_pass, (CASE WHEN id IN (FROM hit) THEN 1 ELSE 0 END)::BIGINT AS hit_count, round(CASE WHEN id IN (FROM hit) THEN greatest(0.3, weight - 0.03) ELSE weight END, 6) AS after_fail FROM p""")
def pattern_feedback(spark: SparkSession, d: str) -> DataFrame:
    p = patterns.starters(spark)
    m = patterns.match_patterns(_user_events(spark, d), p)
    good, bad = patterns.reinforce(p, m), patterns.penalize(p, m)
    return good.select("id", F.round("weight", 6).alias("after_pass"), long_("hit_count")).join(bad.select("id", F.round("weight", 6).alias("after_fail")), "id")


# Verification

NORM = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query(f"""
WITH b AS (SELECT item_id, {NORM.format(c="text")} AS t FROM benchmark), dd AS (SELECT doc_id, {NORM.format(c="text")} AS t FROM documents)
SELECT item_id AS claim_id, doc_id AS path FROM b, dd WHERE length(b.t) >= 5 AND contains(dd.t, b.t)""")
def literal_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items stand for literal evidence, documents for files."""
    b, docs = read(spark, d, "benchmark"), read(spark, d, "documents")
    return verify.literal_exists(b.select(F.col("item_id").alias("claim_id"), "text"), docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_signup FROM events")
def fill_down(spark: SparkSession, d: str) -> DataFrame:
    """The last signup stands for the file last named before a line number."""
    e = read(spark, d, "events")
    return verify.fill_down(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "last_signup").select("event_id", "last_signup")


@query("""
WITH c AS (SELECT doc_id, lang <> 'en' AS unknown, source = 'src1' AS cross_repo, n_chars AS line, length(text) AS size, (quality = 0)::INT AS miss FROM documents JOIN labels USING (doc_id)),
p AS (SELECT doc_id, 0.2::DOUBLE * (unknown::INT + miss) + CASE WHEN unknown THEN 0.3 WHEN line > 1000 + 6 THEN 0.3 ELSE 0 END + CASE WHEN unknown AND cross_repo THEN 0.05 ELSE 0 END + CASE WHEN NOT unknown AND line > 2000 + 10 THEN 0.15 ELSE 0 END + 0.15::DOUBLE * miss AS penalty, unknown AND NOT cross_repo AS rejected FROM c)
SELECT doc_id, round(penalty, 6) AS penalty, rejected, round(greatest(0.0, 0.9::DOUBLE - penalty), 6) AS adjusted FROM p""")
def claim_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents stand for claims: other languages for unknown files, lengths for lines, bad ones for missed literals."""
    x = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    unknown, miss, zero = F.col("lang") != "en", (F.col("quality") == 0).cast("int"), F.lit(0)
    c = x.select(
        "doc_id", F.lit(0.9).alias("confidence"), unknown.cast("int").alias("n_unknown_evidence"), miss.alias("n_literal_misses"), (~unknown).alias("location_known"), F.col("n_chars").alias("location_line"), F.lit(1000).alias("file_lines"),
        (~unknown).alias("root_known"), (F.col("source") == "src1").alias("cross_repo"), F.lit(False).alias("whitelisted"), F.col("n_chars").alias("root_line"), F.lit(2000).alias("root_lines"), miss.alias("n_missing_callers"), zero.alias("n_unknown_security"),
    )
    return verify.claim_penalty(c).select("doc_id", F.round("penalty", 6).alias("penalty"), "rejected", F.round("adjusted", 6).alias("adjusted"))


def _any_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(s, '{w}')" for w in words) + ")"


@query(f"""
WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN {_any_sql(verify.PACKAGE_PHRASES)} OR (contains(s, 'package.json') AND (contains(s, 'missing') OR contains(s, 'dependency'))) THEN 'PACKAGE_RESOLUTION'
  WHEN {_any_sql(verify.BUILD_PHRASES)} OR (contains(s, 'type error') AND (contains(s, 'compile') OR contains(s, 'build'))) OR (contains(s, 'vite') AND contains(s, 'error')) THEN 'BUILD_CONFIG'
  WHEN {_any_sql(verify.TYPE_PHRASES)} THEN 'RUNTIME_TYPE' ELSE 'RUNTIME_LOGIC' END AS error_class,
  CASE WHEN regexp_matches(s, '\\bcan i\\b|\\bcould i\\b|\\bwhat would break\\b|\\bif i\\b|\\bwould it\\b|\\bshould i\\b|\\bsafe to\\b|\\brefactor\\b') THEN 'feasibility'
  WHEN regexp_matches(s, '\\bwhere (is|are|does)\\b|\\bwhat is\\b|\\bwhat does\\b|\\bshow me\\b|\\bfind\\b|\\bwhich file\\b|\\bdefined\\b') THEN 'factual' ELSE 'analytical' END AS query_class,
  len([w FOR w IN {verify.UPSTREAM!r} IF contains(s, w)])::BIGINT AS upstream FROM t""")
def classify_text(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations stand for symptoms and questions."""
    c = read(spark, d, "conversations")
    up = F.size(F.filter(T.lit_array(verify.UPSTREAM), lambda w: F.contains(F.lower(F.coalesce("text", F.lit(""))), w)))
    return c.select("conv_id", "turn", verify.error_class(F.col("text")).alias("error_class"), rank.query_class(F.col("text")).alias("query_class"), up.cast("long").alias("upstream"))


@query("""
WITH s AS (SELECT user_id, list(DISTINCT json_extract_string(props, '$.k') ORDER BY json_extract_string(props, '$.k')) FILTER (event_type = 'purchase') AS a, list(DISTINCT json_extract_string(props, '$.k') ORDER BY json_extract_string(props, '$.k')) FILTER (event_type = 'error') AS b FROM events GROUP BY user_id),
t AS (SELECT user_id, coalesce(a, []) AS a, coalesce(b, []) AS b, (len(coalesce(a, [])) > 0)::INT + (len(coalesce(b, [])) > 0)::INT AS n, len(list_intersect(coalesce(a, []), coalesce(b, []))) = 0 AS orth FROM s)
SELECT user_id, n::BIGINT AS survivors, orth, round(least(0.95::DOUBLE, CASE WHEN len(b) = 0 THEN 0.70 ELSE 1.0 END, CASE WHEN n = 1 AND len(b) = 0 THEN 0.75 WHEN n = 1 THEN 0.82 ELSE 1.0 END, CASE WHEN n > 1 AND orth THEN 0.85 WHEN n > 1 THEN 0.65 ELSE 1.0 END), 6) AS confidence FROM t""")
def confidence_caps(spark: SparkSession, d: str) -> DataFrame:
    """A user's purchases and errors stand for the evidence of two hypotheses."""
    k = F.get_json_object("props", "$.k")
    of = lambda t: F.collect_set(F.when(F.col("event_type") == t, k))
    s = read(spark, d, "events").groupBy("user_id").agg(of("purchase").alias("a"), of("error").alias("b"))
    n, orth = (F.size("a") > 0).cast("int") + (F.size("b") > 0).cast("int"), verify.pairwise_disjoint(F.array("a", "b"))
    s = s.select("user_id", n.cast("long").alias("survivors"), orth.alias("orth"), "b")
    quality = F.when(F.col("survivors") == 1, F.when(F.size("b") == 0, "DEFAULT").otherwise("WEAK"))
    conf = verify.recalibrate(F.lit(0.95), F.lit(False), F.size("b") == 0, quality, F.col("survivors"), F.col("orth"))
    return s.select("user_id", "survivors", "orth", F.round(conf, 6).alias("confidence"))


@query("""
WITH t AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25),
w AS (SELECT *, coalesce(sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT doc_id, (CASE WHEN n_chars <= 1500000 - before THEN n_chars WHEN 1500000 - before > 500 THEN 1500000 - before END)::BIGINT AS kept_chars FROM w WHERE n_chars <= 1500000 - before OR 1500000 - before > 500""")
def resource_cap(spark: SparkSession, d: str) -> DataFrame:
    """The largest documents stand for the files of a prompt."""
    t = read(spark, d, "documents").select("doc_id", "n_chars", (-F.col("n_chars")).alias("o"))
    return verify.resource_cap(t, ["o", "doc_id"], "n_chars").select("doc_id", long_("kept_chars"))


# Memory


CODEX_SQL = """
WITH x AS (SELECT o_orderkey AS task_id, lower(o_orderpriority) AS p, lower(o_orderstatus) AS st, 'order of customer ' || o_custkey AS problem, o_orderdate FROM orders),
tok(t) AS (VALUES ('urgent'), ('high'), ('customer')),
k AS (SELECT x.*, (SELECT sum(CASE WHEN contains(p, t) OR contains(st, t) THEN 2 WHEN contains(problem, t) THEN 1 ELSE 0 END) FROM tok)::BIGINT AS kw, 1 / (1 + greatest(0.0::DOUBLE, (epoch_ms(TIMESTAMP '1998-12-01') - epoch_ms(o_orderdate)) / 86400000.0::DOUBLE) / 30) AS rec FROM x),
b AS (SELECT task_id, kw, rec, (kw / 6.0::DOUBLE) * 0.8::DOUBLE + rec * 0.2::DOUBLE AS score FROM k WHERE kw >= 2)
SELECT task_id, kw, round(rec, 6) AS recency, round(score, 6) AS score FROM b ORDER BY round(score, 9) DESC, task_id LIMIT 3"""


@query(CODEX_SQL)
def codex_search(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for past tasks: priority and status are tags."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("order of customer "), "o_custkey").alias("problem"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.col("o_orderdate").alias("dt"))
    r = memory.search_codex(o, "the urgent, high customer bug", F.lit("1998-12-01").cast("timestamp"))
    return r.select("task_id", long_("kw"), F.round("recency", 6).alias("recency"), F.round("score", 6).alias("score"))


@query(CHANGED_SQL + "SELECT d.doc_id, CASE WHEN now.h <> was.h OR was.h IS NULL THEN 'stale' ELSE 'ok' END AS state FROM documents d JOIN now ON now.path = d.doc_id::VARCHAR LEFT JOIN was ON was.path = now.path")
def stale_entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents stand for memory entries, held against the stored hashes."""
    now, was = _hashes(spark, d)
    e = now.select(F.col("path").alias("task_id"), "path", "content_hash", F.lit(0).alias("failed_uses"), F.lit("fresh").alias("status"))
    return memory.doctor(e, was).select(F.col("task_id").cast("long").alias("doc_id"), "state")


@query("SELECT n_nationkey::VARCHAR AS task_id, n_name AS problem, 'r' || n_regionkey || ',nation' AS tags FROM nation")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nations, written as a Markdown table and read back."""
    n = read(spark, d, "nation").select(F.concat(F.lit("| "), "n_nationkey", F.lit(" | "), "n_name", F.lit(" | r"), "n_regionkey", F.lit(", nation | 2024-01-05 |")).alias("l"))
    t = n.agg(F.concat(F.lit("# Index\n\n| Task ID | Problem | Tags | Date |\n|---|---|---|---|\n"), F.array_join(F.array_sort(F.collect_list("l")), "\n")).alias("content"))
    return memory.index_rows(t).select("task_id", "problem", F.array_join("tags", ",").alias("tags"))


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS section, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
c AS (SELECT *, (contains(lower(section), 'ing')::INT + contains(lower(section), 'tion')::INT + contains(lower(section), 'der')::INT) AS score FROM p)
SELECT doc_id, sum(score)::BIGINT AS total, max(score)::BIGINT AS best, count(*) AS n FROM c WHERE score > 0 GROUP BY doc_id""")
def section_rank(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents stand for sections of notes, scored by the words of a question; all that score fit."""
    notes = F.concat(F.lit("# "), F.regexp_replace(F.regexp_replace("text", "(?m)^#+ ", "x"), "\n", "\n# "))
    p = rank.sections(read(spark, d, "documents").select("doc_id", notes.alias("t")), "doc_id", "t", "tion der ing", budget=1 << 40)
    return p.groupBy(F.col("id").alias("doc_id")).agg(F.sum("score").alias("total"), F.max("score").cast("long").alias("best"), F.count("*").alias("n"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
m AS (SELECT doc_id, line AS mark_line FROM l WHERE contains(content, '@'))
SELECT m.doc_id, m.mark_line::BIGINT AS mark_line, l.line::BIGINT AS line, md5(l.content) AS content FROM m JOIN l ON l.doc_id = m.doc_id AND l.line BETWEEN m.mark_line - 3 AND m.mark_line + 3""")
def line_window(spark: SparkSession, d: str) -> DataFrame:
    """Lines with addresses stand for findings."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    marks = docs.select("id", F.posexplode(F.split("content", "\n")).alias("p", "l")).where(F.contains("l", F.lit("@"))).select("id", (F.col("p") + 1).alias("line"))
    return rank.line_window(docs, marks).select(F.col("id").alias("doc_id"), long_("mark_line"), long_("line"), F.md5(F.col("content").cast("binary")).alias("content"))


@query("SELECT sha256(string_agg(n_name, '|' ORDER BY n_name)) AS project_key FROM nation")
def project_key(spark: SparkSession, d: str) -> DataFrame:
    return graph.project_key(read(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AS ok FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Properties stand for parts of a report."""
    v = F.try_parse_json("props")
    return read(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), F.try_variant_get(v, "$.k", "bigint").isNotNull().alias("ok"))


# Extraction and streams


@query(r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS code, generate_subscripts(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), 1) - 1 AS i FROM pages),
c AS (SELECT page_id, i, unnest(regexp_extract_all(regexp_replace(code, '"(?:\\.|[^"\\])*"', '""', 'g'), '([A-Za-z_$][A-Za-z0-9_$]*)\(', 1)) AS callee FROM s)
SELECT DISTINCT 'page' || page_id || '-' || i || '.js' AS file, callee FROM c""")
def extract_functions(spark: SparkSession, d: str) -> DataFrame:
    """Calls in the inline scripts of pages."""
    facts = extract.extract_facts(extract.scripts_of_pages(read(spark, d, "pages")))
    return extract.table(facts, "call").select("file", "callee").distinct()


@query("""SELECT doc_id::VARCHAR AS path, 'sha256:' || sha256(coalesce(CASE WHEN lang = 'de' THEN text || '!' ELSE text END, '')) AS content_hash FROM documents""")
def incremental_stream(spark: SparkSession, d: str) -> DataFrame:
    """Documents land as files in two batches, the German ones again with other texts; the table holds the last of each."""
    root = f"{tables.shared_dir(spark)}/tessera-stream-{uuid.uuid4().hex}"
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "lang")
    docs.select("path", "content", F.timestamp_seconds(F.lit(0)).alias("ts")).write.parquet(f"{root}/in")
    streaming.watch(spark, f"{root}/in", f"{root}/table", f"{root}/state").awaitTermination()
    again = docs.where("lang = 'de'").select("path", F.concat("content", F.lit("!")).alias("content"), F.timestamp_seconds(F.lit(60)).alias("ts"))
    again.write.mode("append").parquet(f"{root}/in")
    streaming.watch(spark, f"{root}/in", f"{root}/table", f"{root}/state").awaitTermination()
    return streaming.current(spark, f"{root}/table").select("path", "content_hash")
