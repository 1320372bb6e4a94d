"""Queries over sources and sinks: what is written is read back from the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import tables
from tessera.plans import standin
from tessera.plans.registry import query
from tessera.plans.standin import EDGES_SQL, NODES_SQL, read
from tessera.sources import files, sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def _scanned(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, str]:
    """A folder of JSON files, one for each nation, below a folder of its region; two regions are folders that no scan enters."""
    root = _folder(spark, name)
    folder = F.when(F.col("n_regionkey") == 0, "node_modules").when(F.col("n_regionkey") == 1, "test").otherwise(F.concat(F.lit("r"), "n_regionkey"))
    rows = read(spark, d, "nation").select(folder.alias("a"), F.col("n_nationkey").alias("k"), "n_name")
    # a path of plain folder names: the partition columns' values only
    for a in ("node_modules", "test", "r2", "r3", "r4"):
        rows.where(F.col("a") == a).select("k", "n_name").repartition("k").write.partitionBy("k").json(f"{root}/{a}")
    return read(spark, d, "nation"), root


@query("""SELECT n_nationkey AS k, 'r' || n_regionkey AS folder, '{"n_name":"' || n_name || '"}' || chr(10) AS content, 2::BIGINT AS n_lines FROM nation WHERE n_regionkey > 1""")
def scan_directory(spark: SparkSession, d: str) -> DataFrame:
    """A folder of files, scanned by the rules of folders, extensions and tests."""
    _, root = _scanned(spark, d, "scan")
    found = files.scan_directory(spark, root)
    return found.select(F.regexp_extract("path", r"k=(\d+)/", 1).cast("int").alias("k"), F.regexp_extract("path", r"^(\w+)/", 1).alias("folder"), "content", F.col("n_lines").cast("long").alias("n_lines"))


@query("""SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 3 OR n_regionkey = 1 AND n_nationkey = 1""")
def scan_some(spark: SparkSession, d: str) -> DataFrame:
    """The same folder with tests, of which only one folder and one file are included."""
    _, root = _scanned(spark, d, "scan")
    found = files.resolve_source(spark, known=files.scan_directory(spark, root, include=["/r3/", "/test/k=1/"], exclude=["/r2/"], tests=True))
    return found.select(F.regexp_extract("path", r"k=(\d+)/", 1).cast("int").alias("k"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/x' || page_id || CASE page_id % 4 WHEN 0 THEN '.test.js' WHEN 1 THEN '.js' ELSE '.ts' END AS path, html FROM pages)
SELECT path, length(html)::BIGINT AS n FROM p WHERE len(string_split(path, '/')) <= 6 AND page_id % 4 <> 0 AND length(html) <= 5000 AND NOT contains('/' || path, 'example.com/de')""")
def select_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages stand for files: the rules of depth, tests, exclusion and size on rows."""
    k = F.col("page_id")
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", ""), F.lit("/x"), k, F.when(k % 4 == 0, ".test.js").when(k % 4 == 1, ".js").otherwise(".ts"))
    rows = read(spark, d, "pages").select(path.alias("path"), F.col("html").alias("content"))
    out = files.select_files(rows, max_depth=5, exclude=["example.com/de"], max_chars=5000)
    return out.select("path", F.length("content").cast("long").alias("n"))


@query("""SELECT r_name || '.js' AS path, 'sha256:' || sha256('let a = ' || r_regionkey || ';') AS content_hash FROM region""")
def inline_files(spark: SparkSession, d: str) -> DataFrame:
    """Files given by name and content; a handful, as a caller has them at hand."""
    given = [{"name": f"{r.r_name}.js", "content": f"let a = {r.r_regionkey};"} for r in read(spark, d, "region").collect()]
    return files.resolve_source(spark, files=given).select("path", "content_hash")


@query("""SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'high' ELSE 'medium' END AS trust, 6 AS n FROM nation WHERE n_regionkey < 3""")
def context_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents about projects: nations' readmes, change logs and designs, cut to a length; other names say nothing."""
    r = F.col("n_regionkey")
    name = F.when(r == 0, "README.md").when(r == 1, "Changelog.md").when(r == 2, "design_notes.md").when(r == 3, "notes.md").otherwise("readme.rst")
    rows = read(spark, d, "nation").select(F.concat(F.lit("p"), "n_nationkey", F.lit("/"), name).alias("path"), F.concat("n_name", F.lit(" and more")).alias("content"))
    return files.context_files(rows, max_chars=6).select(F.regexp_extract("path", r"^p(\d+)/", 1).cast("int").alias("k"), "trust", F.length("content").alias("n"))


@query("""SELECT 'user' || user_id AS file, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id ORDER BY n DESC, file LIMIT 8""")
def git_churn(spark: SparkSession, d: str) -> DataFrame:
    """Events stand for commits, users for files."""
    c = read(spark, d, "events").select(F.concat(F.lit("user"), "user_id").alias("file"), "ts", F.col("event_id").alias("hash"))
    return files.git_churn(c, F.lit("2024-02-14").cast("timestamp"), days=30)


@query("""SELECT event_id AS hash, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, hash LIMIT 10""")
def recent_commits(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "events").select(F.concat(F.lit("user"), "user_id").alias("file"), "ts", F.col("event_id").alias("hash"))
    return files.recent_commits(c, F.lit("2024-02-03").cast("timestamp"), days=14)


@query("""SELECT r_regionkey AS k, 'runtime' AS kind, 'a' || r_regionkey || ',b' AS names FROM region UNION ALL SELECT r_regionkey, 'development', 't' FROM region WHERE r_regionkey % 2 = 0""")
def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Package files of regions, beside requirement files that they go before."""
    r = read(spark, d, "region")
    dev = F.when(F.col("r_regionkey") % 2 == 0, ', "devDependencies": {"t": "1"}').otherwise("")
    a = r.select(F.concat(F.lit("p"), "r_regionkey", F.lit("/package.json")).alias("path"), F.concat(F.lit('{"dependencies": {"a'), "r_regionkey", F.lit('": "1", "b": "2"}'), dev, F.lit("}")).alias("content"))
    b = r.select(F.concat(F.lit("p"), "r_regionkey", F.lit("/requirements.txt")).alias("path"), F.lit("numpy==1\n# no\nflask").alias("content"))
    out = files.dependencies(a.unionByName(b))
    return out.select(F.regexp_extract("path", r"^p(\d+)/", 1).cast("int").alias("k"), "kind", F.array_join("names", ",").alias("names"))


@query("""SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'src/a' || s_suppkey || '.js' WHEN 1 THEN 'b.js' END AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'pk' || s_suppkey END AS package FROM supplier""")
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for solved bugs: the file that the solution names, and the package that it lies in."""
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("# Fix\n**File:** `src\\a"), k, F.lit(".js`\n"))).when(k % 3 == 1, F.lit("root cause file: `b.js` line 3")).otherwise("unknown")
    path = F.when(k % 2 == 0, F.concat(F.lit("x/packages/pk"), k, F.lit("/solution.md"))).otherwise(F.concat(F.lit("x/pk"), k, F.lit("/solution.md")))
    rows = read(spark, d, "supplier").select(path.alias("path"), text.alias("content"))
    out = files.ground_truth(rows)
    return out.select(F.regexp_extract("path", r"pk(\d+)/", 1).cast("long").alias("k"), "file", files.package_of(F.col("path")).alias("package"))


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'node' AS kind, id AS a, name AS b FROM nodes UNION ALL SELECT 'edge', source, target FROM edges UNION ALL SELECT 'hash', n_name, 'sha256:' || sha256(n_name) FROM nation")
def graph_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A graph saved and loaded."""
    hashes = read(spark, d, "nation").select(F.col("n_name").alias("path"), F.concat(F.lit("sha256:"), F.sha2("n_name", 256)).alias("content_hash"))
    root = _folder(spark, "graph")
    sinks.save_graph(standin.nodes(spark, d), standin.edges(spark, d), hashes, root)
    n, e, h = files.load_graph(spark, root)
    rows = n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))
    return rows.unionByName(h.select(F.lit("hash").alias("kind"), F.col("path").alias("a"), F.col("content_hash").alias("b")))


@query("""SELECT 'node' AS kind, 'n' || n_nationkey AS a, n_name AS b, n_nationkey::BIGINT AS line FROM nation UNION ALL SELECT 'edge', 'r' || n_regionkey, 'n' || n_nationkey, NULL FROM nation UNION ALL SELECT 'file', n_name || '.js', 'h' || n_regionkey, NULL FROM nation""")
def graph_json(spark: SparkSession, d: str) -> DataFrame:
    """A graph kept as one JSON object of nations, as a client stores it, loaded as tables."""
    n = read(spark, d, "nation")
    i, r = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    whole = n.agg(
        F.collect_list(F.struct(i.alias("id"), F.lit("file").alias("type"), F.col("n_name").alias("name"), F.array("n_nationkey", F.lit(9)).alias("lineRange"))).alias("nodes"),
        F.collect_list(F.struct(r.alias("source"), i.alias("target"), F.lit("contains").alias("type"))).alias("edges"),
        F.map_from_entries(F.collect_list(F.struct(F.concat("n_name", F.lit(".js")), F.concat(F.lit("h"), "n_regionkey")))).alias("files"),
    )
    root = _folder(spark, "json")
    whole.select(F.to_json(F.struct("nodes", "edges", "files")).alias("value")).write.text(root)
    nodes, edges, hashes = files.load_graph_json(spark, root)
    rows = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("line_start").cast("long").alias("line"))
    rows = rows.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit(None).cast("long").alias("line")))
    return rows.unionByName(hashes.select(F.lit("file").alias("kind"), F.col("path").alias("a"), F.col("content_hash").alias("b"), F.lit(None).cast("long").alias("line")))


@query("SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS region FROM nation")
def json_store(spark: SparkSession, d: str) -> DataFrame:
    """Metadata saved as JSON and loaded with a schema; what does not fit it is null."""
    n = read(spark, d, "nation")
    root = _folder(spark, "meta")
    region = F.when(F.col("n_regionkey") == 2, F.lit('"two"')).otherwise(F.col("n_regionkey").cast("string"))
    n.select(F.concat(F.lit('{"k": '), "n_nationkey", F.lit(', "name": "'), "n_name", F.lit('", "region": '), region, F.lit("}")).alias("v")).repartition(25, "v").write.option("maxRecordsPerFile", 1).text(root)
    return files.load_json(spark, root, "k int, name string, region int")


@query("SELECT vec_id, label, 1 + (vec_id % 2)::BIGINT AS times FROM embeddings WHERE vec_id % 3 <> 0")
def archive_appends(spark: SparkSession, d: str) -> DataFrame:
    """Diagnoses appended to an archive, odd ones twice; without an embedding none is kept."""
    e = read(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    root = _folder(spark, "archive")
    sinks.append_diagnosis(e, root)
    sinks.append_diagnosis(e.where("vec_id % 2 = 1"), root)
    return spark.read.parquet(root).groupBy("vec_id", "label").agg(F.count("*").alias("times"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_size > 40")
def table_saves(spark: SparkSession, d: str) -> DataFrame:
    """A table saved, saved over, and appended to."""
    p, root = read(spark, d, "part"), _folder(spark, "save")
    sinks.save_table(p, root)
    sinks.save_table(p.where("p_size <= 25"), root)
    sinks.save_table(p.where("p_size > 40"), root, mode="append")
    return spark.read.parquet(root).select("p_partkey", "p_name")


@query("SELECT '# Map' || chr(10) || 'new' || chr(10) || '## Notes' || chr(10) || 'kept by ' || count(*) || chr(10) AS content FROM nation")
def overview_notes(spark: SparkSession, d: str) -> DataFrame:
    """An overview written anew keeps the notes of the old one, read back from its file."""
    root = _folder(spark, "overview")
    read(spark, d, "nation").agg(F.concat(F.lit("# Map\nold\n## Notes\nkept by "), F.count("*")).alias("value")).coalesce(1).write.text(root)  # one row
    old = files.texts(spark, root, "*.txt").select("content")
    return sinks.with_notes(spark.range(1).select(F.lit("# Map\nnew\n## Notes\nnone").alias("content")), old)


@query(f"""WITH li AS (SELECT l_suppkey AS file, l_partkey AS var, CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS kind, l_suppkey % 7 AS origin_file FROM lineitem WHERE l_linenumber = 1)
SELECT origin_file::BIGINT AS origin_file, var AS origin_var, md5(string_agg(DISTINCT '  ' || kind || ' ' || file || ':1', chr(10) ORDER BY '  ' || kind || ' ' || file || ':1')) AS section FROM li GROUP BY ALL HAVING bool_or(file <> origin_file)""")
def cross_file_sections(spark: SparkSession, d: str) -> DataFrame:
    """First order lines stand for accesses of variables, sevenths of suppliers for their files: a section for each that others touch."""
    li = read(spark, d, "lineitem").where("l_linenumber = 1")
    chains = li.select(F.col("l_suppkey").alias("file"), F.when(F.col("l_returnflag") == "R", "write").otherwise("read").alias("kind"), F.lit(1).alias("line"), (F.col("l_suppkey") % 7).alias("origin_file"), F.col("l_partkey").alias("origin_var"))
    return sinks.cross_file_text(chains).select("origin_file", "origin_var", F.md5(F.col("section").cast("binary")).alias("section"))
