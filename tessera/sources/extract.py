"""Fact tables of sources: one Arrow pass over the files, then a table for each kind of fact."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import extension, lit_array, slashes, stem
from tessera.operators.tables import workers
from tessera.sources import javascript

#: Fields of each kind of fact, beside file.
FACTS = {
    "function": "name string, line int, line_end int, is_async boolean, owner string",
    "class": "name string, line int, line_end int",
    "import": "local_name string, original_name string, source string, line int",
    "import_source": "source string",
    "export": "name string, line int, is_default boolean",
    "call": "callee string, receiver string, line int, fn string, is_awaited boolean, statement boolean",
    "access": "var string, kind string, fn string, line int, write_type string, conditional boolean, computed boolean",
    "use": "scope_id int, fn string, name string",
    "scope": "scope_id int, parent_id int, fn string",
    "binding": "scope_id int, name string, kind string, line int",
    "module_let": "var string, line int",
    "timing": "api string, callback string, line int, fn string, is_awaited boolean",
    "listener": "added boolean, event string, handler string, line int, capture boolean, passive boolean, has_options boolean",
    "callback": "method string, is_async boolean, fn string, line int",
    "loop": "line int, collection string, callback string",
    "hook": "hook string, line int, n_args int, has_timing boolean, has_await boolean, has_cleanup boolean, deps array<string>",
    "declarator": "name string, unstable boolean",
    "state_var": "var string",
    "comparison": "fn string, line int, op string",
    "new_expr": "instance string, `class` string, arg string, arg_idx int, line int",
    "call_expr": "local_var string, callee string, line int",
    "class_capture": "`class` string, field string, param_idx int, param string",
    "statement": "block_id string, stmt_idx int, write_subject string, write_kind string, line int, await_line int",
    "parse": "n_tokens int, errors int",
}
# Arrow's and Python's types for the types of fields.
TYPES = {"string": (pa.string(), str), "int": (pa.int32(), int), "boolean": (pa.bool_(), bool), "array<string>": (pa.list_(pa.string()), list)}


def _columns() -> tuple[dict[str, dict[str, str]], dict[str, str]]:
    """The column that each field of each kind lies in, and the columns' types: a kind's first string in string0, and so on, so that all kinds share few columns."""
    places, types = {}, {}
    for fact, fields in FACTS.items():
        places[fact], n = {}, dict.fromkeys(TYPES, 0)
        for name, kind in (x.replace("`", "").split(" ") for x in fields.split(", ")):
            column = f"{kind.split('<')[0]}{n[kind]}"
            n[kind] += 1
            places[fact][name], types[column] = column, kind
    return places, dict(sorted(types.items()))


PLACES, COLUMNS = _columns()
# The kinds of facts that a map is built of.
MAP_FACTS = frozenset({"function", "class", "import", "import_source", "call"})
#: Facts that a worker holds before it passes them on: beyond this only the file at hand.
MOST_FACTS = 20_000
#: Bytes of texts that a worker is given at once.
ARROW_BYTES = 8 << 20
SCRIPT_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs"]


def extract_facts(files: DataFrame, extractor: Callable[[str], list[tuple[str, dict]]] | None = None, kinds: frozenset[str] | None = None) -> DataFrame:
    """(file, fact, ..., fields, error) of files (path, content), for table(): fields lie in columns of their types, which kinds share, or as JSON in
    `fields` if the kind is none of FACTS. With kinds only these kinds of facts are looked for.

    The extractor is a plain function of a source and can be replaced; what is not of its field's type is null. A file it fails on gives one row
    with the error, so no file stops a job; files that are no scripts give none. A fact that a file states twice is
    one row, but for hooks, of which each is its own; a path is one file, so tables need no shuffle to be distinct.
    """

    most, places, columns, types = MOST_FACTS, PLACES, COLUMNS, TYPES
    extractor = extractor or (lambda code: javascript.extract(code, kinds))
    said = {fact: {c: k for k, c in by.items()} for fact, by in places.items()}

    def array(values: list, kind: str) -> pa.Array:
        arrow, python = types[kind]

        def fitting(x):
            if type(x) is not python or python is int and abs(x) >= 1 << 31 or python is list and not all(type(y) is str for y in x):
                return None
            return x.encode("utf-8", "replace").decode() if python is str else x

        try:
            return pa.array(values, arrow)
        except (pa.ArrowException, TypeError, ValueError, OverflowError):
            return pa.array([fitting(x) for x in values], arrow)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        by: dict[str | None, list[tuple]] = {}
        for r in rows:
            by.setdefault(r[1], []).append(r)
        cols = {"file": pa.array([r[0] for g in by.values() for r in g], pa.string()), "fact": pa.array([f for f, g in by.items() for _ in g], pa.string())}
        for c, kind in columns.items():
            parts = [(said.get(f, {}).get(c), g) for f, g in by.items()]
            cols[c] = pa.concat_arrays([array([r[2].get(k) for r in g], kind) if k else pa.nulls(len(g), types[kind][0]) for k, g in parts])
        cols["fields"] = pa.array([None if f is None or f in places else json.dumps(r[2]) for f, g in by.items() for r in g], pa.string())
        cols["error"] = pa.array([r[3] for g in by.values() for r in g], pa.string())
        return pa.RecordBatch.from_pydict(cols)

    def distinct(facts: list[tuple]) -> list[tuple]:
        try:
            return list({(x[1], *x[2], *x[2].values()) if x[1] in places else (x[1], json.dumps(x[2])): x for x in facts}.values())
        except TypeError:  # there are lists in fields that have none
            return list({(x[1], json.dumps(x[2])): x for x in facts}.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                path, content = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                try:
                    facts = [(path, fact, f, None) for fact, f in extractor(content or "") if kinds is None or fact in kinds]
                    once = distinct([x for x in facts if x[1] != "hook"])
                    out += [x for x in facts if x[1] == "hook"] + once
                except Exception as e:  # the row keeps it
                    out.append((path, None, {}, f"{type(e).__name__}: {e}"[:300]))
                for a in range(0, len(out), most) if len(out) >= most else ():
                    yield batch(out[a : a + most])
                out = out if len(out) < most else []
        if out:
            yield batch(out)

    scripts = files.where(extension(F.col("path")).isin(*SCRIPT_EXTENSIONS)).select("path", "content")
    # scanning a text takes far longer than moving it, so few or uneven splits are dealt out to all workers first
    spark = files.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)  # texts can be long
    return scripts.repartition(workers(spark), "path").mapInArrow(run, ", ".join(["file string", "fact string", *[f"{c} {k}" for c, k in columns.items()], "fields string", "error string"]))


def table(facts: DataFrame, fact: str) -> DataFrame:
    """The rows of one kind of fact, with their fields as columns."""
    return facts.where(F.col("fact") == fact).select("file", *[F.col(c).alias(k) for k, c in PLACES[fact].items()])


# The regular-expression bridge: names only, native.

# The forms in which a module is named.
IMPORTS = [r"""\bimport\s+(?:[^'"]+?\s+from\s+)?['"]([^'"]+)['"]""", r"""\bexport\s+(?:\*|\{[^}]*\})\s+from\s+['"]([^'"]+)['"]""", r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)""", r"""\bimport\s*\(\s*['"]([^'"]+)['"]\s*\)"""]


def import_sources(code: Column) -> Column:
    """Distinct module names in the four forms in which they are written."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(code, F.lit(p), 1) for p in IMPORTS]))


def without_comments(code: Column) -> Column:
    """Without comments but with the line breaks of block comments. Slashes in strings count as comments here; the scanner knows better."""
    blocks = F.split(code, r"/\*")
    kept = F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), lambda b: F.when(F.contains(b, F.lit("*/")), F.concat(F.regexp_replace(F.substring_index(b, "*/", 1), r"[^\n]", ""), F.substring(b, F.length(F.substring_index(b, "*/", 1)) + 3, F.length(b)))).otherwise(F.regexp_replace(b, r"[^\n]", "")))
    return F.regexp_replace(F.concat(blocks[0], F.array_join(kept, "")), r"//[^\n]*", "")


def exported_names(code: Column) -> Column:
    named = F.regexp_extract_all(code, F.lit(r"\bexport\s+(?:const|let|var|function|class)\s+(\w+)"), 1)
    clauses = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(r"\bexport\s+\{([^}]+)\}"), 1), lambda c: F.split(c, ",")))
    alias = F.transform(clauses, lambda s: F.trim(F.element_at(F.split(F.trim(s), r"\s+as\s+"), -1)))
    return F.array_distinct(F.concat(named, F.filter(alias, lambda n: n != "")))


def class_names(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(without_comments(code), F.lit(r"\bclass\s+(\w+)"), 1))


def doc_summary(content: Column, longest: int = 150) -> Column:
    """The first documentation comment of over ten characters before a declaration, without its tags."""
    docs = F.regexp_extract_all(content, F.lit(r"(?s)/\*\*(.*?)\*/\s*(?:export|function|class|const|async|import)"), 1)
    text = lambda d: F.array_join(F.filter(F.transform(F.split(d, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*?\s?", ""))), lambda x: (x != "") & ~x.startswith("@")), " ")
    lines = F.regexp_extract_all(content, F.lit(r"(?m)^//\s*(.+)\n(?:export|function|class|const|async)"), 1)
    return F.left(F.get(F.filter(F.concat(F.transform(docs, text), lines), lambda x: F.length(x) > 10), F.lit(0)), F.lit(longest))


# What function names, paths and imports say about a file, in order.
NAME_TAGS = [
    ("request-handler", r"(?i)handler|route|middleware|listen|serve"), ("embeddings", r"(?i)embed|semantic|vector|cosine|similarity"), ("knowledge-graph", r"(?i)graph|node|edge|builder|kg|knowledg"),
    ("orchestration", r"(?i)orchestrat|pipeline|phase|verif"), ("search", r"(?i)search|query|match|rank|score"), ("storage", r"(?i)save|load|persist|store|read|write|cache"),
    ("memory", r"(?i)codex|archive|memory|recall"), ("formatting", r"(?i)format|render|display|output|report"),
]
IMPORT_TAGS = [("http-server", r"express|fastify|koa|hono|http"), ("ui-framework", r"react|preact|vue|svelte")]


def node_metadata(files: DataFrame) -> DataFrame:
    """files (path, content or doc, fn_names, n_async, sources, degree, n_lines) with tags, complexity and summary."""
    any_name = lambda p: F.exists("fn_names", lambda n: n.rlike(p))
    tags = [F.when(any_name(r"(?i)\bmain\b") | F.col("path").rlike(r"/index\.|/cli\."), "entry-point")]
    tags += [F.when(any_name(p), t) for t, p in NAME_TAGS] + [F.when(F.exists("sources", lambda s: F.lower(s).rlike(p)), t) for t, p in IMPORT_TAGS]
    tags += [F.when(F.col("degree") >= 10, "hub").when(F.col("degree") >= 5, "connector"), F.replace(F.regexp_replace(slashes(F.col("path")), r"\.[^.]+$", ""), F.lit("/"), F.lit("-"))]
    n = F.size("fn_names")
    level = F.when((n > 20) | (F.col("n_lines") > 500) | (F.col("n_async") > 6), "high").when((n > 8) | (F.col("n_lines") > 200) | (F.col("n_async") > 2), "moderate").otherwise("low")
    role = F.when(n > 0, F.concat(n.cast("string"), F.lit(" functions: "), F.array_join(F.slice("fn_names", 1, 5), ", "), F.when(n > 5, "...").otherwise(""), F.lit("."))).otherwise(F.concat(stem(F.col("path")), F.lit(" -> "), F.when(F.size("sources") > 0, F.concat(F.lit("imports: "), F.array_join(F.slice("sources", 1, 3), ", "))).otherwise("no functions detected"), F.lit(".")))
    doc = F.col("doc") if "doc" in files.columns else doc_summary(F.col("content"))
    return files.withColumn("tags", F.array_compact(F.array(*tags))).withColumn("complexity", level).withColumn("summary", F.left(F.when(doc.isNotNull(), F.concat(doc, F.lit(" - "), role)).otherwise(role), F.lit(200)))


def scripts_of_pages(pages: DataFrame) -> DataFrame:
    """(path, content): inline scripts of pages (page_id, html), each a file."""
    s = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1)).alias("i", "content"))
    return s.select(F.concat(F.lit("page"), "page_id", F.lit("-"), "i", F.lit(".js")).alias("path"), "content")


def known_extensions() -> Column:
    return lit_array(SCRIPT_EXTENSIONS)
