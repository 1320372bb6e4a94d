"""What a scan takes as scripts grow, and of which kinds of facts."""

import resource
import time

from tessera.plans import mixed, services
from tessera.sources import extract, javascript


def script(n):
    parts = [t.replace("{o}", str(i)) for i in range(n) for t in [mixed.FRAGMENTS[i % len(mixed.FRAGMENTS)][0]]]
    return mixed.HEAD + "".join(parts) + "".join(f"top.a{i} = {i};\n" for i in range(n))


def test_time_grows_as_the_script():
    def took(n):
        text, began = script(n), time.process_time()
        javascript.extract(text)
        return time.process_time() - began

    small = min(took(400) for _ in range(3))
    assert took(6400) < 16 * 3 * small  # sixteen times as long; it took over a hundred times as long


def test_a_source_keeps_lists_of_brackets_only():
    text = mixed.HEAD + "a + b;\n" * 500 + "if (x) { y = 1; }\n"
    s = javascript.Source.__new__(javascript.Source)
    s.module_kinds, s.module_words = {}, set()
    s.__init__(text)
    assert not hasattr(s, "toks") and len(s.around) == len(s.branch) == sum(x in javascript.STRUCTURE for x in s.texts) < 20  # a value for each of 2,000 tokens before, and an object
    y = s.texts.index("y")
    assert s.conditional(y) and not s.conditional(s.texts.index("a"))


def test_kinds_are_those_of_all():
    text = script(40)
    all_ = javascript.extract(text)
    for kinds in (extract.MAP_FACTS, services.FINDING_FACTS, services.CALL_FACTS, frozenset({"function"}), frozenset({"statement", "parse"})):
        assert javascript.extract(text, kinds) == [r for r in all_ if r[0] in kinds]


def test_a_worker_holds_few_facts(spark):
    def many(_):
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        return [("function", {"name": "f" * 100 + str(i), "line": peak, "line_end": i, "is_async": False, "owner": ""}) for i in range(20_000)]

    files = spark.createDataFrame([("src/a.js", "")], "path string, content string").selectExpr("explode(sequence(1, 60)) i", "content").selectExpr("concat('s', i, '.js') path", "content")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        rows = extract.table(extract.extract_facts(files, many), "function").groupBy().agg({"line": "max", "*": "count"}).first()
        low = extract.table(extract.extract_facts(files.limit(1), many), "function").groupBy().agg({"line": "min"}).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert rows["count(1)"] == 60 * 20_000
    assert rows["max(line)"] - low["min(line)"] < 150_000  # KB; all facts of a batch of files were held before
