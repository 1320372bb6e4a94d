"""Claims that name no file, and words that very many texts or literals have, do not meet in one task."""

import re

from tessera.operators import literals
from tessera.plans import services


def test_frequent_words_find_what_stands_there(spark):
    texts = [(f"t{i}", f"the one {'rare' + str(i % 9)} word of many words {i % 4}") for i in range(40)] + [("none", None), ("blank", "  ")]
    lits = ["the one rare3 word", "one rare1 word of many", "of many words 2", "the absent one word", "many words", "rare5", "ord", "s 1", "one two three four", " "]
    want = sorted((k, x) for k, t in texts if t for x in lits if x in t)
    t, x = spark.createDataFrame(texts, "key string, content string").where("content is not null"), spark.createDataFrame([(y,) for y in lits], "lit string")
    for often in (1, 3, 10, 1000):
        assert sorted(map(tuple, literals.hits_by_words(t, x, often).collect())) == want, often


def test_frequent_words_are_dealt_out(spark):
    words = spark.range(1000).selectExpr("concat('t', id) key", "explode(array('hot', 'cold')) word")
    counts = words.groupBy("word").count().withColumnRenamed("count", "n")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(was, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        got = literals._meet(words, counts, spark.createDataFrame([("a hot b", "hot")], "lit string, word string"), 50)
        sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1000 and max(sizes) < 500  # one task had all


def test_claims_without_a_file_are_dealt_by_their_ids(spark):
    fields = "claim_id long, root_cause string, hypotheses array<string>, evidence array<string>, location_file string, location_line int, confidence double"
    rows = [(i, "wrong somewhere", ["h"], [], ("" if i % 3 else None), 1, 0.9) for i in range(50)] + [(99, "src/a.js:1", ["h"], [], "a.js", 1, 0.9)]
    files = spark.createDataFrame([("src/a.js", "let a;\n")], "path string, content string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = services.check_claims(spark.createDataFrame(rows, fields), files)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        got = {r.claim_id: r.status for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {**{i: "PROTOCOL_VIOLATION" for i in range(50)}, 99: "PASSED"}
    keys = re.findall(r"SortMergeJoin \[([^\]]*)\], .*LeftOuter", plan)
    assert sum("__name" in k for k in keys) == 2 and not any(k.startswith(("root_file", "location_file")) for k in keys)
