import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import queries, repetition

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, least):
    w = WORDS.findall(text)
    n = len(w)
    share = [[0] * (n + 1) for _ in range(n + 1)]
    longest = [0] * n
    for i in range(n - 1, -1, -1):
        for j in range(n - 1, i, -1):
            if w[i] == w[j]:
                share[i][j] = share[i + 1][j + 1] + 1
                longest[i], longest[j] = max(longest[i], share[i][j]), max(longest[j], share[i][j])
    cover = lambda k: len({p for i in range(n) if longest[i] >= k for p in range(i, i + longest[i])})
    later = {p for i in range(n) if any(w[j : j + least] == w[i : i + least] for j in range(i)) and i + least <= n for p in range(i, i + least)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), cover(3), cover(least), len(later), max(longest, default=0))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aab é\n\t\x1c\xa0#|", max_size=90), max_size=5))
def test_measures_of_any_texts(texts):
    assert repetition.measure(texts, 4) == [brute(t, 4) for t in texts]


def test_windows_of_three_found_twice():
    r = random.Random(1)
    for _ in range(30):
        w = r.choices("abcd", k=60)
        seen = {}
        for i in range(58):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        want = len({p for s in seen.values() if len(s) > 1 for i in s for p in range(i, i + 3)})
        assert repetition.measure([" ".join(w)], 10)[0][4] == want


def test_rules_and_odd_rows(spark):
    r = random.Random(2)
    clean = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(400))
    half = clean[:1800]
    rows = [(None,), ("",), (" \n",), (clean,), (clean + " " + half,), (clean * 2,), ("x " * 20000,), (clean,)]
    m = repetition.repetition(F.col("t"), piece=1000)
    got = spark.createDataFrame(rows, "t string").select("t", m.alias("m")).select("t", "m.*", repetition.repetition_rules(F.col("m")).alias("kept")).collect()
    assert [x.kept for x in got] == [True, True, True, True, False, False, False, True]
    assert [x.n_words for x in got][:4] == [0, 0, 0, 400] and got[6].longest_repeat == 19999
    assert spark.createDataFrame([], "t string").select(m).count() == 0


def test_the_method_rejects_what_the_base_rule_keeps(spark):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    passage, line = words(45), words(12)
    texts = {
        "four times": " ".join(words(150) + " " + passage for _ in range(4)) + " " + words(100),
        "ten times": " ".join(words(40) + " " + line for _ in range(10)),
        "one long repeat": (p := words(60)) + " " + words(900) + " " + p,
        "a line twice": words(30) + " " + line + " " + words(30) + " " + line,
        "no repeats": words(500),
    }
    df = spark.createDataFrame(list(texts.items()), "name string, t string").select("name", repetition.repetition(F.col("t")).alias("m"))
    got = {x.name: x for x in df.select("name", "m.*", repetition.repetition_rules(F.col("m")).alias("ok")).collect()}
    assert all(x.n_words >= 50 and 100 * x.n_repeat_words <= 50 * x.n_words for x in got.values())  # the base rule keeps all
    assert {n for n, x in got.items() if x.ok} == {"a line twice", "no repeats"}


def test_query_against_sql(spark, sf_dir, duck):
    got = queries.op7_repetition(spark, sf_dir).toPandas()
    want = duck.sql(queries.OP7_SQL).df()[got.columns.tolist()]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()
