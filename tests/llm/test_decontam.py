import random
import re

import pytest

from tessera.llm import decontam, queries

PART = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return PART.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, size):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        b = words(t)
        for win in [b[k : k + size] for k in range(len(b) - size + 1)] or ([b] if b else []):
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    ids.add(i or "")
    return len(w), len(hit), sorted(ids)


@pytest.fixture(scope="module")
def case():
    r = random.Random(3)
    vocab = ["a", "b", "C", "dd", "É", "x1", "ß"]
    items = [(str(i), " ".join(r.choices(vocab, k=r.choice([2, 3, 4, 6, 9])))) for i in range(25)] + [("3", "other, text here now"), (None, "zz yy"), ("40", None), ("41", "!!")]
    docs = [(i, "".join(w + r.choice([" ", ", ", "\n", "--"]) for w in r.choices(vocab, k=r.choice([0, 1, 5, 60])))) for i in range(60)]
    docs += [(None, items[0][1].upper()), (7, None), (8, ""), (8, "Zz  yY! other text here now"), (8, "Zz  yY! other text here now"), (9, "q " * 50000 + items[1][1])]
    return docs, items


@pytest.mark.parametrize("way", [1 << 20, 0])
def test_against_brute_force(spark, case, way):
    docs, items = case
    d = spark.createDataFrame([(i, t, "e", 1, "w", 5) for i, t in docs], "doc_id long, text string, item_id string, contamination int, w string, row int").repartition(5)
    got = decontam.contamination(d, spark.createDataFrame(items, "item_id string, text string"), size=4, max_broadcast=way).collect()
    order = lambda x: (str(x[0]), x[1] or "", x[2])
    assert sorted(((x.doc_id, x.text, tuple(x.contamination)) for x in got), key=order) == sorted(((i, t, brute(t, items, 4)) for i, t in docs), key=order)
    assert got[0].item_id == "e" and got[0].contamination_in == 1


@pytest.mark.parametrize("way", [1 << 20, 0])
def test_empty_tables(spark, case, way):
    docs, items = case
    d, b = (spark.createDataFrame(x, s) for x, s in ((docs, "doc_id long, text string"), (items, "item_id string, text string")))
    assert decontam.contamination(d.limit(0), b, max_broadcast=way).count() == 0
    assert {x.contamination.n_hit for x in decontam.contamination(d, b.limit(0), max_broadcast=way).collect()} == {0}


def test_query_against_sql(spark, sf_dir, duck):
    got = queries.op8_decontamination(spark, sf_dir).toPandas()
    want = duck.sql(queries.OP8_SQL).df()[got.columns.tolist()]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()
    assert got.contaminated.sum() > 0
