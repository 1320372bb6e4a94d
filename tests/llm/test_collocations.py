import random
import re
from collections import Counter

import pytest

from tessera.llm import collocations, queries


def brute(rows, longest=3, least=10, share=50, top=2000):
    """rows of (text, lang)."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            c = f.setdefault(lang, Counter())
            for k in range(1, longest + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(100 * b >= share * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, cut = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["the", "The", "OF", "é", "漢字", "a\xa0b", "x", "y", "z", "new", "york", "city", "\x1c", "#", "\0"]
    out = []
    for _ in range(n):
        t = "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", "  ", ".", ", ", "\n", "; ", "!", "\r\n"]) for _ in range(r.choice([0, 3, 60])))
        out.append((t + "New York City " * r.choice([0, 0, 1]), r.choice(["de", "en", "", None, "und"])))
    return [*out, (None, "de"), ("", None), ("new york city " * 200, "en"), ("x " * 3000, "fr"), ("rare words here", "it")]


@pytest.mark.parametrize(("bits", "longest", "top"), [(8, 3, 2000), (20, 3, 5), (14, 4, 7), (18, 2, 2000)])
def test_against_brute_force(spark, bits, longest, top):
    """Few buckets let more phrases through to exact counting, and no other through to the result."""
    rows = texts(bits)
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = collocations.collocations(df, bits=bits, longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, longest, top=top)


def test_rare_phrases_are_not_counted_exactly(spark):
    rows = [(f"the word{i} of thing{i} the end", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    two = collocations.frequent_phrases(df, bits=20)[2]
    assert sorted((x.phrase, x.f) for x in two.collect()) == [("the end", 300)]
    w = collocations.Words(collocations.pa.array([t for t, _ in rows]), collocations.pa.array([x for _, x in rows]))
    assert len(w.follows) == 1800 and len(collocations.starts(w, 2)) == 1500 and len(collocations.starts(w, 6)) == 300


def test_no_rows_and_no_words(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(df, bits=14).count() == 0
    assert collocations.collocations(spark.createDataFrame([(" . ", "en"), (None, None)], "text string, lang string"), bits=14).count() == 0
    with pytest.raises(ValueError, match="least"):
        collocations.collocations(df, least=300)


def test_counts_beyond_64_bits(spark):
    """The score's products need more than 64 bits where counts pass some two million."""
    d = spark.createDataFrame([(3_000_000_000, 3_000_000_001, 3_000_000_007)], "a long, l long, r long")
    wide = lambda c: c.cast("decimal(38,0)")
    got = d.select(collocations.F.call_function("div", wide(collocations.F.lit(1_000_000)) * wide(d.a) * wide(d.a), wide(d.l) * wide(d.r))).first()[0]
    assert got == 1_000_000 * 3_000_000_000**2 // (3_000_000_001 * 3_000_000_007)


def test_query_against_sql(spark, duck):
    """The smallest tables hardly have a phrase ten times; these do."""
    path = "/root/testdata/sf0.01"
    duck.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    got = queries.op12_collocations(spark, path).toPandas()
    want = duck.sql(queries.OP12_SQL).df()[got.columns.tolist()]
    key = ["lang", "rank"]
    assert len(got) > 100 and got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


def test_query_against_brute_force(spark, sf_dir):
    docs = [(x.text, x.lang) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(x) for x in queries.op12_collocations(spark, sf_dir).collect()) == brute(docs)
