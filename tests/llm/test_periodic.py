import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import periodic, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    """Runs by definition: for each period, maximal stretches of words that are equal a period apart; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def runs(texts, least):
    out = periodic.analyse(periodic.pa.array(texts, periodic.pa.string()), least)
    return [(x["n_words"], [(r["start"], r["length"], r["period"]) for r in x["runs"]], x["collapsed"]) for x in out.to_pylist()]


def want(texts, least):
    out = []
    for t in texts:
        w = WORDS.findall(t or "")
        r = brute(w, least)
        out.append((len(w), r, collapsed(w, r)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aab é\n\t\x1c\xa0", max_size=200), max_size=5), st.sampled_from([2, 3, 4, 12]))
def test_runs_of_any_texts(texts, least):
    assert runs(texts, least) == want(texts, least)


@pytest.mark.parametrize("least", [2, 12])
def test_runs_in_repetitive_texts(least):
    r = random.Random(4)
    texts = []
    for _ in range(300):
        t = []
        while len(t) < r.choice([10, 80, 400]):
            unit = r.choices("abcdefg"[: r.choice([1, 2, 3, 7])], k=r.randrange(1, 40))
            t += (unit * r.randrange(1, 6))[: r.randrange(1, 150)]
        texts.append(" ".join(t))
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    texts += [" ".join(fib[-1]), " ".join("a" * 1000), " ".join("abc" * 300 + "d" + "abc" * 300)]
    assert runs(texts, least) == want(texts, least)


def test_every_word_of_a_run_is_in_a_repeated_gram():
    r = random.Random(5)
    w = np.array(r.choices(range(3), k=3000))
    mask = periodic.in_repeated_grams(w, np.array([0, 1000, 1000, 3000]), 6)
    for a, b in ((0, 1000), (1000, 3000)):
        for s, n, _ in brute(w[a:b].tolist()):
            assert mask[a + s : a + s + n].all()


def test_odd_rows_and_extra_columns(spark):
    r = random.Random(6)
    noise = [" ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(300)) for _ in range(20)]
    texts = [None, "", " \n", "x " * 60_000, "a b c d e f g " * 3, "same", "same", *noise, *[f"{n} {n[:100]} {n[:100]} {n[:100]}" for n in noise]]
    df = spark.createDataFrame([(t, "x", 1) for t in texts], "t string, runs string, n_words int").repartition(4)
    got = df.select("t", periodic.periodic_runs(F.col("t"), piece=5000).alias("m")).collect()
    assert sorted((x.t is not None, x.t or "", x.m.n_words, [tuple(y) for y in x.m.runs], x.m.collapsed) for x in got) == sorted((t is not None, t or "", *y) for t, y in zip(texts, [want([t], 12)[0] if t != texts[3] else (60_000, [(0, 60_000, 1)], "x") for t in texts], strict=True))
    assert df.limit(0).select(periodic.periodic_runs(F.col("t"))).count() == 0


def planted(doc_id, text):
    """The words of the contract: of every tenth id, by its checksum, the end of the text is made periodic."""
    w = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query(spark, sf_dir):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_periodic_runs(spark, sf_dir).collect()
    assert rows[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert len(rows) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for x in rows:
        w = planted(x.doc_id, docs[x.doc_id])
        r = brute(w)
        best = min(r, key=lambda y: (-y[1], y[0], y[2])) if r else (None, None, None)
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == (len(r), *best, 1000 * best[1] // best[2] if r else None), x.doc_id
        assert x.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in r)) and x.collapsed_sha256 == sha(collapsed(w, r))
    assert sum(x.n_runs > 0 for x in rows) > 10


def test_odd_ids_of_the_query(spark, tmp_path):
    rows = [(None, "a b c d"), (1, None), (2, ""), (17, "x y z " * 40), (17, "x y z " * 40), *((i, f"w{i} " * (i % 9) + "a b c d e f g h i j k l m n o p") for i in range(100, 160))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((str(x.doc_id), x.n_runs, x.collapsed_sha256) for x in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    each = [(i, planted("" if i is None else i, t)) for i, t in rows]
    assert got == sorted((str(i), len(brute(w)), sha(collapsed(w, brute(w)))) for i, w in each)
