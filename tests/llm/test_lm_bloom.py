import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, lm_bloom, queries


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [x for x in low.split(" ") if x] + [None]


def base(rows, held):
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return n, {(i, t): (len(words(t)), sum(c[w] > 0 for w in words(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 1) | st.integers(0, 300), st.integers(1, 10**7) | st.integers(1, 3), max_size=40))
def test_packing(counts):
    h = np.array(sorted(counts), np.uint64)
    c = np.array([counts[int(x)] for x in h], np.int64)
    a, b = lm_bloom.unpack(lm_bloom.pack(h, c))
    assert a.tolist() == h.tolist() and b.tolist() == c.tolist()


def test_levels():
    c = np.array([1, 2, 3, 4, 5, 6, 100, 10**7])
    q = lm_bloom.level_of(c)
    assert q[:6].tolist() == [1, 2, 3, 4, 4, 5] and (np.diff(q) >= 0).all()
    w = lm_bloom.WORTH[q]
    assert (abs(w - c) <= 0.35 * c).all() and w[:3].tolist() == [1, 2, 3]


def docs(n=300, seed=1):
    r = random.Random(seed)
    vocab = ["w" + str(i) for i in range(400)]
    out = []
    for i in range(n):
        w, k = ["start"], r.choice([0, 3, 40, 200])
        for _ in range(k):
            w.append(vocab[(hash(w[-1]) if r.random() < 0 else zlib.crc32(w[-1].encode()) + r.choice([0, 0, 0, r.randrange(400)])) % 400])
        out.append((i, " ".join(w)))
    return out


def test_base_and_model(spark):
    rows = docs() + [(None, "Start W1"), (1000, None), (1001, ""), (1002, " \n"), (1003, "never seen words"), (1003, "never seen words"), (1004, "W1\tw2 " * 20000)]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, n_tokens string").repartition(6)
    df = df.withColumn("held_out", queries.held_out("doc_id", 7, 2))
    m, exact = lm_bloom.train(df.where("not held_out"), frequent=50, flush=5000, slice_bytes=1000, fan_out=8)
    got = lm_bloom.score(df, m, exact, keep=("held_out", "text")).collect()
    n, want = base(rows, held)
    assert len(got) == len(rows)
    for x in got:
        w = want[x.doc_id, x.text]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (w[0], w[1], n, held(x.doc_id))
        assert math.isclose(x.base_score, w[2], rel_tol=1e-9) and x.score < 0
    assert lm_bloom.score(df, m, exact, keep=("score", "n_tokens")).columns[:3] == ["doc_id", "score_in", "n_tokens_in"]
    out = [x for x in got if x.held_out and x.n_known == x.n_tokens > 50]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)


def test_filter_finds_the_quantised_counts(spark):
    rows = docs(200)
    m, _ = lm_bloom.train(spark.createDataFrame(rows, "doc_id long, text string"), bits_per_item=24)
    c1, c2 = Counter(), Counter()
    for _, t in rows:
        h, n = lm_bloom.tokens([t.encode()])
        c1.update(h.tolist())
        c2.update(lm_bloom.pairs(h, n).tolist())
    for kind, c, least in ((0, c1, 1), (1, c2, 2)):
        key = np.array(sorted(c), np.uint64)
        n = np.array([c[int(k)] for k in key])
        want = np.where(n >= least, lm_bloom.level_of(n), 0)
        got = m.filter.levels(key, kind)
        assert (got >= want).all() and (got != want).mean() < 0.02  # a false positive can only raise a level
    assert (m.filter.levels(np.arange(10**6, 10**6 + 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0) > 0).mean() < 0.01


def test_a_full_filter_holds_the_frequent(spark):
    m, _ = lm_bloom.train(spark.createDataFrame(docs(200), "doc_id long, text string"), max_bits=1 << 14)
    assert m.filter.bits.nbytes <= 1 << 11
    h, n = lm_bloom.tokens([b"start"])
    assert np.isfinite(m.log_probs(h, n)).all() and m.filter.levels(h, 0)[0] > 5


def test_probabilities_of_a_context_sum_to_one_at_most(spark):
    rows = docs(300)
    m, _ = lm_bloom.train(spark.createDataFrame(rows, "doc_id long, text string"), bits_per_item=30)
    vocab = sorted({w for _, t in rows for w in words(t)[:-1]})
    for before in ("start", vocab[3]):
        h, n = lm_bloom.tokens([f"{before} {w}".encode() for w in vocab])
        p = 10 ** m.log_probs(h, n)
        assert 0.3 < p[1::3].sum() < 1.1  # counts are quantised, pairs seen once are not held


def test_query(spark, sf_dir):
    got = queries.op9_language_model(spark, sf_dir).toPandas().set_index("doc_id")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    n, want = base(rows, held)
    for i, t in rows:
        x, w = got.loc[i], want[i, t]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (w[0], w[1], n, held(i)) and math.isclose(x.base_score, w[2], rel_tol=1e-9)
    assert got.score.sum() > got.base_score.sum()


def test_nothing_to_learn(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    m, exact = lm_bloom.train(e)
    assert lm_bloom.score(e, m, exact).count() == 0
    got = lm_bloom.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), m, exact).first()
    assert (got.n_tokens, got.n_known, got.base_score) == (3, 0, 0.0) and math.isfinite(got.score)


def test_scores_do_not_depend_on_the_room_of_the_filter(spark):
    df = spark.createDataFrame(docs(200), "doc_id long, text string").repartition(3)
    got = []
    for bits in (1 << 14, 1 << 28):
        m, exact = lm_bloom.train(df, max_bits=bits, bits_per_item=30, slice_bytes=1000)
        assert bits > 1 << 14 or min(m.least) > 2  # levels of both kinds have no room
        m.weight = 10.0
        got.append({x.doc_id: x.score for x in lm_bloom.score(df, m, exact, flush=3000, fan_out=8).collect()})
    assert len(got[0]) == 200 and all(math.isclose(x, got[1][i], rel_tol=1e-9) for i, x in got[0].items())


def exact_scores(rows, m):
    """Scores from quantised exact counts of all rows."""
    hashed = [(i, *lm_bloom.tokens([(t or "").encode()])) for i, t in rows]
    c1, c2 = Counter(x for _, h, _ in hashed for x in h.tolist()), Counter(x for _, h, n in hashed for x in lm_bloom.pairs(h, n).tolist())
    worth = lambda c, keys: np.array([lm_bloom.WORTH[lm_bloom.level_of(np.array([c[k]]))[0]] if c[k] else 0.0 for k in keys.tolist()])
    out = {}
    for i, h, n in hashed:
        own = worth(c1, h)
        out[i] = m.terms(own, np.append(m.n_texts, own[:-1]), worth(c2, lm_bloom.pairs(h, n)), m.weight).sum()
    return out


def test_pairs_seen_once_count(spark):
    rows = docs(200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m, exact = lm_bloom.train(df, bits_per_item=30)
    m.weight = 10.0
    want = exact_scores(rows, m)
    assert all(math.isclose(x.score, want[x.doc_id], rel_tol=1e-9) for x in lm_bloom.score(df, m, exact).collect())
    seen = spark.createDataFrame([(0, "zz1 zz2 zz1 zz3 zz4 zz5")], df.schema)
    m, exact = lm_bloom.train(df.union(seen), bits_per_item=30)
    m.weight = 10.0
    a, b = (lm_bloom.score(spark.createDataFrame([(0, t)], df.schema), m, exact).first().score for t in ("zz4 zz5", "zz5 zz4"))
    assert a > b + 0.5  # the same words


def test_the_weight_matches_the_mass_of_new_pairs(spark):
    rows = docs(200)
    copied = " ".join(f"c{k}" for k in range(50))
    fit = lambda x: lm_bloom.train(spark.createDataFrame(x, "doc_id long, text string").repartition(3))[0]
    m = fit(rows)
    hashed = [lm_bloom.tokens([t.encode()]) for _, t in rows]
    c1, c2 = Counter(x for h, _ in hashed for x in h.tolist()), Counter(x for h, n in hashed for x in lm_bloom.pairs(h, n).tolist())
    single = sum(len(t) + 1 for _, t in rows if sum(t == u for _, u in rows) == 1) / sum(len(t) + 1 for _, t in rows)
    share = sum(c == 1 for c in c2.values()) / (sum(c1.values()) * single)
    c = lm_bloom.WORTH[lm_bloom.level_of(np.array(list(c1.values())))]
    assert math.isclose((c * m.weight / (c + m.weight)).sum() / c.sum(), share, rel_tol=1e-6)
    many = fit(rows + [(1000 + k, copied) for k in range(300)])  # copies of one text say little of new pairs
    assert 0.3 < many.weight / m.weight < 3


def test_a_fitted_weight_does_better_than_far_ones(spark):
    df = spark.createDataFrame(docs(400, seed=4), "doc_id long, text string")
    m, exact = lm_bloom.train(df.where("doc_id < 300"), bits_per_item=30)
    fitted, likely = m.weight, []
    for w in (fitted, fitted * 100, fitted / 1000):
        m.weight = w
        likely.append(lm_bloom.score(df.where("doc_id >= 300"), m, exact).agg({"score": "sum"}).first()[0])
    assert likely[0] > max(likely[1:])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**31), 2**31 - 1), st.integers(0, 3000), st.integers(0, 10**9)), max_size=40))
def test_packed_codes_and_counts(rows):
    codes = np.array(rows, np.int64).reshape(-1, 3).T
    got = lm_bloom.unpack_codes(lm_bloom.pack_codes(codes.copy()), 3)
    assert sorted(got.T.tolist()) == sorted(codes.T.tolist()) and got[0].tolist() == sorted(codes[0].tolist())
    assert lm_bloom.unpack_counts(lm_bloom.pack_counts(codes[2])).tolist() == codes[2].tolist()


def test_no_token_counts_in_the_workers(spark):
    rows = docs(200, seed=2) + [(500, "often " * 1000 + "once"), (501, "new new often"), (502, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    m, exact = lm_bloom.train(df.where("doc_id <> 501"), frequent=0, flush=3000, slice_bytes=1000)
    assert not len(m.frequent[0])
    n, want = base(rows, lambda i: i == 501)
    got = lm_bloom.score(df, m, exact, keep=("text",), flush=2000, fan_out=8).collect()
    assert len(got) == len(rows)
    for x in got:
        w = want[x.doc_id, x.text]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (w[0], w[1], n) and math.isclose(x.base_score, w[2], rel_tol=1e-9)


def put_on_disk(spark, since):
    """Bytes that the session has shuffled and those of the tables written after a mark."""
    sc = spark._jsc.sc()
    sc.listenerBus().waitUntilEmpty(10000)
    files = [f for p in common._SCRATCH[since:] for f in Path(p.removeprefix("file:")).glob("*.parquet")]
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite() + sum(f.stat().st_size for f in files)


def test_disk_of_a_run(spark):
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(5000)]
    df = spark.createDataFrame([(i, " ".join(r.choices(vocab, k=400))) for i in range(500)], "doc_id long, text string").repartition(2).cache()
    assert df.count() == 500
    since = common.written()
    began = put_on_disk(spark, since)
    m, exact = lm_bloom.train(df, frequent=100)
    lm_bloom.score(df, m, exact).write.format("noop").mode("overwrite").save()
    assert common.written() > since
    assert put_on_disk(spark, since) - began < 32 * 200_500  # tokens; 41 bytes each before rare tokens and waiting codes went by what is asked
