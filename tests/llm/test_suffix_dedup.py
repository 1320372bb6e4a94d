import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from tessera.llm import induced, queries, suffix_dedup


def brute_suffixes(parts, cap):
    t = [x for p in parts for x in [*(c + 2 for c in p), 1]] + [0]
    order = sorted(range(len(t) - 1), key=lambda i: t[i:], reverse=True)
    shared = []
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < cap and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        shared.append(k)
    return t, order, shared


@pytest.mark.parametrize("seed", range(60))
def test_induced_order_and_common_prefixes(seed):
    r = random.Random(seed)
    parts = [bytes(r.choices(b"ab" if seed % 3 else b"abcdef\0\xff", k=r.choice([0, 1, 2, 5, 30, 80, 400]))) * r.choice([1, 1, 2, 5]) for _ in range(r.choice([1, 2, 6]))]
    parts += parts[: seed % 2]
    cap = r.choice([4, 10, 1000])
    t, order, shared = brute_suffixes(parts, cap)
    _, blocks = induced.suffixes(parts, cap, ram=r.choice([600, 2000, 1 << 20]) if len(t) < 500 else r.choice([4000, 1 << 20]))
    pos, val = (np.concatenate(x).tolist() for x in zip(*blocks, strict=True))
    assert [t[i : i + cap] for i in pos] == [t[i : i + cap] for i in order] and sorted(pos) == sorted(order)
    assert val[1:] == shared


def test_a_shard_larger_than_memory(monkeypatch):
    """Names are sorted by recursive induction, level by level, in a fraction of the shard's size."""
    r = random.Random(3)
    passage = bytes(r.choices(b"etaoin shrdlu", k=3000))
    parts = [bytes(r.choices(b"etaoin shrdlu", k=800)) + passage[i % 2000 : i % 2000 + 900] for i in range(0, 4000, 4)]
    size, ram, levels = sum(map(len, parts)), 1 << 19, []
    order = induced.order_of_names
    monkeypatch.setattr(induced, "order_of_names", lambda names, *a: levels.append(len(names)) or order(names, *a))
    tracemalloc.start()
    got = induced.repeated(parts, 400, ram)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = sum(x.nbytes for x, _ in got)
    assert len(levels) >= 4 and size > 3 * ram and peak < held + 4 * ram, (levels, size, held, peak)
    monkeypatch.setattr(induced, "order_of_names", None)  # with more memory none is needed, and the result is the same
    assert [x.tolist() for x, _ in got] == [x.tolist() for x, _ in induced.repeated(parts, 400, 1 << 28)]
    assert sum(len(x) for x, _ in got) > 200_000


def brute(texts, length):
    """Removed spans of each text: strings counted by their bytes."""
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    hit = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                hit[i].update(range(s, s + length))
    out = []
    for h in hit:
        spans = []
        for p in sorted(h):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append([tuple(s) for s in spans])
    return out


def corpus(seed):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choices("abcdefgh é\n", k=n))
    passages = [noise(r.choice([90, 130, 400])) for _ in range(4)]
    texts = [None, "", "ab", noise(99), "x" * 700, "ab" * 300, ("abcdefg " * 100)[:777]]
    for _ in range(25):
        texts.append("".join(r.choice([noise(r.randrange(200)), r.choice(passages), r.choice(passages)[5:110]]) for _ in range(r.randrange(1, 6))))
    whole = noise(900)
    texts += [whole] * 20 + [whole[:i] + "#" + whole[i + 1 :] for i in r.sample(range(900), 12)]
    return texts


def lines_again(seed, length, pairs):
    """Pairs of documents that share one string of some `length` bytes, in which a line comes again, so that a gram does."""
    r = random.Random(seed)
    noise = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    texts = []
    for _ in range(pairs):
        line, shared = noise(r.randrange(33, 60)), ""
        while len(shared) < length + r.randrange(60):
            shared += line if r.random() < 0.5 else noise(r.randrange(1, length // 4))
        texts += [noise(r.randrange(length)) + shared + noise(r.randrange(length)) for _ in range(2)]
    return texts


@pytest.mark.parametrize(("length", "window", "pairs"), [(100, 80, 400), (400, 340, 1500)])
def test_a_line_that_comes_again_in_a_shared_string(spark, length, window, pairs):
    texts = lines_again(length, length, pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in suffix_dedup.repeated_spans(df, length=length, window=window).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts], length)


def test_grams_that_stand_twice_in_a_run():
    texts = [t.encode() for t in lines_again(7, 100, 40)]
    buf, w = b"".join(texts), 80 - 32 + 1
    h = suffix_dedup.gram_hashes(buf)
    start = [sum(map(len, texts[:i])) for i in range(len(texts))]
    d, low, s, _, own, twice, *_ = suffix_dedup.contexts(texts, 100, 32, 80)
    want = [int((h[start[i] + a : start[i] + a + n - 1 + w].view("int64") == m).sum()) > 1 for i, m, a, n in zip(d, low, s, own, strict=True)]
    assert twice.tolist() == want and any(want)


@pytest.mark.parametrize(("seed", "shard"), [(1, 1 << 20), (2, 2000), (3, 300)])
def test_against_brute_force(spark, seed, shard):
    """Small shards make many minimizers overfill one, so that their strings are dealt again by longer grams."""
    texts = corpus(seed)
    rows = [(i // 2 if i % 5 else None, t, 3, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, k1 string").repartition(5)
    got = suffix_dedup.repeated_spans(df, length=100, window=80, shard_bytes=shard, ram=5000)
    assert got.columns == ["doc_id", "text", "spans_in", "k1", "spans", "passages"]
    got = got.withColumn("kept", suffix_dedup.kept_bytes(got.text, got.spans)).collect()
    data = [(t or "").encode() for t in texts]
    want = sorted((str(x[0]), t, s) for x, t, s in zip(rows, data, brute(data, 100), strict=True))
    assert sorted((str(x.doc_id), (x.text or "").encode(), [tuple(s) for s in x.spans]) for x in got) == want
    for x in got:
        t, at = (x.text or "").encode(), 0
        kept = b""
        for a, b in x.spans:
            kept, at = kept + t[at:a], b
        assert bytes(x.kept) == kept + t[at:]


def test_passages_of_over_fifty_words(spark):
    """Planted in two texts or more, too short for 400 bytes or not; at a text's start, inside and at its end; clean texts have none."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("etaoinshrdlu", k=r.randrange(4, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    passages = [words(n) for n in (52, 55, 60, 64, 80, 120)]
    texts, planted = [], []
    for p in passages:
        for a, b in ((0, 200), (100, 100), (200, 0), (3, 2)):
            texts.append(f"{words(a)} {p} {words(b)}".strip())
            planted.append(p)
    clean = [words(r.choice([20, 60, 300])) for _ in range(60)] + [f"{words(100)} {passages[5][:150]} {words(100)}"]
    texts += clean
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x for x in suffix_dedup.repeated_spans(df).collect()}
    for i, p in enumerate(planted):
        (span,) = got[i].passages
        at = texts[i].index(p)
        assert abs(span.start - at) <= 9 and abs(span.end - at - len(p)) <= 9 and bool(got[i].spans) == (len(p) + 2 >= 400), (i, len(p), span)
    assert not any(got[len(planted) + i].passages or got[len(planted) + i].spans for i in range(len(clean)))


def test_one_very_long_text(spark):
    r = random.Random(9)
    part = "".join(r.choices("abcdefgh", k=5000))
    t = "".join(r.choices("abcdefgh", k=200_000)) + part + "".join(r.choices("abcdefgh", k=100_000)) + part
    got = suffix_dedup.repeated_spans(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert [tuple(s) for s in got.spans] == [(200_000, 205_000), (305_000, 310_000)]


def test_a_text_that_repeats_throughout(spark):
    texts = ["a" * 50_000, "ab" * 20_000 + "c", "abc" * 300]
    got = suffix_dedup.repeated_spans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    data = [t.encode() for t in texts]
    assert {x.doc_id: [tuple(s) for s in x.spans] for x in got} == {0: [(0, 50_000)], 1: [(0, 40_000)], 2: [(0, 900)]}, data and None


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.repeated_spans(e).count() == 0
    with pytest.raises(ValueError, match="window"):
        suffix_dedup.repeated_spans(e, length=10, window=10)


def test_query_against_sql(spark, sf_dir, duck):
    got = queries.repeated_strings(spark, sf_dir).toPandas()
    want = duck.sql(queries.REPEATED_SQL).df()[got.columns.tolist()]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()


def test_query(spark, sf_dir):
    docs = {x.doc_id: (x.text or "").encode() for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {x.doc_id: x for x in queries.op10_suffix_dedup(spark, sf_dir).collect()}
    ids = sorted(docs)
    for i, spans in zip(ids, brute([docs[i] for i in ids], 400), strict=True):
        t, at, kept = docs[i], 0, b""
        for a, b in spans:
            kept, at = kept + t[at:a], b
        kept += t[at:]
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert any(x.n_spans for x in got.values())
