import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import components, queries, simhash

SCHEMA = "doc_id long, text string, lang string, fp long, component_id string"


def brute_print(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, d=3):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= d:
                label[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ \n\t\x0b\xa0\x85.", max_size=80))
def test_simhash_of_any_text(t):
    assert simhash.simhash(t.encode()) == brute_print(t)


def test_blocks_meet():
    r = random.Random(1)
    masks = simhash.block_masks(3, 5)
    assert len(masks) == 10
    for _ in range(500):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 3):
            y ^= 1 << b
        met = [m for m in masks if x & m == y & m]
        assert met
        assert any(x & f == y & f for f in simhash.finer(met[0], 3))


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abcde", k=4)) for _ in range(300)]
    rows, base = [], [" ".join(r.choices(words, k=r.choice([40, 400]))) for _ in range(12)]
    for i in range(150):
        w = r.choice(base).split(" ")
        if i % 3:
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((1000 - i, " ".join(w), "en", 7, "x"))
    rows += [(5000, None, None, None, None), (5001, "", "", 0, ""), (5002, " \n", "", 0, ""), (None, base[0], "", 0, ""), (900, base[1], "", 0, ""), (900, base[1], "", 0, ""), (6000, "word " * 30000, "", 0, ""), (6001, "one two", "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(df).collect()
    ids, prints = [x[0] for x in rows], [brute_print(x[1]) for x in rows]
    want = sorted(zip(map(str, ids), prints, brute_components(ids, prints), strict=True), key=str)
    assert sorted(((str(x[0]), x[1] % (1 << 64), x[2]) for x in got), key=str) == want


def test_dense_bucket_is_dealt_again(spark):
    """Over max_bucket values that share blocks: levels below find the same components."""
    r = random.Random(3)
    base = r.getrandbits(64)
    prints = {base}
    for _ in range(3000):
        x = base
        for b in r.sample(range(64), r.randrange(1, 9)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    links = simhash.near_links(df, "fp", max_bucket=50)
    found = {x[0]: x[1] for x in components.connected_components(links, "a", "b").collect()}
    a = np.array(prints, np.uint64)
    label = np.arange(len(a))
    while True:
        new = np.array([label[np.bitwise_count(a ^ x) <= 3].min() for x in a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    want = {}
    for p, c in zip(prints, label, strict=True):
        want.setdefault(c, set()).add(simhash.signed(p))
    want = sorted(map(sorted, (g for g in want.values() if len(g) > 1)))
    got = {}
    for n, c in found.items():
        got.setdefault(c, set()).add(n)
    assert sorted(map(sorted, got.values())) == want


def test_query(spark, sf_dir):
    """op1_simhash as it is registered, against all pairs of fingerprints."""
    got = queries.op1_simhash(spark, sf_dir).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id").text
    fp = {i: simhash.simhash((docs[i] or "").encode()) for i in docs.index}
    assert {i: f"{x:016x}" for i, x in fp.items()} == got.fingerprint.to_dict()
    label = {i: i for i in fp}
    for i in sorted(fp):
        for j in sorted(fp):
            if j < i and (fp[i] ^ fp[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert label == got.component_id.to_dict()


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3), (7, 7), (2000, 2001), (2001, 2000)]
    got = {(x[0], x[1]) for x in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    label = {x: x for p in links if None not in p and p[0] != p[1] for x in p}
    for _ in label:
        changed = False
        for a, b in links:
            if a in label and b in label and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
        if not changed:
            break
    assert got == set(label.items())


def shingle_set(t, k=5):
    return set(simhash.shingles((t or "").encode().lower().split(), k))


def jaccard(a, b, k=5):
    s, t = shingle_set(a, k), shingle_set(b, k)
    return len(s & t) / max(1, len(s | t))


def test_similar_documents(spark):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(3000)]
    rows, i = [], 0
    for _ in range(60):
        base = r.choices(words, k=r.choice([60, 300, 900]))
        rows.append((i, " ".join(base), "en"))
        i += 1
        for _ in range(3):
            w = list(base)
            for _ in range(max(1, len(w) // 100)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((i, " ".join(w), "en"))
            i += 1
    rows += [(9000, None, None), (9001, "", ""), (None, "one two", ""), (9003, "two one", ""), (9003, "two one", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(4)
    text = {x[0]: x[1] for x in rows}
    got = simhash.similar_documents(df).collect()
    assert len(got) == len(rows)
    label = {x.doc_id: x.component for x in got}
    close = [(a, a + k) for a in range(0, i, 4) for k in (1, 2, 3) if jaccard(text[a], text[a + k]) >= 0.8]
    assert len(close) > 120 and sum(label[a] == label[b] for a, b in close) > 0.95 * len(close)
    assert len({label[a] for a in range(0, i, 4)}) == 60 and label[None] != label[9003]
    kept = simhash.one_of_each(df).collect()
    assert len(kept) == len({x.component for x in got})
    ids = {x.doc_id for x in kept}
    assert {0, 4, 8, None, 9000, 9003} <= ids and 9001 not in ids
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_similar_documents_against_all_pairs(spark):
    """Groups are those of all pairs at 0.8 or more: none is missed and none is joined below."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(3000)]
    rows = []
    for _ in range(40):
        base = r.choices(words, k=r.choice([12, 30, 60, 300]))
        for k in range(8):
            w = list(base)
            for _ in range(k * len(w) // 100 + (k > 0)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \n", "one two", "ONE  two", "two one"])]
    got = {x.doc_id: x.component for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = [set(simhash.shingles((t or "").encode().lower().split(), 5)) for _, t in rows]
    label = list(range(len(rows)))
    for i in label:
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    groups = lambda of: sorted(sorted(i for i in range(len(rows)) if of[i] == c) for c in {of[i] for i in range(len(rows))})
    assert groups(got) == groups(label) and 60 < len(set(label)) < 300
