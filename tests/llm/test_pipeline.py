"""Each stage on its predecessor's rows, held against plain code."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import compression, decontam, mixing, pii
from tessera.llm.common import materialize

from .test_simhash import shingle_set


@pytest.fixture(scope="module")
def kept(spark):
    d = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    out.append(docs)
    for name, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, d), name)
        out.append(docs)
    return [x.toPandas() for x in out]


def test_shape(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontaminate", "personal_data", "mix"]
    for x in kept[:-1]:
        assert list(x.columns) == ["doc_id", "text", "lang", "source", "n_chars"] and x.doc_id.is_unique
    sizes = [len(x) for x in kept]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]


def test_quality(spark, kept):
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").quality
    left = lab.index.isin(kept[1].doc_id)
    assert left[lab.values == 1].mean() > 0.97 and left[lab.values == 0].mean() < 0.3
    docs = spark.createDataFrame(kept[0])
    m = compression.train(docs.where(~corpus_pipeline.held_out("doc_id", 5, 0)), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    zs = compression.compressors(m.good, m.bad, m.level)
    for _, x in kept[0].head(200).iterrows():
        z = m.weights[0] + m.weights[1] * compression.difference(x.text.encode(), zs)
        assert (z >= -0.8472978603872034) == (x.doc_id in set(kept[1].doc_id))  # log(0.3 / 0.7)


def test_near_copies(kept):
    """All pairs of 0.8 or more by brute force: of each group they make, the least id stays, and nothing else goes."""
    text = kept[1].set_index("doc_id").text
    holders, sets = {}, {}
    for i in text.index:
        sets[i] = shingle_set(text[i])
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    root = {i: i for i in text.index}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in text.index:
        both = Counter(j for g in sets[i] for j in holders[g] if j < i)
        for j, n in both.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    groups = Counter(map(top, text.index))
    assert sum(n > 1 for n in groups.values()) > 10
    want, got = set(groups), set(kept[2].doc_id)
    assert len(got - want) <= 0.01 * (len(text) - len(want)) and not want - got, (len(got - want), len(want - got))


def test_decontaminate(spark, kept):
    items = [(str(x.item_id), x.text.encode()) for x in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    wins = {w for _, t in items for w in decontam.windows_of(decontam.words_of(t), 10)}
    sizes = {len(w) for w in wins}
    clean = set()
    for _, x in kept[2].iterrows():
        w = decontam.words_of(x.text.encode())
        if not any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1)):
            clean.add(x.doc_id)
    assert set(kept[3].doc_id) == clean < set(kept[2].doc_id)


def test_personal_data(kept):
    a, b = (x.set_index("doc_id") for x in kept[3:5])
    assert list(a.index.sort_values()) == list(b.index.sort_values())
    changed = 0
    for i in a.index:
        spans = pii.base_spans(a.text[i])
        assert not pii.base_spans(b.text[i]) and b.n_chars[i] == len(b.text[i])
        assert bool(spans) <= (a.text[i] != b.text[i])
        if not any(c in a.text[i] for c in "0123456789@"):
            assert a.text[i] == b.text[i]
        changed += a.text[i] != b.text[i]
    assert changed


def test_mix(kept):
    docs, mixed = kept[4], kept[5]
    size = docs.text.map(lambda t: len(t.encode().split()))
    per = size.groupby(docs.source).sum()
    order = sorted(per.index, key=lambda s: s.encode())
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * per.sum(), set(order), {}
    while over := {s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * per[s]}:
        target |= {s: 2.0 * per[s] for s in over}
        left, free = left - sum(target[s] for s in over), free - over
        if not free:
            break
    target |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
    text = docs.set_index("doc_id").text
    assert (mixed.text == mixed.doc_id.map(text)).all() and set(mixed.copies) <= {1, 2}
    for s, g in mixed.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s])
        assert abs(g.taken.sum() - target[s]) <= size[docs.source == s].max() / 2 + 1


def test_run(spark):
    d = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, d).toPandas()
    assert len(got) and got.doc_id.is_unique and {"copies", "taken"} <= set(got.columns)


def test_odd_and_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "some words here and there " * 30, "en", None, 5), (2, "some words here and there " * 30, "en", None, 5), (3, "mail me at a.b@c.de " + "many other words " * 4000, "en", "a", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema).withColumn("contamination", F.lit(1)).withColumn("d", F.lit("x")).withColumn("size", F.lit("own"))
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, d)
            assert {c if name != "mix" or c != "size" else "size_in" for c in docs.columns} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
            got = out.collect()
            assert len(got) <= len(data)
            if name in ("decontaminate", "personal_data"):
                assert len(got) == len(data)
            if name == "near_copies" and data:
                assert sorted(str(x.doc_id) for x in got) == ["1", "2", "3"]
