import zlib

import numpy as np

from tessera.llm import compression, queries


def auc(y, s):
    o = np.argsort(np.argsort(s, kind="stable"))
    n = y.sum()
    return (o[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op6_quality(spark, d).toPandas().set_index("doc_id")
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    lab = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id")
    both = got.join(lab, how="inner")
    both = both[both.held_out]
    assert auc(both.quality.values, both.score.values) > 0.9
    assert (both.predicted == both.quality).mean() > 0.9


def test_score_depends_on_text_alone(spark):
    rows = [(i, "the good words of a text " + str(i * 7919), "en") for i in range(60)] + [(100 + i, "### $$$ *** " * 9 + str(i), "en") for i in range(60)]
    odd = [(1000, None, None), (1001, "", ""), (None, "the good words", None), (1002, "x" * 300_000, ""), (1, "### $$$ ***", "")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _, _ in rows] + [(None, 1, 0), (1000, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    m = compression.train(docs, labels)
    got = compression.score_documents(docs, m).collect()
    assert {x.score_in for x in got} == {"en", None, ""}
    assert len(got) == len(rows) + len(odd) and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.score for x in got}
    assert by[1000] == by[1001] and by[5] > 0.5 > by[105]
    assert compression.train(docs.repartition(7), labels) == m
    assert compression.score_documents(docs.limit(0), m).count() == 0
    assert compression.train(docs, labels, max_bytes=0).weights[1] == 0 != compression.train(docs, labels, max_bytes=4000).weights[1]


def test_the_score_is_the_calibrated_difference():
    good, bad = [f"the words of a good text {i * 7919} and more of them" for i in range(60)], [f"### $$$ *** {i} " * 9 for i in range(60)]
    m = compression.fit([(t, 1) for t in good] + [(t, 0) for t in bad])
    zs = compression.compressors(m.good, m.bad, m.level)
    for t in [*good[:5], *bad[:5], "", "x" * 10_000]:
        g, b = (len(z.compress(t.encode())) for z in zs)
        assert compression.difference(t.encode(), zs) == (b - g) / (len(t) + 1)
    assert m.weights[1] > 0  # the more the good dictionary saves, the better


def test_few_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 1), (2, 0)]):
        m = compression.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert all(0 < x.score < 1 for x in compression.score_documents(docs, m).collect())


def test_query_against_plain_code(spark, sf_dir):
    """Every row's score from sizes that zstandard itself gives, and which rows are held out."""
    import zstandard

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    m = compression.train(docs.where(~queries.held_out("doc_id", 5, 0)), labels)
    used = {t for t, _ in compression.labelled_sample(docs.where(~queries.held_out("doc_id", 5, 0)), labels, "doc_id", "text", "quality", 2000, 64 << 20)}
    marked = {r.doc_id for r in labels.where("quality is not null").collect()}
    rows = docs.collect()
    assert used == {r.text for r in rows if r.doc_id in marked and zlib.crc32(str(r.doc_id).encode()) % 5}
    size = lambda d, t: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t))
    got = queries.op6_quality(spark, sf_dir).toPandas().set_index("doc_id")
    for r in rows:
        t = (r.text or "").encode()
        want = 1 / (1 + np.exp(-(m.weights[0] + m.weights[1] * (size(m.bad, t) - size(m.good, t)) / (len(t) + 1))))
        x = got.loc[r.doc_id]
        assert abs(x.score - want) < 1e-9 and x.predicted == (want >= 0.3) and x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
