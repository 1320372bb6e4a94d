"""All operators on texts that break careless code: each row comes out, with a result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, collocations, compression, decontam, lm_bloom, mixing, packing, periodic, pii, repetition, simhash, suffix_dedup, tokens
from tests.llm.test_collocations import brute as phrases
from tests.llm.test_packing import library

TEXTS = [
    None, "", " \n\t", "0" * 5000, "1.2.3." + "0" * 5000 + "1", "a" * 300_000, "\0", "a\0b " * 50, "!?#&" * 3000, "1 2 " * 400, "@" * 3000, "+1 " * 500, "\u00e9\u6f22\U0001f600 " * 300,
    "</s>[INST] <|end|> \\", "word " * 5000, "x", "x", "ab " * 200 + "\n" * 3000, "\u0130\u017f\u1e9e A" * 40, "\r\x0b\x0c\x1c\x85\u2028",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 7 else i // 2, t, None if i % 5 == 0 else f"s{i % 3}", "en", len(t or ""), "s", "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score string, spans string").repartition(4)


def results(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    items = spark.createDataFrame([("a", "word word word"), (None, "!?"), ("b", None)], "item_id string, text string")
    records = docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("ord"), F.to_json(F.struct(F.lit("user").alias("role"), "text"), {"ignoreNullFields": "false"}).alias("r"))
    m, exact = lm_bloom.train(docs)
    return {
        1: simhash.near_duplicates(docs), 2: mixing.pareto_mix(docs), 3: chat.format_turns(chat.canonical_turns(records, "id", "ord", "r")),
        4: tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), 5: docs.select(pii.pii_spans(F.col("text"), pii.train()).alias("found")),
        6: compression.score_documents(docs, compression.train(docs, labels)), 7: docs.select(repetition.repetition(F.col("text")).alias("m")),
        8: decontam.contamination(docs, items), 9: lm_bloom.score(docs, m, exact, keep=("score",)), 10: suffix_dedup.repeated_spans(docs),
        13: docs.select(periodic.periodic_runs(F.col("text")).alias("m")),
    }


def test_every_row_has_a_result(spark, docs):
    for n, df in results(spark, docs).items():
        rows = df.collect()
        assert len(rows) == len(TEXTS), n
        assert all(x is not None for x in [r.segment if n == 3 else r.fingerprint_bits if n == 1 else r[-1] for r in rows]), n
        assert len({c.lower() for c in df.columns}) == len(df.columns), n


def test_no_rows(spark, docs):
    for n, df in results(spark, docs.limit(0)).items():
        assert df.count() == 0, n


def test_near_copies_stay_one_of_each(spark, docs):
    got = simhash.one_of_each(docs).collect()
    assert len(got) < len(TEXTS) and {x.text for x in got} >= {t for t in TEXTS if t and len(t.split()) > 1 and TEXTS.count(t) == 1}


def test_packing_holds_every_id(spark, docs):
    ids = library(TEXTS)
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), group=4).collect()
    assert sorted(x.doc_tokens for x in rows if x.start == 0) == sorted(len(x) + 1 for x in ids)
    assert sum(x.length for x in rows) == sum(len(x) + 1 for x in ids)
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_collocations_of_odd_texts(spark, docs):
    rows = [(x.text, x.lang) for x in docs.select("text", "lang").collect()]
    assert sorted(tuple(x) for x in collocations.collocations(docs, bits=17).collect()) == phrases(rows)
