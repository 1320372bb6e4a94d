import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import queries, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
SPLIT = tokens.Splitter(PATH)


def library(texts):
    return [len(e.ids) for e in TOK.encode_batch(texts, add_special_tokens=False)]


def by_pre_tokens(texts):
    out = []
    for t in texts:
        table, n = SPLIT.frequencies(t)
        out.append(n + sum(k * table[p] for p, k in zip(table, SPLIT.pieces(list(table)), strict=True)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "'s", "'", " ", "  ", "\n", "\x1c", "\x85", " ", "ab", "Éa", "12", "²", "!?", "漢字", "'re", "<|"]), max_size=15).map("".join), max_size=6))
def test_counts_as_the_library(texts):
    assert by_pre_tokens(texts) == library(texts)


def test_latin_characters_one_by_one():
    texts = [f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(1, 0x600)]
    assert by_pre_tokens(texts) == library(texts)


def rows():
    r = random.Random(5)
    texts = [None, "", "x " * 60000, "word" * 5000, " " * 3000, "a", "a", "1" * 5000, "\0\0", "!?" * 4000, "<|endoftext|> a"]
    return [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, "a b", "n", 2), (3, "a b", "n", 3)] * 2 + [(100 + i, "".join(r.choices("ab é\n'.s", k=50)), "n", 4) for i in range(50)]


@pytest.mark.parametrize("most", [0, 3, 1 << 18])
def test_counts_by_join(spark, most):
    df = spark.createDataFrame(rows(), "doc_id long, text string, n_tokens string, p int").repartition(5)
    got = tokens.count_tokens(df, PATH, keep=("text", "n_tokens", "p"), most=most, sample=20).collect()
    assert [x.n_tokens for x in got] == library([x.text or "" for x in got])
    assert sorted((x.doc_id is None, x.doc_id, x.text is None, x.text, x.n_tokens_in, x.p) for x in got) == sorted((i is None, i, t is None, t, n, p) for i, t, n, p in rows())
    assert [x.n_bytes for x in got] == [len((x.text or "").encode()) for x in got]
    assert tokens.count_tokens(df.limit(0), PATH, most=most).count() == 0


def test_rare_pre_tokens_are_joined_and_counted_once(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} other") for i in range(100)], "doc_id long, text string").repartition(4)
    out = tokens.count_tokens(df, PATH, most=2, sample=100)
    assert out.agg({"n_tokens": "sum"}).first()[0] == sum(library([f"word{i % 7} other" for i in range(100)]))
    assert "Join" in out._jdf.queryExecution().executedPlan().toString()


def test_a_tokenizer_counted_text_by_text(spark):
    import os

    names = [n for n in os.listdir(os.path.dirname(PATH)) if n.endswith(".model")]
    if not names:
        pytest.skip("no such file")
    import sentencepiece

    path = public_tokenizers.path(names[0])
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokens.count_tokens(spark.createDataFrame([(1, "a word here"), (2, None)], "doc_id long, text string"), path).collect()
    assert {x.doc_id: x.n_tokens for x in got} == {1: len(sp.encode("a word here")), 2: 0}


def test_query(spark, sf_dir):
    got = queries.op4_tokens(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    want = library([docs.text[i] or "" for i in got.doc_id])
    assert got.n_tokens.tolist() == want and got.over_limit.tolist() == [n > 1024 for n in want]
    assert got.n_bytes.tolist() == [len((docs.text[i] or "").encode()) for i in got.doc_id]
