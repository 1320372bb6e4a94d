import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
ENC = packing.Encoder(PATH)


def library(texts):
    return [e.ids for e in TOK.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(texts, enc=ENC):
    ids, at = enc.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


PARTS = ["<|endoftext|>", "'s", "'", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "ab", "Éa", "12", "²", "!?", "漢字", "'re", "'ll", "'LL", "<|", "ª", "×", "÷", "İ", "ı", "é", "\xad", "¼3", "''", "ǅ", "Ȳ"]


def test_encoder_knows_the_file():
    assert ENC.fast and not packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).fast


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(max_size=40) | st.text(alphabet="aAs'tréÉ×1²! \n", max_size=40) | st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_ids_as_the_library(texts):
    assert encoded(texts) == library(texts)


def test_latin_characters_one_by_one():
    texts = [f"a{chr(c)} {chr(c)}{chr(c)}1'{chr(c)}s" for c in range(1, 0x600) if not 0xD800 <= c < 0xE000]
    assert encoded(texts) == library(texts)


def test_words_are_forgotten_and_learnt_again():
    enc = packing.Encoder(PATH, most=50)
    for i in range(5):
        texts = [f"word{chr(97 + j)}{chr(97 + i)} other" for j in range(26)]
        assert encoded(texts, enc) == library(texts)
        assert len(enc.known) <= 60


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60), st.sampled_from([0.0, 0.01, 1.0]))
def test_fill(sizes, share):
    got = packing.fill(sizes, 64, 8, share)
    spans = sorted(p for x in got for p in x)
    assert all(0 < sum(n for _, _, n in x) <= 64 for x in got)
    at = [0] * len(sizes)
    for i, start, n in spans:
        assert start == at[i] and start % 8 == 0
        at[i] += n
    assert at == sizes
    if share == 1.0:  # first fit: brute force
        bins = []
        for s in sorted((s for s in sizes if s), reverse=True):
            k = next((k for k, b in enumerate(bins) if b + s <= 64), None)
            bins.append(s) if k is None else bins.__setitem__(k, bins[k] + s)
        assert [sum(n for _, _, n in x) for x in got] == bins


def test_awkward_lengths_are_cut():
    sizes = [2100] * 1000
    assert len(packing.fill(sizes, 4096, 64, 1.0)) == 1000
    got = packing.fill(sizes, 4096, 64, 0.005)
    assert len(got) * 4096 < 1.03 * sum(sizes)


def test_checksums_of_joined_parts():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(64 * 7))
    assert packing.joined_crc([zlib.crc32(data[i : i + 64]) for i in range(0, len(data), 64)], bytes(64)) == zlib.crc32(data)


def held(rows, texts, path_ids=library, capacity=4096):
    """Pieces of (id, text) cover each document once, sequences are full of pieces, and checksums are right."""
    want = sorted((str(i), (*x, 2)) for (i, _), x in zip(texts, path_ids([t for _, t in texts]), strict=True))
    by_seq = {}
    for x in rows:
        by_seq.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for p in by_seq.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    got = {}
    for x in rows:
        got.setdefault(str(x.doc_id), []).append(x)
    return want, got


def test_pieces_of_a_table(spark):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(n))
    texts = [(0, None), (1, ""), (2, " \n"), (3, words(9000)), (4, "<|endoftext|> a"), (5, "漢字 " * 50), *((i, words(r.choice([1, 5, 50, 500, 2500]))) for i in range(6, 200))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, start string, length int").repartition(5)
    out = packing.pack(df, PATH, group=40, ids=True)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = out.collect()
    want, got = held(rows, texts)
    for i, ids in want:
        p = sorted(got[i], key=lambda x: x.start)
        assert [x.start for x in p] == np.cumsum([0, *[x.length for x in p[:-1]]]).tolist()
        assert tuple(k for x in p for k in x.ids) == ids and {x.doc_tokens for x in p} == {len(ids)}
        assert all(x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and len(x.ids) == x.length for x in p)
    assert len(got) == len(texts)
    again = packing.pack(df.repartition(3), PATH, group=40).count()
    assert abs(again - len(rows)) < 50


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c")] * 50 + [(1, "x")] * 50, "doc_id long, text string").repartition(3)
    rows = packing.pack(df, PATH, capacity=64, block=8, group=20).collect()
    assert sum(x.length for x in rows) == 50 * 4 + 50 * 2
    assert packing.pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        packing.pack(df, PATH, capacity=100, block=64)


def test_query(spark, sf_dir):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op11_packing(spark, sf_dir).collect()
    assert rows[0].__fields__ == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    want, got = held(rows, docs)
    for i, ids in want:
        p = sorted(got[i], key=lambda x: x.start)
        for x in p:
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) and x.doc_tokens == len(ids)
        assert [x.start for x in p] == np.cumsum([0, *[x.length for x in p[:-1]]]).tolist() and p[-1].start + p[-1].length == len(ids)
    fill = {}
    for x in rows:
        fill[x.sequence_id] = fill.get(x.sequence_id, 0) + x.length
    padded = sum(4096 - n for n in fill.values() if n & (n - 1))
    assert padded <= 4096 + 0.01 * sum(fill.values())
