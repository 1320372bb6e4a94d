import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, queries


def records(spark, rows):
    return spark.createDataFrame([(i, o, r if r is None or isinstance(r, str) else json.dumps(r)) for i, o, r in rows], "id long, ord long, record string")


def test_layouts(spark):
    rows = [
        (1, 0, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}),
        (2, 0, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}),
        (3, 0, {"instruction": "do", "input": "this", "output": "done"}),
        (4, 0, {"instruction": "do", "input": "", "output": "done"}),
        (5, 0, {"prompt": {"text": "p"}, "response": {"text": "r"}}),
        (6, 0, {"unknown": 1}),
        (7, 0, "no json"),
        (8, 0, None),
        (9, 0, {"output": "o", "instruction": "i"}),
    ]
    got = chat.canonical_turns(records(spark, rows), "id", "ord", "record").orderBy("id", "ord", "seq").collect()
    said = {}
    for x in got:
        said.setdefault(x.id, []).append((x.layout, x.role, x.text))
    assert said[1] == [("messages", "user", "hi"), ("messages", "assistant", "yo")]
    assert said[2] == [("from and value", "user", "a"), ("from and value", "assistant", "")]
    assert said[3][0][2] == "do\n\nthis" and said[4][0][2] == "do" and said[3][1] == ("instruction and input", "assistant", "done")
    assert [x[2] for x in said[5]] == ["p", "r"] and [x[2] for x in said[9]] == ["i", "o"]
    assert said[6] == said[7] == said[8] == [(None, None, None)]


def test_fingerprints_differ_by_path_only():
    a = chat.schema_fingerprint(chat.field_paths({"b": 1, "a": [{"x": 1}, {"x": None}]}))
    assert a == chat.schema_fingerprint(["a[].x", "b"]) != chat.schema_fingerprint(["a.x", "b"])
    assert len({chat.schema_fingerprint(m["paths"]) for m in chat.LAYOUTS}) == len(chat.LAYOUTS)


texts = st.lists(st.sampled_from(["\\", "<", "/s>", "</s>", "[INST]", "[", "INST]", "<|end|>", "<|", "|>", "é", "\n", "a", *chat.CONTROL]), max_size=12).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "</s>", None]), st.none() | texts), min_size=1, max_size=40))
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(1, i, 0, r, t, "x") for i, (r, t) in enumerate(turns)], "id long, ord long, seq int, role string, text string, layout string")
    f = chat.format_turns(df)
    for x in f.collect():
        inner = x.segment[len(chat.OPEN) : -len(chat.CLOSE)]
        assert not [c for c in chat.CONTROL if c != chat.SEP and c in inner] and inner.count(chat.SEP) == 1
    got = chat.read_back(f).collect()
    turns = [(r or "", t or "") for r, t in turns]
    learnt = "".join(t for r, t in turns if r == "assistant")
    assert [tuple(x)[:5] for x in got] == [(1, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())]


def test_query_against_sql(spark, sf_dir, duck):
    got = queries.op3_chat(spark, sf_dir).toPandas()
    want = duck.sql(queries.OP3_SQL).df()[got.columns.tolist()]
    key = ["conv_id"]
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()
    assert got[got.conv_id == -1].n_turns.tolist() == [2]


def test_ids_of_any_kind(spark):
    df = spark.createDataFrame([("2024-01-01", 1.5, 0, "user", "a")], "d string, x double, ord int, role string, text string")
    df = df.select(F.lit(0).alias("seq"), F.lit("l").alias("layout"), "*")
    for kind in ("date", "decimal(5,2)", "binary", "short"):
        ids = F.col("d").cast(kind) if kind in ("date", "binary") else F.col("x").cast(kind)
        assert chat.read_back(chat.format_turns(df.withColumn("id", ids))).first().n_turns == 1


def test_ties_nulls_and_long_conversations(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (None, None, "assistant", "z"), (None, 1, None, None)] + [(2, i, "assistant", "x" * 50) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, ord long, role string, text string").select("*", F.lit(0).alias("seq"), F.lit("l").alias("layout"), F.lit(1).alias("segment0"))
    got = {x.id: x for x in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\nb\n").hexdigest()
    assert got[2].n_turns == 5000 and got[2].loss_chars == 250000 and got[None].n_turns == 2


def test_empty(spark):
    assert chat.read_back(chat.format_turns(chat.canonical_turns(records(spark, []), "id", "ord", "record"))).count() == 0


@pytest.mark.parametrize("s", ["", "\\", "\\\\<\\/s>", "</s></s>"])
def test_escape_is_reversible(spark, s):
    e = spark.createDataFrame([(s,)], "t string").select(chat.escape(F.col("t"))).first()[0]
    assert chat.unescape(e) == s


def test_roles_of_turn_rows_stay_as_they_are(spark, tmp_path, duck):
    rows = [(1, 0, "human", "hi"), (1, 1, "gpt", "ho"), (1, 2, "assistant", "yes"), (2, 0, "bot", "a"), (2, 1, None, None), (3, 0, "model", ""), (4, 0, "assistant", "b\\n[INST]")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.OP3_SQL).df()
    got = queries.op3_chat(spark, str(tmp_path)).toPandas()[want.columns.tolist()]
    assert got.sort_values("conv_id").values.tolist() == want.sort_values("conv_id").values.tolist()
