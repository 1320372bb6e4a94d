import duckdb
import pandas as pd
import pytest

from tessera.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, size int, target string, taken string, s string"


def water(sizes, share=1.5, most=2.0):
    """Targets in rounds: those above their cap stop there, the excess goes to the rest by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.fixture(scope="module")
def rows():
    import random

    r = random.Random(4)
    out = []
    for i in range(3000):
        s = r.choice(["a", "a", "a", "b", "é", None, "tiny", "Z", "c"]) if i % 60 else "tiny"
        out.append((i, "w " * r.choice([0, 1, 5, 50, 300]), s, 1, "x", "y", "z"))
    out += [(None, "a b", "a", 0, "", "", ""), (7, None, "a", 0, "", "", ""), (8, "q r s", "a", 0, "", "", ""), (8, "q r s", "a", 0, "", "", ""), (9, " \t", "only", 0, "", "", ""), (10, "x " * 40000, "b", 0, "", "", "")]
    return out


def test_mix(spark, rows):
    got = mixing.pareto_mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for x in rows:
        sizes[x[2]] = sizes.get(x[2], 0) + len((x[1] or "").split())
    want = water(sizes)
    got["source"] = got.source.where(got.source.notna(), None)
    for s, g in got.groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert g.source_size.iloc[0] == sizes[s] == g["size"].sum()
        assert g.target.iloc[0] == pytest.approx(want[s])
        assert abs(g.taken.sum() - want[s]) <= max(1, g["size"].max() / 2 + 1e-6)
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    again = mixing.pareto_mix(spark.createDataFrame(rows[::-1], SCHEMA)).toPandas()
    key = ["doc_id", "size", "copies"]
    assert again[key].sort_values(key).fillna(-1).values.tolist() == got[key].sort_values(key).fillna(-1).values.tolist()


def test_equals_whole_sort_in_sql(spark, rows):
    documents = pd.DataFrame([x[:3] for x in rows if x[0] is not None], columns=["doc_id", "text", "source"])  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(queries.OP2_SQL).df().sort_values(["doc_id", "size", "taken"])
    df = mixing.pareto_mix(spark.createDataFrame([x for x in rows if x[0] is not None], SCHEMA)).select("doc_id", "size", "source_size", "target", "taken").toPandas().sort_values(["doc_id", "size", "taken"])
    assert df.drop(columns="target").values.tolist() == want.drop(columns="target").values.tolist()
    assert df.target.tolist() == pytest.approx(want.target.tolist())


def test_inclusion_follows_the_preference(spark):
    import pyspark.sql.functions as F

    df = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.pareto_mix(df, share=0.5, preference=F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0)).toPandas()
    g = got[got.source == "a"]
    low, high = g[g.doc_id % 4 >= 2].copies.mean(), g[g.doc_id % 4 < 2].copies.mean()
    assert high > 1.3 * low and abs(g.taken.sum() - g.target.iloc[0]) <= 10


def test_empty_and_wordless(spark):
    assert mixing.pareto_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.pareto_mix(spark.createDataFrame([(1, None, None, 0, "", "", ""), (2, "", "a", 0, "", "", "")], SCHEMA)).collect()
    assert sorted((x.doc_id, x["size"], x.target, x.taken) for x in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_no_python_on_the_main_path(spark, rows, capsys):
    mixing.pareto_mix(spark.createDataFrame(rows, SCHEMA)).explain()
    assert "Python" not in capsys.readouterr().out and "Arrow" not in capsys.readouterr().out
