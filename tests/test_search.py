"""Search and routing of many questions against those of one."""

import random

from tessera.operators import rank, search
from tessera.sources.buckets import Store

WORDS = ["auth", "login", "session", "cache", "a", "io", "user", "graph", "é", "load", "save", "sessions", "log"]


def made(spark, seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice(WORDS)
    nodes = [(f"n{i}", r.choice(["file", "function"]), r.choice([word(), word().title() + word(), None]), [word() + "-" + word() for _ in range(r.randrange(3))] or None, " ".join(word() for _ in range(r.randrange(6))), r.choice([None, "", f"src/{word()}/{word()}{i % 9}.js"]), i) for i in range(n)]
    edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.choice(["calls", "imports", "contains", "x"]), r.choice([None, 0.4]), i) for i in range(3 * n)]
    n_ = spark.createDataFrame(nodes, "id string, type string, name string, tags array<string>, summary string, file_path string, ord long")
    return n_, spark.createDataFrame(edges, "source string, target string, type string, weight double, ord long")


QUESTIONS = [(1, "login session"), (2, "Cache cache LOAD"), (3, "a"), (4, "nothing-like-it"), (5, ""), (6, "io é"), (7, "sessions user graph login auth log"), (8, None)]


def test_many_questions_as_each_alone(spark, tmp_path):
    nodes, edges = made(spark, 3)
    store = Store(spark, str(tmp_path / "i"), buckets=8)
    search.write_index(store, nodes)
    q = spark.createDataFrame(QUESTIONS, "qid int, text string").repartition(2)
    found, routed = search.search_many(store, q).collect(), search.route_many(store, edges, q).collect()
    for qid, text in QUESTIONS:
        if text is None:
            continue
        one = rank.search(nodes, text).collect()
        got = sorted((x.rank, x.id, round(x.score, 9)) for x in found if x.qid == qid)
        assert {(i, s) for _, i, s in got} == {(x.id, round(x.score, 9)) for x in one} or len(one) == 15, text
        assert [s for _, _, s in got] == [round(x.score, 9) for x in one], text
        one = rank.route(nodes, edges, text).collect()
        assert sorted((x.rank, x.file_path, round(x.score, 6)) for x in routed if x.qid == qid) == sorted((x.rank, x.file_path, round(x.score, 6)) for x in one), text
    assert not [x for x in [*found, *routed] if x.qid in (4, 5, 8)]


def test_nodes_without_a_shared_gram_are_not_read(spark, tmp_path):
    rows = [(f"n{i}", i, "".join(random.Random(i).choices("bcdfghjk", k=9)), [], "", "") for i in range(2000)] + [("x", 9999, "zyxwv", [], "", "")]
    nodes = spark.createDataFrame(rows, "id string, ord long, name string, tags array<string>, summary string, file_path string")
    store = Store(spark, str(tmp_path / "i"), buckets=64)
    search.write_index(store, nodes)
    total = store.manifest["tables"]
    size = lambda t: sum(n for s in total[t]["segments"].values() for _, n in s)
    assert [x.id for x in search.search_many(store, spark.createDataFrame([(1, "zyx")], "qid int, text string")).collect()] == ["x"]
    assert store.rows_read < 0.1 * (size("posting") + size("text"))


def test_index_follows_changed_nodes(spark, tmp_path):
    nodes, _ = made(spark, 5)
    store = Store(spark, str(tmp_path / "i"), buckets=8)
    search.write_index(store, nodes)
    other, _ = made(spark, 6)
    new = other.where("ord % 3 = 0")
    search.write_index(store, new, replaced=nodes.where("ord % 3 = 0 or ord % 7 = 0"))
    now = nodes.where("not (ord % 3 = 0 or ord % 7 = 0)").unionByName(new)
    q = spark.createDataFrame(QUESTIONS[:3], "qid int, text string")
    got = search.search_many(store, q, limit=200).collect()
    for qid, text in QUESTIONS[:3]:
        assert {(x.id, round(x.score, 9)) for x in got if x.qid == qid} == {(x.id, round(x.score, 9)) for x in rank.search(now, text, limit=200).collect()}


def test_no_questions(spark, tmp_path):
    nodes, edges = made(spark, 3)
    store = Store(spark, str(tmp_path / "i"), buckets=4)
    search.write_index(store, nodes)
    q = spark.createDataFrame([], "qid int, text string")
    assert search.search_many(store, q).count() == 0 and search.route_many(store, edges, q).count() == 0


def test_equal_questions_and_equal_nodes_are_scored_once(spark, tmp_path):
    rows = [(f"n{i}", i, ["red ring", "blue ring", "big red bolt"][i % 3], ["ring" if i % 2 else "x"], "", f"f{i % 5}") for i in range(400)]
    nodes = spark.createDataFrame(rows, "id string, ord long, name string, tags array<string>, summary string, file_path string")
    store = Store(spark, str(tmp_path / "i"), buckets=4)
    search.write_index(store, nodes)
    q = spark.createDataFrame([(i, ["Red  ring", "bolt red", "red ring"][i % 3]) for i in range(90)], "qid int, text string")
    tokens, same = search._asked(q)
    assert (tokens.count(), same.count()) == (4, 90)
    found = search.search_many(store, q, limit=25).collect()
    for i, text in enumerate(["red ring", "bolt red", "red ring"]):
        want = [(k + 1, x.id, round(x.score, 9)) for k, x in enumerate(rank.search(nodes, text, limit=25).collect())]
        assert {tuple(sorted((x.rank, x.id, round(x.score, 9)) for x in found if x.qid == j)) for j in range(i, 90, 3)} == {tuple(want)}
