"""Search and routing for a table of questions at once, over an index of postings.

The index is a bucketed store: lower-cased fields of nodes by id, and for each gram of one to three characters the nodes
that have it in a field. A token's nodes are looked for among those of its rarest gram and verified exactly, so a node
that shares no gram with a question is not read. All questions are one plan: fronts are keyed by question, and what would be
collected for one is a window over the best few of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import lit_array, slashes
from tessera.operators.rank import ends_swapped
from tessera.operators.tables import materialize
from tessera.sources.buckets import Store

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The grams of n characters, repeats kept."""
    return F.transform(F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(n)))


def write_index(store: Store, nodes: DataFrame, replaced: DataFrame | None = None) -> int:
    """Puts nodes (id, ord, name, tags, summary, file_path) into the index, in place of those with ids in `replaced`; the version."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tags = F.transform(F.coalesce("tags", lit_array([])), low)
    rows = materialize(nodes.select(F.col("id").cast("string").alias("id"), "ord", low(F.col("name")).alias("name"), tags.alias("tags"), low(F.col("summary")).alias("summary"), low(slashes(F.col("file_path"))).alias("path"), "file_path"))
    fields = F.concat(F.array("name", "summary", "path"), F.col("tags"))
    grams = F.flatten(F.transform(fields, lambda f: F.concat(*[_grams(f, n) for n in range(1, GRAM + 1)])))
    postings = rows.select("id", F.explode(F.array_distinct(grams)).alias("gram")).where(~F.col("gram").rlike(r"\s"))
    gone = None
    if replaced is not None and store.version >= 0:
        old = store.read("text", replaced.select("id"))
        gone = old.select("id", F.explode(F.array_distinct(F.flatten(F.transform(fields, lambda f: F.concat(*[_grams(f, n) for n in range(1, GRAM + 1)]))))).alias("gram"))
    return store.commit({"text": ("id", "id", rows, None if gone is None else replaced.select(F.col("id").cast("string").alias("id"))), "posting": ("gram", "id", postings, gone)})


def token_points(store: Store, tokens: DataFrame) -> DataFrame:
    """(token, id, ord, file_path, points): what each node has of each token (token): .4 for its name, .3 within it; .3 and .2 for tags; .2 in the summary; .1 in the path."""
    tokens = materialize(tokens.select("token").distinct())
    n = F.least(F.length("token"), F.lit(GRAM))
    grams = F.transform(F.sequence(F.lit(1), F.length("token") - n + 1), lambda i: F.substr("token", i, n))
    wanted = materialize(tokens.select("token", F.explode(F.array_distinct(grams)).alias("gram")))
    postings = store.read("posting", wanted.select("gram"))
    sizes = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rare = wanted.join(sizes, "gram", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    found = materialize(rare.where("r.n > 0").select("token", "r.gram").join(postings, "gram").select("token", "id"))
    t = F.col("token")
    tagged = F.when(F.array_contains("tags", t), 0.3).when(F.exists("tags", lambda x: F.contains(x, t)), 0.2).otherwise(0.0)
    points = F.when(F.col("name") == t, 0.4).when(F.contains("name", t), 0.3).otherwise(0.0) + tagged + F.when(F.contains("summary", t), 0.2).otherwise(0.0) + F.when(F.contains("path", t), 0.1).otherwise(0.0)
    rows = found.join(store.read("text", found.select("id")), "id")
    return rows.select("token", "id", "ord", "file_path", points.alias("points")).where("points > 0")


def _first(df: DataFrame, keys: str, order: str, most: int) -> DataFrame:
    """The first few rows of each group, numbered from 1 as rank."""
    return df.withColumn("rank", F.expr(f"row_number() over (partition by {keys} order by {order})")).where(F.col("rank") <= most)


def _asked(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, pos, token) of one question of each sequence of tokens, and (qid, of): which question stands for which; what is asked often is answered once."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")
    each = materialize(questions.select(F.col("qid").alias("of"), words.alias("words")))
    one = each.groupBy("words").agg(F.min("of").alias("qid"))
    return materialize(one.select("qid", F.posexplode("words").alias("pos", "token"))), each.join(one, "words").select("qid", "of")


def _answers(rows: DataFrame, same: DataFrame) -> DataFrame:
    """The rows of one question of each kind, for all of that kind."""
    return rows.join(same, "qid").withColumn("qid", F.col("of")).drop("of")


def _best_nodes(tokens: DataFrame, points: DataFrame, most: int, min_score: float) -> DataFrame:
    """(qid, id, ord, score, rank): each question's best nodes by score and then ord. A score is 70 % of the best token's points and 30 % of their
    mean, 1 at most, added up in the tokens' order as rank.keyword_score() does.

    Nodes that have the same points of all tokens score alike for any question, so one of them is scored for all. Of such a group only the
    first few by ord can be among a question's best, and only groups whose first node is.
    """
    alike = points.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "points"))).alias("has"), F.min("ord").alias("ord"))  # a node's tokens
    firsts = materialize(_first(alike, "has", "ord", most))
    heads = materialize(firsts.where("rank = 1").select(F.col("id").alias("head"), "ord", "has"))
    members = firsts.select("id", "ord", "has").join(heads.select("head", "has"), "has").select("head", "id", "ord")
    points = heads.select("head", "ord", F.explode("has").alias("h")).select("head", "ord", "h.token", "h.points")
    n = tokens.groupBy("qid").agg(F.count("*").alias("n"))
    each = tokens.join(points, "token").groupBy("qid", "head").agg(F.max("points").alias("best"), F.array_sort(F.collect_list(F.struct("pos", "points"))).alias("xs"), F.min("ord").alias("ord"))  # a question's tokens
    total = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["points"])
    scored = each.join(n, "qid").select("qid", "head", "ord", F.least(F.col("best") * 0.7 + total / F.col("n") * 0.3, F.lit(1.0)).alias("score")).where(F.col("score") >= min_score)
    groups = materialize(_first(scored, "qid", "score desc, ord", most).select("qid", "head", "score"))
    return _first(groups.join(members, "head").select("qid", "id", "ord", "score"), "qid", "score desc, ord", most)


def search_many(store: Store, questions: DataFrame, limit: int = 15, min_score: float = 0.1) -> DataFrame:
    """(qid, rank, id, score): the best nodes for each question (qid, text), by score and then ord."""
    tokens, same = _asked(questions)
    best = _best_nodes(tokens, token_points(store, tokens), limit, min_score)
    return _answers(best, same).select("qid", "rank", "id", "score")


def expand_many(seeds: DataFrame, edges: DataFrame, hops: int = 2, beam: int = 5, floor: float = 0.2) -> DataFrame:
    """(qid, id, score): rank.expand() for the seeds (qid, id, ord) of all questions. A node keeps the score of its first reach, a minimum that is
    aggregated before the shuffle, and the best `beam` of a question's new nodes go on."""
    front = seeds.select("qid", "id", F.lit(1.0).alias("score"), F.col("ord").cast("long").alias("rank"))
    reached, links = front.select("qid", "id", "score"), ends_swapped(edges)
    for hop in range(hops):
        step = links.join(front.select("qid", F.col("id").alias("node"), F.col("score").alias("parent"), F.col("rank").alias("prank")), "node")
        step = step.join(reached.select("qid", F.col("id").alias("other")), ["qid", "other"], "left_anti")
        step = step.withColumn("score", F.col("parent") * 0.7 + F.col("worth") * 0.3)
        first = step.groupBy("qid", "other").agg(F.min(F.struct((-F.col("parent")).alias("p"), "prank", "ord", "score")).alias("f"))
        new = materialize(first.select("qid", F.col("other").alias("id"), "f.score", "f.p", "f.prank", "f.ord"))
        reached = reached.unionByName(new.select("qid", "id", "score"))
        if hop + 1 < hops:
            best = _first(new.where(F.col("score") >= floor), "qid", "round(score, 9) desc, p, prank, ord", beam)
            front = materialize(best.select("qid", "id", "score", F.col("rank").cast("long").alias("rank")))
    return reached


def route_many(store: Store, edges: DataFrame, questions: DataFrame, max_files: int = 12) -> DataFrame:
    """(qid, rank, file_path, score): the files to read first for each question (qid, text), as rank.route() has them for one.

    Seeds are a question's 20 best nodes and the 5 best of each of its tokens, which are found once a token.
    """
    tokens, same = _asked(questions)
    points = materialize(token_points(store, tokens))
    whole = _best_nodes(tokens, points, 20, 0.1).select("qid", "id", "ord", "score", F.lit(0).alias("pass"))
    alone = points.select("token", "id", "ord", F.least(F.col("points") * 0.7 + F.col("points") * 0.3, F.lit(1.0)).alias("score"))
    best = _first(alone.where("score >= 0.25"), "token", "score desc, ord", 5).select("token", "id", "ord", "score")
    each = tokens.join(best, "token").select("qid", "id", "ord", "score", (F.col("pos") + 1).alias("pass"))
    hits = whole.unionByName(each).groupBy("qid", "id").agg(F.min(F.struct("pass", (-F.col("score")).alias("s"), "ord", "score")).alias("h")).select("qid", "id", "h.score", "h.pass", "h.ord")
    seeds = materialize(hits.withColumn("rank", F.expr("row_number() over (partition by qid order by pass, score desc, ord)")).select("qid", "id", F.col("score").alias("own"), F.col("rank").alias("ord")))
    grown = expand_many(seeds, edges)
    scored = grown.join(seeds.select("qid", "id", "own"), ["qid", "id"], "left").select("qid", "id", F.greatest("score", F.coalesce("own", F.lit(0.0))).alias("score"))
    both = scored.unionByName(seeds.select("qid", "id", (F.col("own") + 1.5).alias("score")))
    files = store.read("text", both.select("id")).where(F.coalesce(F.col("file_path"), F.lit("")) != "").select("id", "file_path", F.col("ord").alias("o"))
    ranked = both.join(files, "id").groupBy("qid", "file_path").agg(F.max("score").alias("score"), F.min("o").alias("o"))
    return _answers(_first(ranked, "qid", "round(score, 9) desc, o", max_files), same).select("qid", "rank", "file_path", "score")
