"""Which of many literals stand in which texts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import lit_array
from tessera.operators.tables import materialize

#: Bytes of literals that every worker may have, and characters that one automaton is built of: some 100 MB of memory.
MAX_BYTES, BLOCK = 16 << 20, 1_000_000
#: Texts or literals with a word, beyond which the word is known to all workers and its texts are dealt to several tasks.
OFTEN = 10_000


def literal_hits(texts: DataFrame, literals: DataFrame, key: str = "path", content: str = "content", lit: str = "lit", max_bytes: int = MAX_BYTES, block: int = BLOCK) -> DataFrame:
    """(key, lit): each literal that stands in a text, once a text. Case, quotes and blanks are as given.

    The distinct literals are measured first. Up to max_bytes they go to all workers, which run an automaton of them over
    the texts: one scan, nothing is joined with texts. An automaton has some `block` characters; of more literals
    several are built in turn for each batch of texts, so a worker has one at a time. Beyond max_bytes texts and literals
    meet on words, by shuffle. Null and empty literals stand in nothing, and neither does anything in null texts.
    """
    wanted = materialize(literals.select(F.col(lit).alias("lit")).where(F.col(lit) != "").distinct())
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("lit")), F.lit(0))).first()[0]
    texts = texts.select(F.col(key).alias("key"), F.col(content).alias("content")).where("content is not null")
    if size > max_bytes:
        return hits_by_words(texts, wanted).select(F.col("key").alias(key), F.col("lit").alias(lit))
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(blocks([r.lit for r in wanted.collect()], block))  # max_bytes at most
    kind = pa.string() if isinstance(texts.schema["key"].dataType, T.StringType) else None

    def automaton(literals: list[str]) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for x in literals:
            a.add_word(x, x)
        a.make_automaton()
        return a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        only = automaton(parts[0]) if len(parts) == 1 else None
        for b in batches:
            for part in parts if b.num_rows else []:
                a, at, found = only or automaton(part), [], []
                for i, x in enumerate(b.column(1)):
                    here = {v for _, v in a.iter(x.as_py())}
                    at += [i] * len(here)
                    found += here
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())).cast(kind or b.column(0).type), pa.array(found, pa.string())], names=["key", "lit"])

    schema = T.StructType([T.StructField("key", texts.schema["key"].dataType), T.StructField("lit", T.StringType())])
    return texts.mapInArrow(run, schema).select(F.col("key").alias(key), F.col("lit").alias(lit))


def blocks(literals: list[str], block: int = BLOCK) -> list[list[str]]:
    """The literals in order, cut into lists of `block` characters and at most one literal more."""
    out, room = [], 0
    for x in sorted(literals):
        if room <= 0:
            out.append([])
            room = block
        out[-1].append(x)
        room -= len(x)
    return out


def hits_by_words(texts: DataFrame, literals: DataFrame, often: int = OFTEN) -> DataFrame:
    """(key, lit) by joins: for literals (lit, distinct) of any number.

    A literal's inner words are words of any text that holds it, so texts (key, content) and literals meet on the one that the fewest
    texts have, and are compared then. The longest part of a literal of two words or fewer lies within one word: it
    meets the words by its first characters, five at most, and those words' texts are compared. Words end at blanks; a literal
    of blanks alone is compared with all texts that have a blank.

    A word that more than `often` texts or literals have would send them all to one task. There are few such words, so all workers know them:
    literals learn their numbers without a shuffle, and texts are not moved for them, or dealt to several tasks where a literal has no rarer word.
    """
    parts = F.split("lit", " ")
    words = texts.select("key", F.explode(F.array_distinct(F.split("content", " "))).alias("word"))
    counts = materialize(words.groupBy("word").agg(F.count("*").alias("n")))
    inner = literals.where(F.size(parts) > 2).select("lit", F.explode(F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))).alias("word"))
    numbers = materialize(inner.groupBy("word").agg(F.count("*").alias("m")).join(counts, "word", "left").select("word", "m", F.coalesce("n", F.lit(0)).alias("n")))
    known = F.broadcast(numbers.where(F.col("m") > often).select("word", "n"))
    each = inner.join(known, "word").unionByName(inner.join(known.select("word"), "word", "left_anti").join(numbers.where(F.col("m") <= often).select("word", "n"), "word"))
    rare = each.groupBy("lit").agg(F.min(F.struct("n", "word")).alias("r")).where("r.n > 0").select("lit", F.col("r.word").alias("word"))
    pairs = _meet(words, counts, rare, often)
    longest = F.array_max(F.transform(parts, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = literals.where(F.size(parts) <= 2).select("lit", longest.alias("probe")).withColumn("gram", F.left("probe", F.lit(5)))
    sizes = [r[0] for r in short.select(F.length("gram")).distinct().collect()]  # numbers up to 5
    if sizes:
        pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - n + 1, F.lit(1))), lambda i: F.substring(F.col("word"), i, F.lit(n)))
        cuts = F.array_distinct(F.flatten(F.array(*[F.when(F.length("word") >= n, pieces(n)).otherwise(lit_array([])) for n in sizes])))
        near = counts.select("word", F.explode(cuts).alias("gram")).join(short, "gram").where(F.contains("word", F.col("probe"))).select("word", "lit").distinct()
        pairs = pairs.unionByName(_meet(words, counts, near, often).distinct())
    return pairs.join(texts, "key").where(F.contains("content", F.col("lit"))).select("key", "lit").distinct()


def _meet(words: DataFrame, counts: DataFrame, literals: DataFrame, often: int) -> DataFrame:
    """(key, lit): words (key, word) of texts joined with literals (lit, word); counts (word, n) of texts."""
    used = literals.select("word").distinct().withColumn("used", F.lit(True))
    hot = counts.where(F.col("n") > often).select("word", F.ceil(F.col("n") / often).cast("int").alias("shares"))  # as many as all words of texts by `often` at most
    w = words.join(F.broadcast(hot.join(used, "word", "left")), "word", "left").where("shares is null or used")
    w = w.select("key", "word", F.when(F.col("used"), F.pmod(F.xxhash64("key"), F.col("shares"))).otherwise(F.lit(0)).cast("int").alias("share"))
    of = literals.join(F.broadcast(hot), "word", "left").select("lit", "word", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    return w.join(of, ["word", "share"]).select("key", "lit")
