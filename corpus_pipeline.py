"""A training corpus from documents: five stages, each one operator of tessera.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import compression, decontam, mixing, pii, simhash
from tessera.llm.common import beside, materialize, read, release, small_batches, written
from tessera.llm.queries import held_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Documents that the compression classifier scores below the threshold go. It learns from labelled rows as op6_quality does.

    Null and empty texts have the score of no difference; equal rows have equal scores; a score equal to the threshold
    stays. Without labels of both classes the share of good ones decides. All columns stay as they are, whatever
    their names; an empty table stays empty.
    """
    model = compression.train(docs.where(~held_out("doc_id", 5, 0)), read(spark, sf_dir, "labels"))
    scored = compression.score_documents(docs.select(F.struct(*docs.columns).alias("d"), F.col("text")), model)
    return scored.where(F.col("score") >= threshold).select("d.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 or more in common) stays, the one of least id.

    Nulls come last; ties of ids go to the text of least hash; of rows equal in id and text one stays. Null and empty
    texts are one group. All columns stay, whatever their names; an empty table stays empty.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a ten-word window of a benchmark item occurs go.

    Null and empty texts have no windows and stay; repeated rows go or stay together. All columns stay, whatever
    their names; without items, and for an empty table, nothing changes.
    """
    marked = decontam.contamination(docs.select(F.struct(*docs.columns).alias("d"), F.col("text")), read(spark, sf_dir, "benchmark"))
    return marked.where(F.col("contamination")["n_hit"] == 0).select("d.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in angle brackets; n_chars follows, where there is such a column.

    Overlapping spans become one, named by the first. A null text stays null, an empty one empty; every row stays, repeated
    ones too, with all its columns, whatever their names.
    """
    small_batches(spark)
    text = pii.redact(F.col("text"), pii.train())
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, how often (copies), and the words so taken, against their source's target.

    Null texts have no words, a null source is a source, repeated rows are rows of their own; ties in rank go by id and
    size. Columns of the documents with the names of these results stay under names that end in _in; an empty table
    stays empty.
    """
    mixed = mixing.pareto_mix(docs, keep=tuple(docs.columns))
    made = ["size", "source_size", "target", "copies", "taken"]
    return mixed.where("copies > 0").select(*beside(docs.columns, F.col("kept"), made), *made)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mix", mix),
]
#: Compression, SimHash and the random field are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = read(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, since, (docs,))  # the stage before, and what this one wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
