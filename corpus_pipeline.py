"""The corpus pipeline: toxicity, near duplicates, decontamination, PII, mixing.

Each stage takes (spark, docs, sf_dir), docs holding what the stage before kept,
and returns a DataFrame. run() applies them in order, each written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspindle.llm.common import materialise, small, table
from docspindle.llm.decontam import benchmark_leaks
from docspindle.llm.mixing import mix_sources
from docspindle.llm.pii import replace_pii
from docspindle.llm.queries import pii_key
from docspindle.llm.simhash import fingerprint_groups, fingerprints, with_fingerprints
from docspindle.llm.toxicity import score_toxicity


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't in `ids` (doc_id); null ids stay. The ids are counted, and
    broadcast if they are few, so that texts don't shuffle."""
    gone = materialise(ids.distinct().withColumnRenamed("doc_id", "gone_id"))
    return docs.join(small(gone), docs["doc_id"] == gone["gone_id"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; rows with a null id stay."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.filter("predicted = 1").select("doc_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one of the smallest id (null last),
    then of the smallest fingerprint, then the first by its columns. Rows are grouped by their
    texts alone: rows of one id whose texts differ are documents of their own."""
    prints = materialise(fingerprints(docs, id_col="doc_id", text_col="text", width=4))
    grouped = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id")).alias("first"))
    best = fingerprint_groups(prints).join(grouped, "fp").groupBy("group").agg(F.min(F.struct("first", "fp")).alias("kept"))
    best = materialise(best.select(F.col("kept.first.id").alias("kept_id"), F.col("kept.fp").alias("kept_fp")))
    # Ids of one row are decided by id, so that texts don't shuffle; the rows of others are looked at one by one.
    ids = prints.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("fp").alias("fp"))
    ids = materialise(ids.join(best, (F.col("id") == F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")), "left").filter("n > 1 or kept_id is null").select(F.col("id").alias("doc_id"), "n"))
    twice = materialise(ids.filter("n > 1").select(F.col("doc_id").alias("twice_id")))
    several = docs.join(small(twice), docs["doc_id"] == twice["twice_id"], "left_semi").unionByName(docs.filter("doc_id is null"))
    mark = "fp"
    while mark in docs.columns:
        mark += "_"
    several = with_fingerprints(several, mark)
    several = several.join(best, F.col(mark).eqNullSafe(F.col("kept_fp")) & F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    several = several.groupBy(mark).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return without(docs.filter("doc_id is not null"), ids.select("doc_id")).unionByName(several)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(docs, benchmark_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in texts get surrogates; all documents stay. n_chars follows the text."""
    out = replace_pii(docs, key=pii_key(spark), count_col=None)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", replace_personal_data),
    ("mixing", mix),
]

#: Nearest-example votes and surrogates have no SQL form; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
