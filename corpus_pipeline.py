"""A training-corpus pipeline: documents pass five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, jaccard_join, langid, packing, pii
from tallyforge.llm.store import discard, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose best language has a smaller posterior are no clear text of any learned language.
LEAST_POSTERIOR = 0.5
#: Rows sent to Python at once, at most: documents are long, and an executor and its worker each hold a batch.
BATCH_ROWS = 500


def batched(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose result, written by whoever calls it, goes to Python at most BATCH_ROWS rows at a time; the session keeps that setting."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = int(spark.conf.get(key))
        spark.conf.set(key, str(min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@batched
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; doubtful ones and those no language tells better than the background go. lang becomes what was found."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))).select("lang", "text"))
    judged = langid.identify(docs.select(*COLUMNS), langid.with_background(model))
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@batched
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, rows without one last, then of the smallest row hash. Rows without words all stay."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("__key"))
    groups = written(jaccard_join.jaccard_components(keyed.select(F.col("__key").alias("doc_id"), "text"), shingle=5, percent=80).where("n_shingles > 0"), "groups")
    rows = groups.groupBy(F.col("doc_id").alias("__key"), "component_id").agg(F.count("*").alias("copies"))
    named = rows.join(keyed.select("__key", "doc_id").distinct(), "__key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key"))["__key"].alias("first"))
    gone = rows.join(first, "component_id").where("__key <> first").select("__key")
    # rows equal in doc_id and text have one key: of those that stay, any one row
    again = written(rows.where("copies > 1").join(first, "component_id").where("__key = first").select("__key"), "again")
    once = keyed.join(gone.union(again), "__key", "left_anti")
    return once.union(keyed.join(again, "__key", "left_semi").dropDuplicates(["__key"]).select(*once.columns)).select(*COLUMNS)


@batched
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


@batched
def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose it generalised; n_chars counts the new text."""
    return pii.find_personal_data(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", sanitise),
    ("packing", pack),
]

#: SQL cannot express the models, alignments and packing of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
