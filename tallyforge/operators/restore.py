"""Whole runs: collect what fails, write every sink, and only then fail."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus_tables import read_fact_files, stored
from . import corpus, facts
from .store import read_pointers, store_version, update_store

LETTERS = "id string, error string"


@dataclass(frozen=True)
class Run:
    """What a run left behind: folder has dead_letters and outcome, version is the store's (None where there is none)."""

    name: str
    folder: str
    version: int | None
    failures: int


class RunFailed(RuntimeError):
    """Raised after all sinks were written; run tells where they are."""

    def __init__(self, run: Run, what: str):
        super().__init__(f"{run.failures} {what} failed")
        self.run = run


def _sinks(folder: str, letters: DataFrame, outcome: DataFrame) -> int:
    """Write both sinks; returns the number of letters."""
    letters.select("id", "error").write.parquet(f"{folder}/dead_letters")
    outcome.write.parquet(f"{folder}/outcome")
    return letters.sparkSession.read.schema(LETTERS).parquet(f"{folder}/dead_letters").count()


def landed_digests(manifest: DataFrame, landed: DataFrame) -> DataFrame:
    """(path, sha256) of what landed, one a path: of several copies one that has the manifest's digest, else the smallest."""
    want = manifest.select("path", "sha256").distinct().withColumn("asked", F.lit(True))
    copies = corpus.fingerprint(landed, "content").select("path", "sha256").join(want, ["path", "sha256"], "left")
    return copies.groupBy("path").agg(F.min(F.struct(F.col("asked").isNull().alias("odd"), "sha256"))["sha256"].alias("sha256"))


def restore(manifest: DataFrame, landed: DataFrame, base: str, sinks: str, *, origin: str = corpus.PUBLIC, root: str = corpus.ROOT, strict: bool = False) -> Run:
    """Bring the store at base up to the manifest from landed (path, content).

    Rows of the origin are classified once, against the store's newest version. Verified
    copies are published as one new version (none if nothing changes), dead letters
    (id, error) and the outcome (status, n) are written below sinks/run=<name>, and then
    any failure raises RunFailed with their number, so that a run that failed in part has
    restored the rest and said what is lacking. strict: a path outside the root raises
    ValueError before anything is written. A version that another run published in the
    meantime raises StoreConflict before the sinks are written; the run can be repeated.
    """
    spark = manifest.sparkSession
    asked = corpus.origin_filter(manifest, origin)
    if strict:
        corpus.require_inside(asked, root)
    name, before = uuid.uuid4().hex, store_version(spark, base)
    classified = stored(corpus.classify(asked, read_pointers(spark, base, before), landed_digests(asked, landed), root), "classified")
    accepted = classified.where(F.col("status").isin("new", "replaced")).select("path", "sha256")
    version = update_store(accepted, landed, base, before)
    folder = f"{sinks}/run={name}"
    failures = _sinks(folder, corpus.dead_letter(classified), corpus.run_outcome(classified))
    run = Run(name, folder, version, failures)
    if failures:
        raise RunFailed(run, "documents")
    return run


def load_facts(spark: SparkSession, path: str, target: str, sinks: str, *, multi_line: bool = True) -> Run:
    """Read fact files into a new Parquet table at target: all that can be read, parsed.

    Broken files, files without facts and facts without a readable value or period become
    dead letters; the outcome counts facts read and letters by reason. Then any letter
    raises RunFailed.
    """
    name = uuid.uuid4().hex
    flat, broken = read_fact_files(spark, path, multi_line=multi_line)
    flat, broken = stored(flat, "flat"), stored(broken.drop("record"), "broken")
    good, unread = facts.read_facts(flat)
    good.write.parquet(target)
    reasons = broken.select(F.col("reason").alias("status")).union(unread.select(F.concat(F.lit("unreadable "), "reason").alias("status")))
    outcome = reasons.union(good.select(F.lit("read").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))
    folder = f"{sinks}/run={name}"
    failures = _sinks(folder, facts.file_letters(broken).union(facts.fact_letters(unread)), outcome)
    run = Run(name, folder, None, failures)
    if failures:
        raise RunFailed(run, "files and facts")
    return run
