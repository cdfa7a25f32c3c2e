"""Reconciling a document manifest with stored and landed copies, and keeping corpora apart.

Joins are on paths and digests; contents move only in store.py, and there only accepted ones.
All operators are DataFrame expressions. Rows without a path or digest match nothing;
repeated rows are each returned unless an operator says otherwise; empty tables give
empty results, or results as for nothing present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import inside, resolved_segments

PUBLIC = "public_original"
ROOT = "corpus/files"
FAILED = ("rejected_path", "path_conflict", "not_landed", "mismatch")


def origin_filter(manifest: DataFrame, origin: str = PUBLIC) -> DataFrame:
    """Rows of exactly this origin; the comparison reaches the scan."""
    return manifest.where(F.col("origin") == origin)


def normalize_path(df: DataFrame, root: str = ROOT) -> DataFrame:
    """Adds norm_path: backslashes turned, joined to the root, . and .. resolved."""
    return df.withColumn("norm_path", F.concat_ws("/", resolved_segments(F.col("path"), root)))


def reject_escaping_paths(df: DataFrame, root: str = ROOT) -> tuple[DataFrame, DataFrame]:
    """(rows whose path stays in the root, the others)."""
    ok = inside(resolved_segments(F.col("path"), root), root)
    return df.where(ok), df.where(~F.coalesce(ok, F.lit(False)))


def require_inside(df: DataFrame, root: str = ROOT) -> DataFrame:
    """The rows, all tested before anything is written: any that leaves the root fails the run."""
    _, bad = reject_escaping_paths(df, root)
    if not bad.isEmpty():
        raise ValueError("the manifest has paths outside the root")
    return df


def fingerprint(df: DataFrame, column: str) -> DataFrame:
    """Adds sha256 of the full content, lower-case hex."""
    return df.withColumn("sha256", F.sha2(F.col(column).cast("binary"), 256))


def freshness(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Adds state: current if the stored copy has the manifest's digest exactly, stale, or absent. A path stored several times counts once, as current if any copy is."""
    exact = store.select("path", "sha256").distinct().withColumn("exact", F.lit(True))
    there = store.select("path").distinct().withColumn("there", F.lit(True))
    state = F.when(F.col("exact"), "current").when(F.col("there"), "stale").otherwise("absent")
    return manifest.join(exact, ["path", "sha256"], "left").join(there, "path", "left").select(*(manifest[c] for c in manifest.columns), state.alias("state"))


def pending(manifest: DataFrame, store: DataFrame) -> DataFrame:
    """Rows that no stored copy satisfies."""
    return manifest.join(store.select("path", "sha256"), ["path", "sha256"], "left_anti")


def classify(manifest: DataFrame, store: DataFrame, landed: DataFrame, root: str = ROOT) -> DataFrame:
    """manifest with status and error; the first that holds of rejected_path, path_conflict, current, not_landed, mismatch, new, replaced.

    Equal (path, sha256) rows count once each and share a status; different digests
    on one path are a conflict. Copies are one a path in store and landed.
    """
    held = store.select("path", F.col("sha256").alias("stored"))
    came = landed.select("path", F.col("sha256").alias("landed"))
    many = manifest.groupBy("path").agg((F.min("sha256") != F.max("sha256")).alias("conflict"))
    joined = manifest.join(many, "path", "left").join(held, "path", "left").join(came, "path", "left")
    ok = F.coalesce(inside(resolved_segments(F.col("path"), root), root), F.lit(False))
    status = (
        F.when(~ok, "rejected_path").when(F.col("conflict"), "path_conflict").when(F.col("stored") == F.col("sha256"), "current").when(F.col("landed").isNull(), "not_landed")
        .when(F.col("sha256").isNull() | (F.col("landed") != F.col("sha256")), "mismatch").when(F.col("stored").isNull(), "new").otherwise("replaced")
    )
    return joined.withColumn("status", status).withColumn("error", F.when(status.isin(*FAILED), F.concat(status, F.lit(": "), F.col("path"))))


def verified_replace(classified: DataFrame, store: DataFrame) -> DataFrame:
    """The new store's digests (path, sha256): verified landed copies replace stored ones, all others stay."""
    fresh = classified.where(F.col("status").isin("new", "replaced")).select("path", F.col("landed").alias("verified")).distinct()
    return store.select("path", "sha256").join(fresh, "path", "full_outer").select("path", F.coalesce("verified", "sha256").alias("sha256"))


def dead_letter(classified: DataFrame) -> DataFrame:
    """(id, error) of the rows that failed."""
    return classified.where(F.col("status").isin(*FAILED)).select("id", "error")


def run_outcome(classified: DataFrame) -> DataFrame:
    """Rows by status."""
    return classified.groupBy("status").agg(F.count("*").alias("n"))


def fail_on_errors(outcome: DataFrame) -> None:
    """Raise with the number of failures, after all rows were tried and the sinks written."""
    n = outcome.where(F.col("status").isin(*FAILED)).agg(F.sum("n")).first()[0]
    if n:
        raise RuntimeError(f"{n} documents failed")


def completeness(required: DataFrame, present: DataFrame) -> DataFrame:
    """(group, path) required and present -> group, ready, missing_paths. Present paths of other groups count for nothing, repeated ones once; a required null path is never present. A group's list is as long as what it lacks."""
    here = present.select("group", "path", F.lit(True).alias("here")).distinct()
    missing = F.sort_array(F.collect_list(F.when(F.col("here").isNull(), F.col("path"))))
    rows = required.join(here, ["group", "path"], "left").groupBy("group").agg(missing.alias("missing_paths"))
    return rows.select("group", (F.size("missing_paths") == 0).alias("ready"), "missing_paths")


#: grouping_id of a rollup by source and origin: what a row counts.
LEVELS = {0: "origin", 1: "source", 3: "all"}


def source_groups(manifest: DataFrame) -> DataFrame:
    """level, source, origin, n: documents by source and origin, by source, and all. A null source or origin is a group of its own, told from a total, whose columns summed over are null, by the level."""
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.grouping_id("source", "origin").cast("int")]
    return manifest.rollup("source", "origin").agg(level.alias("level"), F.count("*").alias("n")).select("level", "source", "origin", "n")


def against_expected(groups: DataFrame, expected: DataFrame) -> DataFrame:
    """source_groups() against expected (level, source, origin, n): level, source, origin, n, expected, status.

    status: met, short, over, absent (expected and not there; n is null) or unexpected.
    Nulls in keys are equal. Expecting 0 of a group that is not there is met. An expected
    row without a number is compared as 0. Repeated expected rows of one group add up.
    """
    key = ("level", "source", "origin")
    x = groups.select(*(F.col(k).alias(f"x_{k}") for k in key), "n", F.lit(True).alias("in_x"))
    y = expected.groupBy(*key).agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("expected")).select(*(F.col(k).alias(f"y_{k}") for k in key), "expected", F.lit(True).alias("in_y"))
    same = [F.col(f"x_{k}").eqNullSafe(F.col(f"y_{k}")) for k in key]
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when(F.col("in_y").isNull(), "unexpected").when(n == F.col("expected"), "met").when(F.col("in_x").isNull(), "absent")
        .when(n < F.col("expected"), "short").otherwise("over")
    )
    keys = [F.when(F.col("in_x"), F.col(f"x_{k}")).otherwise(F.col(f"y_{k}")).alias(k) for k in key]
    return x.join(y, same, "full_outer").select(*keys, "n", "expected", status.alias("status"))


def holdout_split(manifest: DataFrame, pct: int = 20) -> DataFrame:
    """Adds split: whole sources are tuning or holdout, by a stable hash; rows without source are tuning."""
    bucket = F.conv(F.substring(F.sha2("source", 256), 1, 8), 16, 10).cast("long") % 100
    return manifest.withColumn("split", F.when(bucket < pct, "holdout").otherwise("tuning"))


def holdout_leaks(split: DataFrame) -> DataFrame:
    """Holdout rows whose digest or source tuning has too, each once however often tuning has it; null digests and sources are equal to none."""
    tuning = split.where("split = 'tuning'")
    held = split.where("split = 'holdout'")
    digests = tuning.select("sha256").distinct().withColumn("same_content", F.lit(True))
    sources = tuning.select("source").distinct().withColumn("same_source", F.lit(True))
    joined = held.join(digests, "sha256", "left").join(sources, "source", "left")
    return joined.where("same_content or same_source").select("id", "source", F.coalesce("same_content", F.lit(False)).alias("same_content"), F.coalesce("same_source", F.lit(False)).alias("same_source"))


# What counts as private data or a usage note in a sample.
PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "card": r"\b\d{16}\b",
    "token": r'token = "[0-9a-f]{40}"',
}
LICENCE = r"(?i)\blicen[cs]ed? "


def admission_gate(docs: DataFrame, *, least: int = 100, most: int = 20_000) -> DataFrame:
    """(doc_id, source, text) -> doc_id, admitted, reasons: what keeps a document out of the samples."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.char_length(text)
    rules = [F.when(F.col("source").isNull(), "no_source"), F.when(~text.rlike(LICENCE), "no_licence"), F.when((size < least) | (size > most), "size")]
    rules += [F.when(text.rlike(p), name) for name, p in PRIVATE.items()]
    reasons = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return docs.select("doc_id", (F.size(reasons) == 0).alias("admitted"), F.array_join(reasons, ",").alias("reasons"))
