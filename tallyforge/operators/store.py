"""The document store: contents are kept once, by digest; a version is a table of pointers to them.

    base/contents/batch=<name>   Parquet (sha256, content), what one update brought
    base/pointers/<name>         Parquet (path, sha256, batch), all paths of one version
    base/commits/<number>.json   which pointers and batches make the version

An update writes the contents it accepts and a new table of pointers; contents that are
stored already stay where they are, and older versions can be read as long as they are
kept. A version exists once its commit file does. That file is put where none is, in one
step that fails if another writer was first, so of several writers of one version exactly
one succeeds:

- a local or network file system: a hard link, which never replaces a file;
- hdfs and viewfs: FileContext.rename without overwriting, one operation of the name node;
- abfs and gs: creation without overwriting, which their stores test when the object is closed;
- others, s3a among them, promise nothing of the kind to all clients and are refused.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus_tables import stored

POINTERS = "path string, sha256 string, batch string"
#: Accepted paths up to which they are broadcast (a path and a digest each), so that only accepted contents leave their place.
BROADCAST_PATHS = 500_000


class StoreConflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Staged:
    """What an update has written and not yet published."""

    base: str
    version: int
    pointers: str
    batch: str
    batches: tuple[str, ...]
    changed: bool


def hadoop(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _create(system, at, text: str) -> None:
    out = system.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def _linked(path: str, text: str) -> bool:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "x") as out:
        out.write(text)
    try:
        os.link(draft, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)
    return True


def _renamed(spark: SparkSession, system, at, text: str) -> bool:
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{at}.{uuid.uuid4().hex}")
    _create(system, draft, text)
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, at, no_options)
    except Py4JJavaError as error:
        system.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _created(system, at, text: str) -> bool:
    try:
        _create(system, at, text)
    except Py4JJavaError:
        if system.exists(at):
            return False
        raise
    return True


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Put a whole small file where none is; False, and nothing changed, if there is one already, whoever put it."""
    system, at = hadoop(spark, path)
    scheme = system.getUri().getScheme()
    if scheme == "file":
        return _linked(system.makeQualified(at).toUri().getPath(), text)
    if scheme in ("hdfs", "viewfs"):
        return _renamed(spark, system, at, text)
    if scheme in ("abfs", "abfss", "gs"):
        return _created(system, at, text)
    raise ValueError(f"a store on {scheme} could be published by two writers at once: its files cannot be put only where none is")


def _commit_file(base: str, version: int) -> str:
    return f"{base}/commits/{version:012d}.json"


def store_version(spark: SparkSession, base: str) -> int:
    """The number of the store's newest version, 0 if there is none."""
    system, at = hadoop(spark, f"{base}/commits")
    names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)


def read_commit(spark: SparkSession, base: str, version: int) -> dict:
    return json.loads(spark.read.text(_commit_file(base, version), wholetext=True).first()[0])


def read_pointers(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """(path, sha256, batch) of a version, the newest by default; version 0 is empty. No content is read."""
    version = store_version(spark, base) if version is None else version
    if not version:
        return spark.createDataFrame([], POINTERS)
    return spark.read.schema(POINTERS).parquet(f"{base}/pointers/{read_commit(spark, base, version)['pointers']}")


def read_contents(spark: SparkSession, base: str, version: int) -> DataFrame:
    """(sha256, content, batch) of all batches that a version points into."""
    return spark.read.schema("sha256 string, content binary, batch string").option("basePath", f"{base}/contents").parquet(*[f"{base}/contents/batch={b}" for b in read_commit(spark, base, version)["batches"]])


def read_store(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """(path, sha256, content) of a version, the newest by default; a store without versions is an error."""
    version = store_version(spark, base) if version is None else version
    return read_pointers(spark, base, version).join(read_contents(spark, base, version), ["sha256", "batch"]).select("path", "sha256", "content")


def stage(accepted: DataFrame, landed: DataFrame, base: str, after: int | None = None) -> Staged:
    """accepted (path, sha256) and landed (path, content) -> the next version, written beside the store and not yet part of it.

    Accepted paths get the landed content of their digest; all other paths stay. Only
    contents move that are accepted and not stored yet, each once, whatever the store
    holds and whatever else landed. Rows without path or digest are not accepted; of
    several digests of a path the smallest is. Contents are read back and held against
    their digests: a landed copy that is not there or no longer has its digest raises
    ValueError and leaves nothing behind. after: the version that accepted was judged
    by, the newest by default.
    """
    spark = accepted.sparkSession
    after = store_version(spark, base) if after is None else after
    held = read_pointers(spark, base, after)
    name = uuid.uuid4().hex
    wanted = accepted.where("path is not null and sha256 is not null").groupBy("path").agg(F.min("sha256").alias("sha256"))
    changed = wanted.join(held.select("path", "sha256"), ["path", "sha256"], "left_anti")
    placed = stored(changed.join(held.groupBy("sha256").agg(F.min("batch").alias("batch")), "sha256", "left"), "placed")
    missing = stored(placed.where("batch is null").groupBy("sha256").agg(F.min("path").alias("path")), "missing")
    n_missing = missing.count()
    batches = {r["batch"] for r in held.select("batch").distinct().collect()}  # one an update at most
    if n_missing:
        at = f"{base}/contents/batch={name}"
        fresh_contents(landed, missing, n_missing).write.parquet(at)
        found = spark.read.schema("sha256 string, content binary").parquet(at).agg(F.count("*").alias("n"), F.count_if(F.sha2("content", 256).eqNullSafe(F.col("sha256"))).alias("good")).first()
        if (found["n"], found["good"]) != (n_missing, n_missing):
            _drop(spark, at)
            raise ValueError(f"{n_missing - found['good']} landed files do not have their digests")
        batches.add(name)
    kept = held.join(placed.select("path"), "path", "left_anti")
    kept.union(placed.select("path", "sha256", F.coalesce("batch", F.lit(name)).alias("batch"))).write.parquet(f"{base}/pointers/{name}")
    used = {r["batch"] for r in spark.read.schema(POINTERS).parquet(f"{base}/pointers/{name}").select("batch").distinct().collect()}
    return Staged(base, after + 1, name, name if n_missing else "", tuple(sorted(batches & used)), not placed.isEmpty())


def fresh_contents(landed: DataFrame, missing: DataFrame, n_missing: int) -> DataFrame:
    """(sha256, content): for each missing (sha256, path) the landed content with that digest, once."""
    source = F.broadcast(missing) if n_missing <= BROADCAST_PATHS else missing
    return landed.select("path", "content").join(source, "path").where(F.sha2("content", 256) == F.col("sha256")).select("sha256", "content").dropDuplicates(["sha256"])


def _drop(spark: SparkSession, path: str) -> None:
    system, at = hadoop(spark, path)
    system.delete(at, True)


def publish(spark: SparkSession, staged: Staged) -> int:
    """Make a staged version the store's newest and return its number; StoreConflict, with what was staged deleted, if another writer has that number."""
    commit = {"version": staged.version, "pointers": staged.pointers, "batches": staged.batches}
    if not put_if_absent(spark, _commit_file(staged.base, staged.version), json.dumps(commit)):
        _drop(spark, f"{staged.base}/pointers/{staged.pointers}")
        if staged.batch:
            _drop(spark, f"{staged.base}/contents/batch={staged.batch}")
        raise StoreConflict(f"version {staged.version} was published by another run")
    return staged.version


def update_store(accepted: DataFrame, landed: DataFrame, base: str, after: int | None = None) -> int:
    """stage() and publish(); without a change there is no new version, and the number of the present one is returned."""
    spark = accepted.sparkSession
    staged = stage(accepted, landed, base, after)
    if not staged.changed and staged.version > 1:
        _drop(spark, f"{base}/pointers/{staged.pointers}")
        return staged.version - 1
    return publish(spark, staged)


def store_history(spark: SparkSession, base: str) -> DataFrame:
    """version, n_paths, n_contents, n_new, bytes_new: what each version points to, and the contents it brought."""
    rows = None
    for version in range(1, store_version(spark, base) + 1):
        commit = read_commit(spark, base, version)
        counts = read_pointers(spark, base, version).agg(F.count("*").alias("n_paths"), F.count_distinct("sha256").alias("n_contents"))
        brought = [b for b in commit["batches"] if b == commit["pointers"]]
        contents = read_contents(spark, base, version).where(F.col("batch").isin(brought))
        new = contents.agg(F.count("*").alias("n_new"), F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)).alias("bytes_new")) if brought else spark.range(1).select(F.lit(0).cast("long").alias("n_new"), F.lit(0).cast("long").alias("bytes_new"))
        row = counts.join(F.broadcast(new)).select(F.lit(version).alias("version"), "*")
        rows = row if rows is None else rows.union(row)
    return rows if rows is not None else spark.createDataFrame([], "version int, n_paths long, n_contents long, n_new long, bytes_new long")
