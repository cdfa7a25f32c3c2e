"""Landed copies as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDED = "path string, sha256 string"


def landed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Landing records (path, sha256) as Parquet files appear in a folder."""
    return spark.readStream.schema(LANDED).parquet(folder)


def verified_landings(landed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each landing against the manifest, by a stream-static join: verified, mismatch or unexpected."""
    want = manifest.select("path", F.col("sha256").alias("want")).dropDuplicates(["path"])
    status = F.when(F.col("want").isNull(), "unexpected").when(F.col("want") == F.col("sha256"), "verified").otherwise("mismatch")
    return landed.join(want, "path", "left").select("path", "sha256", status.alias("status"))
