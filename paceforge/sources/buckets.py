"""Tables of fixed buckets whose writes replace whole buckets, also by nothing.

Rows of touched buckets are written under a version of their own; what a bucket
consists of is told by a manifest, one small file per commit, that is written
last. A write that fails before its manifest leaves the table as it was, one
that is repeated under the same commit replaces itself, and a bucket that lost
all rows points to a version without rows of it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "commit long, bucket int, version long"


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(bucket, version) of the last commit, or of the last one before ``before``; one row per bucket at most."""
    try:
        commits = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "bucket int, version long")
    if before is not None:
        commits = commits.where(F.col("commit") < before)
    last = commits.agg(F.max("commit").alias("commit")).first()["commit"]
    return commits.where(F.col("commit") == F.lit(last)).where("bucket is not null").select("bucket", "version")


def read_buckets(spark: SparkSession, path: str, schema: StructType | str, touched: DataFrame | None = None, before: int | None = None) -> DataFrame:
    """The rows (with ``bucket``) of the last commit, or of the last one before ``before``; with ``touched`` (bucket) only those buckets are read."""
    wanted = _manifest(spark, path, before)
    if touched is not None:
        wanted = wanted.join(touched.select("bucket").distinct(), "bucket", "left_semi")
    kinds = spark.createDataFrame([], schema).schema
    try:
        rows = spark.read.schema(StructType([*kinds.fields]).add("version", "long").add("bucket", "integer")).parquet(f"{path}/data")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds).withColumn("bucket", F.lit(None).cast("int"))
    # a row per bucket: the scan is pruned to the partitions of the versions that count
    return rows.join(F.broadcast(wanted), ["version", "bucket"], "left_semi").drop("version")


def write_buckets(rows: DataFrame, touched: DataFrame, path: str, commit: int) -> None:
    """Make ``rows`` (with ``bucket``) the whole content of the ``touched`` (bucket) buckets; other buckets stay. Commits count up."""
    spark = rows.sparkSession
    touched = touched.select("bucket").distinct()
    rows.join(F.broadcast(touched), "bucket", "left_semi").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={commit}")
    kept = _manifest(spark, path, commit).join(touched, "bucket", "left_anti")
    now = kept.unionByName(touched.select("bucket", F.lit(commit).cast("long").alias("version")))
    # a commit without buckets is a commit, too
    blank = spark.createDataFrame([(None, None)], "bucket int, version long")
    now.unionByName(blank).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/commit={commit}")
