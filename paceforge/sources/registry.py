"""Content-hash file registry and incremental discovery."""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hash_files(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """(provider, path, sha256, length): files by the SHA-256 of their content, gzipped ones by what they hold.

    A broken gzip file has a null hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length")

    def digest(batches):
        for batch in batches:
            out = []
            for content in batch.column(1):
                data = content.as_py()
                try:
                    h = hashlib.sha256()
                    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                    while part := stream.read(1 << 20):
                        h.update(part)
                    out.append(h.hexdigest())
                except (OSError, EOFError, zlib.error):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(2)], ["path", "sha256", "length"])

    return files.mapInArrow(digest, "path string, sha256 string, length long").select(F.lit(provider).alias("provider"), "path", "sha256", "length")


def first_of_batch(files: DataFrame) -> DataFrame:
    """One file per provider and content: the first by path."""
    order = Window.partitionBy("provider", "sha256").orderBy("path")
    return files.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def register(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``outcome``: duplicate if the content was accepted before or comes twice in the batch, invalid without a hash, else accepted."""
    known = registry.select("provider", "sha256").distinct().withColumn("known", F.lit(True))
    order = Window.partitionBy("provider", "sha256").orderBy("path")
    marked = files.join(known, ["provider", "sha256"], "left").withColumn("n", F.row_number().over(order))
    outcome = F.when(F.col("sha256").isNull(), "invalid").when(F.col("known") | (F.col("n") > 1), "duplicate").otherwise("accepted")
    return marked.withColumn("outcome", outcome).drop("known", "n")


def discover(files: DataFrame, activities: DataFrame, registry: DataFrame, since=None) -> DataFrame:
    """Files to import with their ``outcome``: known, bulk_export, no_single_run, before_date or new.

    ``activities`` is (path, kind, local_date), one row per activity of a file.
    """
    runs = activities.where(F.col("kind").isin("running", "trail_running", "treadmill_running")).groupBy("path").agg(F.count("*").alias("runs"), F.max("local_date").alias("local_date"))
    marked = register(files, registry).join(runs, "path", "left")
    name = F.element_at(F.split("path", "/"), -1)
    early = F.col("local_date") < F.lit(since).cast("date") if since is not None else F.lit(False)
    outcome = F.when(F.col("outcome") != "accepted", "known").when(name.rlike(r"^\d+\.fit\.gz$"), "bulk_export").when(F.coalesce("runs", F.lit(0)) != 1, "no_single_run").when(early, "before_date").otherwise("new")
    return marked.withColumn("outcome", outcome)


def outcome_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("outcome").agg(F.count("*").alias("files"))


def logical_name(path):
    """A path as exports name it: forward slashes, no leading dot, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", ""))


def referenced_files(files: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, missing): sensor files (path) with the summary rows (file_name, ...) that name them, and rows whose file is not there.

    Names meet in their logical form; rows without a file name are in neither.
    """
    have = files.select(logical_name(F.col("path")).alias("__name"), *files.columns)
    named = rows.where("file_name is not null").withColumn("__name", logical_name(F.col("file_name")))
    return named.join(have, "__name").drop("__name"), named.join(have.select("__name"), "__name", "left_anti").drop("__name")
