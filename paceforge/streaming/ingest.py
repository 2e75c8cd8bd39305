"""Incremental ingest of dropped files, and recomputation for the athletes they touch.

Records are stored by a bucket of the athlete, so what a batch needs of the
past, hashes for telling repeated records and loads for taking a series up
again, lies in the buckets that it touches. Nothing is kept as streaming state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.workload import BLOCK_DAYS, resume_points, resumed_series
from ..sources.buckets import bucket_of, read_buckets, write_buckets

CONTENT = "content_sha256"
#: Records of a bucket, about, in a table of the expected size.
BUCKET_ROWS = 5_000_000
SERIES = "athlete_id long, local_date date, daily_load double, acute_load double, chronic_load double, form_index double, coverage_pct double, history_days int"
ENDS = "athlete_id long, first date, block long, acute double, chronic double"


def buckets_for(rows: int) -> int:
    """A number of buckets for a table that shall hold so many rows; it stays the same for the life of the table."""
    return 1 << max(4, (rows // BUCKET_ROWS).bit_length())


def read_drops(spark: SparkSession, path: str, schema: StructType | str, file_format: str = "json", max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream of records with the hash of their content."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(file_format).load(path)
    return rows.withColumn(CONTENT, F.sha2(F.to_json(F.struct(*rows.columns)), 256))


def stored_records(spark: SparkSession, path: str, schema: StructType, touched: DataFrame | None = None) -> DataFrame:
    """The stored records with ``bucket`` and ``batch_id``; with ``touched`` only of its buckets."""
    kinds = StructType([*schema.fields]).add("bucket", "integer").add("batch_id", "long")
    try:
        rows = spark.read.schema(kinds).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds)
    return rows if touched is None else rows.join(F.broadcast(touched), "bucket", "left_semi")


def append_new(batch: DataFrame, batch_id: int, path: str, buckets: int) -> DataFrame:
    """Store the records of a batch that no earlier batch has brought, each once, and return them.

    Equal records are of one athlete, so only hashes of the touched buckets are
    looked up. A batch that is run again does not know itself and replaces what
    it had stored.
    """
    marked = batch.withColumn("bucket", bucket_of("athlete_id", buckets))
    touched = marked.select("bucket").distinct()  # at most ``buckets`` rows
    known = stored_records(batch.sparkSession, path, batch.schema, touched).where(F.col("batch_id") < batch_id).select("bucket", "provider", CONTENT)
    new = marked.dropDuplicates(["provider", CONTENT]).join(known, ["bucket", "provider", CONTENT], "left_anti").select(*marked.columns, F.lit(batch_id).cast("long").alias("batch_id"))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(path)
    return stored_records(batch.sparkSession, path, batch.schema, touched).where(F.col("batch_id") == batch_id)


def _history(batch: DataFrame, batch_id: int, path: str, touched: DataFrame) -> DataFrame:
    return stored_records(batch.sparkSession, path, batch.schema, touched).where(F.col("batch_id") <= batch_id)


def run_ingest(drops: DataFrame, table: str, results: str, checkpoint: str, compute: Callable[[DataFrame], DataFrame], schema: str, buckets: int = 64) -> StreamingQuery:
    """Take what is there and stop: append new records, recompute the touched athletes and replace their results.

    ``compute`` gets the whole history of these athletes, so late records are
    always absorbed; it returns rows of ``schema`` with athlete_id. Only the
    touched buckets are read and written; the results are a table of
    ``sources.buckets``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = append_new(batch, batch_id, table, buckets).select("athlete_id", "bucket").distinct().persist()
        try:
            touched, athletes = new.select("bucket").distinct(), new.select("athlete_id")
            history = _history(batch, batch_id, table, touched).join(athletes, "athlete_id", "left_semi").drop("bucket", "batch_id")
            old = read_buckets(spark, results, schema, touched, before=batch_id).join(athletes, "athlete_id", "left_anti")
            now = compute(history)
            write_buckets(old.unionByName(now.withColumn("bucket", bucket_of("athlete_id", buckets)).select(*old.columns)), touched, results, batch_id)
        finally:
            new.unpersist()

    return drops.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_workload(history: DataFrame, changed: DataFrame, touched: DataFrame, root: str, commit: int, buckets: int, block_days: int = BLOCK_DAYS) -> None:
    """Bring the stored series and block states of the athletes in ``changed`` (athlete_id, local_date) up to date.

    ``history`` (athlete_id, local_date, load) holds the records of the touched
    buckets. Each series is taken up again at the earliest block with a changed
    day; loads before it are not summed again, days before it stay. States of
    the commit itself are not read, so that it can be repeated.
    """
    spark = history.sparkSession
    ends = read_buckets(spark, f"{root}/ends", ENDS, touched, before=commit)
    series = read_buckets(spark, f"{root}/series", SERIES, touched, before=commit)
    points = resume_points(ends, changed, block_days)
    begin = points.select("athlete_id", "from_block", F.expr(f"date_add(first, cast(from_block * {block_days} as int))").alias("begin"))
    late = history.join(begin, "athlete_id").where(F.col("local_date") >= F.col("begin"))
    daily = late.groupBy("athlete_id", "local_date").agg(F.sum("load").alias("daily_load"))
    now, now_ends = resumed_series(daily, points, block_days)

    def kept(old: DataFrame, stays) -> DataFrame:
        met = old.join(begin, "athlete_id", "left")
        return met.where(F.col("begin").isNull() | stays).select(*old.columns)

    def put(rows: DataFrame, name: str, old: DataFrame, stays) -> None:
        whole = kept(old, stays).unionByName(rows.withColumn("bucket", bucket_of("athlete_id", buckets)).select(*old.columns))
        write_buckets(whole, touched, f"{root}/{name}", commit)

    put(now.withColumn("history_days", F.col("history_days").cast("int")), "series", series, F.col("local_date") < F.col("begin"))
    put(now_ends, "ends", ends, F.col("block") < F.col("from_block"))


def run_workload(drops: DataFrame, root: str, checkpoint: str, buckets: int = 64, block_days: int = BLOCK_DAYS) -> StreamingQuery:
    """Take dropped records (provider, athlete_id, local_date, load) in and keep ``root``/series up to date."""

    def step(batch: DataFrame, batch_id: int) -> None:
        new = append_new(batch, batch_id, f"{root}/records", buckets).persist()
        try:
            touched = new.select("bucket").distinct()
            history = _history(batch, batch_id, f"{root}/records", touched)
            refresh_workload(history.select("athlete_id", "local_date", "load"), new.select("athlete_id", "local_date"), touched, root, batch_id, buckets, block_days)
        finally:
            new.unpersist()

    return drops.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_workload(spark: SparkSession, root: str) -> DataFrame:
    return read_buckets(spark, f"{root}/series", SERIES).drop("bucket")
