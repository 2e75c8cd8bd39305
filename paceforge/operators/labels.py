"""The queue of results that wait for a human label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import review_token

#: Columns of the queue (fixed values).
SCHEMA = (
    "dataset_version string, activity_id string, activity_name string, achieved_at timestamp, matched_distance string, measured_distance_m double, "
    "recorded_elapsed_time_seconds double, distance_deviation_pct double, review_status string, review_label string, verified_elapsed_time_seconds double, review_notes string"
)
KEY = ("activity_id", "matched_distance")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """The queue from CSV; a missing column is an error, values that cannot be read are null and become findings."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if missing := [n for n in names if n not in raw.columns]:
        raise ValueError(f"the label queue lacks {', '.join(missing)}")
    kinds = dict(f.split(" ") for f in SCHEMA.split(", "))
    return raw.select(*[F.col(n).try_cast(kinds[n]).alias(n) for n in names])


def queue_findings(queue: DataFrame) -> DataFrame:
    """(activity_id, matched_distance, code): repeated keys, bad numbers, status without its label, mixed versions."""
    keys = list(KEY)
    repeated = queue.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("LABEL_REPEATED").alias("code"))
    bad = queue.where("coalesce(measured_distance_m, 0) <= 0 or coalesce(recorded_elapsed_time_seconds, 0) <= 0").select(*keys, F.lit("LABEL_NUMBER_INVALID").alias("code"))
    verified = (F.col("review_status") == "verified") & (F.col("review_label").isNull() | ~F.coalesce(F.col("verified_elapsed_time_seconds") > 0, F.lit(False)))
    status = queue.where(verified | ~F.coalesce(F.col("review_status").isin("unreviewed", "verified", "excluded"), F.lit(False))).select(*keys, F.lit("LABEL_STATUS_INVALID").alias("code"))
    mixed = queue.agg(F.count_distinct("dataset_version").alias("n")).where("n > 1").select(F.lit(None).cast("string").alias(keys[0]), F.lit(None).cast("string").alias(keys[1]), F.lit("LABEL_VERSION_MIXED").alias("code"))
    return repeated.unionByName(bad).unionByName(status).unionByName(mixed)


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count("*").alias("total"), *[F.count_if(F.col("review_status") == s).alias(s) for s in ("verified", "excluded", "unreviewed")])


def page(queue: DataFrame, status: str | None = None, offset: int = 0, limit: int = 25) -> DataFrame:
    """Up to 100 candidates from an offset, oldest first."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100 and offset not negative")
    chosen = queue if status is None else queue.where(F.col("review_status") == status)
    return chosen.orderBy("achieved_at", *KEY).offset(offset).limit(limit)


def by_token(queue: DataFrame, token: str) -> DataFrame:
    """The rows whose recomputed token is the given one."""
    return queue.where(review_token(F.col("dataset_version"), F.col("activity_id")) == token)


def resolve_tokens(queue: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``token``, findings): each token of ``tokens`` that exactly one row recomputes; the others are findings."""
    own = queue.withColumn("token", review_token(F.col("dataset_version"), F.col("activity_id")))
    met = tokens.select("token").distinct().join(own, "token", "left")
    counted = met.withColumn("n", F.count("activity_id").over(Window.partitionBy("token")))
    code = F.when(F.col("n") == 0, "TOKEN_UNKNOWN").otherwise("TOKEN_NOT_UNIQUE")
    return counted.where("n = 1").drop("n"), counted.where("n <> 1").select("token", code.alias("code")).distinct()


def apply_reviews(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue with the decisions (key, review_status, review_label, verified_elapsed_time_seconds, review_notes) of known rows.

    A decision without a match changes nothing; a verified one needs label and
    time, or it is left out.
    """
    fields = ["review_status", "review_label", "verified_elapsed_time_seconds", "review_notes"]
    sound = (F.col("review_status") != "verified") | F.col("review_label").isNotNull() & (F.col("verified_elapsed_time_seconds") > 0)
    new = decisions.where(sound).dropDuplicates(list(KEY)).select(*KEY, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("decided"))
    joined = queue.join(new, list(KEY), "left")
    return joined.select(*[F.when(F.col("decided"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in queue.columns])


def verified_observations(queue: DataFrame) -> DataFrame:
    """What validation may read: verified rows only."""
    return queue.where("review_status = 'verified'").select("activity_id", F.col("matched_distance").alias("distance"), F.col("verified_elapsed_time_seconds").alias("elapsed_s"), "achieved_at", F.col("review_label").alias("label"))
