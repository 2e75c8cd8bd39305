"""Sinks: wide feature sets, validation reports and replaced detail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import official_metres
from ..operators.features import HORIZONS
from .buckets import bucket_of, read_buckets, write_buckets


#: Columns of an exported feature set before those of the windows (fixed names), and what they hold here.
BASE_COLUMNS = {
    "dataset_version": "dataset_version",
    "activity_id": "activity_id",
    "activity_name": "activity_name",
    "achieved_at": "achieved_at",
    "matched_distance": "distance",
    "measured_distance_m": "distance_m",
    "recorded_elapsed_time_seconds": "elapsed_s",
    "distance_deviation_pct": "deviation_pct",
    "review_status": "review_status",
    "review_label": "review_label",
    "verified_elapsed_time_seconds": "label_s",
    "review_notes": "review_notes",
    "prior_history_runs": "prior_history_runs",
    "prior_history_days": "prior_history_days",
    "prior_acute_load": "prior_acute_load",
    "prior_chronic_load": "prior_chronic_load",
    "prior_form_index": "prior_form_index",
    "prior_5k_best_seconds": "prior_5k_s",
    "prior_10k_best_seconds": "prior_10k_s",
    "prior_half_marathon_best_seconds": "prior_half_marathon_s",
    "prior_marathon_best_seconds": "prior_marathon_s",
}
#: Columns of each window (fixed names), and what they hold here.
WINDOW_COLUMNS = {
    "runs": "runs",
    "distance_km": "distance_km",
    "moving_hours": "moving_hours",
    "longest_run_km": "longest_run_km",
    "weighted_pace_seconds_per_km": "weighted_pace",
    "elevation_gain_m": "elevation_m",
    "activities_with_heart_rate": "hr_runs",
    "duration_load_minutes": "load_min",
    "classified_sessions": "classified",
    "quality_sessions": "quality",
    "easy_sessions": "easy",
    "long_sessions": "long",
    "progressive_sessions": "progressive",
    "tempo_sessions": "tempo",
    "hill_sessions": "hills",
    "interval_sessions": "intervals",
    "race_sessions": "race",
    "unclassified_sessions": "unclassified",
}


def export_columns(dataset: DataFrame, activities: DataFrame, version: str, reviews: DataFrame | None = None) -> DataFrame:
    """A feature dataset (``features.feature_dataset``) in the export's columns.

    ``activities`` is (activity_id, name, distance_m, elapsed_s), ``reviews``
    (activity_id, distance, review_label, review_notes) of what was reviewed.
    """
    about = activities.select("activity_id", F.col("name").alias("activity_name"), F.col("distance_m").cast("double").alias("distance_m"), "elapsed_s")
    full = dataset.join(about, "activity_id")
    if reviews is None:
        full = full.withColumns({"review_label": F.lit(None).cast("string"), "review_notes": F.lit(None).cast("string")})
    else:
        full = full.join(reviews.select("activity_id", "distance", "review_label", "review_notes"), ["activity_id", "distance"], "left")
    official = official_metres(F.col("distance"))
    full = full.withColumns({"dataset_version": F.lit(version), "achieved_at": F.col("start_utc"), "deviation_pct": F.round((F.col("distance_m") - official) / official * 100, 6)})
    windows = {f"prior_{n}d_{name}": f"prior_{n}d_{own}" for n in HORIZONS for name, own in WINDOW_COLUMNS.items()}
    return full.select(*[F.col(own).alias(name) for name, own in (BASE_COLUMNS | windows).items()])


def write_features(features: DataFrame, path: str) -> None:
    """A feature set as CSV with a header, nulls as empty fields."""
    features.write.mode("overwrite").option("header", True).csv(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Validation metrics as JSON lines."""
    metrics.write.mode("overwrite").json(path)


DETAIL_BUCKETS = 256


def replace_detail(detail: DataFrame, changed: DataFrame, path: str, commit: int, buckets: int = DETAIL_BUCKETS) -> None:
    """Put the whole new detail of the ``changed`` activities in place of what is stored of them.

    ``detail`` has the new rows of the changed activities; one without rows
    there has none afterwards. Other activities keep theirs. Only the changed
    buckets are read and written (``buckets.write_buckets``); a write that
    fails leaves the old state, a repeated commit replaces itself.
    """
    spark, key = detail.sparkSession, bucket_of("activity_id", buckets)
    ids = changed.select("activity_id").distinct()
    touched = ids.select(key.alias("bucket")).distinct()
    old = read_buckets(spark, path, detail.schema, touched, before=commit).join(ids, "activity_id", "left_anti")
    new = detail.join(ids, "activity_id", "left_semi").withColumn("bucket", key).select(*old.columns)
    write_buckets(old.unionByName(new), touched, path, commit)


def read_detail(spark: SparkSession, path: str, schema) -> DataFrame:
    return read_buckets(spark, path, schema).drop("bucket")


def changed_sources(selected: DataFrame, stored: DataFrame) -> DataFrame:
    """Activities whose selected sensor source or content hash differs from the stored one, and those that are new."""
    s = stored.select("activity_id", F.col("source_id").alias("old_source"), F.col("sha256").alias("old_sha256"))
    joined = selected.join(s, "activity_id", "left")
    return joined.where(~(F.col("source_id").eqNullSafe(F.col("old_source")) & F.col("sha256").eqNullSafe(F.col("old_sha256")))).drop("old_source", "old_sha256")
