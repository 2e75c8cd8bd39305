"""Personal bests: progression, supersession, best marks and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def progression(performances: DataFrame) -> DataFrame:
    """The strict improvements per athlete and distance, with the best before each.

    ``performances`` is (athlete_id, distance, activity_id, achieved_at,
    elapsed_s); order is by time, then result, then activity.
    """
    order = Window.partitionBy("athlete_id", "distance").orderBy("achieved_at", "elapsed_s", "activity_id").rowsBetween(Window.unboundedPreceding, -1)
    return performances.withColumn("previous_best_s", F.min("elapsed_s").over(order)).where("previous_best_s is null or elapsed_s < previous_best_s")


def supersessions(performances: DataFrame) -> DataFrame:
    """The progression as validity periods: each best is superseded when the next one is achieved."""
    best = progression(performances)
    following = F.lead("achieved_at").over(Window.partitionBy("athlete_id", "distance").orderBy("achieved_at", F.col("elapsed_s").desc()))
    return best.withColumn("superseded_at", following).withColumn("is_current", F.col("superseded_at").isNull())


def rejected(performances: DataFrame) -> DataFrame:
    """The rows that improve nothing."""
    return performances.join(progression(performances).select("athlete_id", "distance", "activity_id"), ["athlete_id", "distance", "activity_id"], "left_anti")


MARK = ("athlete_id", "distance", "activity_id", "elapsed_s", "achieved_on", "effort_type")


def best_marks(verified: DataFrame, observed: DataFrame) -> DataFrame:
    """The fastest mark per athlete and distance, with its source; equal times go to the verified one.

    Both are (athlete_id, distance, activity_id, elapsed_s, achieved_on,
    effort_type), at most one row per athlete and distance. The source is
    verified_result, training_split (a segment of an activity) or
    training_activity.
    """
    split = F.when(F.col("effort_type") == "rolling_segment", "training_split").otherwise("training_activity")
    both = verified.select(*MARK, F.lit("verified_result").alias("source")).unionByName(observed.select(*MARK, split.alias("source")))
    rank = F.struct(F.col("elapsed_s"), (F.col("source") != "verified_result").cast("int"))
    fields = F.struct("activity_id", "elapsed_s", "achieved_on", "effort_type", "source")
    return both.groupBy("athlete_id", "distance").agg(F.min_by(fields, rank).alias("m")).select("athlete_id", "distance", "m.*")


def new_efforts(observed: DataFrame, verified: DataFrame, tolerance_s: float = 2.0) -> DataFrame:
    """Observed efforts without a verified one of the same activity and distance within the tolerance."""
    v = verified.select(F.col("activity_id").alias("v_activity"), F.col("distance").alias("v_distance"), F.col("elapsed_s").alias("v_elapsed"))
    same = (observed["activity_id"] == v["v_activity"]) & (observed["distance"] == v["v_distance"]) & (F.abs(observed["elapsed_s"] - v["v_elapsed"]) <= tolerance_s)
    return observed.join(v, same, "left_anti")


def duplicate_current(periods: DataFrame) -> DataFrame:
    """Athlete and distance pairs with more than one current best."""
    return periods.where("is_current").groupBy("athlete_id", "distance").agg(F.count("*").alias("n")).where("n > 1")
