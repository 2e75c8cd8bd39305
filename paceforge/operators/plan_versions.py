"""Plan versions: append on change, keep what was run, decide on a refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_hash(fields: list[str]) -> Column:
    """SHA-256 of the canonical JSON of the fields that a plan was made from, in their given order."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def store_versions(existing: DataFrame, calculated: DataFrame) -> DataFrame:
    """(goal_id, version, evidence_hash, status, action) of all plan versions after storing one calculated plan per goal.

    ``existing`` is (goal_id, version, evidence_hash, status), ``calculated``
    (goal_id, evidence_hash). A known hash makes that version active again,
    another one is appended with the next number; all other versions of the
    goal are superseded. Goals without a calculated plan stay as they are.
    """
    new = calculated.select("goal_id", F.col("evidence_hash").alias("new_hash"))
    joined = existing.join(new, "goal_id", "left")
    same = F.col("evidence_hash") == F.col("new_hash")
    old = joined.select(
        "goal_id",
        "version",
        "evidence_hash",
        F.when(F.col("new_hash").isNull(), F.col("status")).when(same, "active").otherwise("superseded").alias("status"),
        F.when(F.col("new_hash").isNull(), "kept").when(same & (F.col("status") == "active"), "reused").when(same, "reactivated").when(F.col("status") == "active", "superseded").otherwise("kept").alias("action"),
    )
    last = existing.groupBy("goal_id").agg(F.max("version").alias("last"))
    known = existing.select("goal_id", "evidence_hash")
    fresh = calculated.join(known, ["goal_id", "evidence_hash"], "left_anti").join(last, "goal_id", "left")
    added = fresh.select("goal_id", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), "evidence_hash", F.lit("active").alias("status"), F.lit("created").alias("action"))
    return old.withColumn("version", F.col("version").cast("int")).unionByName(added)


def active_plans(goals: DataFrame, versions: DataFrame) -> DataFrame:
    """The active primary goal of each athlete with its highest active version."""
    order = Window.partitionBy("goal_id").orderBy(F.col("version").desc())
    best = versions.where("status = 'active'").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "status")
    return goals.where("status = 'active' and priority = 'primary'").join(best, "goal_id")


def retain_completed(old_weeks: DataFrame, new_weeks: DataFrame, detailed_start: Column) -> DataFrame:
    """The new outline, with the old targets of weeks that ended before the detailed week; both have the same calendar."""
    before = old_weeks.select("goal_id", "week", F.col("start_date").alias("o_start"), F.col("target_km").alias("o_target"), F.col("long_run_km").alias("o_long"))
    joined = new_weeks.join(before, ["goal_id", "week"], "left")
    keep = (F.col("end_date") < detailed_start) & (F.col("o_start") == F.col("start_date"))
    return joined.select(*[F.when(keep, F.col({"target_km": "o_target", "long_run_km": "o_long"}[c])).otherwise(F.col(c)).alias(c) if c in ("target_km", "long_run_km") else F.col(c) for c in new_weeks.columns])


def calendar_conflicts(old_weeks: DataFrame, new_weeks: DataFrame) -> DataFrame:
    """Weeks of one number that start on different days."""
    return old_weeks.select("goal_id", "week", F.col("start_date").alias("old_start")).join(new_weeks.select("goal_id", "week", "start_date"), ["goal_id", "week"]).where("old_start <> start_date")


def needs_refresh(as_of: Column, last_session: Column, all_done: Column, plan_week_start: Column, expected_week_start: Column) -> Column:
    """After the last dated session, when all are done, or when the detailed week is not the expected one."""
    return F.coalesce(as_of > last_session, F.lit(True)) | F.coalesce(all_done, F.lit(False)) | F.coalesce(plan_week_start > expected_week_start, F.lit(False))


def single_active(goals: DataFrame, chosen: DataFrame) -> DataFrame:
    """The goals after one is made the athlete's active primary goal: other active primary ones become planned."""
    pick = chosen.select("athlete_id", F.col("goal_id").alias("chosen"))
    joined = goals.join(pick, "athlete_id", "left")
    status = F.when(F.col("goal_id") == F.col("chosen"), "active").when(F.col("chosen").isNotNull() & (F.col("status") == "active") & (F.col("priority") == "primary"), "planned").otherwise(F.col("status"))
    return joined.select(*[status.alias(c) if c == "status" else F.col(c) for c in goals.columns])
