"""Per-activity metrics from sensor samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import effective_ms, half_up, heart_rate_zone, pace

MAX_GAP_MS = 10_000


def sample_intervals(samples: DataFrame, max_gap_ms: int = MAX_GAP_MS) -> DataFrame:
    """Add ``interval_ms``: the capped time to the next sample; 0 if paused, last or not later."""
    order = Window.partitionBy("activity_id").orderBy("seq")
    raw = F.lead("elapsed_ms").over(order) - F.col("elapsed_ms")
    return samples.withColumn("interval_ms", F.when((raw > 0) & ~F.coalesce("is_paused", F.lit(False)), F.least(raw, F.lit(max_gap_ms))).otherwise(0))


def sensor_totals(samples: DataFrame, max_hr: DataFrame, max_gap_ms: int = MAX_GAP_MS) -> DataFrame:
    """Observed milliseconds by channel and zone per activity; ``max_hr`` has (activity_id, max_hr), null without profile.

    One shuffle by activity serves the lead, the join and the sums.
    """
    timed = sample_intervals(samples, max_gap_ms).join(max_hr, "activity_id", "left")
    zone = heart_rate_zone(F.col("heart_rate"), F.col("max_hr"))
    ms = lambda keep: F.sum(F.when(keep, F.col("interval_ms")).otherwise(0))
    return timed.groupBy("activity_id").agg(
        ms(F.col("heart_rate").isNotNull()).alias("hr_ms"),
        ms(F.col("has_position")).alias("gps_ms"),
        ms(F.col("cadence").isNotNull()).alias("cadence_ms"),
        *[ms(zone == z).alias(f"zone{z}_ms") for z in range(1, 6)],
    )


def _share(part, whole, places: int = 4):
    return F.when(whole > 0, F.round(F.least(part, whole) / whole * 100, places)).otherwise(0.0)


def activity_metrics(activities: DataFrame, samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """Paces, coverage, zones, TRIMP and load, one row per activity.

    ``activities`` (activity_id, athlete_id, local_date, distance_m, moving_ms,
    elapsed_ms), ``samples`` (activity_id, seq, elapsed_ms, heart_rate,
    has_position, cadence, is_paused), ``profiles`` (athlete_id, valid_from,
    valid_to, max_hr) with half-open periods. Activities without samples have
    zero coverage; TRIMP is null without a profile or observed heart rate.
    """
    valid = profile_on(activities, profiles).select("activity_id", "max_hr")
    joined = activities.join(sensor_totals(samples, valid), "activity_id", "left").join(valid, "activity_id", "left").na.fill(0, ["hr_ms", "gps_ms", "cadence_ms", *[f"zone{z}_ms" for z in range(1, 6)]])
    whole = effective_ms(F.col("moving_ms"), F.col("elapsed_ms"))
    has_profile = F.col("max_hr").isNotNull()
    weighted = sum((F.col(f"zone{z}_ms") * z for z in range(2, 6)), F.col("zone1_ms"))
    zones = F.array(*[F.struct(F.lit(z).alias("zone"), F.round(F.col(f"zone{z}_ms") / 1000, 3).alias("seconds"), _share(F.col(f"zone{z}_ms"), F.col("hr_ms")).alias("pct")) for z in range(1, 6)])
    return joined.select(
        "activity_id",
        "athlete_id",
        "local_date",
        F.round(pace(F.col("moving_ms"), F.col("distance_m")), 6).alias("moving_pace"),
        F.round(pace(F.col("elapsed_ms"), F.col("distance_m")), 6).alias("elapsed_pace"),
        _share(F.col("hr_ms"), whole).alias("hr_coverage"),
        _share(F.col("gps_ms"), whole).alias("gps_coverage"),
        _share(F.col("cadence_ms"), whole).alias("cadence_coverage"),
        half_up(whole / 60000, 6).alias("training_load"),
        F.when(has_profile, zones).alias("zones"),
        F.when(has_profile & (F.col("hr_ms") > 0), F.round(weighted / 60000, 6)).alias("edwards_trimp"),
    )


FOREVER = "date'9999-12-31'"


def profile_segments(profiles: DataFrame) -> DataFrame:
    """(athlete_id, valid_from, valid_to, max_hr, n): time cut where a period begins or ends, with the number of periods there.

    ``profiles`` are half-open periods (athlete_id, valid_from, valid_to,
    max_hr); equal rows are one. A sweep over begins and ends keeps running
    sums of how many and which periods are open; ``max_hr`` is that of the only
    one, null where there are several.
    """
    rows = profiles.select("athlete_id", "valid_from", "valid_to", "max_hr").distinct()
    rows = rows.withColumn("p", F.row_number().over(Window.partitionBy("athlete_id").orderBy("valid_from", "valid_to", "max_hr")).cast("long"))
    ends = F.array(F.struct(F.col("valid_from").alias("at"), F.lit(1).alias("step")), F.struct(F.coalesce("valid_to", F.expr(FOREVER)).alias("at"), F.lit(-1).alias("step")))
    steps = rows.select("athlete_id", "p", F.explode(ends).alias("e")).groupBy("athlete_id", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"), F.sum(F.col("e.step") * F.col("p")).alias("moved"))
    by = Window.partitionBy("athlete_id").orderBy("at")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    open_ = steps.select("athlete_id", F.col("at").alias("begin"), F.lead("at").over(by).alias("end"), F.sum("step").over(run).alias("n"), F.sum("moved").over(run).alias("p")).where("n > 0")
    one = open_.withColumn("p", F.when(F.col("n") == 1, F.col("p")))
    found = one.join(rows.select("athlete_id", "p", "max_hr"), ["athlete_id", "p"], "left")
    return found.select("athlete_id", F.col("begin").alias("valid_from"), F.when(F.col("end") < F.expr(FOREVER), F.col("end")).alias("valid_to"), "max_hr", F.col("n").cast("int").alias("n"))


def _on(activities: DataFrame, segments: DataFrame, how: str) -> DataFrame:
    p = segments.select(F.col("athlete_id").alias("p_athlete"), "valid_from", "valid_to", "max_hr")
    on = (activities["athlete_id"] == p["p_athlete"]) & (p["valid_from"] <= activities["local_date"]) & (p["valid_to"].isNull() | (activities["local_date"] < p["valid_to"]))
    return activities.join(p, on, how).drop("p_athlete", "valid_from", "valid_to")


def profile_on(activities: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each activity with the values of the athlete's profile of its date (valid_from <= date < valid_to), if there is exactly one."""
    return _on(activities, profile_segments(profiles).where("n = 1"), "left")


def profile_findings(activities: DataFrame, profiles: DataFrame) -> DataFrame:
    """(activity_id, code): activities on a day with several profiles; they get none."""
    return _on(activities, profile_segments(profiles).where("n > 1"), "left_semi").select("activity_id", F.lit("PROFILE_AMBIGUOUS").alias("code"))


def profile_overlaps(profiles: DataFrame) -> DataFrame:
    """(athlete_id, valid_from, valid_to, max_hr, same): every period that shares a day with another one, or is there ``same`` times.

    One sweep: a period overlaps an earlier one that ends last of all earlier
    ones, or the next one that begins.
    """
    until = F.coalesce("valid_to", F.expr(FOREVER))
    rows = profiles.groupBy("athlete_id", "valid_from", "valid_to", "max_hr").agg(F.count("*").alias("same"))
    by = Window.partitionBy("athlete_id").orderBy("valid_from", until, "max_hr")
    seen = rows.withColumns({"reached": F.max(until).over(by.rowsBetween(Window.unboundedPreceding, -1)), "next_from": F.lead("valid_from").over(by)})
    overlaps = (F.col("reached") > F.col("valid_from")) | (F.col("next_from") < until)
    return seen.where(overlaps | (F.col("same") > 1)).select("athlete_id", "valid_from", "valid_to", "max_hr", "same")


def eligible(activities: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The activities that analytics read: not excluded, and of no later day than ``as_of``."""
    kept = activities.where(F.coalesce(F.col("status") != "excluded", F.lit(True)))
    return kept if as_of is None else kept.where(F.col("local_date") <= as_of)


def documents(metrics: DataFrame) -> DataFrame:
    """(activity_id, zone_distribution, additional_metrics) as JSON: seconds and share by zone, paces and coverages; the first is null without a profile."""
    zones = F.to_json(F.struct(F.transform("zones", lambda z: F.struct(z["zone"].alias("zone"), z["seconds"].alias("seconds"), z["pct"].alias("percent"))).alias("zones")))
    more = F.to_json(F.struct("moving_pace", "elapsed_pace", "gps_coverage", "cadence_coverage"), {"ignoreNullFields": "false"})
    return metrics.select("activity_id", F.when(F.col("zones").isNotNull(), zones).alias("zone_distribution"), more.alias("additional_metrics"))


def daily_load(metrics: DataFrame) -> DataFrame:
    """(athlete_id, local_date, daily_load): loads summed as decimals, so the order of rows does not matter."""
    return metrics.groupBy("athlete_id", "local_date").agg(F.sum("training_load").alias("daily_load"))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The newest metric row of each activity: by calculated_at, then id."""
    return metrics.groupBy("activity_id").agg(F.max_by(F.struct(*[c for c in metrics.columns if c != "activity_id"]), F.struct("calculated_at", "metric_id")).alias("m")).select("activity_id", "m.*")
