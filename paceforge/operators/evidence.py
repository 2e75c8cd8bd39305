"""Which activities tell something about performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import distance_band, official_metres, reliable_timing, standard_distance, strong_training

#: Why an activity was kept (fixed values).
REASONS = {
    "race_performance": "Explicit race metadata or title identifies this as a race effort.",
    "standard_distance_performance": ("Whole activity is within 3% of ", " and its distance-normalized elapsed time is faster than "),
    "strong_training": (" sub-4:30/km training activity in the ", " evidence band, with at least 3 km, 12 minutes, and no material stopped-time distortion."),
}


def select_evidence(candidates: DataFrame, verified: DataFrame) -> DataFrame:
    """(athlete_id, activity_id, achieved_on, evidence_kind, target, distance_km, elapsed_s, pace, reason).

    ``candidates`` is (athlete_id, activity_id, achieved_on, distance_m,
    moving_s, elapsed_s, activity_type, session_kind); activities in
    ``verified`` (activity_id) are left out. Reliable races are kept, then fast
    10 km and half marathons, then of the other strong runs the fastest and the
    most recent of each distance band. Training is paced by moving time.
    """
    rows = candidates.join(verified.select("activity_id").distinct(), "activity_id", "left_anti").where("distance_m > 0 and moving_s > 0 and elapsed_s > 0")
    km = F.col("distance_m").cast("double") / 1000
    rows = rows.withColumns({"km": km, "target": standard_distance(F.col("distance_m"))})
    scaled = F.col("elapsed_s") * official_metres(F.col("target")) / (F.col("km") * 1000)
    reliable = reliable_timing(F.col("moving_s"), F.col("elapsed_s"))
    race = (F.col("activity_type") == "race") | (F.col("session_kind") == "race")
    fast = F.coalesce((F.col("target") == "10k") & (scaled < 2520) | (F.col("target") == "half_marathon") & (scaled < 6300), F.lit(False))
    strong = strong_training(F.col("km"), F.col("moving_s"), F.col("elapsed_s"))
    routed = rows.withColumn("evidence_kind", F.when(race & reliable, "race_performance").when(reliable & fast, "standard_distance_performance").when(strong, "strong_training")).where("evidence_kind is not null")
    band = Window.partitionBy("athlete_id", "evidence_kind", distance_band(F.col("km")))
    pace = F.col("moving_s") / F.col("km")
    ranked = routed.withColumns({
        "by_pace": F.row_number().over(band.orderBy(pace, F.col("achieved_on").desc(), "activity_id")),
        "by_date": F.row_number().over(band.orderBy(F.col("achieved_on").desc(), pace, "activity_id")),
    })
    kept = ranked.where("evidence_kind <> 'strong_training' or by_pace = 1 or by_date = 1")
    training = F.col("evidence_kind") == "strong_training"
    target = F.when(~training, F.col("target"))
    limit = F.when(F.col("target") == "10k", "42:00").otherwise("1:45:00")
    reason = (
        F.when(training, F.concat(F.lit("Representative "), F.when(F.col("by_pace") == 1, "fastest").otherwise("most recent"), F.lit(REASONS["strong_training"][0]), distance_band(F.col("km")), F.lit(REASONS["strong_training"][1])))
        .when(F.col("evidence_kind") == "standard_distance_performance", F.concat(F.lit(REASONS["standard_distance_performance"][0]), F.col("target"), F.lit(REASONS["standard_distance_performance"][1]), limit, F.lit(".")))
        .otherwise(REASONS["race_performance"])
    )
    return kept.select("athlete_id", "activity_id", "achieved_on", "evidence_kind", target.alias("target"), F.round("km", 6).alias("distance_km"), F.round("elapsed_s", 3).alias("elapsed_s"), F.round(F.when(training, F.col("moving_s")).otherwise(F.col("elapsed_s")) / F.col("km"), 6).alias("pace"), reason.alias("reason"))


def evidence_union(verified: DataFrame, selected: DataFrame, observed: DataFrame) -> DataFrame:
    """All evidence of each athlete, ``position`` 1 the newest.

    Each is (athlete_id, activity_id, target, achieved_on, evidence_kind,
    elapsed_s). Verified performances that were also observed (same activity and
    target, where neither is null) are named once, as observed. Of one day the
    greater kind comes first, then the greater id as text.
    """
    columns = ("athlete_id", "activity_id", "target", "achieved_on", "evidence_kind", "elapsed_s")
    own = verified.join(observed.select("activity_id", "target").distinct(), ["activity_id", "target"], "left_anti")
    union = own.select(*columns).unionByName(selected.select(*columns)).unionByName(observed.select(*columns))
    order = Window.partitionBy("athlete_id").orderBy(F.desc("achieved_on"), F.desc("evidence_kind"), F.desc(F.col("activity_id").cast("string")), "target")
    return union.withColumn("position", F.row_number().over(order))


def latest_dates(athletes: DataFrame, loads: DataFrame, runs: DataFrame) -> DataFrame:
    """(athlete_id, evidence_on, run_on): the last date with a load, without any the last run; and the last run that counts.

    ``loads`` is (athlete_id, local_date), ``runs`` (athlete_id, local_date,
    status) with excluded ones. Null where there is nothing.
    """
    last_load = loads.groupBy("athlete_id").agg(F.max("local_date").alias("load_on"))
    last_run = runs.groupBy("athlete_id").agg(F.max("local_date").alias("any_on"), F.max(F.when(F.col("status") != "excluded", F.col("local_date"))).alias("run_on"))
    joined = athletes.select("athlete_id").distinct().join(last_load, "athlete_id", "left").join(last_run, "athlete_id", "left")
    return joined.select("athlete_id", F.coalesce("load_on", "any_on").alias("evidence_on"), "run_on")


#: A benchmark run may be this much shorter than its distance (fixed value).
BENCHMARK_SHARE = 0.95


def benchmark_activities(declared: DataFrame, runs: DataFrame) -> DataFrame:
    """(athlete_id, distance, declared_on, activity_id, code) of declared benchmarks.

    ``declared`` is (athlete_id, distance, declared_on). Exactly one run of that
    day must be long enough; else ``activity_id`` is null and ``code`` says so.
    """
    key = ["athlete_id", "distance", "declared_on"]
    long_enough = F.col("distance_m").cast("double") >= official_metres(F.col("distance")) * BENCHMARK_SHARE
    met = declared.join(runs.select("athlete_id", F.col("local_date").alias("declared_on"), "activity_id", "distance_m"), ["athlete_id", "declared_on"]).where(long_enough)
    counted = met.groupBy(*key).agg(F.count("*").alias("n"), F.min("activity_id").alias("only"))
    unique = F.col("n") == 1
    joined = declared.join(counted, key, "left")
    return joined.select(*key, F.when(unique, F.col("only")).alias("activity_id"), F.when(unique, None).otherwise("BENCHMARK_ACTIVITY_NOT_UNIQUE").alias("code"))
