"""Leakage-safe features before an event, and walk-forward validation of baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import RIEGEL_EXPONENT, deviation_pct, official_metres, standard_distance
from .running_median import earlier_medians

HORIZONS = (7, 28, 42, 84, 180, 365)
TAGS = ("easy", "long", "progressive", "tempo", "hills", "intervals", "race", "unclassified")


def distance_candidates(activities: DataFrame, tolerance_pct: float = 3.0) -> DataFrame:
    """Activities near a standard distance, with official length and deviation."""
    found = activities.where("distance_m > 0 and elapsed_ms > 0").withColumn("distance", standard_distance(F.col("distance_m"), tolerance_pct)).where("distance is not null")
    official = official_metres(F.col("distance"))
    return found.withColumns({"official_m": official, "deviation_pct": F.round((F.col("distance_m").cast("double") - official) / official * 100, 6)})


def pre_event_windows(candidates: DataFrame, history: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Training of the last days before each candidate, only from runs that start earlier.

    ``candidates`` is (activity_id, athlete_id, start_utc, local_date),
    ``history`` (athlete_id, start_utc, local_date, distance_m, moving_ms,
    elevation_m, hr_coverage, training_load, tags, is_quality). A run of ``n``
    days ago counts for horizons of at least n days. Candidates meet runs by
    (athlete, block of 365 days), each run in its own block and the next, so
    only runs of at most two blocks are compared.
    """
    longest = max(horizons)
    block = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / longest)
    c = candidates.select("activity_id", "athlete_id", F.col("start_utc").alias("c_start"), F.col("local_date").alias("c_date"), block(F.col("local_date")).alias("block"))
    # what is counted travels as one number, a bit for each condition
    conditions = {"hr_runs": F.col("hr_coverage") > 0, "classified": ~F.array_contains("tags", "unclassified"), "quality": F.col("is_quality")} | {t: F.array_contains("tags", t) for t in TAGS}
    bits = {name: 1 << i for i, name in enumerate(conditions)}
    flags = sum((F.when(c, bits[name]).otherwise(0) for name, c in conditions.items()), F.lit(0)).alias("flags")
    fields = ["distance_m", "moving_ms", "elevation_m", "training_load"]
    h = history.select("athlete_id", "start_utc", "local_date", *fields, flags, F.explode(F.array(block(F.col("local_date")), block(F.col("local_date")) + 1)).alias("block"))
    near = c.join(h, ["athlete_id", "block"]).where((F.col("start_utc") < F.col("c_start")) & (F.col("local_date") >= F.date_sub("c_date", longest)))
    # sums by the smallest horizon that holds a run, then running sums over at most six horizons of a candidate
    back = F.datediff("c_date", "local_date")
    horizon = F.coalesce(*[F.when(back <= n, n) for n in sorted(horizons)])
    count = lambda name: F.sum((F.col("flags").bitwiseAND(bits[name]) != 0).cast("bigint"))
    sums = {
        "runs": F.count("*"),
        "m": F.sum("distance_m"),
        "ms": F.sum("moving_ms"),
        "elevation": F.sum("elevation_m"),
        "load": F.sum("training_load"),
    } | {name: count(name) for name in conditions}
    order = Window.partitionBy("activity_id").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    steps = near.withColumn("horizon", horizon).groupBy("activity_id", "horizon").agg(*[v.alias(k) for k, v in sums.items()], F.max("distance_m").alias("longest"))
    running = steps.select("activity_id", "horizon", *[F.sum(k).over(order).alias(k) for k in sums], F.max("longest").over(order).alias("longest"))
    states = running.groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in running.columns if c != "activity_id"]))).alias("s"))
    at = lambda n: F.try_element_at(F.filter("s", lambda x: x["horizon"] <= n), F.lit(-1))
    wide = candidates.select("activity_id").join(states, "activity_id", "left").select("activity_id", *[at(n).alias(f"h{n}") for n in horizons])
    out: list[Column] = []
    for n in horizons:
        of, p = (lambda k, n=n: F.col(f"h{n}.{k}")), f"prior_{n}d_"
        zero = lambda x: F.coalesce(x, F.lit(0))
        out += [
            zero(of("runs")).alias(p + "runs"),
            F.round(zero(of("m")).cast("double") / 1000, 6).alias(p + "distance_km"),
            F.round(zero(of("ms")) / 3600000, 6).alias(p + "moving_hours"),
            F.round(of("longest").cast("double") / 1000, 6).alias(p + "longest_run_km"),
            F.round(F.when((of("m") > 0) & (of("ms") > 0), of("ms") / of("m").cast("double")), 6).alias(p + "weighted_pace"),
            F.round(of("elevation").cast("double"), 6).alias(p + "elevation_m"),
            F.round(zero(of("load")).cast("double"), 6).alias(p + "load_min"),
            *[zero(of(k)).alias(p + k) for k in ("hr_runs", "classified", "quality", *TAGS)],
        ]
    return wide.select("activity_id", *out)


def prior_workload(candidates: DataFrame, series: DataFrame) -> DataFrame:
    """The workload state of the day before each candidate."""
    s = series.select("athlete_id", F.date_add("local_date", 1).alias("local_date"), *[F.col(c).alias(f"prior_{c}") for c in ("acute_load", "chronic_load", "form_index")])
    return candidates.select("activity_id", "athlete_id", "local_date").join(s, ["athlete_id", "local_date"], "left").drop("athlete_id", "local_date")


def prior_bests(candidates: DataFrame, verified: DataFrame) -> DataFrame:
    """The fastest verified result per distance before each candidate, one column a distance."""
    v = verified.select("athlete_id", "distance", "elapsed_s", "achieved_at")
    # a running minimum per athlete and distance makes the earlier results one lookup, not a join of all pairs
    order = Window.partitionBy("athlete_id").orderBy("at", "kind")
    events = v.select("athlete_id", F.col("achieved_at").alias("at"), F.lit(1).alias("kind"), "distance", "elapsed_s", F.lit(None).cast("long").alias("activity_id"))
    asks = candidates.select("athlete_id", F.col("start_utc").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("distance"), F.lit(None).cast("double").alias("elapsed_s"), "activity_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    best = {d: F.min(F.when(F.col("distance") == d, F.col("elapsed_s"))).over(before).alias(f"prior_{d}_s") for d in ("5k", "10k", "half_marathon", "marathon")}
    return events.unionByName(asks).select("activity_id", "kind", *best.values()).where("kind = 0").drop("kind")


def walk_forward(observations: DataFrame) -> DataFrame:
    """Predictions of each observation from strictly earlier ones of the athlete: (athlete_id, activity_id, distance, baseline, actual_s, predicted_s, signed_error_s, absolute_error_s, absolute_pct).

    Baselines: the best Riegel prediction from any earlier result, the most
    recent result over the distance, and their median. ``observations`` is
    (athlete_id, activity_id, distance, elapsed_s, achieved_at). Results at one
    instant do not know each other; of equally recent ones the last by id
    counts. The first two are running windows: the best Riegel source for a
    distance is the one with the least seconds / metres ** 1.06. Medians are
    ``running_median.earlier_medians``.
    """
    metres = official_metres(F.col("distance"))
    scaled = observations.withColumn("ratio", F.col("elapsed_s") / F.pow(metres, F.lit(RIEGEL_EXPONENT)))
    earlier, same = (Window.partitionBy(*keys).orderBy(F.unix_micros("achieved_at")).rangeBetween(Window.unboundedPreceding, -1) for keys in (["athlete_id"], ["athlete_id", "distance"]))
    recent = F.max(F.struct("achieved_at", "activity_id", "elapsed_s")).over(same)["elapsed_s"]
    seen = earlier_medians(scaled, ["athlete_id", "distance"], "achieved_at", "elapsed_s", "activity_id")
    seen = seen.withColumns({"best": F.min("ratio").over(earlier), "recent": recent})
    long = seen.select(
        "athlete_id",
        "activity_id",
        "distance",
        "elapsed_s",
        F.explode(
            F.array(
                F.struct(F.lit("riegel_best_prior").alias("baseline"), (F.col("best") * F.pow(metres, F.lit(RIEGEL_EXPONENT))).alias("predicted")),
                F.struct(F.lit("recent_same_distance").alias("baseline"), F.col("recent").alias("predicted")),
                F.struct(F.lit("historical_median_same_distance").alias("baseline"), F.col("median").alias("predicted")),
            )
        ).alias("p"),
    ).where("p.predicted is not null")
    error = F.col("p.predicted") - F.col("elapsed_s")
    return long.select(
        "athlete_id",
        "activity_id",
        "distance",
        F.col("p.baseline").alias("baseline"),
        F.round("elapsed_s", 3).alias("actual_s"),
        F.round(F.col("p.predicted").cast("decimal(18,6)"), 3).cast("double").alias("predicted_s"),
        F.round(error, 3).alias("signed_error_s"),
        F.round(F.abs(error), 3).alias("absolute_error_s"),
        F.round(F.abs(error) / F.col("elapsed_s") * 100, 6).alias("absolute_pct"),
    )


def validation_metrics(predictions: DataFrame, places: int = 3) -> DataFrame:
    """Number, MAE, median error, MAPE and mean signed error per baseline, and per baseline and distance (distance null: all)."""
    return (
        predictions.groupingSets([["baseline"], ["baseline", "distance"]], "baseline", "distance")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("absolute_error_s"), places).alias("mae_s"),
            F.round(F.median("absolute_error_s"), places).alias("median_ae_s"),
            F.round(F.avg("absolute_pct"), places + 1).alias("mape"),
            F.round(F.avg("signed_error_s"), places).alias("mean_signed_s"),
        )
    )


#: What a set of observations needs before a model may be tried on it (fixed values).
LEAST_LABELS, LEAST_TARGETS, LEAST_DISTANCES = 30, 8, 2


def eligibility(observations: DataFrame) -> DataFrame:
    """Per athlete whether verified observations allow a candidate model: (athlete_id, labels, chronological_targets, distances, status, reasons).

    A chronological target is an observation with a strictly earlier one.
    ``reasons`` names the gates that are not passed, in order.
    """
    first = F.min("achieved_at").over(Window.partitionBy("athlete_id"))
    counted = observations.withColumn("later", F.col("achieved_at") > first).groupBy("athlete_id").agg(F.count("*").alias("labels"), F.count_if("later").alias("chronological_targets"), F.count_distinct("distance").alias("distances"))
    gates = [("labels", LEAST_LABELS), ("chronological_targets", LEAST_TARGETS), ("distances", LEAST_DISTANCES)]
    reasons = F.array_compact(F.array(*[F.when(F.col(c) < n, F.lit(c)) for c, n in gates]))
    return counted.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "eligible_for_candidate_model").otherwise("descriptive_only"))


def with_verified(candidates: DataFrame, verified: DataFrame, activities: DataFrame) -> DataFrame:
    """(activity_id, athlete_id, distance, start_utc, local_date): candidates, and verified results over a distance that their activity was no candidate for."""
    columns = ("activity_id", "athlete_id", "distance", "start_utc", "local_date")
    missing = verified.select("activity_id", "distance").distinct().join(candidates.select("activity_id", "distance"), ["activity_id", "distance"], "left_anti")
    return candidates.select(*columns).unionByName(missing.join(activities.select("activity_id", "athlete_id", "start_utc", "local_date"), "activity_id").select(*columns))


def prior_history(activities: DataFrame) -> DataFrame:
    """(activity_id, prior_history_runs, prior_history_days): strictly earlier runs of the athlete, and days since the first of them."""
    by = Window.partitionBy("athlete_id").orderBy("start_utc")
    first = F.first("local_date").over(by.rowsBetween(Window.unboundedPreceding, 0))
    n = F.rank().over(by) - 1
    return activities.select("activity_id", n.alias("prior_history_runs"), F.when(n > 0, F.datediff("local_date", first)).otherwise(0).alias("prior_history_days"))


def feature_dataset(candidates: DataFrame, windows: DataFrame, workload: DataFrame, bests: DataFrame, verified: DataFrame, history: DataFrame) -> DataFrame:
    """One row per candidate (``with_verified``) with its features of before the event and, if it was verified, its result (``label_s``).

    The parts are those of ``pre_event_windows``, ``prior_workload``,
    ``prior_bests`` and ``prior_history``; ``verified`` is (activity_id,
    distance, elapsed_s). A candidate whose result was verified over another
    distance has no label and is ``unreviewed``.
    """
    labels = verified.select("activity_id", "distance", F.col("elapsed_s").alias("label_s"))
    joined = candidates.join(labels, ["activity_id", "distance"], "left")
    joined = joined.withColumn("review_status", F.when(F.col("label_s").isNotNull(), "verified").otherwise("unreviewed"))
    for part in (history, windows, workload, bests):
        joined = joined.join(part, "activity_id", "left")
    return joined


def dataset_status(dataset: DataFrame) -> DataFrame:
    """(athlete_id, candidate_rows, verified_rows, unreviewed_rows, model_status)."""
    counts = dataset.groupBy("athlete_id").agg(F.count("*").alias("candidate_rows"), F.count_if(F.col("review_status") == "verified").alias("verified_rows"))
    open_rows = F.col("candidate_rows") - F.col("verified_rows")
    return counts.withColumn("unreviewed_rows", open_rows).withColumn("model_status", F.when(open_rows > 0, "label_audit_required").otherwise("evaluation_required"))
