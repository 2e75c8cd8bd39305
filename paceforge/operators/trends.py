"""Totals, trailing windows and weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import effective_ms, pace_display, week_start


def overview(activities: DataFrame) -> DataFrame:
    """Runs, kilometres, hours and first and last date per athlete."""
    return activities.groupBy("athlete_id").agg(
        F.count("*").alias("runs"),
        F.round(F.sum("distance_m").cast("double") / 1000, 3).alias("distance_km"),
        F.round(F.sum("moving_ms") / 3600000, 3).alias("moving_hours"),
        F.min("local_date").alias("first_date"),
        F.max("local_date").alias("last_date"),
    )


def trailing(activities: DataFrame, as_of: DataFrame, days: tuple[int, ...] = (7, 28)) -> DataFrame:
    """Runs, kilometres and load minutes of the last days up to each athlete's date, that day included."""
    near = activities.join(as_of, "athlete_id").where(F.col("local_date").between(F.date_sub("as_of", max(days) - 1), F.col("as_of")))
    back = F.datediff("as_of", "local_date")
    load = effective_ms(F.col("moving_ms"), F.col("elapsed_ms"))
    values: list[Column] = []
    for n in days:
        values += [
            F.count(F.when(back < n, 1)).alias(f"runs_{n}d"),
            F.round(F.coalesce(F.sum(F.when(back < n, F.col("distance_m"))), F.lit(0)).cast("double") / 1000, 3).alias(f"distance_{n}d_km"),
            F.round(F.coalesce(F.sum(F.when(back < n, load)), F.lit(0)) / 60000, 3).alias(f"load_{n}d_min"),
        ]
    found = near.groupBy("athlete_id").agg(*values)
    zero = {f"{k}_{n}d{u}": 0 for n in days for k, u in (("runs", ""), ("distance", "_km"), ("load", "_min"))}
    return as_of.join(found, "athlete_id", "left").na.fill(zero)


def coverage(metrics: DataFrame, places: int = 4) -> DataFrame:
    """Mean coverage of the latest metrics and the number with heart-rate load."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), places)
    return metrics.groupBy("athlete_id").agg(mean("hr_coverage").alias("hr_coverage"), mean("gps_coverage").alias("gps_coverage"), mean("cadence_coverage").alias("cadence_coverage"), F.count("edwards_trimp").alias("with_trimp"))


def weekly(activities: DataFrame, as_of: DataFrame, weeks: int = 52) -> DataFrame:
    """One row per athlete and week (Monday to Sunday), the last ``weeks`` up to ``as_of``; weeks without runs are kept.

    ``activities`` may have ``edwards_trimp``. Elevation and TRIMP are null when
    no run of the week has a value, pace without distance or time.
    """
    last = week_start(F.col("as_of"))
    frame = as_of.select("athlete_id", "as_of", F.explode(F.sequence(F.date_sub(last, 7 * (weeks - 1)), last, F.expr("interval 7 days"))).alias("week_start"))
    runs = activities.withColumns({"week_start": week_start(F.col("local_date")), "load_ms": effective_ms(F.col("moving_ms"), F.col("elapsed_ms"))})
    runs = runs.join(as_of, "athlete_id").where("local_date <= as_of")
    sums = runs.groupBy("athlete_id", "week_start").agg(
        F.count("*").alias("runs"),
        F.sum("distance_m").alias("m"),
        F.sum("moving_ms").alias("ms"),
        F.sum("load_ms").alias("load_ms"),
        F.sum("elevation_m").alias("elevation_m"),
        F.count("edwards_trimp").alias("trimp_runs"),
        F.sum("edwards_trimp").alias("trimp"),
    )
    joined = frame.join(sums, ["athlete_id", "week_start"], "left").na.fill(0, ["runs", "ms", "load_ms", "trimp_runs"])
    m = F.coalesce("m", F.lit(0)).cast("double")
    return joined.select(
        "athlete_id",
        "week_start",
        F.least(F.date_add("week_start", 6), "as_of").alias("week_end"),
        "runs",
        F.round(m / 1000, 3).alias("distance_km"),
        F.round(F.col("ms") / 3600000, 3).alias("moving_hours"),
        F.round(F.col("load_ms") / 60000, 3).alias("load_min"),
        F.when((m > 0) & (F.col("ms") > 0), F.round(F.col("ms") / m, 3)).alias("weighted_pace"),
        F.round(F.col("elevation_m").cast("double"), 3).alias("elevation_m"),
        "trimp_runs",
        F.round(F.col("trimp").cast("double"), 3).alias("edwards_trimp"),
    )


def weekly_frame(weeks: DataFrame) -> DataFrame:
    """The weekly rows as a report shows them: pace in minutes and as text beside the sums."""
    return weeks.withColumns({"pace_min_per_km": F.col("weighted_pace") / 60, "pace_display": pace_display(F.col("weighted_pace"))}).drop("weighted_pace")


def workload_frame(series: DataFrame) -> DataFrame:
    """The workload series as a report shows it, oldest day first."""
    return series.select("athlete_id", "local_date", "daily_load", "acute_load", "chronic_load", "form_index", "coverage_pct").orderBy("athlete_id", "local_date")
