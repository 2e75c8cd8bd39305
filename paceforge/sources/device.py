"""Decoded device messages: session, record and lap tables as activities, trackpoints and laps.

One row per message, (file_id, n, ...), ``n`` being the order within its file.
Messages may lack any field. Nothing stops at a bad message: it becomes a
finding, and the others go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.contracts import lap_rules, message_rules, session_rules, check

SEMICIRCLE = 180.0 / 2**31


def _first(df: DataFrame, *names: str) -> Column:
    """The first of the fields that has a number; null where none is there."""
    found = [F.col(n).try_cast("double") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def _steps(df: DataFrame, cadence: str, fraction: str) -> Column:
    """Steps a minute: both legs."""
    return (_first(df, cadence) + F.coalesce(_first(df, fraction), F.lit(0.0))) * 2


def _time(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("timestamp") if name in df.columns else F.lit(None).cast("timestamp")


def _text(df: DataFrame, name: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(name).cast("string"))), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _finding(rows: DataFrame, code: str | Column, severity: str = "warning") -> DataFrame:
    return rows.select("file_id", F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), "n")


def _started(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """The first session of each file with its ``start``: its own, else that of the first record."""
    order = Window.partitionBy("file_id").orderBy("n")
    first = sessions.withColumns({"rank": F.row_number().over(order), "of": F.count("*").over(Window.partitionBy("file_id"))}).where("rank = 1").drop("rank")
    lead = records.groupBy("file_id").agg(F.min_by(_time(records, "timestamp"), "n").alias("lead"))
    return first.join(lead, "file_id", "left").withColumn("start", F.coalesce(_time(first, "start_time"), "lead")).drop("lead")


def _trackpoints(records: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted points and findings. Times must not lie before the start or any earlier accepted point.

    A point that is dropped for its time lies before the running maximum of
    the sound ones, so that is the maximum of the accepted ones, too.
    """
    made = records.join(starts.select("file_id", "start"), "file_id").select(
        "file_id", "n", "start",
        _time(records, "timestamp").alias("recorded_at"),
        _first(records, "distance").alias("distance_m"),
        *[F.when(_first(records, "position_lat").isNotNull() & _first(records, "position_long").isNotNull(), _first(records, f) * SEMICIRCLE).alias(c) for f, c in (("position_lat", "latitude"), ("position_long", "longitude"))],
        _first(records, "enhanced_altitude", "altitude").alias("altitude_m"),
        _first(records, "heart_rate").cast("int").alias("heart_rate"),
        _steps(records, "cadence", "fractional_cadence").alias("cadence"),
        _first(records, "enhanced_speed", "speed").alias("speed_mps"),
        _first(records, "power").alias("power_watts"),
        _first(records, "temperature").alias("temperature_c"),
    )
    order = Window.partitionBy("file_id").orderBy("n")
    checked = check(made, message_rules())
    sound = (F.size("errors") == 0) & (F.col("recorded_at") >= F.col("start"))
    seen = F.max(F.when(sound, F.col("recorded_at"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    code = (
        F.when(F.col("recorded_at").isNull(), "FIT_RECORD_TIMESTAMP_MISSING")
        .when((F.col("recorded_at") < F.col("start")) | (F.col("recorded_at") < F.col("seen")), "FIT_RECORD_TIME_INVALID")
        .when(F.size("errors") > 0, "FIT_RECORD_INVALID")
    )
    marked = checked.withColumn("seen", seen).withColumn("code", code)
    kept = marked.where("code is null").withColumn("seq", F.row_number().over(order) - 1)
    fixed = {"distance_m": "decimal(14,3)", "latitude": "decimal(9,6)", "longitude": "decimal(9,6)", "altitude_m": "decimal(10,3)", "cadence": "decimal(8,3)", "speed_mps": "decimal(10,4)", "power_watts": "decimal(10,3)", "temperature_c": "decimal(6,3)"}
    elapsed = (F.unix_millis("recorded_at") - F.unix_millis("start")).alias("elapsed_ms")
    points = kept.select("file_id", "seq", "recorded_at", elapsed, *[F.col(c).cast(t).alias(c) for c, t in fixed.items()], "heart_rate")
    return points, _finding(marked.where("code is not null"), F.col("code"))


def _laps(laps: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    made = laps.join(starts.select("file_id"), "file_id", "left_semi").select(
        "file_id", "n", _time(laps, "start_time").alias("start_utc"), _first(laps, "total_elapsed_time").alias("elapsed_s"), _first(laps, "total_timer_time").alias("moving_s"), _first(laps, "total_distance").alias("distance_m"),
        _first(laps, "total_ascent").alias("elevation_gain_m"), _first(laps, "total_descent").alias("elevation_loss_m"), _first(laps, "avg_heart_rate").cast("int").alias("average_heart_rate"), _first(laps, "max_heart_rate").cast("int").alias("maximum_heart_rate"),
        _steps(laps, "avg_cadence", "avg_fractional_cadence").alias("average_cadence"), _steps(laps, "max_cadence", "max_fractional_cadence").alias("maximum_cadence"),
    )
    checked = check(made, lap_rules())
    kept = checked.where(F.size("errors") == 0).drop("errors").withColumn("seq", F.row_number().over(Window.partitionBy("file_id").orderBy("n")) - 1)
    return kept.drop("n"), _finding(checked.where(F.size("errors") > 0), "FIT_LAP_INVALID")


def with_lap(points: DataFrame, laps: DataFrame) -> DataFrame:
    """``points`` with ``lap``, the last lap that has begun by then; null before the first and in files without lap times."""
    begun = laps.where("start_utc is not null").select("file_id", F.col("start_utc").alias("recorded_at"), F.col("seq").alias("lap_seq"))
    both = points.unionByName(begun, allowMissingColumns=True)
    # at one instant a lap comes before its points
    order = Window.partitionBy("file_id").orderBy("recorded_at", F.col("lap_seq").asc_nulls_last(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("lap", F.last("lap_seq", ignorenulls=True).over(order)).where("lap_seq is null").drop("lap_seq")


def normalize(sessions: DataFrame, records: DataFrame, laps: DataFrame) -> dict[str, DataFrame]:
    """``activities``, ``trackpoints``, ``laps`` and ``findings`` of all files at once.

    The first session of a file counts. Its elapsed time is total_elapsed_time,
    else total_timer_time, else that of the last trackpoint. A file without a
    start, without a duration or with values out of range has findings only, no
    activity; its trackpoints and laps stay out, too. Laps and points are
    numbered densely from 0 after bad ones are left out.
    """
    first = _started(sessions, records)
    several = _finding(first.where("of > 1 and start is not null"), "FIT_MULTIPLE_SESSIONS")
    no_start = _finding(first.where("start is null"), "FIT_START_TIME_MISSING", "error")
    starts = first.where("start is not null")
    points, bad_points = _trackpoints(records, starts)
    kept_laps, bad_laps = _laps(laps, starts)
    last = points.groupBy("file_id").agg((F.max_by("elapsed_ms", "seq") / 1000).alias("recorded_s"))
    sport, sub = _text(starts, "sport"), _text(starts, "sub_sport")
    kind = F.when(F.coalesce(sport != "running", F.lit(True)), "other").when(sub == "trail", "trail_running").when(sub == "treadmill", "treadmill_running").otherwise("running")
    named = F.when(sub.isNotNull() & (sub != "generic"), F.concat(F.coalesce(sport, F.lit("unknown")), F.lit(":"), sub)).otherwise(F.coalesce(sport, F.lit("unknown")))
    one = starts.join(last, "file_id", "left").select(
        "file_id", "n", kind.alias("kind"), named.alias("provider_type"), F.col("start").alias("start_utc"), F.coalesce(_first(starts, "total_elapsed_time", "total_timer_time"), "recorded_s").alias("elapsed_s"), _first(starts, "total_timer_time").alias("moving_s"), _first(starts, "total_distance").alias("distance_m"),
        _first(starts, "total_ascent").alias("elevation_gain_m"), _first(starts, "total_descent").alias("elevation_loss_m"), _first(starts, "enhanced_avg_speed", "avg_speed").alias("average_speed"), _first(starts, "enhanced_max_speed", "max_speed").alias("maximum_speed"),
        *[_first(starts, f"{a}_heart_rate").cast("int").alias(f"{b}_heart_rate") for a, b in (("avg", "average"), ("max", "maximum"), ("min", "minimum"))],
        _steps(starts, "avg_cadence", "avg_fractional_cadence").alias("average_cadence"), _steps(starts, "max_cadence", "max_fractional_cadence").alias("maximum_cadence"), _first(starts, "total_calories").alias("calories"),
    )
    checked = check(one, session_rules())
    code = F.when(F.col("elapsed_s").isNull(), "FIT_DURATION_MISSING").when(F.size("errors") > 0, "FIT_ACTIVITY_INVALID")
    marked = checked.withColumn("code", code)
    good = marked.where("code is null").drop("errors", "code", "n")
    findings = several.unionByName(no_start).unionByName(bad_points).unionByName(bad_laps).unionByName(_finding(marked.where("code is not null"), F.col("code"), "error"))
    own = good.select("file_id")
    kept_laps = kept_laps.join(own, "file_id", "left_semi")
    return {"activities": good, "trackpoints": with_lap(points.join(own, "file_id", "left_semi"), kept_laps), "laps": kept_laps, "findings": findings}
