"""The evidence that a coaching reply may cite: a few rows per athlete, from nine sources.

Every source is projected to one shape and the rows are united; nothing is
joined wide, so a source that has no rows for an athlete only leaves its rows out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clock

#: Pending sessions that are told.
NEXT_SESSIONS = 3


def told_time(seconds: Column) -> Column:
    """A clock time of whole seconds, half to even; ``unavailable`` for null."""
    return F.coalesce(clock(F.bround(seconds)), F.lit("unavailable"))


def told_pace(seconds_per_km: Column) -> Column:
    s = F.bround(seconds_per_km).cast("bigint")
    return F.when(s.isNull(), "unavailable").otherwise(F.format_string("%d:%02d/km", F.floor(s / 60), s % 60))


def _text(*parts) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _words(c: str) -> Column:
    return F.replace(F.col(c), F.lit("_"), F.lit(" "))


def _km(c: str) -> Column:
    return F.format_string("%.1f", F.round(F.col(c).cast("double"), 1))


def _rows(df: DataFrame, section: int, order: Column, evidence_id: Column, category: str, summary: Column, facts: dict[str, Column | str]) -> DataFrame:
    pairs = [x for name, value in facts.items() for x in (F.lit(name), (F.col(value) if isinstance(value, str) else value).cast("string"))]
    return df.select("athlete_id", F.struct(F.lit(section).alias("section"), order.cast("string").alias("at")).alias("__order"), evidence_id.alias("evidence_id"), F.lit(category).alias("category"), summary.alias("summary"), F.create_map(*pairs).alias("facts"))


def training_rows(history: DataFrame) -> DataFrame:
    """``history``: (athlete_id, as_of, first_date, last_date, runs, distance_km, runs_7d, distance_7d_km, runs_28d, distance_28d_km, distance_84d_km, longest_84d_km, distance_365d_km, quality_84d)."""
    summary = _text(F.col("runs"), " recorded runs through ", F.col("last_date"), ", including ", _km("distance_28d_km"), " km in the latest 28 days.")
    facts = {
        "as_of_date": "as_of", "data_start_date": "first_date", "data_end_date": "last_date", "total_runs": "runs", "total_distance_km": "distance_km",
        "runs_7d": "runs_7d", "distance_7d_km": "distance_7d_km", "runs_28d": "runs_28d", "distance_28d_km": "distance_28d_km",
        "distance_84d_km": "distance_84d_km", "longest_run_84d_km": "longest_84d_km", "distance_365d_km": "distance_365d_km", "quality_sessions_84d": "quality_84d",
    }
    return _rows(history, 1, F.lit(""), F.lit("training:history"), "training", summary, facts)


def workload_rows(snapshot: DataFrame) -> DataFrame:
    """``snapshot``: (athlete_id, local_date, daily_load, acute_load, chronic_load, form_index, coverage_pct, load_method, algorithm_version)."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    summary = _text("Latest form index is ", value("form_index"), "; acute load is ", value("acute_load"), " and chronic load is ", value("chronic_load"), ".")
    facts = {"date": "local_date"} | {c: c for c in ("daily_load", "acute_load", "chronic_load", "form_index", "coverage_pct", "load_method", "algorithm_version")}
    return _rows(snapshot, 2, F.lit(""), _text("workload:", F.col("local_date")), "workload", summary, facts)


def best_rows(bests: DataFrame) -> DataFrame:
    """``bests``: (athlete_id, distance, elapsed_s, pace, achieved_on, source)."""
    summary = _text("Current ", F.col("distance"), " personal best is ", told_time(F.col("elapsed_s")), ", achieved ", F.col("achieved_on"), " as a ", _words("source"), ".")
    facts = {"distance": "distance", "time": told_time(F.col("elapsed_s")), "elapsed_time_seconds": "elapsed_s", "pace_seconds_per_km": "pace", "achieved_on": "achieved_on", "source": "source"}
    return _rows(bests, 3, F.col("distance"), _text("pb:", F.col("distance")), "performance", summary, facts)


def performance_rows(evidence: DataFrame, bests: DataFrame) -> DataFrame:
    """``evidence``: (athlete_id, activity_id, achieved_on, activity_name, distance_km, pace, evidence_kind, target, reason), without the activities of ``bests``."""
    others = evidence.join(bests.select("athlete_id", "activity_id").distinct(), ["athlete_id", "activity_id"], "left_anti")
    name = F.when(F.col("activity_name") != "", F.col("activity_name")).otherwise("run")
    summary = _text(F.col("achieved_on"), " ", name, " covered ", _km("distance_km"), " km at ", told_pace(F.col("pace")), "; selected as ", _words("evidence_kind"), ".")
    facts = {"achieved_on": "achieved_on", "activity_name": "activity_name", "activity_distance_km": "distance_km", "pace_seconds_per_km": "pace", "evidence_kind": "evidence_kind", "target_distance": "target", "selection_reason": "reason"}
    return _rows(others, 4, _text(F.col("achieved_on"), F.col("activity_id")), _text("performance:", F.col("activity_id")), "performance", summary, facts)


def fitness_rows(estimates: DataFrame) -> DataFrame:
    """``estimates``: (athlete_id, distance, metres, potential_s, readiness_s, optimistic_s, conservative_s, preparation, confidence, algorithm_version)."""
    pace = F.round(F.col("readiness_s") / (F.col("metres") / 1000), 6)
    summary = _text("Experimental ", F.col("distance"), " race-readiness estimate is ", told_time(F.col("readiness_s")), " at ", told_pace(pace), ", with ", F.col("confidence"), " confidence.")
    facts = {
        "distance": "distance", "fitness_potential_time": told_time(F.col("potential_s")), "race_readiness_time": told_time(F.col("readiness_s")), "race_readiness_time_seconds": "readiness_s",
        "optimistic_time": told_time(F.col("optimistic_s")), "conservative_time": told_time(F.col("conservative_s")), "race_readiness_pace_seconds_per_km": pace,
        "preparation_pct": F.round(F.col("preparation") * 100, 1), "confidence": "confidence", "algorithm_version": "algorithm_version",
    }
    return _rows(estimates, 5, F.col("metres").cast("decimal(9,1)"), _text("fitness:", F.col("distance")), "prediction", summary, facts)


def goal_rows(goals: DataFrame) -> DataFrame:
    """``goals``: (athlete_id, distance, race_date, target_s, recommended_s, days_per_week, version) of the active primary goal."""
    target, advised = F.col("target_s"), F.col("recommended_s")
    summary = _text("Active ", F.col("distance"), " goal is scheduled for ", F.col("race_date"), "; the saved target is ", told_time(target), ".")
    facts = {"distance": "distance", "race_date": "race_date", "target_time": told_time(target), "target_time_seconds": target, "recommended_target_time": told_time(advised), "recommended_target_time_seconds": advised, "days_per_week": "days_per_week", "plan_version": "version"}
    return _rows(goals, 6, F.lit(""), F.lit("goal:active"), "goal", summary, facts)


def tracking_rows(tracking: DataFrame) -> DataFrame:
    """``tracking``: a row of ``tracking.plan_tracking`` with athlete_id, of the active plan."""
    facts = {
        "status": "status", "as_of_date": "as_of", "current_week_number": "current_week", "completed_weeks": "completed_weeks", "total_weeks": "total_weeks",
        "planned_distance_to_date_km": "planned_km", "actual_distance_to_date_km": "actual_km", "adherence_pct": "adherence_pct", "recommendation_code": "code", "recommendation": "recommendation",
    }
    return _rows(tracking, 7, F.lit(""), F.lit("plan:tracking"), "plan", F.col("recommendation"), facts)


def latest_session_rows(sessions: DataFrame) -> DataFrame:
    """The session whose run is the latest, of the sessions of ``tracking.session_status`` with athlete_id and pace_status."""
    done = sessions.where(F.col("status").isin("completed", "partial", "substituted"))
    order = Window.partitionBy("athlete_id").orderBy(F.desc("activity_date"), "scheduled", "session")
    latest = done.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    summary = _text("Latest matched run on ", F.col("activity_date"), ": ", _km("actual_km"), " km at ", told_pace(F.col("actual_pace")), " against ", _km("target_km"), " km of ", F.lower("title"), "; pace was ", _words("pace_status"), ".")
    facts = {
        "scheduled_date": "scheduled", "activity_date": "activity_date", "activity_name": "activity_name", "planned_kind": "kind", "planned_title": "title", "target_distance_km": "target_km", "actual_distance_km": "actual_km",
        "actual_pace_seconds_per_km": "actual_pace", "actual_pace": told_pace(F.col("actual_pace")), "classified_as": "classified_as", "distance_completion_pct": "completion_pct", "session_status": "status", "pace_status": "pace_status", "purpose": "purpose",
    }
    return _rows(latest, 8, F.lit(""), F.lit("plan:latest-session"), "session_review", summary, facts)


def next_session_rows(sessions: DataFrame) -> DataFrame:
    """The next ``NEXT_SESSIONS`` sessions that are upcoming, due or partial, in plan order."""
    order = Window.partitionBy("athlete_id").orderBy("scheduled", "session")
    pending = sessions.where(F.col("status").isin("upcoming", "due", "partial")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= NEXT_SESSIONS)
    known = F.col("faster").isNotNull() & F.col("slower").isNotNull()
    paces = F.when(known, _text(told_pace(F.col("faster")), " to ", told_pace(F.col("slower")))).otherwise("unavailable")
    at = F.when(known, F.concat(F.lit(" at "), paces)).otherwise("")
    summary = _text(F.col("scheduled"), ": ", F.col("title"), ", ", _km("target_km"), " km", at, " (", F.col("status"), ").")
    facts = {"scheduled_date": "scheduled", "kind": "kind", "title": "title", "target_distance_km": "target_km", "status": "status", "pace_status": "pace_status", "faster_seconds_per_km": "faster", "slower_seconds_per_km": "slower", "pace_range": paces, "purpose": "purpose"}
    return _rows(pending, 9, F.col("__n"), _text("plan:next-session:", F.col("__n")), "session", summary, facts)


def evidence_table(*parts: DataFrame) -> DataFrame:
    """(athlete_id, position, evidence_id, category, summary, facts) of the sources' rows; positions from 1 in the order of the sources."""
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("position", F.row_number().over(Window.partitionBy("athlete_id").orderBy("__order", "evidence_id"))).drop("__order")
