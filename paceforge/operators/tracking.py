"""Planned sessions against completed runs, and sensor files against canonical activities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reconcile import START_S
from .turns import in_turn

#: What each recommendation says (fixed values); titles, distances and days are put in.
ADVICE = {
    "avoid_makeup_quality": " was missed. Do not stack it onto the next day; continue with the next scheduled session and preserve recovery.",
    "accept_partial_quality": " was partially completed. Count the work already done and do not repeat the unfinished portion on the next day.",
    "reduce_optional_volume": "Completed volume is both more than 15 percent and at least 5 km above the plan-to-date target. Keep the next hard session unchanged only if recovered, and trim optional easy volume.",
    "plan_not_started": "The plan begins with ",
    "continue_as_planned": "Continue with ",
    "first_week_complete": "The detailed week is complete. Update the active plan after recalculating analytics to generate the next dated schedule.",
}
#: Score parts of a candidate run (fixed values): same day, adjacent day, fitting kind, most for distance.
SAME_DAY, ADJACENT, FITTING, DISTANCE = 100.0, 35.0, 50.0, 25.0


def kind_fits(planned: Column, tags: Column, primary: Column, activity_type: Column, actual_km: Column, target_km: Column) -> Column:
    has = lambda t: F.array_contains(tags, t)
    quality = F.arrays_overlap(tags, F.array(*map(F.lit, ("race", "hills", "intervals", "tempo", "progressive"))))
    return (
        F.when(planned.isin("easy", "recovery"), has("easy") | (primary == "unclassified") & activity_type.isin("easy", "unknown"))
        .when(planned == "quality", quality | (activity_type == "workout"))
        .when(planned == "long", has("long") | has("progressive") | (activity_type == "long") | (actual_km >= target_km * 0.9))
        .when(planned == "race", has("race") | (activity_type == "race"))
        .otherwise(False)
    )


def session_candidates(sessions: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs on a session's day or the days beside it, with ``fits`` and ``score``: an equi-join on athlete and day.

    ``sessions`` is (plan_id, athlete_id, session, scheduled, kind, target_km,
    as_of), ``runs`` (athlete_id, activity_id, start_utc, local_date,
    distance_m, tags, primary, activity_type). With ``plan_start`` and
    ``plan_end`` in ``sessions`` only runs of that time are candidates. The
    sessions' days are not broadcast: they are many more than Spark assumes.
    """
    days = sessions.withColumn("day", F.explode(F.sequence(F.date_sub("scheduled", 1), F.date_add("scheduled", 1))))
    met = days.hint("merge").join(runs.withColumnRenamed("local_date", "day"), ["athlete_id", "day"]).where("day <= as_of")
    if {"plan_start", "plan_end"} <= set(sessions.columns):
        met = met.where("day between plan_start and plan_end")
    km = F.col("distance_m").cast("double") / 1000
    off = F.when(F.col("target_km") > 0, F.abs(km - F.col("target_km")) / F.col("target_km")).otherwise(0.0)
    fits = kind_fits(F.col("kind"), F.col("tags"), F.col("primary"), F.col("activity_type"), km, F.col("target_km"))
    same = F.col("day") == F.col("scheduled")
    score = F.when(same, SAME_DAY).otherwise(ADJACENT) + F.when(fits, FITTING).otherwise(0.0) + F.greatest(F.lit(0.0), DISTANCE - off * DISTANCE)
    return met.select("plan_id", "session", "activity_id", "start_utc", same.alias("same_day"), fits.alias("fits"), score.alias("score"), km.alias("actual_km"), F.col("day").alias("activity_date"))


def _take(candidates: Iterable[tuple]) -> Iterator[tuple]:
    """Candidates in turn: each takes its session and its run if both are free."""
    done, used = set(), set()
    for plan, session, activity in candidates:
        if session not in done and activity not in used:
            done.add(session)
            used.add(activity)
            yield plan, session, activity


def match_sessions(sessions: DataFrame, runs: DataFrame) -> DataFrame:
    """(plan_id, session, activity_id): which run fulfils which session.

    Same day first, then fitting runs of the days beside; sessions in plan
    order, a run once; best score, then earlier start, then id.
    """
    found = session_candidates(sessions, runs).withColumn("turn", F.when(F.col("same_day"), 0).when(F.col("fits"), 1)).where("turn is not null")
    found = found.select(F.col("plan_id").cast("long").alias("plan_id"), F.col("session").cast("int").alias("session"), F.col("activity_id").cast("long").alias("activity_id"), "turn", "score", "start_utc")
    order = ("turn", "session", F.desc("score"), F.asc_nulls_last("start_utc"), "activity_id")
    return in_turn(found, ("plan_id",), order, ("session", "activity_id"), "plan_id long, session int, activity_id long", _take)


def session_status(sessions: DataFrame, matches: DataFrame, runs: DataFrame) -> DataFrame:
    """Each session with its run and upcoming, due, missed, substituted, partial (under three quarters) or completed.

    Adds (activity_id, activity_date, activity_name, actual_km, actual_pace,
    classified_as, completion_pct, status, pace_status) to the sessions'
    columns, which hold the planned paces ``faster`` and ``slower``; ``runs`` as
    in ``session_candidates`` with moving_ms and name.
    """
    km = F.col("distance_m").cast("double") / 1000
    run = F.struct(km.alias("km"), (F.col("moving_ms") / 1000).alias("s"), "local_date", "name", "tags", "primary", "activity_type").alias("run")
    chosen = matches.hint("merge").join(runs.select("activity_id", run), "activity_id")
    joined = sessions.join(chosen, ["plan_id", "session"], "left")
    km, target = F.col("run.km"), F.col("target_km")
    fits = kind_fits(F.col("kind"), F.col("run.tags"), F.col("run.primary"), F.col("run.activity_type"), km, target)
    share = F.when(target != 0, km / target * 100).otherwise(0.0)
    open_status = F.when(F.col("scheduled") > F.col("as_of"), "upcoming").when(F.col("scheduled") == F.col("as_of"), "due").otherwise("missed")
    status = F.when(F.col("activity_id").isNull(), open_status).when(~fits, "substituted").when(share < 75, "partial").otherwise("completed")
    pace = F.when(km > 0, F.col("run.s") / km)
    judged = F.when(F.col("activity_id").isNull(), "unavailable").otherwise(pace_status(F.col("kind"), F.col("faster"), F.col("slower"), pace))
    return joined.select(
        *sessions.columns, "activity_id", F.col("run.local_date").alias("activity_date"), F.col("run.name").alias("activity_name"),
        F.round(km, 3).alias("actual_km"), F.round(pace, 3).alias("actual_pace"), F.col("run.primary").alias("classified_as"),
        F.when(F.col("activity_id").isNotNull(), F.round(share, 1)).alias("completion_pct"), status.alias("status"), judged.alias("pace_status"),
    )


def pace_status(planned_kind: Column, faster: Column, slower: Column, actual: Column) -> Column:
    """Where an actual pace (s/km) lies beside the planned range; hard sessions are not judged by pace."""
    return (
        F.when(planned_kind.isin("quality", "race"), "not_applicable")
        .when(faster.isNull() | slower.isNull() | actual.isNull(), "unavailable")
        .when(actual < faster, "faster_than_planned")
        .when(actual > slower, "easier_than_planned")
        .otherwise("within_range")
    )


def pending_sessions(statuses: DataFrame, most: int = 3) -> DataFrame:
    """The next upcoming, due or partial sessions of each plan, in plan order, numbered from 1: a report of the first ``most``."""
    order = Window.partitionBy("plan_id").orderBy("scheduled", "session")
    return statuses.where(F.col("status").isin("upcoming", "due", "partial")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def latest_completed(statuses: DataFrame) -> DataFrame:
    """The session of each plan whose run is the latest; of one day the first in plan order."""
    done = statuses.where(F.col("status").isin("completed", "partial", "substituted") & F.col("activity_date").isNotNull())
    order = Window.partitionBy("plan_id").orderBy(F.desc("activity_date"), "scheduled", "session")
    return done.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


#: From what share and distance above the plan optional volume is trimmed (fixed values).
OVER_PCT, OVER_KM = 115.0, 5.0


def plan_tracking(progress: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row per plan: where it stands and what to do next.

    (plan_id, as_of, status, current_week, completed_weeks, total_weeks,
    planned_km, actual_km, adherence_pct, code, recommendation).
    ``progress`` are the weeks of ``training_plan.week_progress``,
    ``statuses`` (plan_id, session, scheduled, kind, title, target_km, status)
    the sessions of the detailed week. A missed hard session comes first, then
    a partial one, then volume far above the plan, then a plan whose first day
    is still ahead, then the next session; else the detailed week is complete.
    """
    weeks = progress.groupBy("plan_id", "as_of", "plan_start", "plan_end").agg(
        F.max(F.when(F.col("status") == "in_progress", F.col("week"))).alias("current_week"),
        F.count(F.when(F.col("status") == "completed", 1)).alias("completed_weeks"),
        F.count("*").alias("total_weeks"),
        F.round(F.sum("planned_km"), 3).alias("planned_km"),
        F.round(F.sum("actual_km"), 3).alias("actual_km"),
    )
    hard = F.col("kind").isin("quality", "long", "race")
    first = lambda keep: F.min(F.when(keep, F.struct("scheduled", "session", F.lower("title").alias("title"), F.format_string("%.1f km", "target_km").alias("km"))))
    ahead = statuses.groupBy("plan_id").agg(
        first(hard & (F.col("status") == "missed")).alias("missed"),
        first(hard & (F.col("status") == "partial")).alias("half"),
        first(F.col("status").isin("due", "upcoming")).alias("next"),
    )
    rows = weeks.join(ahead.hint("merge"), "plan_id", "left").withColumn("adherence_pct", F.when(F.col("planned_km") > 0, F.round(F.col("actual_km") / F.col("planned_km") * 100, 1)))
    status = F.when(F.col("as_of") < F.col("plan_start"), "not_started").when(F.col("as_of") > F.col("plan_end"), "completed").otherwise("in_progress")
    over = (F.col("adherence_pct") > OVER_PCT) & (F.col("actual_km") - F.col("planned_km") >= OVER_KM)
    code = (
        F.when(F.col("missed").isNotNull(), "avoid_makeup_quality")
        .when(F.col("half").isNotNull(), "accept_partial_quality")
        .when(over, "reduce_optional_volume")
        .when((status == "not_started") & F.col("next").isNotNull(), "plan_not_started")
        .when(F.col("next").isNotNull(), "continue_as_planned")
        .otherwise("first_week_complete")
    )
    rows = rows.withColumns({"status": status, "code": code})
    upcoming = F.concat("next.km", F.lit(" of "), "next.title", F.lit(" on "), F.col("next.scheduled").cast("string"), F.lit("."))
    text = (
        F.when(F.col("code") == "avoid_makeup_quality", F.concat(F.lit("The "), "missed.title", F.lit(ADVICE["avoid_makeup_quality"])))
        .when(F.col("code") == "accept_partial_quality", F.concat(F.lit("The "), "half.title", F.lit(ADVICE["accept_partial_quality"])))
        .when(F.col("code") == "plan_not_started", F.concat(F.lit(ADVICE["plan_not_started"]), upcoming))
        .when(F.col("code") == "continue_as_planned", F.concat(F.lit(ADVICE["continue_as_planned"]), upcoming))
        .when(F.col("code") == "reduce_optional_volume", ADVICE["reduce_optional_volume"])
        .otherwise(ADVICE["first_week_complete"])
    )
    return rows.select("plan_id", "as_of", "status", "current_week", "completed_weeks", "total_weeks", "planned_km", "actual_km", "adherence_pct", "code", text.alias("recommendation"))


#: How far a file may be from an activity: seconds or share of its duration, metres or share of its distance (fixed values).
FILE_S, FILE_S_SHARE, FILE_M, FILE_M_SHARE = 60.0, 0.02, 50.0, 0.005


def compatible_activities(files: DataFrame, activities: DataFrame) -> DataFrame:
    """(file_id, provider, activity_id): activities of the athlete with near start, duration and distance; an equi-join on athlete and bucket of seconds."""
    width = 2 * START_S
    bucket = F.floor(F.col("start_s") / width)
    left = files.select("file_id", "athlete_id", "provider", F.col("start_s").alias("f_start"), F.col("elapsed_s").alias("f_elapsed"), F.col("distance_m").alias("f_m"), bucket.alias("bucket"))
    right = activities.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    near = left.join(right, ["athlete_id", "bucket"]).where(
        (F.abs(F.col("f_start") - F.col("start_s")) <= START_S)
        & (F.abs(F.col("f_elapsed") - F.col("elapsed_s")) <= F.greatest(F.lit(FILE_S), F.col("elapsed_s") * FILE_S_SHARE))
        & (F.abs(F.col("f_m") - F.col("distance_m")) <= F.greatest(F.lit(FILE_M), F.col("distance_m") * FILE_M_SHARE))
    )
    return near.select("file_id", "provider", "activity_id")


def _create(files: Iterable[tuple]) -> Iterator[tuple]:
    """Files of near starts in turn: one that fits what an earlier one made is attached to it."""
    made = defaultdict(list)
    for _, _, file, start, elapsed, metres, n, only in files:
        whole, at = elapsed is not None and metres is not None, None if start is None else start // (2 * START_S)
        near = [
            m_file
            for bucket in ((at - 1, at, at + 1) if whole and at is not None else ())
            for m_file, m_start, m_elapsed, m_metres in made.get(bucket, ())
            if abs(start - m_start) <= START_S
            and abs(elapsed - m_elapsed) <= max(FILE_S, m_elapsed * FILE_S_SHARE)
            and abs(metres - m_metres) <= max(FILE_M, m_metres * FILE_M_SHARE)
        ]
        if n + len(near) > 1:
            yield file, None, None, "ambiguous"
        elif n or near:
            yield file, None if near else only, near[0] if near else None, "matched"
        elif not whole:
            yield file, None, None, "unmatched"
        else:
            made[at].append((file, start, elapsed, metres))
            yield file, None, file, "created"


def create_missing(files: DataFrame, resolved: DataFrame, activities: DataFrame) -> DataFrame:
    """What becomes of files that stayed unmatched: (file_id, activity_id, new_of, action).

    A file with one compatible activity is attached to it (``matched``), with
    several it is ``ambiguous``; with none an activity is ``created`` from it,
    named by the file in ``new_of``, to which later files of the batch can be
    attached. Without a distance or an elapsed time nothing can be made
    (``unmatched``). Only files whose starts lie near each other are decided in
    turn; all others by expressions.
    """
    near = compatible_activities(files, activities).groupBy("file_id").agg(F.count("*").alias("n"), F.min("activity_id").alias("only"))
    open_files = files.join(resolved.where("status = 'unmatched'").select("file_id"), "file_id", "left_semi").join(near, "file_id", "left")
    order = Window.partitionBy("athlete_id").orderBy("start_s", "file_id")
    gap = (F.col("start_s") - F.lag("start_s").over(order) > START_S).cast("int")
    placed = open_files.select("file_id", "athlete_id", "start_s", "elapsed_s", "distance_m", F.coalesce("n", F.lit(0)).alias("n"), "only", F.coalesce(gap, F.lit(0)).alias("gap"))
    placed = placed.withColumn("cluster", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("size", F.count("*").over(Window.partitionBy("athlete_id", "cluster")))
    action = F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "matched").when(F.col("distance_m").isNull() | F.col("elapsed_s").isNull(), "unmatched").otherwise("created")
    alone = placed.where("size = 1").withColumn("action", action)
    alone = alone.select("file_id", F.when(F.col("action") == "matched", F.col("only")).alias("activity_id"), F.when(F.col("action") == "created", F.col("file_id")).alias("new_of"), "action")
    kinds = "file_id long, activity_id long, new_of long, action string"
    return alone.unionByName(in_turn(placed.where("size > 1"), ("athlete_id", "cluster"), ("file_id",), ("file_id", "start_s", "elapsed_s", "distance_m", "n", "only"), kinds, _create))


def created_rows(files: DataFrame, decided: DataFrame, new_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The activities and sources that ``create_missing`` decided on.

    Activities are (activity_id, athlete_id, start_s, elapsed_s, distance_m),
    one for each file that made one, under ``new_id`` (over ``new_of``);
    sources (file_id, provider, external_id, activity_id) link every file that
    made an activity or was attached to one.
    """
    made = F.xxhash64(F.lit("file"), "new_of") if new_id is None else new_id
    own = decided.where("action = 'created'").select("file_id", made.alias("activity_id")).join(files, "file_id")
    activities = own.select("activity_id", "athlete_id", "start_s", "elapsed_s", "distance_m")
    linked = decided.where("action in ('created', 'matched')").select("file_id", F.when(F.col("new_of").isNotNull(), made).otherwise(F.col("activity_id")).alias("activity_id"))
    return activities, linked.join(files.select("file_id", "provider", "external_id"), "file_id").select("file_id", "provider", "external_id", "activity_id")


def resolve_files(files: DataFrame, sources: DataFrame, activities: DataFrame) -> DataFrame:
    """(file_id, activity_id, status): sensor files by provider id, else by near start, duration and distance.

    ``files`` is (file_id, athlete_id, provider, external_id, start_s,
    elapsed_s, distance_m), ``sources`` (provider, external_id, activity_id),
    ``activities`` (activity_id, athlete_id, start_s, elapsed_s, distance_m).
    Status is matched, ambiguous or unmatched; a match by time needs exactly
    one source of the provider on that activity.
    """
    by_id = files.join(sources, ["provider", "external_id"]).groupBy("file_id").agg(F.count("*").alias("id_n"), F.min("activity_id").alias("id_activity"))
    near = compatible_activities(files, activities)
    by_time = near.groupBy("file_id", "provider").agg(F.count("*").alias("time_n"), F.min("activity_id").alias("time_activity"))
    of_provider = sources.where("activity_id is not null").groupBy("provider", F.col("activity_id").alias("time_activity")).agg(F.count("*").alias("source_n"))
    timed = by_time.join(of_provider, ["provider", "time_activity"], "left").select("file_id", "time_n", "time_activity", F.coalesce("source_n", F.lit(0)).alias("source_n"))
    joined = files.select("file_id").join(by_id, "file_id", "left").join(timed, "file_id", "left")
    status = (
        F.when(F.col("id_n") > 1, "ambiguous")
        .when(F.col("id_n") == 1, F.when(F.col("id_activity").isNotNull(), "matched").otherwise("unmatched"))
        .when(F.col("time_n") > 1, "ambiguous")
        .when((F.col("time_n") == 1) & (F.col("source_n") == 1), "matched")
        .when((F.col("time_n") == 1) & (F.col("source_n") > 1), "ambiguous")
        .otherwise("unmatched")
    )
    activity = F.when(F.col("status") == "matched", F.coalesce("id_activity", "time_activity"))
    return joined.withColumn("status", status).select("file_id", activity.alias("activity_id"), "status")
