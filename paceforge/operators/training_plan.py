"""Plan outlines: goals times weeks, by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import STANDARD_DISTANCES
from .fitness import by_distance

MIN_DAYS, MAX_DAYS = 14, 364
#: Plan constants by distance (fixed values): share and cap of the long run, least and greatest peak week.
PLAN = {"5k": (0.22, 18.0, 30.0, 65.0), "10k": (0.24, 22.0, 35.0, 75.0), "half_marathon": (0.28, 30.0, 45.0, 90.0), "marathon": (0.32, 35.0, 60.0, 105.0)}
MARATHON_SHARE = {"base": 0.32, "build": 0.35, "specific": 0.38, "taper": 0.32, "race": 0.0}

#: Least quality, easy and long run (km) by distance (fixed values).
LEAST_KM = {"5k": (7.0, 4.0, 8.0), "10k": (9.0, 4.5, 10.0), "half_marathon": (12.0, 5.0, 12.0), "marathon": (15.0, 5.0, 12.0)}
#: Days after Monday by the number of running days (fixed values).
SLOTS = {3: (1, 3, 6), 4: (1, 3, 5, 6), 5: (0, 1, 3, 5, 6), 6: (0, 1, 2, 3, 5, 6), 7: (0, 1, 2, 3, 4, 5, 6)}
#: Seconds per kilometre beside the potential 5 km pace (fixed values).
PACES = {"easy": (90, 130), "recovery": (115, 150), "long": (75, 115)}
#: Seconds per kilometre of hard sessions beside the potential 5 km pace (5k) or the target pace (fixed values).
QUALITY_PACES = {"5k": (-3, 5), "10k": (-5, 5), "half_marathon": (-8, 4), "marathon": (-5, 5)}
#: Titles and purposes of sessions (fixed values).
TEXTS = {
    "easy": ("Easy aerobic run", "Maintain aerobic frequency while absorbing harder sessions."),
    "recovery": ("Recovery run", "Add low-cost aerobic volume before the long run."),
    "long": ("Long aerobic run", "Build distance-specific aerobic durability without racing training."),
}
HARD_TITLES = {
    "5k": "6 x 800 m at controlled 5K effort",
    "10k": "4 x 2 km at controlled 10K effort",
    "half_marathon": "3 x 3 km at threshold to half-marathon effort",
    "marathon": "3 x 4 km at controlled marathon effort",
}
MARATHON_TITLES = {"base": "Aerobic run with 6 x 20 second relaxed strides", "build": "2 x 3 km at controlled marathon effort"}
FOCUS = {"5k": "5K speed endurance", "10k": "10K pace and threshold durability", "half_marathon": "threshold and half-marathon pace", "marathon": "marathon pace and fueling durability"}


def plan_start(as_of: Column) -> Column:
    """The Monday of the week; from a Sunday the next day."""
    return F.when(F.dayofweek(as_of) == 1, F.date_add(as_of, 1)).otherwise(F.to_date(F.date_trunc("week", as_of)))


def phase(week: Column, weeks: Column) -> Column:
    left = weeks - week
    return F.when(left == 0, "race").when(left <= 2, "taper").when(left <= F.greatest(F.lit(5), F.floor(weeks / 3)), "specific").when(week <= F.greatest(F.lit(2), F.floor(weeks / 4)), "base").otherwise("build")


def goal_status(target_s: Column, readiness_s: Column, potential_s: Column, weeks: Column) -> Column:
    return F.when(target_s.isNull(), "fitness_based").when(target_s >= readiness_s * 0.99, "achievable").when((target_s >= potential_s * 0.98) & (weeks >= 8), "challenging").otherwise("aggressive")


def target_gap(target_s: Column, readiness_s: Column) -> Column:
    """Seconds by which a target is slower than race readiness; null without a target."""
    return F.round(target_s - readiness_s, 3)


def valid_goals(goals: DataFrame) -> DataFrame:
    """Goals with 14 to 364 days from plan start to race."""
    start = plan_start(F.col("as_of"))
    days = F.datediff("race_date", start) + 1
    return goals.withColumns({"plan_start": start, "plan_days": days}).where(days.between(MIN_DAYS, MAX_DAYS)).withColumn("weeks", F.ceil(days / 7).cast("int"))


def weekly_outline(goals: DataFrame) -> DataFrame:
    """(goal_id, distance, weeks, week, start_date, end_date, phase, target_km, long_run_km), one row per week.

    ``goals`` is (goal_id, distance, as_of, race_date, recent_weekly_km); goals
    outside the supported length have no rows.
    """
    value = lambda i: by_distance(F.col("distance"), {d: v[i] for d, v in PLAN.items()})
    g = valid_goals(goals)
    recent, weeks = F.col("recent_weekly_km"), F.col("weeks")
    ceiling = recent * F.pow(F.lit(1.05), F.greatest(weeks - 3, F.lit(1)))
    g = g.withColumn("peak", F.round(F.least(F.greatest(recent * 1.15, value(2)), ceiling, value(3)), 1))
    rows = g.withColumn("week", F.explode(F.sequence(F.lit(1), weeks)))
    rows = rows.withColumn("phase", phase(F.col("week"), weeks))
    done = F.col("week") - 1
    built = recent * F.pow(F.lit(1.035), done - F.floor(done / 4)) * F.when(F.col("week") % 4 == 0, 0.82).otherwise(1.0)
    race_km = by_distance(F.col("distance"), STANDARD_DISTANCES) / 1000
    target = (
        F.when(F.col("phase") == "race", F.greatest(recent * 0.45, race_km + 6))
        .when(F.col("phase") == "taper", F.col("peak") * F.when(weeks - F.col("week") == 1, 0.62).otherwise(0.78))
        .otherwise(F.least(built, F.col("peak")))
    )
    rows = rows.withColumn("target_km", F.round(target, 1))
    share = F.when(F.col("distance") == "marathon", by_distance(F.col("phase"), MARATHON_SHARE)).otherwise(value(0))
    long_run = F.least(F.col("target_km") * share, value(1)) * F.when(F.col("phase") == "taper", 0.75).otherwise(1.0)
    start = F.expr("date_add(plan_start, (week - 1) * 7)")
    return rows.select("goal_id", "distance", "weeks", "week", start.alias("start_date"), F.least(F.date_add(start, 6), "race_date").alias("end_date"), "phase", "target_km", F.when(F.col("phase") == "race", 0.0).otherwise(F.round(long_run, 1)).alias("long_run_km"))


def outline_summary(outline: DataFrame) -> DataFrame:
    """First and peak week and longest run of each plan."""
    return outline.groupBy("goal_id").agg(F.min_by("target_km", "week").alias("first_week_km"), F.max("target_km").alias("peak_week_km"), F.max("long_run_km").alias("peak_long_run_km"), F.count("*").alias("weeks"))


def week_progress(plans: DataFrame, weeks: DataFrame, sessions: DataFrame, runs: DataFrame) -> DataFrame:
    """Planned against run, per week of each plan, up to the plan's ``as_of``.

    (plan_id, week, start_date, end_date, phase, status, target_km,
    long_run_km, runs, actual_km, longest_km, completion_pct,
    long_run_completion_pct, planned_km, as_of, plan_start, plan_end).
    ``plans`` is (plan_id, athlete_id, as_of), ``weeks`` (plan_id, week,
    start_date, end_date, phase, target_km, long_run_km) with weeks of seven
    days from the first, ``sessions`` (plan_id, scheduled, target_km) the
    detailed week. ``planned_km`` is what should be run by now: all of a
    finished week; of the current one the sessions that are due if it is the
    detailed week, else sevenths by day. All runs of the plan's time count,
    whether they fulfil a session or not. Runs meet plans by athlete and block
    of a year. Plans are never broadcast: what a plan is made into by weeks has
    many times the size that Spark assumes.
    """
    span = weeks.groupBy("plan_id").agg(F.min("start_date").alias("plan_start"), F.max_by("end_date", "week").alias("plan_end"))
    asked = plans.select("plan_id", "athlete_id", "as_of").join(span.hint("merge"), "plan_id")
    block = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / 365)
    last = F.least("as_of", "plan_end")
    open_plans = asked.withColumn("last", last).where("plan_start <= last").withColumn("block", F.explode(F.sequence(block(F.col("plan_start")), block(F.col("last")))))
    met = open_plans.hint("merge").join(runs.select("athlete_id", "local_date", "distance_m", block(F.col("local_date")).alias("block")), ["athlete_id", "block"]).where("local_date between plan_start and last")
    km = lambda x: F.round(x.cast("double") / 1000, 3)
    done = met.groupBy("plan_id", (F.floor(F.datediff("local_date", "plan_start") / 7) + 1).cast("int").alias("week")).agg(F.count("*").alias("runs"), km(F.sum("distance_m")).alias("actual_km"), km(F.max("distance_m")).alias("longest_km"))
    due = sessions.join(plans.select("plan_id", "as_of").hint("merge"), "plan_id").groupBy("plan_id").agg(F.min("scheduled").alias("detailed_from"), F.coalesce(F.sum(F.when(F.col("scheduled") <= F.col("as_of"), F.col("target_km"))), F.lit(0.0)).alias("due_km"))
    rows = weeks.join(asked.hint("merge"), "plan_id").join(done.hint("merge"), ["plan_id", "week"], "left").join(due.hint("merge"), "plan_id", "left").na.fill(0, ["runs"]).na.fill(0.0, ["actual_km", "longest_km"])
    as_of = F.col("as_of")
    status = F.when(as_of < F.col("start_date"), "upcoming").when(as_of > F.col("end_date"), "completed").otherwise("in_progress")
    sevenths = F.least(F.datediff(as_of, "start_date") + 1, F.lit(7)) / 7
    planned = (
        F.when(F.col("status") == "upcoming", 0.0)
        .when(F.col("status") == "completed", F.col("target_km"))
        .when(F.col("detailed_from").between(F.col("start_date"), F.col("end_date")), F.col("due_km"))
        .otherwise(F.col("target_km") * sevenths)
    )
    pct = lambda x, y: F.round(F.when(F.col(y) != 0, F.col(x) / F.col(y) * 100).otherwise(0.0), 1)
    return rows.withColumn("status", status).select(
        "plan_id", "week", "start_date", "end_date", "phase", "status", "target_km", "long_run_km", "runs", "actual_km", "longest_km",
        pct("actual_km", "target_km").alias("completion_pct"), pct("longest_km", "long_run_km").alias("long_run_completion_pct"), planned.alias("planned_km"), "as_of", "plan_start", "plan_end",
    )


def detailed_sessions(weeks: DataFrame) -> DataFrame:
    """(goal_id, week, scheduled, kind, title, purpose, distance_km, faster, slower): the sessions of each week.

    ``weeks`` is (goal_id, distance, week, start_date, phase, target_km,
    long_run_km, days_per_week, five_k_pace, target_pace), 3 to 7 days a week,
    paces in s/km. What long, hard and least easy runs have above the week's
    distance is taken from the hard run first, then from the long one, down to
    their least; easy runs that would get too short are left out, but for one.
    Other numbers of days and null values give no sessions.
    """
    least = lambda i: by_distance(F.col("distance"), {d: v[i] for d, v in LEAST_KM.items()})
    strides = (F.col("distance") == "marathon") & (F.col("phase") == "base")
    least_hard = F.when(strides, 8.0).otherwise(least(0))
    w = weeks.where(F.col("days_per_week").between(min(SLOTS), max(SLOTS))).withColumns({"least_hard": least_hard, "hard": F.round(F.greatest(least_hard, F.col("target_km") * F.when(strides, 0.14).otherwise(0.16)), 1), "easy_n": F.col("days_per_week") - 2})
    w = w.withColumn("over", F.greatest(F.col("long_run_km") + F.col("hard") + F.col("easy_n") * least(1) - F.col("target_km"), F.lit(0.0)))
    w = w.withColumn("cut", F.least(F.col("over"), F.greatest(F.col("hard") - F.col("least_hard"), F.lit(0.0))))
    cut_long = F.least(F.col("over") - F.col("cut"), F.greatest(F.col("long_run_km") - least(2), F.lit(0.0)))
    w = w.withColumns({"hard": F.round(F.col("hard") - F.col("cut"), 1), "long": F.round(F.col("long_run_km") - cut_long, 1)})
    w = w.withColumn("rest", F.greatest(F.col("target_km") - F.col("long") - F.col("hard"), F.lit(0.0)))
    fewer = F.greatest(F.least(F.floor(F.col("rest") / least(1)), F.col("easy_n")), F.lit(1))
    w = w.withColumn("easy_n", F.when(F.col("rest") / F.col("easy_n") < least(1), fewer).otherwise(F.col("easy_n")).cast("int"))
    w = w.withColumn("easy", F.round(F.col("rest") / F.col("easy_n"), 1))
    slots = F.create_map(*[x for n, days in SLOTS.items() for x in (F.lit(n), F.array(*map(F.lit, days)))])[F.col("easy_n") + 2]
    w = w.withColumn("slots", slots).select("*", F.explode_outer("slots").alias("offset")).where("offset is not null")  # a plain explode pushes its null check through all of the above
    n, at = F.size("slots"), F.col("offset")
    kind = (
        F.when(at == F.element_at("slots", -1), "long")
        .when(at == F.when(n >= 4, F.element_at("slots", 2)).otherwise(F.element_at("slots", 1)), "quality")
        .when((n >= 4) & (at == F.element_at("slots", -2)), "recovery")
        .otherwise("easy")
    )
    w = w.withColumn("kind", kind)
    hard_base = F.when(F.col("distance") == "5k", F.col("five_k_pace")).otherwise(F.col("target_pace"))
    bound = lambda i: F.round(F.when(F.col("kind") == "quality", hard_base + by_distance(F.col("distance"), {d: v[i] for d, v in QUALITY_PACES.items()})).otherwise(F.col("five_k_pace") + by_distance(F.col("kind"), {k: v[i] for k, v in PACES.items()})), 3)
    km = F.when(F.col("kind") == "long", F.col("long")).when(F.col("kind") == "quality", F.col("hard")).otherwise(F.col("easy"))
    hard_title = by_distance(F.col("distance"), HARD_TITLES)
    hard_title = F.when(F.col("distance") == "marathon", F.coalesce(by_distance(F.col("phase"), MARATHON_TITLES), hard_title)).otherwise(hard_title)
    hard_purpose = F.concat(F.lit("Develop "), by_distance(F.col("distance"), FOCUS), F.lit("; distance includes warm-up and cool-down."))
    text = lambda i, hard: F.when(F.col("kind") == "quality", hard).otherwise(by_distance(F.col("kind"), {k: v[i] for k, v in TEXTS.items()}))
    return w.select("goal_id", "week", F.expr("date_add(start_date, offset)").alias("scheduled"), "kind", text(0, hard_title).alias("title"), text(1, hard_purpose).alias("purpose"), km.alias("distance_km"), bound(0).alias("faster"), bound(1).alias("slower"))
