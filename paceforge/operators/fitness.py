"""Training profiles at any date, current-fitness estimates and goal assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import RIEGEL_EXPONENT, STANDARD_DISTANCES

#: Model constants by distance (fixed values): range width, volume and long-run sensitivity,
#: runs, kilometres and longest run of a full preparation, largest readiness penalty.
FITNESS = {
    "5k": (0.01, 0.0, 0.0, 18, 120.0, 10.0, 0.01),
    "10k": (0.015, 0.003, 0.0, 24, 240.0, 15.0, 0.015),
    "half_marathon": (0.025, 0.008, 0.005, 36, 420.0, 24.0, 0.03),
    "marathon": (0.04, 0.045, 0.02, 48, 650.0, 35.0, 0.08),
}
EMBEDDED_RESERVE, MAX_EFFORT_RESERVE = 0.96, 0.985
#: Goal model by distance (fixed values): cap of the longest run, weights of runs, kilometres and longest run.
GOALS = {"5k": (15.0, 0.35, 0.50, 0.15), "10k": (24.0, 0.25, 0.45, 0.30), "half_marathon": (32.0, 0.20, 0.35, 0.45), "marathon": (42.195, 0.15, 0.30, 0.55)}


def by_distance(distance: Column, values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[distance]


def as_of_runs(asks: DataFrame, runs: DataFrame, days: int) -> DataFrame:
    """Each (athlete_id, ask, as_of) with the athlete's runs of the last ``days`` days up to that date, and ``back`` in days.

    Both sides meet by (athlete, block of ``days`` days), so an athlete's long
    history is not compared with every date.
    """
    block = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)
    left = asks.withColumn("block", block(F.col("as_of")))
    right = runs.withColumn("block", F.explode(F.array(block(F.col("local_date")), block(F.col("local_date")) + 1)))
    back = F.datediff("as_of", "local_date")
    return left.join(right, ["athlete_id", "block"]).withColumn("back", back).where((back >= 0) & (back < days)).drop("block")


def training_profiles(asks: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs and kilometres of the last 28, 84, 168 and 365 days, longest run and classified and quality sessions of 84 days.

    ``asks`` is (athlete_id, ask, as_of), ``runs`` (athlete_id, local_date,
    distance_m, tags, is_quality). Dates without runs have zeros, and a null
    longest run.
    """
    near = as_of_runs(asks, runs, 365)
    inside = lambda n, x: F.when(F.col("back") < n, x)
    km = F.col("distance_m")
    values = []
    for n in (28, 84, 168, 365):
        values += [F.count(inside(n, F.lit(1))).alias(f"runs_{n}d"), F.round(F.coalesce(F.sum(inside(n, km)), F.lit(0)).cast("double") / 1000, 6).alias(f"distance_{n}d_km")]
    values += [
        F.round(F.max(inside(84, km)).cast("double") / 1000, 6).alias("longest_84d_km"),
        F.count(inside(84, F.when(~F.array_contains("tags", "unclassified"), 1))).alias("classified_84d"),
        F.count(inside(84, F.when(F.col("is_quality"), 1))).alias("quality_84d"),
    ]
    found = near.groupBy("athlete_id", "ask").agg(*values)
    zeros = [c for c in found.columns if c not in ("athlete_id", "ask", "longest_84d_km")]
    return asks.join(found, ["athlete_id", "ask"], "left").na.fill(0, zeros)


def training_blocks(asks: DataFrame, runs: DataFrame, days: int = 42) -> DataFrame:
    """Runs, kilometres, hours, longest run and last run date of the ``days`` up to each date."""
    found = as_of_runs(asks, runs, days).groupBy("athlete_id", "ask").agg(
        F.count("*").alias("runs"),
        F.round(F.sum("distance_m").cast("double") / 1000, 6).alias("distance_km"),
        F.round(F.sum("moving_ms") / 3600000, 6).alias("moving_hours"),
        F.round(F.max("distance_m").cast("double") / 1000, 6).alias("longest_km"),
        F.max("local_date").alias("last_run"),
    )
    return asks.join(found, ["athlete_id", "ask"], "left").na.fill(0, ["runs", "distance_km", "moving_hours"])


def anchors(marks: DataFrame) -> DataFrame:
    """The newest mark of each athlete: (athlete_id, anchor struct); equal dates go to the shorter time."""
    fields = [c for c in marks.columns if c != "athlete_id"]
    return marks.groupBy("athlete_id").agg(F.max_by(F.struct(*fields), F.struct("achieved_on", -F.col("elapsed_s"))).alias("anchor"))


def prior_anchors(anchor: DataFrame, history: DataFrame) -> DataFrame:
    """The athlete's best strictly older result over the anchor's distance: (athlete_id, prior_s)."""
    h = history.select("athlete_id", "distance", F.col("achieved_on").alias("on"), "elapsed_s")
    joined = anchor.join(h, "athlete_id").where("distance = anchor.distance and on < anchor.achieved_on")
    return joined.groupBy("athlete_id").agg(F.min("elapsed_s").alias("prior_s"))


def preparation(distance: Column, runs: Column, km: Column, longest: Column) -> Column:
    """0 to 1: recent runs, volume and longest run against a full preparation."""
    want = lambda i: by_distance(distance, {d: float(v[i]) for d, v in FITNESS.items()})
    part = lambda x, i: F.least(F.coalesce(x, F.lit(0.0)) / want(i), F.lit(1.0))
    return F.round(0.15 * part(runs, 3) + 0.45 * part(km, 4) + 0.40 * part(longest, 5), 6)


def current_fitness(marks: DataFrame, history: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """Potential and race readiness per athlete and standard distance.

    ``marks`` is at most one per athlete and distance: (athlete_id, distance,
    elapsed_s, achieved_on, max_effort, effort_type, activity_km, session_kind,
    is_verified). ``history`` has older results for the prior anchor. ``now``
    is the training profile of today, with ``as_of``; ``before`` those of the
    days before each mark, with ``distance``. Athletes without marks have no
    rows.
    """
    anchor = anchors(marks)
    base = anchor.join(prior_anchors(anchor, history), "athlete_id", "left").join(now.select("athlete_id", "as_of", F.col("runs_84d").alias("runs"), F.col("distance_84d_km").alias("km"), F.col("longest_84d_km").alias("longest")), "athlete_id")
    grid = base.withColumn("distance", F.explode(F.array(*[F.lit(d) for d in STANDARD_DISTANCES])))
    mark = marks.select("athlete_id", "distance", F.struct(*[c for c in marks.columns if c not in ("athlete_id", "distance")]).alias("mark"))
    earlier = before.select("athlete_id", "distance", F.col("distance_84d_km").alias("b_km"), F.col("longest_84d_km").alias("b_longest"))
    rows = grid.join(mark, ["athlete_id", "distance"], "left").join(earlier, ["athlete_id", "distance"], "left")

    value = lambda i: by_distance(F.col("distance"), {d: float(v[i]) for d, v in FITNESS.items()})
    metres = by_distance(F.col("distance"), STANDARD_DISTANCES)
    anchor_m = by_distance(F.col("anchor.distance"), STANDARD_DISTANCES)
    embedded = (F.col("anchor.activity_km") >= anchor_m / 1000 * 1.5) & (F.col("anchor.effort_type") != "whole_activity") & F.col("anchor.session_kind").isin("hills", "intervals", "tempo", "progressive")
    factor = F.when(embedded, EMBEDDED_RESERVE).when(F.col("anchor.max_effort"), MAX_EFFORT_RESERVE).otherwise(1.0)
    capacity = F.col("anchor.elapsed_s") * F.col("factor")
    improvement = F.coalesce(F.least(capacity / F.col("prior_s"), F.lit(1.0)), F.col("factor"))
    same = F.col("distance") == F.col("anchor.distance")
    from_mark = F.when(same, capacity).otherwise(F.col("mark.elapsed_s") * improvement)
    raw = F.when(F.col("mark").isNotNull(), from_mark).otherwise(capacity * F.pow(metres / anchor_m, F.lit(RIEGEL_EXPONENT)))

    def changed(x: Column, reference: Column, power: Column) -> Column:
        ratio = F.least(F.greatest(F.coalesce(x, F.lit(0.0)) / reference, F.lit(0.75)), F.lit(4.0))
        return F.when(reference > 0, F.pow(ratio, -power)).otherwise(1.0)

    endurance = F.when((F.col("distance") == "5k") | F.col("b_km").isNull(), 1.0).otherwise(F.least(F.greatest(changed(F.col("km"), F.col("b_km"), value(1)) * changed(F.col("longest"), F.coalesce("b_longest", F.lit(0.0)), value(2)), F.lit(0.90)), F.lit(1.03)))
    capped = lambda x: F.when(F.col("mark").isNotNull(), F.least(x, F.col("mark.elapsed_s"))).otherwise(x)
    rows = rows.withColumn("factor", factor).withColumn("potential", raw * endurance).withColumn("potential", capped(F.col("potential")))
    rows = rows.withColumn("preparation", preparation(F.col("distance"), F.col("runs"), F.col("km"), F.col("longest")))
    rows = rows.withColumn("readiness", capped(F.col("potential") * (1 + value(6) * (1 - F.col("preparation")))))
    width = value(0) * (1 + 0.5 * (1 - F.col("preparation")))
    age = F.datediff("as_of", "mark.achieved_on")
    sure = F.col("mark.is_verified") & (F.col("runs") >= 20)
    confidence = F.when(sure & same & (F.col("anchor.session_kind") != "unclassified"), "high").when(sure & F.col("prior_s").isNotNull() & (age <= 180) & (F.col("preparation") >= 0.85), "medium").otherwise("low")
    return rows.select(
        "athlete_id",
        "distance",
        F.round("potential", 3).alias("potential_s"),
        F.round("readiness", 3).alias("readiness_s"),
        F.round(F.col("readiness") * (1 - width), 3).alias("optimistic_s"),
        F.round(F.col("readiness") * (1 + width), 3).alias("conservative_s"),
        "preparation",
        confidence.alias("confidence"),
        F.col("mark.elapsed_s").alias("current_best_s"),
        F.round(F.col("mark.elapsed_s") - F.col("readiness"), 3).alias("improvement_s"),
    )


def goal_assessments(goals: DataFrame, current: DataFrame, reference: DataFrame) -> DataFrame:
    """Achievable range of each goal from training now against training before the best.

    ``goals`` is (athlete_id, distance, best_s, form_index); ``current`` and
    ``reference`` are training blocks by (athlete_id) and (athlete_id,
    distance), the first with ``as_of``.
    """
    c = current.select("athlete_id", "as_of", *[F.col(x).alias(f"c_{x}") for x in ("runs", "distance_km", "longest_km")], "last_run")
    r = reference.select("athlete_id", "distance", *[F.col(x).alias(f"r_{x}") for x in ("runs", "distance_km", "longest_km")])
    rows = goals.join(c, "athlete_id").join(r, ["athlete_id", "distance"])
    value = lambda i: by_distance(F.col("distance"), {d: float(v[i]) for d, v in GOALS.items()})
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    longest = lambda x: F.least(F.coalesce(x, F.lit(0.0)), value(0))
    rows = rows.withColumns({"run_ratio": ratio(F.col("c_runs"), F.col("r_runs")), "distance_ratio": ratio(F.col("c_distance_km"), F.col("r_distance_km")), "longest_ratio": ratio(longest(F.col("c_longest_km")), longest(F.col("r_longest_km")))})
    parts = [("run_ratio", 1), ("distance_ratio", 2), ("longest_ratio", 3)]
    weight = sum((F.when(F.col(n).isNotNull(), value(i)).otherwise(0.0) for n, i in parts[1:]), F.when(F.col(parts[0][0]).isNotNull(), value(1)).otherwise(0.0))
    clamped = [F.coalesce(F.least(F.greatest(F.col(n), F.lit(0.5)), F.lit(1.5)) * value(i), F.lit(0.0)) for n, i in parts]
    rows = rows.withColumn("support", F.when(weight > 0, F.round((clamped[0] + clamped[1] + clamped[2]) / weight, 6)))
    s = F.col("support")
    low = F.when(s.isNull(), 1.02).when(s >= 1.10, 0.98).when(s >= 0.90, 0.99).when(s >= 0.75, 1.00).otherwise(1.02)
    high = F.when(s.isNull(), 1.08).when(s >= 1.10, 1.02).when(s >= 0.90, 1.03).when(s >= 0.75, 1.05).otherwise(1.08)
    stale = F.col("last_run").isNull() | (F.datediff("as_of", "last_run") > 14)
    extra = F.when(stale, 0.02).otherwise(0.0) + F.when(F.col("form_index") < -15, 0.01).otherwise(0.0)
    weak = (F.col("c_runs") < 6) | (F.col("r_runs") < 6) | s.isNull() | stale
    named = F.filter(F.array(F.struct(F.col("run_ratio").alias("r"), F.lit(0).alias("i"), F.lit("frequency").alias("n")), F.struct(F.col("distance_ratio").alias("r"), F.lit(1).alias("i"), F.lit("volume").alias("n")), F.struct(F.col("longest_ratio").alias("r"), F.lit(2).alias("i"), F.lit("long_run").alias("n"))), lambda x: x["r"].isNotNull())
    focus = F.when(F.size(named) == 0, "history").when(F.array_min(named)["r"] >= 1.0, "distance").otherwise(F.array_min(named)["n"])
    return rows.select(
        "athlete_id",
        "distance",
        "run_ratio",
        "distance_ratio",
        "longest_ratio",
        "support",
        F.round(F.col("best_s") * (low + extra), 3).alias("optimistic_s"),
        F.round(F.col("best_s") * (high + extra), 3).alias("conservative_s"),
        F.when(weak, "low").otherwise("medium").alias("confidence"),
        focus.alias("focus"),
    )
