"""Exact-distance efforts inside activities, without driver loops or Python.

Times between samples are interpolated along cumulative distance. Where the
distance stands still, a segment starts as late and finishes as early as it can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import STANDARD_DISTANCES
from .bests import new_efforts


def targets(spark) -> DataFrame:
    """(target, target_m): one row per standard distance."""
    return spark.createDataFrame([*STANDARD_DISTANCES.items()], "target string, target_m double").withColumn("target_m", F.col("target_m").cast("decimal(14,3)"))


def broken_traces(samples: DataFrame) -> DataFrame:
    """Activities whose time or distance runs backwards; they have no efforts."""
    order = Window.partitionBy("activity_id").orderBy("seq")
    back = (F.col("elapsed_ms") < F.lag("elapsed_ms").over(order)) | (F.col("distance_m") < F.lag("distance_m").over(order))
    return samples.where("distance_m is not null").select("activity_id", back.alias("back")).where("back").select("activity_id").distinct()


def breakpoints(samples: DataFrame) -> DataFrame:
    """(activity_id, d, t0, t1): each distance with the first and last time it was held, of unbroken traces."""
    good = samples.where("distance_m is not null").join(broken_traces(samples), "activity_id", "left_anti")
    return good.groupBy("activity_id", F.col("distance_m").cast("decimal(14,3)").alias("d")).agg(F.min("elapsed_ms").cast("double").alias("t0"), F.max("elapsed_ms").cast("double").alias("t1"))


def _interpolated(p: Column, q: Column, x: Column) -> Column:
    return p["t1"] + (x - p["d"]).cast("double") / (q["d"] - p["d"]).cast("double") * (q["t0"] - p["t1"])


def rolling_efforts(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """(activity_id, target, elapsed_s, start_m, finish_m): the fastest segment of exactly the target distance.

    ``samples`` is (activity_id, seq, elapsed_ms, distance_m), ``wanted``
    (target, target_m). A fastest segment has a sample at its start or at its
    finish, so each sample is tried as both: the other end is looked up by a
    last and a next sample over the samples and ends in order of distance.
    Activities that are too short have no row; equal times go to the earlier
    start.
    """
    points = breakpoints(samples)
    pairs = points.crossJoin(F.broadcast(wanted))  # one copy per standard distance
    known = F.struct("d", "t0", "t1")
    nothing = F.lit(None).cast("struct<d:decimal(14,3),t0:double,t1:double>")
    here = pairs.select("activity_id", "target", "target_m", F.col("d").alias("x"), known.alias("point"), nothing.alias("of"), F.lit(0).alias("side"))
    ends = pairs.select("activity_id", "target", "target_m", (F.col("d") + F.col("target_m")).cast("decimal(14,3)").alias("x"), nothing.alias("point"), known.alias("of"), F.lit(1).alias("side"))
    starts = pairs.select("activity_id", "target", "target_m", (F.col("d") - F.col("target_m")).cast("decimal(14,3)").alias("x"), nothing.alias("point"), known.alias("of"), F.lit(-1).alias("side"))
    # both frames grow by a row at a time; a frame that shrinks would be read anew for each row
    below, above = (Window.partitionBy("activity_id", "target").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("x").asc(), F.col("x").desc()))
    filled = (
        here.unionByName(ends)
        .unionByName(starts)
        .withColumns({"p": F.last("point", True).over(below), "q": F.last("point", True).over(above)})
        .where("side <> 0 and p is not null and q is not null")
    )
    exact = F.col("p.d") == F.col("x")
    other = F.when(exact, F.when(F.col("side") == 1, F.col("p.t0")).otherwise(F.col("p.t1"))).otherwise(_interpolated(F.col("p"), F.col("q"), F.col("x")))
    from_sample = F.col("side") == 1
    elapsed = F.when(from_sample, other - F.col("of.t1")).otherwise(F.col("of.t0") - other)
    start_m = F.when(from_sample, F.col("of.d")).otherwise(F.col("x"))
    best = filled.select("activity_id", "target", F.struct(F.round(elapsed / 1000, 6).alias("elapsed_s"), start_m.alias("start_m"), (start_m + F.col("target_m")).cast("decimal(14,3)").alias("finish_m")).alias("e")).where("e.elapsed_s > 0")
    return best.groupBy("activity_id", "target").agg(F.min("e").alias("e")).select("activity_id", "target", "e.*")


def first_crossings(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """(activity_id, target, elapsed_s): when the cumulative distance first reaches the target, interpolated."""
    order = Window.partitionBy("activity_id").orderBy("d")
    steps = breakpoints(samples).withColumns({"pd": F.lag("d").over(order), "pt": F.lag("t1").over(order)})
    hit = (F.col("pd") < F.col("target_m")) & (F.col("d") >= F.col("target_m")) | F.col("pd").isNull() & (F.col("d") == F.col("target_m"))
    at = F.when(F.col("d") == F.col("target_m"), F.col("t0")).otherwise(F.col("pt") + (F.col("target_m") - F.col("pd")).cast("double") / (F.col("d") - F.col("pd")).cast("double") * (F.col("t0") - F.col("pt")))
    return steps.join(F.broadcast(wanted), hit).select("activity_id", "target", F.round(at / 1000, 6).alias("elapsed_s"))


def distance_evidence(activities: DataFrame, samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per activity and distance: recorded totals, number of samples, from-start and fastest segment times."""
    n = samples.where("distance_m is not null").groupBy("activity_id").agg(F.count("*").alias("distance_samples"))
    start = first_crossings(samples, wanted).withColumnRenamed("elapsed_s", "from_start_s")
    rolling = rolling_efforts(samples, wanted).select("activity_id", "target", F.col("elapsed_s").alias("rolling_s"))
    both = start.join(rolling, ["activity_id", "target"], "full")
    return activities.select("activity_id", "distance_m", "elapsed_ms").join(n, "activity_id", "left").join(both, "activity_id")


def best_observed(activities: DataFrame, samples: DataFrame, wanted: DataFrame, tolerance: float = 0.03, known: DataFrame | None = None) -> DataFrame:
    """(athlete_id, target, elapsed_s, local_date, activity_id, effort_type): the athlete's best per distance.

    A rolling effort where the samples give one, else the whole activity scaled
    to the distance if it is within the tolerance. Only activities that are
    long enough have their samples read. Equal times go to the later date.
    Efforts that ``known`` (activity_id, distance, elapsed_s) has within two
    seconds are left out.
    """
    t = wanted.withColumn("m", F.col("target_m").cast("double"))
    long_enough = activities.where("elapsed_ms > 0").join(F.broadcast(t), activities["distance_m"] >= t["m"] * (1 - tolerance))
    few = samples.join(long_enough.select("activity_id").distinct(), "activity_id", "left_semi")
    rolled = rolling_efforts(few, wanted).select("activity_id", "target", F.col("elapsed_s").alias("rolling_s"))
    joined = long_enough.join(rolled, ["activity_id", "target"], "left")
    whole = F.when(F.abs(F.col("distance_m").cast("double") - F.col("m")) <= F.col("m") * tolerance, F.col("elapsed_ms") / 1000 * F.col("m") / F.col("distance_m").cast("double"))
    kind = F.when(F.col("rolling_s").isNotNull(), "rolling_segment").otherwise("whole_activity")
    found = joined.withColumn("elapsed_s", F.round(F.coalesce("rolling_s", whole), 3)).where("elapsed_s is not null").withColumn("effort_type", kind)
    if known is not None:
        found = new_efforts(found.withColumn("distance", F.col("target")), known)
    order = Window.partitionBy("athlete_id", "target").orderBy("elapsed_s", F.col("local_date").desc(), "activity_id")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").select("athlete_id", "target", "elapsed_s", "local_date", "activity_id", "effort_type")
