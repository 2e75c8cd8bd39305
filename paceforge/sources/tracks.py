"""GPX tracks as trackpoints, and which sensor source of an activity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = "struct<_lat:double,_lon:double,ele:double,time:string>"


def accept_in_order(points: DataFrame, key: str, ts: str, position: str) -> DataFrame:
    """Keep points whose time is not before any earlier kept one, and number them densely from 0 as ``seq``.

    A point that is dropped lies before the running maximum, so the maximum of
    all earlier points is that of the kept ones.
    """
    order = Window.partitionBy(key).orderBy(position)
    seen = F.max(ts).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = points.withColumn("__seen", seen).where(F.col("__seen").isNull() | (F.col(ts) >= F.col("__seen"))).drop("__seen")
    return kept.withColumn("seq", F.row_number().over(order) - 1)


def read_gpx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trackpoints, findings) of GPX files: (file, seq, recorded_at, elapsed_ms, latitude, longitude, altitude_m).

    Points without position or time, out of range, or before an earlier one
    are dropped with a finding; a file without any point left has one too.
    """
    tracks = spark.read.format("xml").option("rowTag", "trk").option("ignoreNamespace", "true").schema(f"name string, trkseg array<struct<trkpt:array<{POINT}>>>").load(path)
    files = tracks.select(F.input_file_name().alias("file"), "name", F.flatten(F.transform("trkseg", lambda s: s["trkpt"])).alias("points"))
    points = files.select("file", F.posexplode_outer("points").alias("at", "p")).select("file", "at", F.col("p._lat").alias("latitude"), F.col("p._lon").alias("longitude"), F.col("p.ele").alias("altitude_m"), F.col("p.time").try_cast("timestamp").alias("recorded_at"))
    good = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.col("recorded_at").isNotNull()
    kept = accept_in_order(points.where(good), "file", "recorded_at", "at")
    first = F.min("recorded_at").over(Window.partitionBy("file"))
    out = kept.select("file", "at", "seq", "recorded_at", (F.unix_millis("recorded_at") - F.unix_millis(first)).alias("elapsed_ms"), F.col("latitude").cast("decimal(9,6)").alias("latitude"), F.col("longitude").cast("decimal(9,6)").alias("longitude"), F.col("altitude_m").cast("decimal(10,3)").alias("altitude_m"))
    dropped = points.where("at is not null").join(kept.select("file", "at"), ["file", "at"], "left_anti").select("file", F.lit("GPX_TRACKPOINT_INVALID").alias("code"), F.col("at").cast("long").alias("row"))
    none = files.select("file").distinct().join(kept.select("file"), "file", "left_anti").select("file", F.lit("GPX_NO_VALID_TRACKPOINTS").alias("code"), F.lit(None).cast("long").alias("row"))
    return out.drop("at"), dropped.unionByName(none)


def choose_source(sources: DataFrame) -> DataFrame:
    """The sensor source of each activity: device file before track file, first provider before second, then most points, laps, smallest hash.

    ``sources`` is (activity_id, provider, format, trackpoints, laps, sha256).
    """
    #: Priority of provider and format (fixed values).
    priority = F.when(F.col("format") == "fit", F.when(F.col("provider") == "garmin", 400).otherwise(300)).otherwise(F.when(F.col("provider") == "garmin", 200).otherwise(100))
    order = Window.partitionBy("activity_id").orderBy(priority.desc(), F.col("trackpoints").desc(), F.col("laps").desc(), "sha256")
    return sources.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
