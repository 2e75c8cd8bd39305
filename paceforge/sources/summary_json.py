"""Nested summary JSON exports: unit scaling and fallbacks."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .summary_csv import with_athlete

CONTAINER = "summarizedActivitiesExport"
KINDS = {"running": "running", "trail_running": "trail_running", "treadmill_running": "treadmill_running"}


#: What is read of a record (fixed names).
FIELDS = (
    "activityId", "activityType", "name", "startTimeGmt", "beginTimestamp", "timeZoneId", "elapsedDuration", "duration", "movingDuration", "distance", "elevationGain", "elevationLoss",
    "avgHr", "maxHr", "avgDoubleCadence", "avgRunCadence", "maxDoubleCadence", "maxRunCadence", "calories", "steps",
)


def container(value: object) -> list | None:
    """The first array of that name, depth first: a mapping's own one before those below it."""
    if isinstance(value, dict) and isinstance(value.get(CONTAINER), list):
        return value[CONTAINER]
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        if (found := container(child)) is not None:
            return found
    return None


def _records(batches):
    """Each file's records as JSON text, or its finding."""
    schema = pa.schema([("file", pa.string()), ("row", pa.int64()), ("record", pa.string()), ("code", pa.string())])
    for batch in batches:
        out: list[tuple] = []
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                found = container(json.loads(text.removeprefix("\ufeff")))
            except (ValueError, RecursionError):
                out.append((file, None, None, "GARMIN_JSON_INVALID"))
                continue
            if found is None:
                out.append((file, None, None, "GARMIN_SUMMARY_CONTAINER_MISSING"))
                continue
            # null for what is an object or a list where a plain value is wanted
            plain = lambda r: {k: r[k] for k in FIELDS if isinstance(r.get(k), (str, int, float)) and not isinstance(r[k], bool)}
            out += [(file, i, json.dumps(plain(r)), None) for i, r in enumerate(found) if isinstance(r, dict)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_summary_json(spark: SparkSession, path: str | list[str], athlete: str | Column | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(activities, findings) of all exports under ``path`` in one scan: milliseconds as seconds, centimetres as metres, single-leg cadence doubled.

    A record without start, duration or id becomes a finding, and so does a
    file that is no JSON or has no summaries. ``start_utc`` takes epoch numbers
    (in milliseconds above 1e10) and ISO text, in UTC. ``row`` counts a file's
    records from 0; ``athlete`` tells whose export a file is.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = with_athlete(files.mapInArrow(_records, "file string, row long, record string, code string"), athlete)
    broken = rows.where("code is not null").select(F.lit("error").alias("severity"), "code", F.lit("The export has no activity summaries.").alias("message"), "row", "athlete_id", F.col("file").alias("export"))
    rows = rows.where("code is null").withColumn("r", F.from_json("record", ", ".join(f"`{f}` string" for f in FIELDS)))
    text = lambda name: F.nullif(F.trim(F.col(f"r.{name}")), F.lit(""))
    number = lambda *names: F.coalesce(*[text(n).try_cast("double") for n in names])
    when = F.coalesce(text("startTimeGmt"), text("beginTimestamp"))
    epoch = when.try_cast("double")
    start = F.when(epoch.isNotNull(), F.timestamp_seconds(F.when(epoch > 1e10, epoch / 1000).otherwise(epoch))).otherwise(when.try_cast("timestamp"))
    leg = lambda double, single: F.coalesce(number(double), number(single) * 2)
    made = rows.select(
        "athlete_id",
        "row",
        text("activityId").alias("activity_id"),
        F.coalesce(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[F.lower(text("activityType"))], F.lit("other")).alias("kind"),
        text("name").alias("name"),
        start.alias("start_utc"),
        text("timeZoneId").alias("timezone_name"),
        (number("elapsedDuration", "duration") / 1000).alias("elapsed_s"),
        (number("movingDuration") / 1000).alias("moving_s"),
        (number("distance") / 100).alias("distance_m"),
        (number("elevationGain") / 100).alias("elevation_gain_m"),
        (number("elevationLoss") / 100).alias("elevation_loss_m"),
        number("avgHr").alias("average_heart_rate"),
        number("maxHr").alias("maximum_heart_rate"),
        leg("avgDoubleCadence", "avgRunCadence").alias("average_cadence"),
        leg("maxDoubleCadence", "maxRunCadence").alias("maximum_cadence"),
        number("calories").alias("calories"),
        F.round(number("steps")).cast("long").alias("steps"),
        F.col("file").alias("export"),
    )
    bad = F.col("start_utc").isNull() | F.col("elapsed_s").isNull() | (F.col("elapsed_s") < 0) | F.col("activity_id").isNull() | F.coalesce(F.col("distance_m") < 0, F.lit(False))
    unread = made.where(bad).select(F.lit("error").alias("severity"), F.lit("GARMIN_SUMMARY_RECORD_INVALID").alias("code"), F.lit("The record could not be read.").alias("message"), "row", "athlete_id", "export")
    return made.where(~bad), broken.unionByName(unread)
