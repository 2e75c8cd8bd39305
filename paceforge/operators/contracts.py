"""Range and pair checks as findings, generated from lists of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = dict[str, tuple[str, Column]]


def between(field: str, low: float | None, high: float | None) -> Column:
    """True where a value is out of range; null is in range."""
    c, bad = F.col(field), F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return F.coalesce(bad, F.lit(False))


def activity_rules() -> Rules:
    """Code by field and what is wrong: the domains of ingested activities (fixed values)."""
    rules = {f"{f}_NEGATIVE": (f, between(f, 0, None)) for f in ("distance_m", "moving_s", "elapsed_s", "elevation_gain_m", "elevation_loss_m")}
    rules |= {f"{f}_RANGE": (f, between(f, 1, 300)) for f in ("average_heart_rate", "maximum_heart_rate")}
    rules |= {f"{f}_RANGE": (f, between(f, 0, 500)) for f in ("average_cadence", "maximum_cadence")}
    rules["MOVING_OVER_ELAPSED"] = ("moving_s", F.coalesce(F.col("moving_s") > F.col("elapsed_s"), F.lit(False)))
    return rules


def trackpoint_rules() -> Rules:
    """Positions come in pairs and inside the globe; heart rate and cadence in their analytic ranges (fixed values)."""
    return {
        "POSITION_UNPAIRED": ("latitude", F.col("latitude").isNull() != F.col("longitude").isNull()),
        "LATITUDE_RANGE": ("latitude", between("latitude", -90, 90)),
        "LONGITUDE_RANGE": ("longitude", between("longitude", -180, 180)),
        "HEART_RATE_RANGE": ("heart_rate", between("heart_rate", 20, 250)),
        "CADENCE_RANGE": ("cadence", between("cadence", 0, 300)),
    }


def message_rules() -> Rules:
    """Domains of device records (fixed values), wider than the analytic ones."""
    rules = {f"{f}_NEGATIVE": (f, between(f, 0, None)) for f in ("distance_m", "speed_mps", "power_watts")}
    rules |= {f"{f}_RANGE": (f, between(f, *r)) for f, r in {"latitude": (-90, 90), "longitude": (-180, 180), "heart_rate": (1, 300), "cadence": (0, 500)}.items()}
    return rules


def lap_rules() -> Rules:
    """Domains of laps (fixed values)."""
    rules = {f"{f}_NEGATIVE": (f, between(f, 0, None)) for f in ("elapsed_s", "moving_s", "distance_m", "elevation_gain_m", "elevation_loss_m")}
    rules |= {f"{f}_RANGE": (f, between(f, 1, 300)) for f in ("average_heart_rate", "maximum_heart_rate")}
    return rules | {f"{f}_RANGE": (f, between(f, 0, 500)) for f in ("average_cadence", "maximum_cadence")}


def session_rules() -> Rules:
    """Domains of device sessions (fixed values)."""
    rules = lap_rules() | {f"{f}_NEGATIVE": (f, between(f, 0, None)) for f in ("average_speed", "maximum_speed", "calories")}
    return rules | {"minimum_heart_rate_RANGE": ("minimum_heart_rate", between("minimum_heart_rate", 1, 300))}


def source_rules() -> Rules:
    """Where a record comes from (fixed values): names and ids within length, a SHA-256, row numbers from 1."""
    long = lambda f, n: F.coalesce(~F.length(f).between(1, n), F.lit(False))
    return {
        "SOURCE_FILE_NAME": ("source_file_name", F.col("source_file_name").isNull() | long("source_file_name", 1024)),
        "REFERENCED_FILE_NAME": ("referenced_file_name", long("referenced_file_name", 1024)),
        "SOURCE_ACTIVITY_ID": ("source_activity_id", long("source_activity_id", 255)),
        "CONTENT_SHA256": ("content_sha256", ~F.coalesce(F.col("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        "SOURCE_ROW_NUMBER": ("source_row_number", between("source_row_number", 1, None)),
    }


def check(df: DataFrame, rules: Rules) -> DataFrame:
    """Add ``errors``: the (code, field) of each broken rule. Rules about columns that are not there do not apply."""
    own = {code: (field, bad) for code, (field, bad) in rules.items() if field in df.columns}
    if not own:
        return df.withColumn("errors", F.array().cast("array<struct<code:string,field:string>>"))
    found = F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))) for code, (field, bad) in own.items()])
    return df.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def split(checked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, findings): bad rows go to the findings, one row per broken rule, and never stop the others."""
    findings = checked.where(F.size("errors") > 0).select(key, F.explode("errors").alias("e")).select(key, F.lit("error").alias("severity"), "e.code", "e.field")
    return checked.where(F.size("errors") == 0).drop("errors"), findings


def required_measurements(rows: DataFrame) -> DataFrame:
    """``rows`` with ``moving_s`` set to ``elapsed_s`` where it is null, and ``reject``: why a row cannot be stored, else null.

    A stored activity needs a distance and an elapsed time; without both, the distance is named.
    """
    reject = F.when(F.col("distance_m").isNull(), "DISTANCE_MISSING").when(F.col("elapsed_s").isNull(), "ELAPSED_TIME_MISSING")
    return rows.withColumns({"moving_s": F.coalesce("moving_s", "elapsed_s"), "reject": reject})


def all_findings(**found: DataFrame) -> DataFrame:
    """(stage, id, code) of the findings of several steps, named by the keywords; each step gives (id, code, ...)."""
    parts = [df.select(F.lit(stage).alias("stage"), F.col("id").cast("string").alias("id"), "code") for stage, df in found.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
