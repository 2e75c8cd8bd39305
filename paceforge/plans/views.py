"""The domain tables over the given star-schema tables, as DataFrames and as SQL.

Every view is a fixed mapping of existing rows; nothing is made up beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as runs: (activity_id, athlete_id, start_utc, local_date, distance_m, moving_ms, elapsed_ms, name, elevation_m, status)."""
    k = F.col("o_orderkey")
    name = F.create_map(*[F.lit(x) for x in ("1-URGENT", "City Race", "2-HIGH", "6 x 1K intervals", "3-MEDIUM", "Progressive long run", "4-NOT SPECIFIED", "Easy aerobic")])[F.col("o_orderpriority")]
    base = table(spark, sf_dir, "orders").select(
        k.alias("activity_id"),
        F.floor(F.col("o_custkey") / 20).cast("bigint").alias("athlete_id"),
        F.timestamp_seconds(F.unix_timestamp("o_orderdate") + k % 86400).alias("start_utc"),
        F.to_date("o_orderdate").alias("local_date"),
        (F.col("o_totalprice") / 10).cast("decimal(12,3)").alias("distance_m"),
        F.coalesce(name, F.lit("Morning Run")).alias("name"),
        F.when(k % 5 != 0, (k % 400).cast("decimal(10,3)")).alias("elevation_m"),
        F.when(k % 97 == 0, "excluded").when(k % 3 == 0, "verified").otherwise("unverified").alias("status"),
    )
    moving = F.round(F.col("distance_m").cast("double") * (240 + F.col("activity_id") % 180)).cast("bigint")
    return base.withColumn("moving_ms", moving).withColumn("elapsed_ms", F.col("moving_ms") + (F.col("activity_id") % 7) * 15000)


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that count: not excluded."""
    return all_activities(spark, sf_dir).where("status <> 'excluded'")


def trackpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sensor samples, an hour as a second: (activity_id, seq, elapsed_ms, distance_m, heart_rate, has_position, cadence, is_paused)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("activity_id"),
        (F.row_number().over(order) - 1).alias("seq"),
        F.floor((us - F.min(us).over(Window.partitionBy("user_id"))) / 3600000).cast("bigint").alias("elapsed_ms"),
        F.sum((F.col("value") * 5).cast("decimal(14,3)")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(14,3)").alias("distance_m"),
        F.when(F.col("event_type") != "signup", 90 + k).alias("heart_rate"),
        (F.col("event_type") != "view").alias("has_position"),
        F.when(F.col("event_type") != "click", 150 + k % 40).alias("cadence"),
        (F.col("event_type") == "error").alias("is_paused"),
    )


def profiles(acts: DataFrame) -> DataFrame:
    """One or two periods per athlete; every seventh athlete has a gap between them: (athlete_id, valid_from, valid_to, max_hr)."""
    ids = acts.select("athlete_id").distinct()
    split = F.lit("1996-01-01").cast("date")
    first = ids.select("athlete_id", F.lit("1990-01-01").cast("date").alias("valid_from"), split.alias("valid_to"), (180 + F.col("athlete_id") % 20).cast("int").alias("max_hr"))
    second = ids.select("athlete_id", F.when(F.col("athlete_id") % 7 == 0, F.date_add(split, 200)).otherwise(split).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), (175 + F.col("athlete_id") % 20).cast("int").alias("max_hr"))
    return first.unionByName(second)


#: The same views for the SQL side.
SQL = """
all_activities AS (
  SELECT *, moving_ms + (activity_id % 7) * 15000 AS elapsed_ms FROM (
    SELECT o_orderkey AS activity_id, CAST(floor(o_custkey / 20) AS BIGINT) AS athlete_id,
      o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND AS start_utc, CAST(o_orderdate AS DATE) AS local_date,
      CAST(o_totalprice / 10 AS DECIMAL(12,3)) AS distance_m,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'City Race' WHEN '2-HIGH' THEN '6 x 1K intervals' WHEN '3-MEDIUM' THEN 'Progressive long run'
        WHEN '4-NOT SPECIFIED' THEN 'Easy aerobic' ELSE 'Morning Run' END AS name,
      CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 400 AS DECIMAL(10,3)) END AS elevation_m,
      CASE WHEN o_orderkey % 97 = 0 THEN 'excluded' WHEN o_orderkey % 3 = 0 THEN 'verified' ELSE 'unverified' END AS status,
      CAST(round(CAST(CAST(o_totalprice / 10 AS DECIMAL(12,3)) AS DOUBLE) * (240 + o_orderkey % 180)) AS BIGINT) AS moving_ms
    FROM orders)),
activities AS (SELECT * FROM all_activities WHERE status <> 'excluded'),
trackpoints AS (
  SELECT user_id AS activity_id, row_number() OVER w - 1 AS seq,
    CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3600000) AS BIGINT) AS elapsed_ms,
    CAST(sum(CAST(value * 5 AS DECIMAL(14,3))) OVER (w ROWS UNBOUNDED PRECEDING) AS DECIMAL(14,3)) AS distance_m,
    CASE WHEN event_type <> 'signup' THEN 90 + CAST(props->>'k' AS INT) END AS heart_rate, event_type <> 'view' AS has_position,
    CASE WHEN event_type <> 'click' THEN 150 + CAST(props->>'k' AS INT) % 40 END AS cadence, event_type = 'error' AS is_paused
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
profiles AS (
  SELECT DISTINCT athlete_id, DATE '1990-01-01' AS valid_from, DATE '1996-01-01' AS valid_to, CAST(180 + athlete_id % 20 AS INT) AS max_hr FROM activities
  UNION ALL
  SELECT DISTINCT athlete_id, CASE WHEN athlete_id % 7 = 0 THEN DATE '1996-01-01' + INTERVAL 200 DAY ELSE DATE '1996-01-01' END, NULL, CAST(175 + athlete_id % 20 AS INT) FROM activities)
"""
