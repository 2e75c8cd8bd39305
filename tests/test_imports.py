"""Provenance, measurements, benchmarks, evidence order, created activities and detailed weeks."""

import datetime as dt

from pyspark.sql import functions as F

from paceforge.functions import scalars
from paceforge.operators import contracts, evidence, reconcile, tracking, training_plan, trends

DAY = dt.date(2024, 5, 6)
PROVIDER = "id long, athlete_id long, row long, kind string, start_s double, elapsed_s double, distance_m double, name string, laps array<int>"


def test_merged_fields_skip_nulls_empty_texts_and_empty_lists(spark):
    a = spark.createDataFrame([(1, 7, 1, "running", 0.0, 600.0, 2000.0, "", []), (2, 7, 2, "running", 9000.0, 600.0, 2000.0, "a", [1])], PROVIDER)
    b = spark.createDataFrame([(11, 7, 1, "running", 1.0, 601.0, 2001.0, "b", [5])], PROVIDER).withColumn("steps", F.lit(10))
    rows = {r.a_id: r for r in reconcile.reconcile(a, b).collect()}
    assert (rows[1].name, rows[1].laps, rows[1].steps, rows[1].distance_m) == ("b", [5], 10, 2000.0)
    assert {(s.field, s.provider) for s in rows[1].provenance} == {("kind", "a"), ("start_s", "a"), ("elapsed_s", "a"), ("provider_type", "a"), ("name", "b"), ("laps", "b"), ("steps", "b"), ("distance_m", "a")}
    assert ("provider_type", "a") not in {(s.field, s.provider) for s in rows[2].provenance}
    assert rows[2].steps is None


def test_canonical_order_breaks_ties_by_provider_and_id_text(spark):
    rows = spark.createDataFrame([(10, None, 1, 5.0), (9, None, 1, 5.0), (None, 1, 1, 5.0), (3, None, 1, 4.0)], "a_id long, b_id long, athlete_id long, start_s double")
    got = {(r.a_id, r.b_id): r.position for r in reconcile.canonical_order(rows).collect()}
    assert got == {(3, None): 1, (10, None): 2, (9, None): 3, (None, 1): 4}


def test_required_measurements_and_findings(spark):
    rows = spark.createDataFrame([(1, 5.0, None, 9.0), (2, None, 1.0, None), (3, 5.0, 4.0, None)], "id long, distance_m double, moving_s double, elapsed_s double")
    got = contracts.required_measurements(rows)
    assert [(r.moving_s, r.reject) for r in got.orderBy("id").collect()] == [(9.0, None), (1.0, "DISTANCE_MISSING"), (4.0, "ELAPSED_TIME_MISSING")]
    bad = got.where("reject is not null").select("id", F.col("reject").alias("code"), "moving_s")
    union = contracts.all_findings(measurements=bad, none=bad.limit(0)).collect()
    assert {(r.stage, r.id, r.code) for r in union} == {("measurements", "2", "DISTANCE_MISSING"), ("measurements", "3", "ELAPSED_TIME_MISSING")}


def test_benchmark_must_be_one_long_enough_run(spark):
    declared = spark.createDataFrame([(1, "5k", DAY), (2, "5k", DAY), (3, "5k", DAY)], "athlete_id long, distance string, declared_on date")
    runs = spark.createDataFrame([(1, 100, DAY, 4750.0), (1, 101, DAY, 4749.0), (2, 102, DAY, 5000.0), (2, 103, DAY, 5000.0)], "athlete_id long, activity_id long, local_date date, distance_m double")
    got = {r.athlete_id: (r.activity_id, r.code) for r in evidence.benchmark_activities(declared, runs).collect()}
    assert got == {1: (100, None), 2: (None, "BENCHMARK_ACTIVITY_NOT_UNIQUE"), 3: (None, "BENCHMARK_ACTIVITY_NOT_UNIQUE")}


def test_latest_dates_prefer_loads(spark):
    days = [DAY + dt.timedelta(i) for i in range(4)]
    runs = spark.createDataFrame([(1, days[2], "verified"), (2, days[1], "verified"), (2, days[3], "excluded")], "athlete_id long, local_date date, status string")
    loads = spark.createDataFrame([(1, days[0])], "athlete_id long, local_date date")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "athlete_id long")
    assert {r.athlete_id: (r.evidence_on, r.run_on) for r in evidence.latest_dates(ids, loads, runs).collect()} == {1: (days[0], days[2]), 2: (days[3], days[1]), 3: (None, None)}


def test_evidence_union_names_observed_pairs_once(spark):
    schema = "athlete_id long, activity_id long, target string, achieved_on date, evidence_kind string, elapsed_s double"
    verified = spark.createDataFrame([(1, 5, "5k", DAY, "v", 1.0), (1, 6, "5k", DAY, "v", 1.0)], schema)
    observed = spark.createDataFrame([(1, 5, "5k", DAY, "o", 2.0)], schema)
    chosen = spark.createDataFrame([(1, 5, None, DAY + dt.timedelta(1), "s", 3.0)], schema)
    got = evidence.evidence_union(verified, chosen, observed).orderBy("position").collect()
    assert [(r.activity_id, r.evidence_kind) for r in got] == [(5, "s"), (6, "v"), (5, "o")]


def test_created_activities_take_later_files(spark):
    files = spark.createDataFrame(
        [(1, 1, 100.0, 600.0, 2000.0), (2, 1, 101.0, 610.0, 2010.0), (3, 1, 102.0, 900.0, 9000.0), (4, 1, 5000.0, None, 2000.0), (5, 1, 9000.0, 600.0, 2000.0), (6, 1, 9001.0, 600.0, 2000.0)],
        "file_id long, athlete_id long, start_s double, elapsed_s double, distance_m double",
    ).withColumn("provider", F.lit("p"))
    canonical = spark.createDataFrame([(50, 1, 9000.0, 600.0, 2000.0)], "activity_id long, athlete_id long, start_s double, elapsed_s double, distance_m double")
    resolved = files.select("file_id", F.lit("unmatched").alias("status"))
    got = {r.file_id: (r.activity_id, r.new_of, r.action) for r in tracking.create_missing(files, resolved, canonical).collect()}
    assert got == {1: (None, 1, "created"), 2: (None, 1, "matched"), 3: (None, 3, "created"), 4: (None, None, "unmatched"), 5: (50, None, "matched"), 6: (50, None, "matched")}
    assert not tracking.create_missing(files.limit(0), resolved, canonical).count()


def test_detailed_week_keeps_its_distance_and_drops_filler(spark):
    schema = "goal_id long, distance string, week int, start_date date, phase string, target_km double, long_run_km double, days_per_week int, five_k_pace double, target_pace double"
    rows = [(1, "10k", 1, DAY, "build", 60.0, 14.4, 5, 240.0, 250.0), (2, "10k", 1, DAY, "build", 24.0, 10.0, 7, 240.0, 250.0), (3, "5k", 1, DAY, "build", 24.0, 10.0, 9, 240.0, 250.0)]
    got = training_plan.detailed_sessions(spark.createDataFrame(rows, schema)).orderBy("scheduled").collect()
    first, second = ([r for r in got if r.goal_id == g] for g in (1, 2))
    assert [(r.kind, (r.scheduled - DAY).days) for r in first] == [("easy", 0), ("quality", 1), ("easy", 3), ("recovery", 5), ("long", 6)]
    assert abs(sum(r.distance_km for r in first) - 60.0) < 0.2
    assert [(r.faster, r.slower) for r in first] == [(330.0, 370.0), (245.0, 255.0), (330.0, 370.0), (355.0, 390.0), (315.0, 355.0)]
    assert len(second) == 3 and min(r.distance_km for r in second) >= 4.5
    assert not [r for r in got if r.goal_id == 3]


def test_report_texts(spark):
    row = spark.range(1).select(scalars.pace_display(F.lit(330.5)).alias("even"), scalars.pace_display(F.lit(None).cast("double")).alias("none"), scalars.duration_range(F.lit(10.0), F.lit(300.0), F.lit(370.0)).alias("range"), scalars.duration_range(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)).alias("null")).first()
    assert (row.even, row.none, row["range"], row["null"]) == ("5:30 /km", "Unavailable", "50:00-1:01:40", None)
    weeks = spark.createDataFrame([(1, 300.0), (2, None)], "athlete_id long, weighted_pace double")
    assert [(r.pace_min_per_km, r.pace_display) for r in trends.weekly_frame(weeks).orderBy("athlete_id").collect()] == [(5.0, "5:00 /km"), (None, "Unavailable")]
