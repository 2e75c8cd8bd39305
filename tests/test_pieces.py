"""Small operators that no registered query covers, each on a few rows."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from paceforge.functions import scalars, titles
from paceforge.operators import activity, bests, labels, plan_versions, state, training_plan, workload
from paceforge.sources import registry, sinks, tracks

D = dt.date


def test_titles_from_files(spark):
    rows = spark.createDataFrame([("a/b/Long_run__home (2).fit.gz", "long"), ("Race_easy.FIT", "race"), ("x/tempo.fit", "workout"), ("morning.fit", "unknown")], "path string, kind string")
    found = rows.select("kind", titles.title_from_file(F.col("path")).alias("title"), titles.coarse_type(titles.title_from_file(F.col("path"))).alias("type")).collect()
    assert [r.title for r in found] == ["Long run home", "Race easy", "tempo", "morning"] and all(r.kind == r.type for r in found)


def test_dates_durations_and_fingerprints(spark):
    zones = F.array(F.lit("Asia/Tokyo"), F.lit("UTC"))
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 20), "Asia/Tokyo", 1.2345), (dt.datetime(2024, 1, 1, 20), "Nowhere/X", 0.0005), (dt.datetime(2024, 1, 1, 20), None, None)], "at timestamp, zone string, s double")
    rows = df.select(scalars.local_date(F.col("at"), F.col("zone"), F.lit("UTC"), zones).alias("d"), scalars.seconds_to_ms(F.col("s")).alias("ms")).collect()
    assert [r.d for r in rows] == [D(2024, 1, 2), D(2024, 1, 1), D(2024, 1, 1)] and [r.ms for r in rows] == [1235, 1, None]
    mark = df.limit(1).select(scalars.fingerprint(F.lit(5), F.lit("p"), F.col("at"), F.lit("running"), F.lit(1000.5), F.lit(60000))).first()[0]
    assert mark == hashlib.sha256(b"5|p|2024-01-01T20:00:00Z|running|1000.500|60000").hexdigest()


def test_discovery_of_new_files(spark):
    files = spark.createDataFrame([("p", "a/new.fit", "h1"), ("p", "a/known.fit", "h2"), ("p", "a/123.fit.gz", "h3"), ("p", "a/two.fit", "h4"), ("p", "a/old.fit", "h5"), ("p", "a/ride.fit", "h6"), ("p", "b/again.fit", "h1")], "provider string, path string, sha256 string")
    acts = spark.createDataFrame([(p, k, d) for p, k, d in [("a/new.fit", "running", D(2024, 2, 1)), ("a/123.fit.gz", "running", D(2024, 2, 1)), ("a/two.fit", "running", D(2024, 2, 1)), ("a/two.fit", "running", D(2024, 2, 1)), ("a/old.fit", "running", D(2023, 1, 1)), ("a/ride.fit", "other", D(2024, 2, 1)), ("a/new.fit", "other", D(2024, 2, 1))]], "path string, kind string, local_date date")
    known = spark.createDataFrame([("p", "h2")], "provider string, sha256 string")
    found = registry.discover(files, acts, known, D(2024, 1, 1))
    assert {r.path: r.outcome for r in found.collect()} == {"a/new.fit": "new", "a/known.fit": "known", "a/123.fit.gz": "bulk_export", "a/two.fit": "no_single_run", "a/old.fit": "before_date", "a/ride.fit": "no_single_run", "b/again.fit": "known"}
    assert {r.outcome: r.files for r in registry.outcome_counts(found).collect()}["no_single_run"] == 2
    assert {r.path for r in registry.first_of_batch(files).collect()} == {r.path for r in files.collect()} - {"b/again.fit"}
    rows = spark.createDataFrame([(1, ".\\\\A\\\\New.fit".replace("\\\\", "\\")), (2, "gone.fit"), (3, None)], "activity_id long, file_name string")
    pairs, missing = registry.referenced_files(files, rows)
    assert [(r.activity_id, r.path) for r in pairs.collect()] == [(1, "a/new.fit")] and [r.activity_id for r in missing.collect()] == [2]


def test_latest_metrics_and_sources(spark):
    metrics = spark.createDataFrame([(1, 1, D(2024, 1, 1), "a"), (1, 2, D(2024, 1, 1), "b"), (1, 3, D(2023, 1, 1), "c"), (2, 1, D(2024, 1, 1), "d")], "activity_id long, metric_id int, calculated_at date, v string")
    assert {r.activity_id: r.v for r in activity.latest_metrics(metrics).collect()} == {1: "b", 2: "d"}
    sources = spark.createDataFrame([(1, "garmin", "gpx", 900, 1, "a"), (1, "strava", "fit", 10, 0, "b"), (2, "garmin", "fit", 5, 1, "c"), (2, "garmin", "fit", 5, 2, "d"), (3, "strava", "gpx", 7, 1, "f"), (3, "strava", "gpx", 7, 1, "e")], "activity_id long, provider string, format string, trackpoints int, laps int, sha256 string")
    assert {r.activity_id: r.sha256 for r in tracks.choose_source(sources).collect()} == {1: "b", 2: "d", 3: "e"}


def test_goals_and_plan_versions(spark):
    goals = spark.createDataFrame([(1, 5, "active", "primary"), (2, 5, "planned", "primary"), (3, 6, "active", "secondary")], "goal_id long, athlete_id long, status string, priority string")
    versions = spark.createDataFrame([(1, 1, "superseded"), (1, 2, "active"), (1, 3, "active"), (3, 1, "active")], "goal_id long, version int, status string")
    assert [(r.goal_id, r.version) for r in plan_versions.active_plans(goals, versions).collect()] == [(1, 3)]
    moved = plan_versions.single_active(goals, spark.createDataFrame([(5, 2)], "athlete_id long, goal_id long"))
    assert {r.goal_id: r.status for r in moved.collect()} == {1: "planned", 2: "active", 3: "active"}
    hashed = spark.createDataFrame([(1, None), (1, 2.0), (1, None)], "a int, b double").select(plan_versions.evidence_hash(["a", "b"]).alias("h")).collect()
    assert hashed[0].h == hashed[2].h != hashed[1].h
    d = lambda n: F.lit(D(2024, 1, n))
    asked = [(5, 6, False, 1, 1), (7, 6, False, 1, 1), (5, 6, True, 1, 1), (5, 6, False, 8, 1)]
    got = spark.range(1).select(*[plan_versions.needs_refresh(d(a), d(b), F.lit(c), d(e), d(f)) for a, b, c, e, f in asked]).first()
    assert list(got) == [False, True, True, True]
    outline = spark.createDataFrame([(1, 1, 30.0, 9.0), (1, 2, 40.0, 8.0), (1, 3, 20.0, 0.0)], "goal_id long, week int, target_km double, long_run_km double")
    assert tuple(training_plan.outline_summary(outline).first()) == (1, 30.0, 40.0, 9.0, 3)
    status = spark.createDataFrame([(None, 10), (1000.0, 10), (985.0, 10), (985.0, 7), (900.0, 20)], "target double, weeks int")
    found = status.select(training_plan.goal_status(F.col("target"), F.lit(1005.0), F.lit(1000.0), F.col("weeks")).alias("s"), training_plan.target_gap(F.col("target"), F.lit(1005.0)).alias("gap")).collect()
    assert [r.s for r in found] == ["fitness_based", "achievable", "challenging", "aggressive", "aggressive"] and [r.gap for r in found] == [None, -5.0, -20.0, -20.0, -105.0]


def test_refresh_keeps_reviews_and_known_efforts(spark):
    kinds = "activity_id long, review_status string, review_label string"
    old, new = spark.createDataFrame([(1, "verified", "race"), (2, "unreviewed", None)], kinds), spark.createDataFrame([(1, "unreviewed", None), (2, "excluded", None), (3, "unreviewed", None)], kinds)
    kept = state.preserve_reviews(old, new, ("activity_id",), ("review_status", "review_label"))
    assert {tuple(r) for r in kept.collect()} == {(1, "verified", "race"), (2, "excluded", None), (3, "unreviewed", None)}
    efforts = spark.createDataFrame([(1, "5k", 1200.0), (1, "10k", 2500.0), (2, "5k", 1300.0)], "activity_id long, distance string, elapsed_s double")
    known = spark.createDataFrame([(1, "5k", 1201.9), (2, "5k", 1302.5)], "activity_id long, distance string, elapsed_s double")
    assert {(r.activity_id, r.distance) for r in bests.new_efforts(efforts, known).collect()} == {(1, "10k"), (2, "5k")}
    assert [(r.activity_id, r.n, r.code) for r in state.repeated_keys(efforts, ("activity_id",), "TWICE").collect()] == [(1, 2, "TWICE")]


def test_exact_dates_eligibility_tokens_and_documents(spark):
    series = spark.createDataFrame([(1, D(2024, 1, 1), 5.0), (1, D(2024, 1, 2), 6.0)], "athlete_id long, local_date date, daily_load double")
    rows, missing = workload.snapshots_on(series, spark.createDataFrame([(1, D(2024, 1, 2)), (2, D(2024, 1, 1))], "athlete_id long, local_date date"))
    assert [r.daily_load for r in rows.collect()] == [6.0] and [(r.athlete_id, r.code) for r in missing.collect()] == [(2, "WORKLOAD_DATE_MISSING")]
    acts = spark.createDataFrame([(1, "excluded", D(2024, 1, 1)), (2, None, D(2024, 1, 1)), (3, "verified", D(2024, 1, 3))], "activity_id long, status string, local_date date")
    assert [r.activity_id for r in activity.eligible(acts, F.lit(D(2024, 1, 2))).collect()] == [2] and activity.eligible(acts).count() == 2
    queue = spark.createDataFrame([("v1", "a"), ("v1", "b"), ("v1", "b")], "dataset_version string, activity_id string")
    token = lambda i: hashlib.sha256(f"v1:{i}".encode()).hexdigest()
    found, bad = labels.resolve_tokens(queue, spark.createDataFrame([(token(i),) for i in "abc"], "token string"))
    assert [r.activity_id for r in found.collect()] == ["a"] and {r.token: r.code for r in bad.collect()} == {token("b"): "TOKEN_NOT_UNIQUE", token("c"): "TOKEN_UNKNOWN"}
    zones = "activity_id long, moving_pace double, elapsed_pace double, gps_coverage double, cadence_coverage double, zones array<struct<zone:int,seconds:double,pct:double>>"
    docs = {r.activity_id: r for r in activity.documents(spark.createDataFrame([(1, 250.0, None, 100.0, 60.0, [(1, 10.0, 50.0)]), (2, None, None, 0.0, 0.0, None)], zones)).collect()}
    assert json.loads(docs[1].zone_distribution) == {"zones": [{"zone": 1, "seconds": 10.0, "percent": 50.0}]} and docs[2].zone_distribution is None
    assert json.loads(docs[1].additional_metrics) == {"moving_pace": 250.0, "elapsed_pace": None, "gps_coverage": 100.0, "cadence_coverage": 60.0}


def test_export_of_a_feature_dataset(spark, tmp_path):
    from paceforge.operators import features

    at = dt.datetime(2024, 1, 9, 8)
    windows = [f"prior_{n}d_{c}" for n in features.HORIZONS for c in sinks.WINDOW_COLUMNS.values()]
    parts = ["prior_history_runs", "prior_history_days", "prior_acute_load", "prior_chronic_load", "prior_form_index", "prior_5k_s", "prior_10k_s", "prior_half_marathon_s", "prior_marathon_s"]
    row = spark.createDataFrame([(1, 5, "5k", at, 1200.0, "verified")], "activity_id long, athlete_id long, distance string, start_utc timestamp, label_s double, review_status string").select("*", *[F.lit(float(i)).alias(c) for i, c in enumerate(parts + windows)])
    about = spark.createDataFrame([(1, "Race", 5050.0, 1201.0)], "activity_id long, name string, distance_m double, elapsed_s double")
    out = sinks.export_columns(row, about, "v3")
    assert len(out.columns) == 21 + 6 * 18 and out.columns[:4] == ["dataset_version", "activity_id", "activity_name", "achieved_at"] and out.columns[-1] == "prior_365d_unclassified_sessions"
    sinks.write_features(out, str(tmp_path / "f"))
    back = spark.read.csv(str(tmp_path / "f"), header=True).first()
    assert (back.matched_distance, back.distance_deviation_pct, back.prior_7d_runs, back.review_label) == ("5k", "1.0", "9.0", None)
    reviewed = sinks.export_columns(row, about, "v3", spark.createDataFrame([(1, "5k", "race", "flat")], "activity_id long, distance string, review_label string, review_notes string")).first()
    assert (reviewed.review_label, reviewed.review_notes, reviewed.verified_elapsed_time_seconds) == ("race", "flat", 1200.0)
    sinks.write_report(spark.createDataFrame([("riegel", 5.5)], "baseline string, mae_s double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().mae_s == pytest.approx(5.5)
