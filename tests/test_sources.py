"""Readers, registry and streaming ingest on small files."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from paceforge.sources import buckets, registry, sinks, summary_csv, summary_json, tracks
from paceforge.streaming import ingest

HEADER = "Activity ID,Activity Date,Activity Name,Activity Type,Elapsed Time,Distance,Filename,Elapsed Time,Moving Time,Distance,Elevation Gain,Elevation Loss"


def test_summary_csv(spark, tmp_path):
    rows = [
        '1,"Jan 5, 2024, 7:08:09 PM","Easy, ""slow""",Run,20:00,5.0,a.fit.gz,"1,200",1190,5000.5,10,',
        "2,2024-01-06 08:00:00,Ride,Ride,1:00,1,b.gpx,60,,100,,",
        "3,bad date,X,Run,1,1,c,60,60,100,,",
        "4,2024-01-06T08:00:00Z,X,Run,1,1,c,,60,100,,",
        "5,too,short",
        '6,"Jan 7, 2024, 12:00:00 AM","two\nlines",Trail Run,1,1,,60,60,,,',
    ]
    path = tmp_path / "a.csv"
    path.write_text("﻿" + HEADER + "\n" + "\n".join(rows) + "\n")
    good, findings = summary_csv.read_summary_csv(spark, str(path), "x")
    found = {r.activity_id: r for r in good.withColumn("at", F.date_format("start_utc", "yyyy-MM-dd HH:mm:ss")).collect()}
    assert set(found) == {"1", "2", "6"} and found["1"].at == "2024-01-05 19:08:09" and found["1"].name == 'Easy, "slow"'
    assert (found["1"].elapsed_s, found["1"].distance_m, found["1"].elevation_loss_m, found["1"].kind) == (1200.0, 5000.5, None, "running")
    assert found["2"].kind == "other" and found["2"].moving_s is None and found["6"].kind == "trail_running" and found["6"].at == "2024-01-07 00:00:00"
    assert sorted((r.code, r.row) for r in findings.collect()) == [("STRAVA_ROW_INVALID", 4), ("STRAVA_ROW_INVALID", 5), ("STRAVA_ROW_WIDTH_INVALID", 6)]


def test_summary_csv_french_and_bad_header(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("ID de l’activité,Date de l’activité,Nom de l’activité,Type d’activité,Temps écoulé,Distance,Nom du fichier,Temps écoulé,Durée de déplacement,Distance,Dénivelé positif,Dénivelé négatif\n" '7,"5 févr. 2024, 19:08:09",Sortie,Course à pied,1,1,,60,60,100,,\n')
    good, findings = summary_csv.read_summary_csv(spark, str(path), "x")
    row = good.withColumn("at", F.date_format("start_utc", "yyyy-MM-dd HH:mm:ss")).first()
    assert (row.at, row.kind) == ("2024-02-05 19:08:09", "running") and findings.count() == 0
    path.write_text(HEADER.replace(",Elapsed Time,Moving", ",Moving") + "\n")
    good, findings = summary_csv.read_summary_csv(spark, str(path), "x")
    assert good.count() == 0 and [r.code for r in findings.collect()] == ["STRAVA_HEADER_INVALID"]


def test_many_summary_exports_in_one_scan(spark, tmp_path):
    french = "ID de l’activité,Nom de l’activité,Date de l’activité,Type d’activité,Temps écoulé,Distance,Nom du fichier,Temps écoulé,Durée de déplacement,Distance,Dénivelé positif,Dénivelé négatif"
    for name, header, row in [("7", HEADER, '1,"Jan 5, 2024, 7:08:09 PM",A,Run,1,1,,60,60,100,,'), ("8", french, '2,B,"5 févr. 2024, 19:08:09",Course à pied,1,1,,60,60,100,,\n3,short'), ("9", HEADER.replace(",Filename", ""), "4,x,y,z")]:
        (tmp_path / f"athlete={name}").mkdir()
        (tmp_path / f"athlete={name}" / "a.csv").write_text("\ufeff" + header + "\n" + row + "\n")
    whose = F.regexp_extract("file", r"athlete=(\d+)", 1)
    good, findings = summary_csv.read_summary_csv(spark, str(tmp_path / "*"), whose)
    assert {(r.athlete_id, r.activity_id, r.name, r.kind) for r in good.collect()} == {("7", "1", "A", "running"), ("8", "2", "B", "running")}
    assert {(r.athlete_id, r.code, r.row) for r in findings.collect()} == {("8", "STRAVA_ROW_WIDTH_INVALID", 3), ("9", "STRAVA_HEADER_INVALID", None)}
    table = good.select(F.col("export").alias("file")).distinct().withColumn("athlete_id", F.lit(5))
    assert {r.athlete_id for r in summary_csv.read_summary_csv(spark, str(tmp_path / "*"), table)[0].collect()} == {"5"}
    record = {"activityId": 1, "activityType": "running", "startTimeGmt": 1704481689000, "duration": 3610000, "distance": {"odd": 1}}
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "1.json").write_text(json.dumps({"x": [{"summarizedActivitiesExport": [record, 5]}]}))
    (tmp_path / "json" / "2.json").write_text(json.dumps([[{"summarizedActivitiesExport": [{**record, "activityId": "2", "distance": 100.5}]}]]))
    (tmp_path / "json" / "3.json").write_text("{broken")
    (tmp_path / "json" / "4.json").write_text("[1, {}]")
    good, findings = summary_json.read_summary_json(spark, str(tmp_path / "json"), F.regexp_extract("file", r"(\d)\.json", 1))
    assert {(r.athlete_id, r.activity_id, r.elapsed_s, r.distance_m) for r in good.collect()} == {("1", "1", 3610.0, None), ("2", "2", 3610.0, 1.005)}
    assert {(r.athlete_id, r.code) for r in findings.collect()} == {("3", "GARMIN_JSON_INVALID"), ("4", "GARMIN_SUMMARY_CONTAINER_MISSING")}


def test_summary_json(spark, tmp_path):
    record = {"activityId": 1, "name": "R", "activityType": "running", "startTimeGmt": 1704481689000, "duration": 3610000, "distance": 1000000, "elevationGain": 21713, "avgRunCadence": 87.0, "avgHr": 150}
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"a": {"summarizedActivitiesExport": [record, {**record, "activityId": 2, "startTimeGmt": None, "beginTimestamp": 1704481689}, {"activityId": 3}]}}]))
    good, findings = summary_json.read_summary_json(spark, str(path), "x")
    rows = {r.activity_id: r for r in good.withColumn("s", F.unix_timestamp("start_utc")).collect()}
    assert set(rows) == {"1", "2"} and rows["1"].s == rows["2"].s == 1704481689
    assert (rows["1"].elapsed_s, rows["1"].distance_m, rows["1"].elevation_gain_m, rows["1"].average_cadence) == (3610.0, 10000.0, 217.13, 174.0)
    assert [r.code for r in findings.collect()] == ["GARMIN_SUMMARY_RECORD_INVALID"]
    path.write_text('{"b": 1}')
    assert [r.code for r in summary_json.read_summary_json(spark, str(path), "x")[1].collect()] == ["GARMIN_SUMMARY_CONTAINER_MISSING"]


def test_gpx(spark, tmp_path):
    point = lambda lat, t: f'<trkpt lat="{lat}" lon="2"><ele>5</ele><time>{t}</time></trkpt>'
    body = point(1, "2024-01-01T00:00:00Z") + point(95, "2024-01-01T00:00:01Z") + point(1, "2024-01-01T00:00:10Z") + point(1, "2024-01-01T00:00:05Z") + point(1, "2024-01-01T00:00:12Z")
    (tmp_path / "a.gpx").write_text(f'<gpx xmlns="http://x"><trk><name>n</name><trkseg>{body}</trkseg></trk></gpx>')
    (tmp_path / "b.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1" lon="2"></trkpt></trkseg></trk></gpx>')
    points, findings = tracks.read_gpx(spark, str(tmp_path))
    assert [(r.seq, r.elapsed_ms) for r in points.orderBy("seq").collect()] == [(0, 0), (1, 10000), (2, 12000)]
    assert sorted((r.file[-5:], r.code) for r in findings.collect()) == [("a.gpx", "GPX_TRACKPOINT_INVALID")] * 2 + [("b.gpx", "GPX_NO_VALID_TRACKPOINTS"), ("b.gpx", "GPX_TRACKPOINT_INVALID")]


def test_registry(spark, tmp_path):
    (tmp_path / "a.fit").write_bytes(b"same")
    (tmp_path / "b.fit.gz").write_bytes(gzip.compress(b"same"))
    (tmp_path / "c.fit").write_bytes(b"known")
    (tmp_path / "d.gz").write_bytes(b"\x1f\x8bbroken")
    files = registry.hash_files(spark, str(tmp_path), "p")
    known = spark.createDataFrame([("p", hashlib.sha256(b"known").hexdigest())], "provider string, sha256 string")
    found = {r.path[-5:]: r.outcome for r in registry.register(files, known).collect()}
    assert found == {"a.fit": "accepted", "it.gz": "duplicate", "c.fit": "duplicate", "/d.gz": "invalid"}


def test_streaming_ingest_is_exactly_once(spark, tmp_path):
    drops, table, results, checkpoint = (str(tmp_path / n) for n in ("drops", "table", "results", "checkpoint"))
    (tmp_path / "drops").mkdir()
    record = {"provider": "p", "athlete_id": 1, "load": 5.0}
    schema, out = "provider string, athlete_id long, load double", "athlete_id long, load double"
    compute = lambda h: h.groupBy("athlete_id").agg(F.sum("load").alias("load"))

    def run(name, rows):
        (tmp_path / "drops" / name).write_text("\n".join(map(json.dumps, rows)))
        query = ingest.run_ingest(ingest.read_drops(spark, drops, schema), table, results, checkpoint, compute, out, 4)
        query.awaitTermination(120)
        states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
        assert not states  # what was seen is looked up, not kept
        return {r.athlete_id: r.load for r in buckets.read_buckets(spark, results, out).collect()}

    assert run("1.json", [record, record, {**record, "athlete_id": 2}]) == {1: 5.0, 2: 5.0}
    assert run("2.json", [record, {**record, "load": 7.0}]) == {1: 12.0, 2: 5.0}
    assert run("3.json", [record, {**record, "athlete_id": 2}]) == {1: 12.0, 2: 5.0}
    # a batch that is run again replaces itself
    again = spark.createDataFrame([("p", 1, 7.0)], schema)
    again = again.withColumn(ingest.CONTENT, F.sha2(F.to_json(F.struct(*again.columns)), 256))
    assert ingest.append_new(again, 1, table, 4).count() == 1 and ingest.stored_records(spark, table, again.schema).count() == 3


def test_resumed_workload_equals_a_whole_run(spark, tmp_path):
    import datetime as dt
    import random

    from paceforge.operators import workload

    drops, root, checkpoint = (str(tmp_path / n) for n in ("drops", "root", "checkpoint"))
    (tmp_path / "drops").mkdir()
    schema = "provider string, athlete_id long, local_date date, load double"
    rnd, seen = random.Random(5), []

    def drop(name, rows):
        (tmp_path / "drops" / name).write_text("\n".join(json.dumps({"provider": "p", "athlete_id": a, "local_date": str(dt.date(2020, 1, 1) + dt.timedelta(days=d)), "load": x}) for a, d, x in rows))
        seen.extend(rows)
        ingest.run_workload(ingest.read_drops(spark, drops, schema), root, checkpoint, 8, 10).awaitTermination(180)
        daily = spark.createDataFrame([(a, dt.date(2020, 1, 1) + dt.timedelta(days=d), x) for a, d, x in set(seen)], "athlete_id long, local_date date, x double").groupBy("athlete_id", "local_date").agg(F.sum("x").alias("daily_load"))
        whole = {(r.athlete_id, r.local_date): r for r in workload.workload_series(daily).collect()}
        stored = {(r.athlete_id, r.local_date): r for r in ingest.read_workload(spark, root).collect()}
        assert stored.keys() == whole.keys()
        for k, r in whole.items():
            assert (r.history_days, r.daily_load) == (stored[k].history_days, stored[k].daily_load)
            for c in ("acute_load", "chronic_load", "form_index"):
                assert r[c] == stored[k][c] or abs(r[c] - stored[k][c]) < 2e-6

    drop("1.json", [(a, rnd.randrange(10, 60), float(rnd.randrange(1, 90))) for a in (1, 2, 3) for _ in range(15)])
    other = {p.name for p in (tmp_path / "root" / "series" / "data" / "version=0").iterdir()}
    drop("2.json", [(1, 75, 30.0), (1, 58, 12.0)])
    mine = {p.name for p in (tmp_path / "root" / "series" / "data" / "version=1").iterdir() if p.name.startswith("bucket")}
    assert len(mine) == 1 and mine < other  # a batch of one athlete writes that bucket only
    drop("3.json", [(2, 11, 5.0), (3, 2, 40.0), (4, 0, 1.0)])  # late, before the first day, new
    drop("4.json", [(1, 75, 30.0)])


def test_buckets_are_emptied_and_failed_writes_change_nothing(spark, tmp_path):
    path, kinds = str(tmp_path / "t"), "activity_id long, v string"
    make = lambda rows: spark.createDataFrame(rows, kinds)
    read = lambda: sorted(tuple(r) for r in sinks.read_detail(spark, path, kinds).collect())
    assert read() == []
    sinks.replace_detail(make([(1, "a"), (1, "b"), (2, "c"), (3, "d")]), make([(1, ""), (2, ""), (3, "")]), path, 1, 2)
    assert read() == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
    broken = make([(1, "x")]).withColumn("v", F.raise_error("fails"))
    with pytest.raises(Exception):
        sinks.replace_detail(broken.select("activity_id", F.col("v").cast("string").alias("v")), make([(1, "")]), path, 2, 2)
    assert read() == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
    for _ in range(2):  # a repeated commit replaces itself
        sinks.replace_detail(make([(2, "e")]), make([(1, ""), (2, "")]), path, 2, 2)
        assert read() == [(2, "e"), (3, "d")]
    sinks.replace_detail(make([]), make([(2, ""), (3, "")]), path, 3, 2)
    assert read() == []
    changed = sinks.changed_sources(spark.createDataFrame([(1, "f", "h1"), (2, "f", "h2"), (3, "g", "h3")], "activity_id long, source_id string, sha256 string"), spark.createDataFrame([(1, "f", "h1"), (2, "f", "old")], "activity_id long, source_id string, sha256 string"))
    assert {r.activity_id for r in changed.collect()} == {2, 3}


def test_contracts(spark):
    from paceforge.operators import contracts

    rows = spark.createDataFrame([(1, 10.0, 60.0, 50.0, 150.0), (2, -1.0, 10.0, 50.0, 400.0), (3, None, None, None, None)], "activity_id long, distance_m double, elapsed_s double, moving_s double, average_heart_rate double")
    good, findings = contracts.split(contracts.check(rows, contracts.activity_rules()), "activity_id")
    assert sorted(r.activity_id for r in good.collect()) == [1, 3]
    assert sorted((r.activity_id, r.code) for r in findings.collect()) == [(2, "MOVING_OVER_ELAPSED"), (2, "average_heart_rate_RANGE"), (2, "distance_m_NEGATIVE")]
    points = spark.createDataFrame([(1, 1.0, None, 100), (2, 91.0, 2.0, 300)], "activity_id long, latitude double, longitude double, heart_rate int")
    assert contracts.split(contracts.check(points, contracts.trackpoint_rules()), "activity_id")[1].count() == 3


def test_label_queue(spark, tmp_path):
    from paceforge.functions.scalars import review_token
    from paceforge.operators import labels

    path = tmp_path / "q.csv"
    header = ",".join(f.split(" ")[0] for f in labels.SCHEMA.split(", "))
    path.write_text(header + "\nv1,a,n,2024-01-01 00:00:00,5k,5000,1200,0.1,unreviewed,,,\nv1,b,n,2024-01-02 00:00:00,5k,5000,x,0.1,verified,,,\n")
    queue = labels.read_queue(spark, str(path))
    assert sorted(r.code for r in labels.queue_findings(queue).collect()) == ["LABEL_NUMBER_INVALID", "LABEL_STATUS_INVALID"]
    assert labels.status_counts(queue).first().asDict() == {"total": 2, "verified": 1, "excluded": 0, "unreviewed": 1}
    decisions = spark.createDataFrame([("a", "5k", "verified", "race", 1195.0, None), ("z", "5k", "excluded", None, None, None)], "activity_id string, matched_distance string, review_status string, review_label string, verified_elapsed_time_seconds double, review_notes string")
    done = labels.apply_reviews(queue, decisions)
    assert {r.activity_id: r.review_status for r in done.collect()} == {"a": "verified", "b": "verified"} and labels.verified_observations(done).where("label = 'race'").first().elapsed_s == 1195.0
    token = queue.where("activity_id = 'a'").select(review_token(F.col("dataset_version"), F.col("activity_id"))).first()[0]
    assert [r.activity_id for r in labels.by_token(queue, token).collect()] == ["a"] and labels.page(queue, "unreviewed").count() == 1


def test_device_messages(spark):
    import datetime as dt

    from paceforge.sources import device

    at = lambda s: dt.datetime(2024, 1, 1, 8, 0, s)
    sessions = spark.createDataFrame([(1, 0, at(0), 60.0, 55.0, 200.0, "Running", "trail", 150), (1, 1, at(30), 9.0, 9.0, 9.0, "cycling", None, None), (2, 0, None, None, None, None, "running", "generic", None), (3, 0, None, None, None, None, None, None, None), (4, 0, at(0), -5.0, None, None, "running", None, 150), (5, 0, at(0), None, None, None, "running", None, None)], "file_id long, n int, start_time timestamp, total_elapsed_time double, total_timer_time double, total_distance double, sport string, sub_sport string, avg_heart_rate int")
    half = 2**30
    records = [(1, 0, at(1), 0.0, half, half, 100, 80, 0.5, 250.0), (1, 1, None, 1.0, None, None, None, None, None, None), (1, 2, at(5), 5.0, half, None, 400, None, None, None), (1, 3, at(4), 4.0, None, None, None, None, None, -1.0), (1, 4, at(3), 4.0, None, None, None, None, None, None), (1, 5, at(3), 4.0, None, None, None, None, None, None), (1, 6, at(2), 3.0, None, None, 300, None, None, None), (1, 7, at(20), 30.0, None, None, 300, None, None, None)]
    records += [(2, 0, at(10), 0.0, None, None, 1, None, None, None), (2, 1, at(9), 1.0, None, None, None, None, None, None), (2, 2, at(18), 2.0, None, None, None, None, None, None), (3, 0, None, None, None, None, None, None, None, None)]
    r = spark.createDataFrame(records, "file_id long, n int, timestamp timestamp, distance double, position_lat long, position_long long, heart_rate int, cadence int, fractional_cadence double, power double").withColumn("altitude", F.lit(5.0)).withColumn("enhanced_altitude", F.when(F.col("n") == 0, 7.0))
    laps = spark.createDataFrame([(1, 0, at(0), 10.0, 80), (1, 1, at(2), -1.0, 80), (1, 2, at(3), 10.0, 81), (4, 0, at(0), 1.0, 80)], "file_id long, n int, start_time timestamp, total_elapsed_time double, avg_cadence int")
    out = device.normalize(sessions, r, laps)
    assert {a.file_id: (a.kind, a.provider_type, a.elapsed_s, a.moving_s, a.average_heart_rate) for a in out["activities"].collect()} == {1: ("trail_running", "running:trail", 60.0, 55.0, 150), 2: ("running", "running", 8.0, None, None)}
    points = {(p.file_id, p.seq): p for p in out["trackpoints"].collect()}
    assert {k: (p.elapsed_ms, p.lap) for k, p in points.items()} == {(1, 0): (1000, 0), (1, 1): (3000, 1), (1, 2): (3000, 1), (1, 3): (20000, 1), (2, 0): (0, None), (2, 1): (8000, None)}
    assert (float(points[1, 0].latitude), float(points[1, 0].cadence), float(points[1, 0].altitude_m), float(points[1, 1].altitude_m), points[1, 1].latitude) == (90.0, 161.0, 7.0, 5.0, None)
    assert [(x.file_id, x.seq, float(x.average_cadence)) for x in out["laps"].orderBy("seq").collect()] == [(1, 0, 160.0), (1, 1, 162.0)]
    assert sorted((f.file_id, f.code, f.n) for f in out["findings"].collect()) == [
        (1, "FIT_LAP_INVALID", 1), (1, "FIT_MULTIPLE_SESSIONS", 0), (1, "FIT_RECORD_INVALID", 2), (1, "FIT_RECORD_INVALID", 3), (1, "FIT_RECORD_TIMESTAMP_MISSING", 1), (1, "FIT_RECORD_TIME_INVALID", 6),
        (2, "FIT_RECORD_TIME_INVALID", 1), (3, "FIT_START_TIME_MISSING", 0), (4, "FIT_ACTIVITY_INVALID", 0), (5, "FIT_DURATION_MISSING", 0),
    ]
    assert device.normalize(sessions.limit(0), r, laps)["activities"].count() == 0


def test_counters_of_one_pass(spark):
    from paceforge.sources import counters

    files = spark.createDataFrame([("accepted", "matched", None), ("accepted", "unmatched", "created"), ("accepted", "unmatched", "unmatched"), ("accepted", "ambiguous", None), ("duplicate", None, None)], "outcome string, status string, action string")
    seen, counts = counters.counted(files, counters.file_counters())
    seen.write.format("noop").mode("overwrite").save()
    assert counts.get == {"total_files": 5, "accepted_files": 4, "duplicate_files": 1, "matched_files": 2, "unmatched_files": 1, "ambiguous_files": 1, "activities_created": 1}
    loads, counts = counters.counted(spark.createDataFrame([("created",), ("reused",), ("reused",), ("kept",)], "action string"), counters.load_counters())
    assert loads.count() == 4 and counts.get == {"daily_loads_created": 1, "daily_loads_updated": 0, "daily_loads_reused": 2}
    metrics, counts = counters.counted(spark.createDataFrame([("created", [1], 2.0), ("reused", None, None)], "action string, zones array<int>, edwards_trimp double"), counters.metric_counters())
    assert metrics.count() == 2 and counts.get == {"activities_processed": 2, "activities_with_profile": 1, "activities_with_heart_rate_load": 1, "activity_metrics_created": 1, "activity_metrics_reused": 1}


def test_source_rules(spark):
    from paceforge.operators import contracts

    rows = spark.createDataFrame([(1, "a.fit", "0" * 64, 1), (2, "", "xyz", 0), (3, None, None, None)], "activity_id long, source_file_name string, content_sha256 string, source_row_number int")
    _, findings = contracts.split(contracts.check(rows, contracts.source_rules()), "activity_id")
    assert sorted((r.activity_id, r.code) for r in findings.collect()) == [(2, "CONTENT_SHA256"), (2, "SOURCE_FILE_NAME"), (2, "SOURCE_ROW_NUMBER"), (3, "CONTENT_SHA256"), (3, "SOURCE_FILE_NAME")]
