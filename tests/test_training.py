"""Golden values and random equivalence of the training-analytics operators."""

import datetime as dt
import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from paceforge.functions import scalars, titles
from paceforge.operators import activity, bests, efforts, features, fitness, reconcile, state, tracking, training_plan, workload

D = dt.date


def test_activity_metrics_golden(spark):
    acts = spark.createDataFrame([(1, 7, D(2024, 1, 1), 200.0, 50000, 60000), (2, 8, D(2024, 1, 1), None, 0, 0)], "activity_id long, athlete_id long, local_date date, distance_m double, moving_ms long, elapsed_ms long")
    rows = [(1, i, i * 10000, h, i < 3, 170.0 if i < 3 else None, False) for i, h in enumerate((100, 130, 150, 170, 190, 190))]
    samples = spark.createDataFrame(rows, "activity_id long, seq int, elapsed_ms long, heart_rate int, has_position boolean, cadence double, is_paused boolean")
    profiles = spark.createDataFrame([(7, D(2023, 1, 1), None, 200)], "athlete_id long, valid_from date, valid_to date, max_hr int")
    m = {r.activity_id: r for r in activity.activity_metrics(acts, samples, profiles).collect()}
    one = m[1]
    assert (one.moving_pace, one.elapsed_pace, one.hr_coverage, one.gps_coverage, one.cadence_coverage) == (250.0, 300.0, 100.0, 60.0, 60.0)
    assert (float(one.training_load), one.edwards_trimp) == (0.833333, 2.5) and [(z.seconds, z.pct) for z in one.zones] == [(10.0, 20.0)] * 5
    assert m[2].edwards_trimp is None and m[2].zones is None and m[2].hr_coverage == 0 and m[2].moving_pace is None


def test_gaps_and_pauses(spark):
    rows = [(1, 0, 0, False), (1, 1, 25000, True), (1, 2, 30000, False), (1, 3, 30000, False), (1, 4, 33000, False)]
    samples = spark.createDataFrame(rows, "activity_id long, seq int, elapsed_ms long, is_paused boolean")
    assert [r.interval_ms for r in activity.sample_intervals(samples).orderBy("seq").collect()] == [10000, 0, 0, 3000, 0]


def test_workload_golden_and_long_history(spark):
    few = spark.createDataFrame([(1, D(2024, 1, 1), 70.0), (1, D(2024, 1, 3), 35.0)], "athlete_id long, local_date date, daily_load double")
    out = workload.workload_series(few).orderBy("local_date").collect()
    assert [r.daily_load for r in out] == [70.0, 0.0, 35.0] and all(r.acute_load is None and r.coverage_pct == 100.0 for r in out)
    rnd = random.Random(1)
    loads = [rnd.choice([0.0, rnd.uniform(1, 200)]) for _ in range(6000)]
    loads[0] = loads[-1] = 10.0
    long = spark.createDataFrame([(2, D(2000, 1, 1) + dt.timedelta(i), x) for i, x in enumerate(loads) if x], "athlete_id long, local_date date, daily_load double")
    acute = chronic = 0.0
    for i, (r, x) in enumerate(zip(workload.workload_series(long).orderBy("local_date").collect(), loads)):
        acute, chronic = acute + (x - acute) / 7, chronic + (x - chronic) / 42
        assert r.history_days == i + 1 and (r.acute_load is None) == (i < 6) and (r.chronic_load is None) == (i < 41)
        if i >= 41:
            assert r.acute_load == pytest.approx(acute, abs=2e-6) and r.form_index == pytest.approx(chronic - acute, abs=2e-6)
    assert workload.workload_series(few.where("false")).count() == 0


@pytest.mark.parametrize(
    "title, primary, tags, confidence",
    [
        ("Easy Aerobic Run", "easy", ["easy"], "high"),
        ("Progressive long run", "progressive", ["progressive", "long"], "high"),
        ("Two hills by the mill", "hills", ["hills"], "high"),
        ("Lake, tempo blocks", "tempo", ["tempo"], "high"),
        ("Harbour race 2019", "race", ["race"], "high"),
        ("6 × 1K", "intervals", ["intervals"], "medium"),
        ("Côte ﬁnale", "unclassified", ["unclassified"], "low"),
        ("Morning Run", "unclassified", ["unclassified"], "low"),
        (None, "unclassified", ["unclassified"], "low"),
    ],
)
def test_titles(spark, title, primary, tags, confidence):
    r = spark.createDataFrame([(title,)], "t string").select(titles.classify(F.col("t")).alias("c")).first().c
    if title == "Côte ﬁnale":
        assert r.normalized == "cote finale" and r.tags == ["hills"]
        return
    assert (r.primary, r.tags, r.confidence) == (primary, tags, confidence)


def direct_effort(samples, target):
    times, dists = [t for t, _ in samples], [d for _, d in samples]

    def at(x, start):
        i = bisect_left(dists, x)
        if i == len(dists):
            return None
        if dists[i] == x:
            return times[bisect_right(dists, x) - 1 if start else i]
        if i == 0:
            return None
        return times[i - 1] + (x - dists[i - 1]) / (dists[i] - dists[i - 1]) * (times[i] - times[i - 1])

    found = []
    for s in {*dists, *(d - target for d in dists)}:
        if dists[0] <= s <= dists[-1] - target:
            a, b = at(s, True), at(s + target, False)
            if a is not None and b is not None and b > a:
                found.append((b - a) / 1000)
    return min(found, default=None)


def test_rolling_efforts_against_direct_search(spark):
    rnd, rows, expected = random.Random(2), [], {}
    for a in range(40):
        t = d = 0
        trace = []
        for seq in range(rnd.randint(2, 60)):
            trace.append((t, float(d)))
            rows.append((a, seq, t, float(d)))
            t += rnd.choice([0, 1000, 5000, 30000])
            d += rnd.choice([0, 0, 50, 125, 300])
        expected[a] = direct_effort(trace, 1000.0)
    samples = spark.createDataFrame([*rows, (99, 0, 5, 0.0), (99, 1, 4, 2000.0)], "activity_id long, seq int, elapsed_ms long, distance_m double")
    wanted = spark.createDataFrame([("1k", 1000.0)], "target string, target_m double").withColumn("target_m", F.col("target_m").cast("decimal(14,3)"))
    found = {r.activity_id: r.elapsed_s for r in efforts.rolling_efforts(samples, wanted).collect()}
    assert found == {a: pytest.approx(x, abs=1e-5) for a, x in expected.items() if x is not None}


def test_first_crossing(spark):
    samples = spark.createDataFrame([(1, 0, 0, 0.0), (1, 1, 60000, 4000.0), (1, 2, 90000, 6000.0)], "activity_id long, seq int, elapsed_ms long, distance_m double")
    found = efforts.first_crossings(samples, efforts.targets(spark)).collect()
    assert [(r.target, r.elapsed_s) for r in found] == [("5k", 75.0)]


def test_bests(spark):
    at = lambda day: dt.datetime(2024, 1, day)
    rows = [(1, "5k", 10, at(1), 1300.0), (1, "5k", 11, at(2), 1310.0), (1, "5k", 12, at(3), 1290.0), (2, "5k", 13, at(1), 1500.0)]
    perf = spark.createDataFrame(rows, "athlete_id long, distance string, activity_id long, achieved_at timestamp, elapsed_s double")
    chain = {r.activity_id: r for r in bests.supersessions(perf).collect()}
    assert set(chain) == {10, 12, 13} and chain[10].superseded_at == at(3) and chain[12].previous_best_s == 1300.0 and chain[12].is_current
    assert [r.activity_id for r in bests.rejected(perf).collect()] == [11] and bests.duplicate_current(bests.supersessions(perf)).count() == 0


SUMMARY = "id long, row long, athlete_id long, kind string, start_s double, elapsed_s double, distance_m double, name string, moving_s double, elevation_m double"


def test_reconciliation(spark):
    run = lambda i, start, elapsed=600.0, m=2000.0, kind="running", name=None: (i, i, 1, kind, float(start), elapsed, m, name, None, None)
    a = spark.createDataFrame([run(1, 1000, name="A"), run(2, 5000), run(3, 9000), run(4, 9002), run(5, 20000, kind="cycling"), run(6, 30000), run(7, 40000)], SUMMARY)
    b = spark.createDataFrame([run(101, 1002, name="B"), run(102, 5000, name="B2", kind="cycling"), run(103, 9001), run(104, 30000, m=2051.0), run(105, 40000), run(106, 40001), run(107, 50000), run(108, 60000, kind="cycling")], SUMMARY)
    found = {(r.a_id, r.b_id): r for r in reconcile.reconcile(a, b).collect()}
    assert set(found) == {(1, 101), (2, 102), (3, 103), (4, None), (6, None), (None, 104), (7, None), (None, 105), (None, 106), (None, 107)}
    assert found[1, 101].name == "A" and found[2, 102].name == "B2" and found[2, 102].method == "cross_source_strong"
    assert [r.a_id for r in reconcile.findings(a, b).collect()] == [7]
    assert ("name", "b") in [(s.field, s.provider) for s in found[2, 102].provenance]


def test_feature_windows_do_not_leak(spark):
    at = lambda day, hour=8: dt.datetime(2024, 1, day, hour)
    runs = [(1, at(10), D(2024, 1, 10), 12000.0, 3600000, None, 50.0, 60.0, ["easy"], False), (1, at(20), D(2024, 1, 20), 5030.0, 1200000, None, 0.0, 20.0, ["race"], True), (1, at(20, 9), D(2024, 1, 20), 9000.0, 1200000, None, 0.0, 20.0, ["race"], True)]
    history = spark.createDataFrame(runs, "athlete_id long, start_utc timestamp, local_date date, distance_m double, moving_ms long, elevation_m double, hr_coverage double, training_load double, tags array<string>, is_quality boolean")
    ask = spark.createDataFrame([(9, 1, at(20), D(2024, 1, 20)), (8, 2, at(1), D(2024, 1, 1))], "activity_id long, athlete_id long, start_utc timestamp, local_date date")
    found = {r.activity_id: r for r in features.pre_event_windows(ask, history).collect()}
    r = found[9]
    assert (r.prior_7d_runs, r.prior_7d_load_min, r.prior_28d_runs, r.prior_28d_distance_km, r.prior_28d_load_min, r.prior_28d_weighted_pace, r.prior_28d_easy, r.prior_28d_quality) == (0, 0.0, 1, 12.0, 60.0, 300.0, 1, 0)
    assert found[8].prior_365d_runs == 0 and found[8].prior_365d_longest_run_km is None


def test_current_fitness(spark):
    marks = spark.createDataFrame([(1, "5k", 1200.0, D(2024, 5, 1), False, "segment", 10.0, "tempo", True), (1, "10k", 2600.0, D(2023, 5, 1), False, "whole_activity", 10.0, "race", True)], "athlete_id long, distance string, elapsed_s double, achieved_on date, max_effort boolean, effort_type string, activity_km double, session_kind string, is_verified boolean")
    history = spark.createDataFrame([(1, "5k", 1250.0, D(2023, 1, 1))], "athlete_id long, distance string, elapsed_s double, achieved_on date")
    now = spark.createDataFrame([(1, D(2024, 5, 10), 24, 240.0, 15.0)], "athlete_id long, as_of date, runs_84d long, distance_84d_km double, longest_84d_km double")
    before = spark.createDataFrame([(1, "10k", 240.0, 15.0)], "athlete_id long, distance string, distance_84d_km double, longest_84d_km double")
    f = {r.distance: r for r in fitness.current_fitness(marks, history, now, before).collect()}
    assert f["5k"].potential_s == 1152.0 and f["5k"].preparation == 1.0 and f["5k"].readiness_s == 1152.0 and f["5k"].confidence == "high"
    assert f["10k"].potential_s == round(2600 * 1152 / 1250, 3) and f["half_marathon"].potential_s == round(1152 * (21097.5 / 5000) ** 1.06, 3)
    assert f["half_marathon"].confidence == "low" and f["half_marathon"].current_best_s is None and f["marathon"].readiness_s > f["marathon"].potential_s


def test_plan_phases(spark):
    goals = spark.createDataFrame([(1, "10k", D(2024, 1, 3), D(2024, 3, 24), 30.0), (2, "5k", D(2024, 1, 3), D(2024, 1, 8), 30.0)], "goal_id long, distance string, as_of date, race_date date, recent_weekly_km double")
    rows = training_plan.weekly_outline(goals).orderBy("week").collect()
    assert [r.phase for r in rows] == ["base"] * 3 + ["build"] * 3 + ["specific"] * 3 + ["taper"] * 2 + ["race"] and rows[0].start_date == D(2024, 1, 1) and rows[-1].end_date == D(2024, 3, 24)
    assert rows[-1].long_run_km == 0.0 and {r.goal_id for r in rows} == {1}


def test_state_is_idempotent(spark):
    old = spark.createDataFrame([(1, "v1", "h1")], "activity_id long, algorithm_version string, input_hash string")
    new = spark.createDataFrame([(1, "v1", "h1"), (1, "v1", "h2"), (2, "v1", "h1")], old.schema)
    rows, counts = state.append_new(old, new)
    assert rows.count() == 2 and {r.action: r["count"] for r in counts.collect()} == {"created": 2, "reused": 1}
    again = state.append_new(old.unionByName(rows), new)[1]
    assert {r.action: r["count"] for r in again.collect()} == {"reused": 3}
    table = spark.createDataFrame([(1, 1.00004), (2, 2.0), (3, None)], "k long, v double")
    merged = state.upsert(table, table.withColumn("v", F.when(F.col("k") == 2, 2.0002).otherwise(F.col("v"))).where("k < 4"), ("k",), {"v": "decimal(12,4)"})
    assert {r.k: r.action for r in merged.collect()} == {1: "reused", 2: "updated", 3: "reused"}


def test_clock_and_distance(spark):
    df = spark.createDataFrame([("3:05", 185.0), ("1:02:03", 3723.0), ("x", None), ("5:61", None), (None, None)], "t string, s double")
    rows = df.select(scalars.clock_to_ms(F.col("t")).alias("ms"), scalars.clock(F.col("s")).alias("c")).collect()
    assert [r.ms for r in rows] == [185000, 3723000, None, None, None] and [r.c for r in rows] == ["3:05", "1:02:03", None, None, None]
    d = spark.createDataFrame([(5100.0,), (5200.0,), (42195.0,), (None,), (0.0,)], "m double").select(scalars.standard_distance(F.col("m")).alias("d")).collect()
    assert [r.d for r in d] == ["5k", None, "marathon", None, None]


def test_session_matching(spark):
    sessions = [(1, 5, 0, D(2024, 1, 1), "easy", 8.0, D(2024, 1, 7)), (1, 5, 1, D(2024, 1, 3), "quality", 10.0, D(2024, 1, 7)), (1, 5, 2, D(2024, 1, 6), "long", 20.0, D(2024, 1, 7))]
    s = spark.createDataFrame(sessions, "plan_id long, athlete_id long, session int, scheduled date, kind string, target_km double, as_of date")
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    runs = [(5, 10, at(1, 8), D(2024, 1, 1), 8000.0, ["easy"], "easy", "unknown"), (5, 11, at(1, 18), D(2024, 1, 1), 3000.0, ["unclassified"], "unclassified", "unknown"), (5, 12, at(4, 8), D(2024, 1, 4), 9000.0, ["tempo"], "tempo", "unknown"), (5, 13, at(5, 8), D(2024, 1, 5), 9000.0, ["easy"], "easy", "unknown")]
    r = spark.createDataFrame(runs, "athlete_id long, activity_id long, start_utc timestamp, local_date date, distance_m double, tags array<string>, primary string, activity_type string")
    found = tracking.match_sessions(s, r)
    assert {(x.session, x.activity_id) for x in found.collect()} == {(0, 10), (1, 12)}
    planned = s.withColumns({"faster": F.lit(300.0), "slower": F.lit(400.0)})
    timed = r.withColumns({"moving_ms": (F.col("distance_m") * 299).cast("long"), "name": F.lit("x")})
    status = tracking.session_status(planned, found, timed)
    assert {x.session: (x.status, x.pace_status, x.completion_pct) for x in status.collect()} == {0: ("completed", "faster_than_planned", 100.0), 1: ("completed", "not_applicable", 90.0), 2: ("missed", "unavailable", None)}
    inside = s.withColumns({"plan_start": F.lit(D(2024, 1, 2)), "plan_end": F.lit(D(2024, 1, 7))})
    assert {(x.session, x.activity_id) for x in tracking.match_sessions(inside, r).collect()} == {(1, 12)}


def test_plan_versions(spark):
    from paceforge.operators import plan_versions

    existing = spark.createDataFrame([(1, 1, "a", "superseded"), (1, 2, "b", "active"), (2, 1, "c", "active"), (3, 1, "d", "active")], "goal_id long, version int, evidence_hash string, status string")
    calculated = spark.createDataFrame([(1, "a"), (2, "x"), (4, "y")], "goal_id long, evidence_hash string")
    found = {(r.goal_id, r.version): (r.status, r.action) for r in plan_versions.store_versions(existing, calculated).collect()}
    assert found == {(1, 1): ("active", "reactivated"), (1, 2): ("superseded", "superseded"), (2, 1): ("superseded", "superseded"), (2, 2): ("active", "created"), (3, 1): ("active", "kept"), (4, 1): ("active", "created")}
    weeks = "goal_id long, week int, start_date date, end_date date, target_km double, long_run_km double"
    old = spark.createDataFrame([(1, 1, D(2024, 1, 1), D(2024, 1, 7), 30.0, 9.0), (1, 2, D(2024, 1, 8), D(2024, 1, 14), 31.0, 9.5)], weeks)
    new = spark.createDataFrame([(1, 1, D(2024, 1, 1), D(2024, 1, 7), 40.0, 12.0), (1, 2, D(2024, 1, 8), D(2024, 1, 14), 41.0, 12.5)], weeks)
    kept = plan_versions.retain_completed(old, new, F.lit(D(2024, 1, 8))).orderBy("week").collect()
    assert [(r.target_km, r.long_run_km) for r in kept] == [(30.0, 9.0), (41.0, 12.5)] and plan_versions.calendar_conflicts(old, new).count() == 0


def test_session_classes_read_whole_texts(spark):
    import duckdb

    from paceforge.plans import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("orders", "customer", "lineitem", "part", "documents", "events", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    whole = queries.ORACLE_SQL["session_classes"]
    found = [tuple(r) for r in queries.QUERIES["session_classes"](spark, sf).collect()]
    assert sorted(found, key=str) == sorted(con.execute(whole).fetchall(), key=str)
    assert max(len(r[0] or "") for r in found) > 200


def test_rolling_efforts_of_a_long_trace(spark):
    """50,000 samples of one activity; a frame read anew for each row would not end."""
    rnd, t, d, trace = random.Random(3), 0, 0, []
    for seq in range(50_000):
        trace.append((1, seq, t, float(d)))
        t += rnd.choice([500, 1000, 1500])
        d += rnd.choice([2, 3, 4, 5])
    samples = spark.createDataFrame(trace, "activity_id long, seq int, elapsed_ms long, distance_m double")
    wanted = efforts.targets(spark).where("target in ('5k', 'marathon')")
    found = {r.target: r.elapsed_s for r in efforts.rolling_efforts(samples, wanted).collect()}
    plain = [(a, b) for _, _, a, b in trace]
    assert found == {name: pytest.approx(direct_effort(plain, m), abs=1e-5) for name, m in (("5k", 5000.0), ("marathon", 42195.0))}


def test_walk_forward_knows_only_strictly_earlier_results(spark):
    at = lambda day: dt.datetime(2024, 1, day)
    rows = [(1, 10, "5k", 1300.0, at(1)), (1, 11, "5k", 1200.0, at(1)), (1, 12, "5k", 1250.0, at(2)), (2, 13, "10k", 3000.0, at(1))]
    df = spark.createDataFrame(rows, "athlete_id long, activity_id long, distance string, elapsed_s double, achieved_at timestamp")
    found = {(r.activity_id, r.baseline): r.predicted_s for r in features.walk_forward(df).collect()}
    assert found == {(12, "riegel_best_prior"): 1200.0, (12, "recent_same_distance"): 1200.0, (12, "historical_median_same_distance"): 1250.0}
    gates = {r.athlete_id: (r.labels, r.chronological_targets, r.distances, r.status, r.reasons) for r in features.eligibility(df).collect()}
    assert gates[1] == (3, 1, 1, "descriptive_only", ["labels", "chronological_targets", "distances"]) and gates[2][1] == 0
    many = spark.createDataFrame([(1, i, ("5k", "10k")[i % 2], 1300.0, at(1 + i % 20)) for i in range(30)], df.schema)
    assert features.eligibility(many).first().status == "eligible_for_candidate_model"


def test_medians_of_long_histories(spark, monkeypatch):
    import bisect
    import time

    from paceforge.operators import running_median

    def plain(rows):
        out, seen, held = {}, [], []
        for k, (key, at, value, i) in enumerate(sorted(rows)):
            if k and (key, at) != last:
                for v in held if key == last[0] else []:
                    bisect.insort(seen, v)
                seen, held = (seen if key == last[0] else []), []
            out[i] = None if not seen else (seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 2
            held.append(value)
            last = key, at
        return out

    rnd = random.Random(4)
    day = dt.datetime(2000, 1, 1)
    kinds = "athlete_id long, at timestamp, v double, id long"
    monkeypatch.setattr(running_median, "BLOCK", 7)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), day + dt.timedelta(hours=rnd.randrange(60)), float(rnd.randrange(40)), i) for i in range(300)] + [(4, day, 1.0, 900)]
    found = running_median.earlier_medians(spark.createDataFrame(rows, kinds), ["athlete_id"], "at", "v", "id").collect()
    assert {r.id: r["median"] for r in found} == plain(rows)
    assert running_median.earlier_medians(spark.createDataFrame([], kinds), ["athlete_id"], "at", "v", "id").count() == 0
    monkeypatch.undo()
    many = spark.range(100_000).selectExpr("1L AS athlete_id", "timestamp_seconds(id * 60) AS at", "cast(pmod(xxhash64(id), 100000) AS double) AS v", "id").cache()
    many.count()
    began = time.time()
    last = running_median.earlier_medians(many, ["athlete_id"], "at", "v", "id").orderBy(F.desc("id")).limit(3).collect()
    assert time.time() - began < 90
    values = [r.v for r in many.orderBy("id").select("v").collect()]
    for r in last:
        s = sorted(values[: r.id])
        assert r["median"] == (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def test_reply_audit(spark):
    from paceforge.operators import replies

    day, none = D(2024, 3, 1), []
    rows = [
        (1, "How was my week?", "Fine.", ["e1"], ["e1"], day, none),
        (2, "How was my week?", "Fine.", ["e2"], ["e1"], day, none),
        (3, "Can I race?", "You definitely can.", none, none, day, none),
        (4, "What about Tomorrow?", "Run easy.", none, none, day, none),
        (5, "What about tomorrow?", "Nothing is scheduled on 2024-03-02: no run.", none, none, day, none),
        (6, "What about tomorrow?", "Run easy.", none, none, day, [D(2024, 3, 2)]),
        (7, "What about tomorrow?", "Run easy.", none, none, None, none),
        (8, "I feel sick", "Take 200 mg of it.", none, none, day, none),
        (9, None, None, none, none, day, none),
    ]
    df = spark.createDataFrame(rows, "reply_id long, question string, answer string, cited array<string>, allowed array<string>, as_of date, scheduled array<date>")
    found = {r.reply_id: r.outcome for r in replies.audit(df).collect()}
    assert found == {1: "approved", 2: "fallback", 3: "fallback", 4: "fallback", 5: "approved", 6: "approved", 7: "fallback", 8: "medical", 9: "approved"}


def test_plan_progress(spark):
    week = [
        (1, 0, D(2024, 1, 1), "easy", 8.0, "completed", 8.5, D(2024, 1, 1)),
        (1, 1, D(2024, 1, 3), "quality", 10.0, "partial", 6.0, D(2024, 1, 3)),
        (1, 2, D(2024, 1, 6), "long", 20.0, "upcoming", None, None),
        (2, 0, D(2024, 1, 1), "long", 20.0, "missed", None, None),
        (3, 0, D(2024, 1, 8), "easy", 8.0, "upcoming", None, None),
        (4, 0, D(2024, 1, 1), "easy", 8.0, "completed", 14.0, D(2024, 1, 2)),
        (4, 1, D(2024, 1, 6), "easy", 8.0, "due", None, None),
        (5, 0, D(2024, 1, 1), "easy", 8.0, "completed", 8.0, D(2024, 1, 1)),
    ]
    df = spark.createDataFrame(week, "plan_id long, session int, scheduled date, kind string, target_km double, status string, actual_km double, activity_date date")
    df = df.withColumn("as_of", F.lit(D(2024, 1, 4)))
    assert {(r.plan_id, r.session, r.n) for r in tracking.pending_sessions(df).collect()} == {(1, 1, 1), (1, 2, 2), (3, 0, 1), (4, 1, 1)}
    assert {(r.plan_id, r.session) for r in tracking.latest_completed(df).collect()} == {(1, 1), (4, 0), (5, 0)}
    paces = spark.createDataFrame([("easy", 300.0, 330.0, 290.0), ("easy", 300.0, 330.0, 331.0), ("easy", 300.0, 330.0, 300.0), ("race", 1.0, 2.0, 3.0), ("long", None, 330.0, 310.0)], "k string, f double, s double, a double")
    assert [r[0] for r in paces.select(tracking.pace_status(F.col("k"), F.col("f"), F.col("s"), F.col("a"))).collect()] == ["faster_than_planned", "easier_than_planned", "within_range", "not_applicable", "unavailable"]


WEEK = "plan_id long, week int, start_date date, end_date date, phase string, target_km double, long_run_km double"


def plan_answer(spark, as_of, runs, sessions):
    """The one row of a plan of three weeks from Monday, 1 January 2024, and its weeks."""
    from paceforge.operators import training_plan

    weeks = spark.createDataFrame([(1, 1, D(2024, 1, 1), D(2024, 1, 7), "base", 30.0, 10.0), (1, 2, D(2024, 1, 8), D(2024, 1, 14), "build", 35.0, 12.0), (1, 3, D(2024, 1, 15), D(2024, 1, 18), "race", 14.0, 0.0)], WEEK)
    plans = spark.createDataFrame([(1, 5, as_of)], "plan_id long, athlete_id long, as_of date")
    ran = spark.createDataFrame([(5, d, m) for d, m in runs], "athlete_id long, local_date date, distance_m double")
    planned = spark.createDataFrame([(1, i, d, kind, title, km, status) for i, (d, kind, title, km, status) in enumerate(sessions)], "plan_id long, session int, scheduled date, kind string, title string, target_km double, status string")
    progress = training_plan.week_progress(plans, weeks, planned, ran)
    return tracking.plan_tracking(progress, planned).first(), progress.orderBy("week").collect()


def test_plan_tracking_counts_all_runs_and_finished_weeks(spark):
    easy = (D(2024, 1, 2), "easy", "Easy aerobic run", 6.0, "upcoming")
    long = (D(2024, 1, 7), "long", "Long aerobic run", 12.0, "upcoming")
    # the plan has begun on Monday, its first session is on Tuesday
    row, weeks = plan_answer(spark, D(2024, 1, 1), [], [easy, long])
    assert (row.status, row.code, row.current_week, row.planned_km, row.adherence_pct) == ("in_progress", "continue_as_planned", 1, 0.0, None)
    assert row.recommendation == "Continue with 6.0 km of easy aerobic run on 2024-01-02."
    row, _ = plan_answer(spark, D(2023, 12, 31), [(D(2023, 12, 31), 9000.0)], [easy, long])
    assert (row.status, row.code, row.actual_km) == ("not_started", "plan_not_started", 0.0)
    # a run that fulfils no session counts; due sessions are what is planned in the detailed week
    done = (*easy[:4], "completed")
    row, weeks = plan_answer(spark, D(2024, 1, 3), [(D(2024, 1, 2), 6000.0), (D(2024, 1, 3), 5500.0)], [done, long])
    assert (row.code, row.planned_km, row.actual_km, row.adherence_pct) == ("reduce_optional_volume", 6.0, 11.5, 191.7) and weeks[0].runs == 2
    # a finished week counts whole, the current one by sevenths if it has no dated sessions
    row, weeks = plan_answer(spark, D(2024, 1, 10), [(D(2024, 1, 6), 30000.0), (D(2024, 1, 9), 12000.0), (D(2024, 1, 11), 5000.0)], [done, (*long[:4], "completed")])
    assert (row.completed_weeks, row.total_weeks, row.current_week, row.planned_km, row.actual_km, row.code) == (1, 3, 2, 45.0, 42.0, "first_week_complete")
    assert [(w.status, w.completion_pct, w.long_run_completion_pct) for w in weeks] == [("completed", 100.0, 300.0), ("in_progress", 34.3, 100.0), ("upcoming", 0.0, 0.0)]
    row, _ = plan_answer(spark, D(2024, 2, 1), [], [(*long[:4], "missed"), (D(2024, 1, 9), "quality", "Hard Run", 9.0, "partial")])
    assert (row.status, row.code, row.current_week, row.planned_km) == ("completed", "avoid_makeup_quality", None, 79.0) and row.recommendation.startswith("The long aerobic run was missed.")
    row, _ = plan_answer(spark, D(2024, 1, 9), [], [(D(2024, 1, 9), "quality", "Hard Run", 9.0, "partial"), done])
    assert row.code == "accept_partial_quality" and row.recommendation.startswith("The hard run was partially completed.")


def test_coaching_evidence_of_an_athlete_without_a_plan(spark):
    from paceforge.operators import coaching

    marks = spark.createDataFrame([(1, "5k", 10, 1234.5, 246.9, D(2024, 1, 2), "training_split"), (2, "10k", 20, 2400.0, 240.0, D(2024, 1, 3), "verified_result")], "athlete_id long, distance string, activity_id long, elapsed_s double, pace double, achieved_on date, source string")
    chosen = spark.createDataFrame([(1, 10, D(2024, 1, 2), "Race", 5.0, 246.9, "race_performance", "5k", "r"), (1, 11, D(2024, 1, 1), None, 7.25, 260.0, "strong_training", None, "s")], "athlete_id long, activity_id long, achieved_on date, activity_name string, distance_km double, pace double, evidence_kind string, target string, reason string")
    goals = spark.createDataFrame([(2, "10k", D(2024, 5, 5), None, 2390.0, 4, 2)], "athlete_id long, distance string, race_date date, target_s double, recommended_s double, days_per_week int, version int")
    sessions = spark.createDataFrame([(2, i, D(2024, 1, 1 + i), "easy", "Easy aerobic run", "p", 8.0, 300.0 if i else None, 330.0, s, "unavailable") for i, s in enumerate(["missed", "due", "upcoming", "partial", "upcoming"])], "athlete_id long, session int, scheduled date, kind string, title string, purpose string, target_km double, faster double, slower double, status string, pace_status string")
    sessions = sessions.withColumns({"activity_date": F.when(F.col("session") == 3, F.col("scheduled")), "activity_name": F.lit("run"), "actual_km": F.lit(4.04), "actual_pace": F.lit(305.5), "classified_as": F.lit("easy"), "completion_pct": F.lit(50.5)})
    rows = coaching.evidence_table(coaching.best_rows(marks), coaching.performance_rows(chosen, marks), coaching.goal_rows(goals), coaching.latest_session_rows(sessions), coaching.next_session_rows(sessions)).orderBy("athlete_id", "position").collect()
    assert [(r.athlete_id, r.evidence_id) for r in rows] == [(1, "pb:5k"), (1, "performance:11"), (2, "pb:10k"), (2, "goal:active"), (2, "plan:latest-session"), (2, "plan:next-session:1"), (2, "plan:next-session:2"), (2, "plan:next-session:3")]
    by_id = {r.evidence_id: r for r in rows}
    assert by_id["pb:5k"].summary == "Current 5k personal best is 20:34, achieved 2024-01-02 as a training split."
    assert by_id["performance:11"].summary == "2024-01-01 run covered 7.3 km at 4:20/km; selected as strong training." and by_id["performance:11"].facts["target_distance"] is None
    assert by_id["goal:active"].summary == "Active 10k goal is scheduled for 2024-05-05; the saved target is unavailable." and by_id["goal:active"].facts["recommended_target_time"] == "39:50"
    assert by_id["plan:next-session:1"].summary == "2024-01-02: Easy aerobic run, 8.0 km at 5:00/km to 5:30/km (due)." and by_id["plan:next-session:3"].facts["scheduled_date"] == "2024-01-04"
    assert by_id["plan:latest-session"].summary == "Latest matched run on 2024-01-04: 4.0 km at 5:06/km against 8.0 km of easy aerobic run; pace was unavailable."


def test_best_mark_sources(spark):
    mark = "athlete_id long, distance string, activity_id long, elapsed_s double, achieved_on date, effort_type string"
    verified = spark.createDataFrame([(1, "5k", 1, 1200.0, D(2024, 1, 1), "whole_activity"), (1, "10k", 2, 2500.0, D(2024, 1, 1), "whole_activity")], mark)
    observed = spark.createDataFrame([(1, "5k", 3, 1200.0, D(2024, 2, 1), "rolling_segment"), (1, "10k", 4, 2400.0, D(2024, 2, 1), "rolling_segment"), (1, "marathon", 5, 9000.0, D(2024, 2, 1), "whole_activity")], mark)
    found = {r.distance: (r.activity_id, r.source) for r in bests.best_marks(verified, observed).collect()}
    assert found == {"5k": (1, "verified_result"), "10k": (4, "training_split"), "marathon": (5, "training_activity")}


def test_periods_against_all_pairs(spark):
    rnd, day = random.Random(6), D(2024, 1, 1)
    rows = [(rnd.randrange(4), day + dt.timedelta(days=(a := rnd.randrange(80))), None if rnd.random() < 0.1 else day + dt.timedelta(days=a + rnd.randrange(1, 25)), rnd.randrange(180, 184)) for _ in range(40)]
    rows += [(9, day, day + dt.timedelta(days=90), 180), (9, day + dt.timedelta(days=5), day + dt.timedelta(days=9), 181), (9, day + dt.timedelta(days=20), day + dt.timedelta(days=30), 182), rows[0], (8, day, day + dt.timedelta(days=5), 180), (8, day + dt.timedelta(days=5), None, 181)]
    kinds = "athlete_id long, valid_from date, valid_to date, max_hr int"
    far, one = D(9999, 12, 31), sorted(set(rows), key=str)
    meets = lambda x, y: x[0] == y[0] and x[1] < (y[2] or far) and y[1] < (x[2] or far)
    expected = {(*x, rows.count(x)) for x in one if rows.count(x) > 1 or any(meets(x, y) for y in one if y != x)}
    profiles = spark.createDataFrame(rows, kinds)
    assert {tuple(r) for r in activity.profile_overlaps(profiles).collect()} == expected and len([e for e in expected if e[0] == 9]) == 3
    runs = [(k * 200 + d, k, day + dt.timedelta(days=d)) for k in (*range(4), 8, 9) for d in range(-1, 120)]
    acts = spark.createDataFrame(runs, "activity_id long, athlete_id long, local_date date")
    on = {i: [x[3] for x in one if x[0] == k and x[1] <= d < (x[2] or far)] for i, k, d in runs}
    assert {r.activity_id: r.max_hr for r in activity.profile_on(acts, profiles).collect()} == {i: v[0] if len(v) == 1 else None for i, v in on.items()}
    assert {r.activity_id for r in activity.profile_findings(acts, profiles).collect()} == {i for i, v in on.items() if len(v) > 1}


def test_input_hash_of_long_traces(spark):
    samples = spark.range(1_000_000).selectExpr("1L AS activity_id", "cast(id AS int) AS seq", "id * 1000 AS elapsed_ms")
    head = spark.createDataFrame([(1, 5000.0), (2, 1.0)], "activity_id long, distance_m double")
    of = lambda s: {r.activity_id: r.input_hash for r in state.input_hash(["activity_id", "distance_m"], s, head).collect()}
    whole = of(samples)
    assert whole == of(samples.orderBy(F.desc("seq")).repartition(7))
    changed = of(samples.withColumn("elapsed_ms", F.when(F.col("seq") == 777_777, 0).otherwise(F.col("elapsed_ms"))))
    assert changed[1] != whole[1] and changed[2] == whole[2]


def test_dataset_holds_verified_results_without_candidates(spark):
    at = lambda d: dt.datetime(2024, 1, d, 8)
    acts = spark.createDataFrame([(i, 1, at(i), D(2024, 1, i)) for i in (1, 2, 3)], "activity_id long, athlete_id long, start_utc timestamp, local_date date")
    near = acts.where("activity_id = 2").withColumn("distance", F.lit("5k"))
    verified = spark.createDataFrame([(2, "5k", 1200.0), (3, "10k", 2500.0)], "activity_id long, distance string, elapsed_s double")
    rows = features.with_verified(near, verified, acts)
    assert {(r.activity_id, r.distance) for r in rows.collect()} == {(2, "5k"), (3, "10k")}
    blank = acts.select("activity_id")
    full = features.feature_dataset(rows, blank, blank, blank, verified.where("activity_id = 3"), features.prior_history(acts))
    assert {r.activity_id: (r.review_status, r.label_s, r.prior_history_runs, r.prior_history_days) for r in full.collect()} == {2: ("unreviewed", None, 1, 1), 3: ("verified", 2500.0, 2, 2)}
    assert features.dataset_status(full).first().model_status == "label_audit_required"


def test_import_merges_whole_tables(spark):
    from paceforge.operators import canonical

    src = "key long, provider string, external_id string, fingerprint string"
    rec = spark.createDataFrame([(1, "new 1", 10.0, [("name", "a"), ("steps", "b")]), (2, "new 2", 20.0, [("name", "a")]), (3, "new 3", 30.0, [("name", "a")]), (4, "new 4", 40.0, [("name", "b")])], "key long, name string, distance_m double, provenance array<struct<field:string,provider:string>>")
    sources = spark.createDataFrame([(1, "a", "x1", "f1"), (1, "b", "y1", "g1"), (2, "a", None, "f2"), (3, "a", "x3", "f3"), (3, "b", "y3", "g3"), (4, "b", "y4", "g4")], src)
    stored_sources = spark.createDataFrame([(11, "a", "x1", "old", 71), (12, "a", "other", "f2", 72), (13, "a", "x3", "f3", 73), (14, "b", "y3", "g3", 74), (15, "b", "far", "far", 75)], "source_id long, provider string, external_id string, fingerprint string, activity_id long")
    stored = spark.createDataFrame([(i, f"old {i}", float(i)) for i in (71, 72, 73, 74, 75)], "activity_id long, name string, distance_m double")
    fields = spark.createDataFrame([(71, "name", "b"), (71, "calories", "b"), (75, "name", "a")], "activity_id long, field string, provider string")
    done = canonical.merge(rec, sources, stored, stored_sources, fields, new_id=F.col("key") + 900)
    assert {r.key: (r.action, r.activity_id, r.new_sources) for r in done["outcomes"].collect()} == {1: ("updated", 71, 1), 2: ("updated", 72, 0), 3: ("conflict", None, 0), 4: ("created", 904, 1)}
    assert {tuple(r) for r in done["activities"].collect()} == {(71, "new 1", 10.0), (72, "new 2", 20.0), (73, "old 73", 73.0), (74, "old 74", 74.0), (75, "old 75", 75.0), (904, "new 4", 40.0)}
    assert {tuple(r) for r in done["sources"].collect()} == {(11, "a", "x1", "old", 71), (12, "a", "other", "f2", 72), (13, "a", "x3", "f3", 73), (14, "b", "y3", "g3", 74), (15, "b", "far", "far", 75), (None, "b", "y1", "g1", 71), (None, "b", "y4", "g4", 904)}
    assert {tuple(r) for r in done["fields"].collect()} == {(71, "name", "a"), (71, "steps", "b"), (71, "calories", "b"), (72, "name", "a"), (75, "name", "a"), (904, "name", "b")}
    numbered = done["sources"].withColumn("source_id", F.coalesce("source_id", F.col("activity_id") + 1000))
    again = canonical.merge(rec, sources, done["activities"], numbered, done["fields"], new_id=F.col("key") + 900)
    assert again["outcomes"].where("action = 'created' or new_sources > 0").count() == 0
    for name, before in (("activities", done["activities"]), ("sources", numbered), ("fields", done["fields"])):
        assert {tuple(r) for r in again[name].collect()} == {tuple(r) for r in before.collect()}


def test_canonical_merge(spark):
    done = spark.createDataFrame([(1,), (2,), (3,), (4,)], "key long")
    sources = spark.createDataFrame([(1, "a", "x1"), (1, "b", "y1"), (2, "a", "x2"), (3, "a", "x3"), (3, "b", "y3"), (4, "a", "x4")], "key long, provider string, external_id string")
    known = spark.createDataFrame([("a", "x1", 71), ("a", "x3", 73), ("b", "y3", 74), ("a", "x4", None)], "provider string, external_id string, activity_id long")
    found = {r.key: r for r in reconcile.merge_canonical(done, sources, known).collect()}
    assert {k: (r.action, r.new_sources) for k, r in found.items()} == {1: ("updated", 1), 2: ("created", 1), 3: ("conflict", 0), 4: ("created", 0)}
    assert found[1].activity_id == 71 and found[2].activity_id is not None and found[3].activity_id is None
    stored = sources.join(spark.createDataFrame([(k, r.activity_id) for k, r in found.items() if r.activity_id], "key long, activity_id long"), "key").select("provider", "external_id", "activity_id")
    again = {r.key: (r.action, r.activity_id, r.new_sources) for r in reconcile.merge_canonical(done.where("key <> 3"), sources, stored).collect()}
    assert again == {k: ("updated", found[k].activity_id, 0) for k in (1, 2, 4)}
