"""Plans and decisions of queries that failed on larger tables: no broadcast of rows that are made, no call per small group."""

import random
import re

from pyspark.sql import functions as F

from paceforge.operators import reconcile, tracking
from paceforge.plans import queries

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    """The physical plan under Spark's own bound for broadcasts, before anything runs."""
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    return df._jdf.queryExecution().sparkPlan().toString()


def test_days_of_a_series_are_not_broadcast(spark):
    plan = planned(queries.daily_load_upsert(spark, SF))
    assert "BroadcastHashJoin" not in plan and "ShuffledHashJoin" in plan


def test_plans_and_sessions_are_not_broadcast(spark):
    """Only the few names of runs are."""
    keys = re.findall(r"BroadcastHashJoin \[(\w+)#", planned(queries.plan_tracking(spark, SF)))
    assert set(keys) <= {"name"}
    few = spark.range(4).select(F.col("id").alias("plan_id"), F.lit(1).alias("n"))
    weeks = few.select("plan_id", F.current_date().alias("as_of"), F.current_date().alias("plan_start"), F.current_date().alias("plan_end"), F.lit(1).alias("week"), F.lit("upcoming").alias("status"), F.lit(1.0).alias("planned_km"), F.lit(1.0).alias("actual_km"))
    sessions = few.select("plan_id", F.current_date().alias("scheduled"), F.lit(0).alias("session"), F.lit("long").alias("kind"), F.lit("Long").alias("title"), F.lit(1.0).alias("target_km"), F.lit("due").alias("status"))
    assert "Broadcast" not in planned(tracking.plan_tracking(weeks, sessions))


def test_sessions_in_turn_against_a_plain_loop(spark, monkeypatch):
    rnd, expected = random.Random(3), set()
    rows = [(p, s, a, rnd.randrange(3), float(rnd.randrange(4)), rnd.choice([None, 1, 2]), rnd.choice([True, False, None])) for p in range(40) for s in range(4) for a in rnd.sample(range(p * 10, p * 10 + 8), 5)]
    for plan in range(40):
        own, taken = [r for r in rows if r[0] == plan], {}
        for adjacent in (False, True):
            for session in range(4):
                pool = sorted((-r[4], r[5] is None, r[5] or 0, r[2]) for r in own if r[1] == session and (r[6] is True if adjacent else r[3] == 0))
                free = [x[3] for x in pool if x[3] not in taken.values()]
                if free and session not in taken:
                    taken[session] = free[0]
        expected |= {(plan, s, a) for s, a in taken.items()}
    found = spark.createDataFrame(rows, "plan_id long, session int, activity_id long, off int, score double, at int, fits boolean").withColumns({"same_day": F.col("off") == 0, "start_utc": F.timestamp_seconds("at")})
    monkeypatch.setattr(tracking, "session_candidates", lambda sessions, runs: found)
    matched = tracking.match_sessions(None, None)
    assert {tuple(r) for r in matched.collect()} == expected and len(expected) > 100
    assert "FlatMapGroupsInPandas" not in planned(matched)


def test_files_in_turn_against_a_plain_loop(spark):
    """Many small clusters and one of 400 files; a file is held against all that were made before."""
    rnd = random.Random(4)
    files = [(c * 4 + i, c, float(1000 * c + rnd.randrange(4)), rnd.choice([600.0, 605.0, 900.0, None]), rnd.choice([2000.0, 2010.0, 9000.0, None])) for c in range(1, 60) for i in range(4)]
    files += [(1000 + i, 0, float(x), rnd.choice([600.0, 605.0, 900.0]), rnd.choice([2000.0, 9000.0])) for i, x in enumerate(rnd.sample(range(400), 400))]
    kinds = "athlete_id long, start_s double, elapsed_s double, distance_m double"
    acts = [(5000 + c, c, 1000.0 * c, 600.0, 2000.0) for c in range(1, 60, 3)]
    fits = lambda f, m: None not in f[3:] and f[1] == m[1] and abs(f[2] - m[2]) <= 2 and abs(f[3] - m[3]) <= max(60, m[3] * 0.02) and abs(f[4] - m[4]) <= max(50, m[4] * 0.005)
    made, expected = [], set()
    for f in sorted(files):
        stored, near = [a for a in acts if fits(f, a)], [m for m in made if fits(f, m)]
        if len(stored) + len(near) > 1:
            expected.add((f[0], None, None, "ambiguous"))
        elif stored or near:
            expected.add((f[0], stored[0][0] if stored else None, near[0][0] if near else None, "matched"))
        elif None in f[3:]:
            expected.add((f[0], None, None, "unmatched"))
        else:
            made.append(f)
            expected.add((f[0], None, f[0], "created"))
    given = spark.createDataFrame(files, "file_id long, " + kinds).withColumn("provider", F.lit("p"))
    found = tracking.create_missing(given, given.select("file_id", F.lit("unmatched").alias("status")), spark.createDataFrame(acts, "activity_id long, " + kinds))
    assert {tuple(r) for r in found.collect()} == expected and {x[3] for x in expected} == {"ambiguous", "matched", "unmatched", "created"}
    assert "FlatMapGroupsInPandas" not in planned(found)


def test_matches_in_turn_against_a_plain_loop(spark):
    """Clusters of a few rows, and one chain of 300."""
    rnd = random.Random(5)
    edges = [(c, c * 10 + i, c * 10 + 9 - i, 100.0 * c + i, c * 10 + j) for c in range(1, 80) for i in range(4) for j in rnd.sample(range(5), rnd.randrange(1, 4))]
    edges += [(0, 5000 + i, 5000 + i, float(i), 7000 + i + j) for i in range(300) for j in (0, 1)]
    used, expected = set(), set()
    for row, a in sorted({(e[2], e[1]) for e in edges}):
        free = [e[4] for e in edges if e[1] == a and e[4] not in used]
        used |= {*free} if len(free) == 1 else set()
        expected.add((a, free[0] if len(free) == 1 else None, ["alone", "merged", "ambiguous"][min(len(free), 2)]))
    found = reconcile.assign(spark.createDataFrame(edges, "athlete_id long, a_id long, a_row long, a_start double, b_id long"))
    assert {tuple(r) for r in found.collect()} == expected and {x[2] for x in expected} == {"alone", "merged", "ambiguous"}
    assert "FlatMapGroupsInPandas" not in planned(found)


def test_crowded_rows_are_decided_once(spark):
    plan = planned(queries.reconciled_crowded(spark, SF))
    assert len(re.findall("MapInArrow|FlatMapGroupsInPandas", plan)) == 1


def test_sources_link_files_that_were_decided_in_turn(spark):
    plan = planned(queries.created_sources(spark, SF))
    assert "FlatMapGroupsInPandas" not in plan
    files = spark.createDataFrame([(1, 1, 100.0, 600.0, 2000.0), (2, 1, 101.0, 610.0, 2010.0), (3, 1, 102.0, 600.0, float("nan"))], "file_id long, athlete_id long, start_s double, elapsed_s double, distance_m double").withColumns({"provider": F.lit("p"), "external_id": F.lit(None).cast("string")})
    none = files.select(F.lit(0).cast("long").alias("activity_id"), "athlete_id", "start_s", "elapsed_s", "distance_m").limit(0)
    decided = tracking.create_missing(files, files.select("file_id", F.lit("unmatched").alias("status")), none)
    # no number is not no value: SQL makes an activity of it, in a cluster as alone
    assert {(r.file_id, r.activity_id) for r in tracking.created_rows(files, decided, new_id=F.col("new_of") + 10)[1].collect()} == {(1, 11), (2, 11), (3, 13)}


def test_created_files_need_no_call_for_each_cluster(spark):
    decided = queries.created_from_files(spark, SF)
    assert "FlatMapGroupsInPandas" not in planned(decided) and decided.columns == ["file_id", "activity_id", "new_of", "action"]
