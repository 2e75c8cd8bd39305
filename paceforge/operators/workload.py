"""Gap-free daily workload series with acute, chronic and form states.

The state s moves by (load - s) / tau every calendar day, from 0. Its closed
form is a weighted sum, which overflows over long histories; it is therefore
summed inside blocks of days, and the ends of the blocks are carried on.
Blocks of one athlete are separate window partitions, so a long history is not
one task. Joins of days are by shuffle: days are made from a row per athlete, so
Spark takes them for far fewer than they are and would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACUTE_DAYS, CHRONIC_DAYS, BLOCK_DAYS = 7, 42, 512


def calendar(daily: DataFrame, end_date: Column | None = None) -> DataFrame:
    """Every day from an athlete's first to last load (or ``end_date``), with load 0 and coverage 100 on days without runs.

    ``daily`` is (athlete_id, local_date, daily_load) with unique dates, and may
    have coverage_pct. Adds ``day``, which counts from 0.
    """
    spans = daily.groupBy("athlete_id").agg(F.min("local_date").alias("first"), F.max("local_date").alias("last"))
    last = F.greatest("last", end_date) if end_date is not None else F.col("last")
    days = spans.select("athlete_id", "first", F.explode(F.sequence("first", last)).alias("local_date"))
    coverage = F.col("coverage_pct") if "coverage_pct" in daily.columns else F.lit(None).cast("double")
    known = daily.select("athlete_id", "local_date", F.col("daily_load").cast("double").alias("daily_load"), coverage.alias("coverage_pct"))
    filled = days.join(known.hint("merge"), ["athlete_id", "local_date"], "left").na.fill(0.0, ["daily_load"]).na.fill(100.0, ["coverage_pct"])
    return filled.withColumn("day", F.datediff("local_date", "first")).drop("first")


def _cut(days: DataFrame, block_days: int) -> DataFrame:
    return days.withColumns({"block": F.floor(F.col("day") / block_days), "k": F.col("day") % block_days})


def _carries(cut: DataFrame, taus: dict[str, int], starts: DataFrame | None = None) -> DataFrame:
    """(athlete_id, block, {name}_carry, {name}_end): each state before a block and after its last day.

    A block's share in its end is a plain weighted sum. ``starts``
    (athlete_id, from_block, {name}) has the states before the first block at
    hand; without it they are 0 before block 0.
    """
    d = {name: 1 - 1 / tau for name, tau in taus.items()}
    shares = {n: (F.sum(F.col("daily_load") * F.pow(F.lit(1 / d[n]), F.col("k"))) * F.pow(F.lit(d[n]), F.max("k")) / taus[n]).alias(n) for n in taus}
    ends = cut.groupBy("athlete_id", "block").agg(F.max("k").alias("k"), *shares.values())
    blocks = ends.groupBy("athlete_id").agg(F.array_sort(F.collect_list(F.struct("block", "k", *taus))).alias("blocks"))
    if starts is None:
        blocks = blocks.withColumns({"from_block": F.lit(0).cast("long"), **{f"{n}_start": F.lit(0.0) for n in taus}})
    else:
        blocks = blocks.join(starts.select("athlete_id", "from_block", *[F.col(n).alias(f"{n}_start") for n in taus]), "athlete_id")

    def carried(name: str, n: Column) -> Column:
        return F.aggregate(F.slice("blocks", F.lit(1), n.cast("int")), F.col(f"{name}_start"), lambda acc, b: acc * F.pow(F.lit(d[name]), b["k"] + 1) + b[name])

    each = blocks.withColumn("block", F.explode(F.sequence("from_block", F.col("from_block") + F.size("blocks") - 1)))
    place = F.col("block") - F.col("from_block")
    return each.select("athlete_id", "block", *[carried(n, place).alias(f"{n}_carry") for n in taus], *[carried(n, place + 1).alias(f"{n}_end") for n in taus])


def _states(cut: DataFrame, taus: dict[str, int], carries: DataFrame) -> DataFrame:
    """Add one column per name in ``taus`` with the state after each day."""
    d = {name: 1 - 1 / tau for name, tau in taus.items()}
    within = Window.partitionBy("athlete_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(carries.select("athlete_id", "block", *[f"{n}_carry" for n in taus]).hint("shuffle_hash"), ["athlete_id", "block"])
    local = {n: F.sum(F.col("daily_load") * F.pow(F.lit(1 / d[n]), F.col("k"))).over(within) * F.pow(F.lit(d[n]), F.col("k")) / taus[n] for n in taus}
    return joined.withColumns({n: local[n] + F.col(f"{n}_carry") * F.pow(F.lit(d[n]), F.col("k") + 1) for n in taus}).drop("block", "k", *[f"{n}_carry" for n in taus])


TAUS = {"acute": ACUTE_DAYS, "chronic": CHRONIC_DAYS}


def _series(states: DataFrame, places: int) -> DataFrame:
    history = F.col("day") + 1
    return states.select(
        "athlete_id",
        "local_date",
        F.round("daily_load", 6).alias("daily_load"),
        F.when(history >= ACUTE_DAYS, F.round("acute", places)).alias("acute_load"),
        F.when(history >= CHRONIC_DAYS, F.round("chronic", places)).alias("chronic_load"),
        F.when(history >= CHRONIC_DAYS, F.round(F.col("chronic") - F.col("acute"), places)).alias("form_index"),
        F.round("coverage_pct", 4).alias("coverage_pct"),
        history.alias("history_days"),
    )


def resume_points(stored: DataFrame, changed: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """(athlete_id, first, from_block, acute, chronic): where a series is taken up again after its loads changed.

    ``stored`` is (athlete_id, first, block, acute, chronic), the first day of
    each athlete's series and the states after each block; ``changed``
    (athlete_id, local_date) the days with new loads. A series goes on at the
    earliest block that holds such a day; one whose first day moves, or that is
    new, begins anew.
    """
    early = changed.groupBy("athlete_id").agg(F.min("local_date").alias("since"))
    firsts = stored.groupBy("athlete_id").agg(F.min("first").alias("was"), F.max("block").alias("last"))
    at = early.join(firsts, "athlete_id", "left")
    whole = F.col("was").isNull() | (F.col("since") < F.col("was"))
    block = F.when(whole, 0).otherwise(F.least(F.floor(F.datediff("since", "was") / block_days), F.col("last"))).cast("long")
    at = at.select("athlete_id", F.when(whole, F.col("since")).otherwise(F.col("was")).alias("first"), block.alias("from_block"))
    before = stored.select("athlete_id", (F.col("block") + 1).alias("from_block"), "acute", "chronic")
    return at.join(before, ["athlete_id", "from_block"], "left").select("athlete_id", "first", "from_block", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in TAUS])


def resumed_series(daily: DataFrame, points: DataFrame, block_days: int = BLOCK_DAYS, places: int = 6) -> tuple[DataFrame, DataFrame]:
    """The series of ``points`` (``resume_points``) from the first day of their block on, and the block states (athlete_id, first, block, acute, chronic).

    ``daily`` are the athletes' loads from that day on; earlier ones are not
    used and need not be read. Both equal what a run over the whole history
    gives.
    """
    begin = F.expr(f"date_add(first, cast(from_block * {block_days} as int))")
    known = daily.join(points.select("athlete_id", begin.alias("begin")), "athlete_id").where(F.col("local_date") >= F.col("begin")).drop("begin")
    last = known.groupBy("athlete_id").agg(F.max("local_date").alias("last"))
    # a series that lost its last days ends earlier; one whose block lost all days has no row here
    span = points.join(last, "athlete_id").withColumn("begin", begin)
    days = span.select("athlete_id", "first", F.explode(F.sequence("begin", "last")).alias("local_date"))
    coverage = F.col("coverage_pct") if "coverage_pct" in daily.columns else F.lit(None).cast("double")
    filled = days.join(known.select("athlete_id", "local_date", F.col("daily_load").cast("double").alias("daily_load"), coverage.alias("coverage_pct")).hint("merge"), ["athlete_id", "local_date"], "left")
    filled = filled.na.fill(0.0, ["daily_load"]).na.fill(100.0, ["coverage_pct"]).withColumn("day", F.datediff("local_date", "first")).drop("first")
    cut = _cut(filled, block_days)
    carries = _carries(cut, TAUS, points)
    ends = carries.join(points.select("athlete_id", "first"), "athlete_id").select("athlete_id", "first", "block", *[F.col(f"{n}_end").alias(n) for n in TAUS])
    return _series(_states(cut, TAUS, carries), places), ends


def workload_series(daily: DataFrame, end_date: Column | None = None, block_days: int = BLOCK_DAYS, places: int = 6) -> DataFrame:
    """(athlete_id, local_date, daily_load, acute_load, chronic_load, form_index, coverage_pct, history_days).

    Acute load is null before the 7th day, chronic load and form before the
    42nd. An empty input gives an empty series.
    """
    cut = _cut(calendar(daily, end_date), block_days)
    return _series(_states(cut, TAUS, _carries(cut, TAUS)), places)


def latest_snapshot(series: DataFrame) -> DataFrame:
    """The last day of each athlete's series."""
    return series.groupBy("athlete_id").agg(F.max_by(F.struct(*[c for c in series.columns if c != "athlete_id"]), "local_date").alias("s")).select("athlete_id", "s.*")


def snapshots_on(series: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The series rows of exactly the asked (athlete_id, local_date), and findings for dates without one."""
    keys = ["athlete_id", "local_date"]
    wanted = asked.select(*keys).distinct()
    return series.join(wanted, keys, "left_semi"), wanted.join(series.select(*keys), keys, "left_anti").withColumn("code", F.lit("WORKLOAD_DATE_MISSING"))


def series_findings(daily: DataFrame) -> DataFrame:
    """Dates that occur more than once: (athlete_id, local_date, code)."""
    return daily.groupBy("athlete_id", "local_date").count().where("count > 1").select("athlete_id", "local_date", F.lit("DAILY_LOAD_DATE_REPEATED").alias("code"))
