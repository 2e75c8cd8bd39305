"""Reconciling two providers' activity summaries into canonical activities.

Near starts are found by an equi-join on (athlete, bucket of seconds), never by
comparing all pairs. Matches that are the only ones on both sides are final;
the rest is resolved in the order of the first provider's rows, inside clusters
of starts that are at most the tolerance apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.scalars import is_running
from .turns import in_turn

START_S, DURATION_S, DISTANCE_M, DISTANCE_SHARE = 2.0, 30.0, 50.0, 0.005
#: Fields that the first provider gives unless it has none; a frame may lack any of them.
MERGED = (
    "timezone", "name", "moving_s", "distance_m", "elevation_m", "elevation_loss_m",
    "average_speed", "maximum_speed",
    "average_heart_rate", "maximum_heart_rate", "minimum_heart_rate",
    "average_cadence", "maximum_cadence",
    "calories", "steps",
    "vo2max", "aerobic_effect", "anaerobic_effect", "effect_label",
    "laps", "samples",
)
#: Fields of the first provider wherever it takes part.
CORE = ("kind", "start_s", "elapsed_s")


def compatible_distance(a: Column, b: Column) -> Column:
    """Within 50 m or half a percent of the longer one; a null distance never matches."""
    return F.abs(a - b) <= F.greatest(F.lit(DISTANCE_M), F.greatest(a, b) * DISTANCE_SHARE)


def strong_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, athlete_id, a_row, a_start): pairs of the same athlete with near start, duration and distance.

    Both are (id, athlete_id, row, kind, start_s, elapsed_s, distance_m, ...);
    rows of ``a`` must be runs.
    """
    width = 2 * START_S
    left = a.where(is_running(F.col("kind"))).select("athlete_id", F.col("id").alias("a_id"), F.col("row").alias("a_row"), F.col("start_s").alias("a_start"), F.col("elapsed_s").alias("a_elapsed"), F.col("distance_m").alias("a_dist"), F.floor(F.col("start_s") / width).alias("bucket"))
    bucket = F.floor(F.col("start_s") / width)
    right = b.select("athlete_id", F.col("id").alias("b_id"), F.col("start_s").alias("b_start"), F.col("elapsed_s").alias("b_elapsed"), F.col("distance_m").alias("b_dist"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    near = left.join(right, ["athlete_id", "bucket"])
    return near.where((F.abs(F.col("a_start") - F.col("b_start")) <= START_S) & (F.abs(F.col("a_elapsed") - F.col("b_elapsed")) <= DURATION_S) & compatible_distance(F.col("a_dist"), F.col("b_dist"))).select("athlete_id", "a_id", "a_row", "a_start", "b_id")


def _greedy(edges: Iterable[tuple]) -> Iterator[tuple]:
    """Rows of the first provider in turn: each takes its partner if just one is free."""
    used = set()
    for a, rows in groupby(edges, key=lambda edge: edge[2]):
        free = [b for *_, b in rows if b not in used]
        if len(free) == 1:
            used.add(free[0])
        yield a, free[0] if len(free) == 1 else None, "merged" if len(free) == 1 else "ambiguous" if free else "alone"


def assign(edges: DataFrame) -> DataFrame:
    """(a_id, b_id, outcome) for each ``a`` with a match: merged, ambiguous (several free ones) or alone (none left)."""
    counted = edges.withColumns({"a_n": F.count("*").over(Window.partitionBy("a_id")), "b_n": F.count("*").over(Window.partitionBy("b_id"))})
    final = counted.where("a_n = 1 and b_n = 1").select("a_id", "b_id", F.lit("merged").alias("outcome"))
    rest = counted.where("not (a_n = 1 and b_n = 1)")
    order = Window.partitionBy("athlete_id").orderBy("a_start", "a_id")
    # two rows that share a partner start at most twice the tolerance apart
    cluster = rest.withColumn("gap", (F.col("a_start") - F.lag("a_start").over(order) > 2 * START_S).cast("int")).withColumn("cluster", F.sum(F.coalesce("gap", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return final.unionByName(in_turn(cluster, ("athlete_id", "cluster"), (F.asc_nulls_last("a_row"), "a_id"), ("a_id", "b_id"), "a_id long, b_id long, outcome string", _greedy))


def reconcile(a: DataFrame, b: DataFrame, outcomes: bool = False) -> DataFrame:
    """Canonical activities: (a_id, b_id, method, athlete_id, kind, start_s, elapsed_s, *merged fields, provenance).

    Core fields are those of ``a`` where it takes part; each merged field that
    either frame has is that of ``a`` unless it is null or empty (a text or an
    array). ``provenance`` lists the provider of each field that has a value;
    pairs also name that of the provider's own type. Rows that are no runs are
    left out. With ``outcomes`` there is a last column ``outcome``, what
    ``assign`` made of a row of ``a``: null without any match.
    """
    decided = assign(strong_matches(a, b))
    fields = [f for f in MERGED if f in a.columns or f in b.columns]
    runs_a, b_all = a.where(is_running(F.col("kind"))), b
    left = runs_a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).join(decided.select("a_id", F.col("b_id").alias("m_b"), "outcome"), "a_id", "left")
    right = b_all.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    both = left.join(right, F.col("m_b") == F.col("b_id"), "full").where(F.col("a_id").isNotNull() | is_running(F.col("b_kind")))

    def given(side: str, frame: DataFrame, field: str) -> Column:
        """A provider's value where it is one, else null."""
        if field not in frame.columns:
            return F.lit(None)
        c, kind = F.col(f"{side}_{field}"), frame.schema[field].dataType
        return F.when(F.size(c) > 0, c) if isinstance(kind, ArrayType) else F.when(c != "", c) if isinstance(kind, StringType) else c

    values = {f: (given("a", a, f), given("b", b, f)) for f in fields}
    first = F.when(F.col("a_id").isNotNull(), "a").otherwise("b")
    paired = F.col("a_id").isNotNull() & F.col("b_id").isNotNull()
    named = [(f, first) for f in CORE] + [("provider_type", F.when(paired, "a"))]
    named += [(f, F.when(x.isNotNull(), "a").when(y.isNotNull(), "b")) for f, (x, y) in values.items()]
    sources = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), p.alias("provider")) for f, p in named]), lambda s: s["provider"].isNotNull())
    method = F.when(paired, "cross_source_strong").otherwise("single_source")
    core = [F.when(F.col("a_id").isNotNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in ("athlete_id", *CORE)]
    return both.select("a_id", "b_id", method.alias("method"), *core, *[F.coalesce(x, y).alias(f) for f, (x, y) in values.items()], sources.alias("provenance"), *["outcome"] * outcomes)


def canonical_order(reconciled: DataFrame) -> DataFrame:
    """``reconciled`` with ``position``: each athlete's activities from 1 by start, provider and the provider's id as text."""
    provider = F.when(F.col("a_id").isNotNull(), "a").otherwise("b")
    order = Window.partitionBy("athlete_id").orderBy("start_s", provider, F.coalesce("a_id", "b_id").cast("string"))
    return reconciled.withColumn("position", F.row_number().over(order))


def merge_canonical(reconciled: DataFrame, sources: DataFrame, known: DataFrame) -> DataFrame:
    """What becomes of each reconciled activity in the stored table: (key, activity_id, action, new_sources).

    ``sources`` is (key, provider, external_id), the representations of each
    reconciled ``key``; ``known`` (provider, external_id, activity_id) are the
    stored ones. An activity whose representations are stored under one
    activity is merged into it (``updated``), under several it is a
    ``conflict``, else it is ``created`` with an id made from its least
    representation. Stored representations without an activity are linked, not
    counted as new. A second identical import creates nothing.
    """
    own = sources.select("key", "provider", "external_id").distinct()
    found = own.join(known.select("provider", "external_id", "activity_id").distinct().withColumn("stored", F.lit(True)), ["provider", "external_id"], "left")
    of = found.groupBy("key").agg(
        F.count_distinct("activity_id").alias("links"),
        F.min("activity_id").alias("linked"),
        F.count_distinct(F.when(F.col("stored").isNull(), F.struct("provider", "external_id"))).alias("new_sources"),
        F.min(F.struct("provider", "external_id")).alias("least"),
    )
    action = F.when(F.col("links") > 1, "conflict").when(F.col("links") == 1, "updated").otherwise("created")
    made = F.xxhash64("least.provider", "least.external_id")
    activity_id = F.when(F.col("links") == 1, F.col("linked")).when(F.col("links") == 0, made)
    return reconciled.select("key").join(of, "key").select("key", activity_id.alias("activity_id"), action.alias("action"), "new_sources")


def findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, code): runs that matched several rows and were kept alone."""
    return assign(strong_matches(a, b)).where("outcome = 'ambiguous'").select("a_id", F.lit("CROSS_SOURCE_MATCH_AMBIGUOUS").alias("code"))


def field_sources(canonical: DataFrame) -> DataFrame:
    """One provenance row per canonical activity and field."""
    return canonical.select("a_id", "b_id", F.explode("provenance").alias("s")).select("a_id", "b_id", "s.field", "s.provider")
