"""The stored canonical tables after an import: activities, their sources and the provenance of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_sources(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """``sources`` with (source_id, activity_id) of their stored representation, null where there is none.

    Both have (provider, external_id, fingerprint). A representation is looked
    up by its provider's id and, where that finds none, by its fingerprint; of
    several stored ones that with the smallest source_id is taken.
    """
    def first(by: str) -> DataFrame:
        kept = stored.where(F.col(by).isNotNull()).groupBy("provider", by).agg(F.min(F.struct("source_id", "activity_id")).alias(f"by_{by}"))
        return kept

    met = sources.join(first("external_id"), ["provider", "external_id"], "left").join(first("fingerprint"), ["provider", "fingerprint"], "left")
    found = F.coalesce("by_external_id", "by_fingerprint")
    return met.select(*sources.columns, found["source_id"].alias("source_id"), found["activity_id"].alias("activity_id"))


def outcomes(found: DataFrame, new_id: Column) -> DataFrame:
    """(key, activity_id, action, new_sources) for each ``key`` of ``find_sources``.

    One whose representations are stored under one activity is ``updated``,
    under several a ``conflict`` (without an id), else ``created`` under
    ``new_id``, an expression over ``key`` and ``least``, its least
    (provider, external_id, fingerprint).
    """
    of = found.groupBy("key").agg(
        F.count_distinct("activity_id").alias("links"),
        F.min("activity_id").alias("linked"),
        F.count(F.when(F.col("source_id").isNull(), 1)).alias("new_sources"),
        F.min(F.struct("provider", "external_id", "fingerprint")).alias("least"),
    )
    action = F.when(F.col("links") > 1, "conflict").when(F.col("links") == 1, "updated").otherwise("created")
    activity_id = F.when(F.col("links") == 1, F.col("linked")).when(F.col("links") == 0, new_id)
    return of.select("key", activity_id.alias("activity_id"), action.alias("action"), "new_sources")


def merge(reconciled: DataFrame, sources: DataFrame, stored_activities: DataFrame, stored_sources: DataFrame, stored_fields: DataFrame, new_id: Column | None = None) -> dict[str, DataFrame]:
    """The tables after the import: ``activities``, ``sources``, ``fields``, and the ``outcomes`` by key.

    ``reconciled`` is (key, *values, provenance), the values named as in
    ``stored_activities`` (activity_id, *values); ``provenance`` lists (field,
    provider). An updated activity takes all values of the import; of several
    keys for one activity the greatest counts. Conflicts change nothing. All
    other stored rows are kept. ``sources`` (key, provider, external_id,
    fingerprint) are linked to their activity, the stored ones under their
    source_id, others with a null one. Fields of ``stored_fields``
    (activity_id, field, provider) that the import names again get its
    provider, the others stay. A second import of the same rows creates
    nothing and changes nothing.
    """
    found = find_sources(sources, stored_sources)
    made = F.xxhash64("least.provider", "least.external_id", "least.fingerprint") if new_id is None else new_id
    decided = outcomes(found, made)
    values = [c for c in stored_activities.columns if c != "activity_id"]
    taken = reconciled.join(decided.where("activity_id is not null"), "key")
    last = Window.partitionBy("activity_id").orderBy(F.desc("key"))
    taken = taken.withColumn("__n", F.row_number().over(last)).where("__n = 1")

    new = taken.select("activity_id", F.struct(*[F.col(c).cast(stored_activities.schema[c].dataType).alias(c) for c in values]).alias("new"))
    both = stored_activities.join(new, "activity_id", "full")
    activities = both.select("activity_id", *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in values])

    linked = found.drop("activity_id").join(decided.select("key", "activity_id").where("activity_id is not null"), "key")
    ids = linked.where("source_id is not null").groupBy("source_id").agg(F.max("activity_id").alias("to"))
    kept = stored_sources.join(ids, "source_id", "left").withColumn("activity_id", F.coalesce("to", "activity_id")).drop("to")
    added = linked.where("source_id is null").select(*[F.col(c) for c in stored_sources.columns])

    named = taken.select("activity_id", F.explode("provenance").alias("p")).select("activity_id", F.col("p.field").alias("field"), F.col("p.provider").alias("now"))
    fields = stored_fields.join(named, ["activity_id", "field"], "full").select("activity_id", "field", F.coalesce("now", "provider").alias("provider"))
    return {"activities": activities, "sources": kept.unionByName(added), "fields": fields, "outcomes": decided}
