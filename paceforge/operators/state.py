"""Versioned tables that are refreshed without change when nothing changed."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """A table that is used several times, written once to the folder that driver and executors share.

    The folder is that of ``spark.checkpoint.dir``; one of our own is taken
    only by a local session that has none.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


#: Sequence numbers of a block of samples that is digested at once.
HASH_BLOCK = 1024


def input_hash(header: list[str], samples: DataFrame | None, rows: DataFrame, key: str = "activity_id") -> DataFrame:
    """Add ``input_hash``: SHA-256 over the header fields and, if given, the ordered samples of each row.

    Samples are digested one by one, their digests in order by blocks of
    ``HASH_BLOCK`` sequence numbers, and those of the blocks once more: what is
    gathered of a long trace is a digest a block.
    """
    head = F.to_json(F.struct(*header))
    if samples is None:
        return rows.withColumn("input_hash", F.sha2(head, 256))
    each = F.struct("seq", F.sha2(F.to_json(F.struct(*[c for c in samples.columns if c != key])), 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"]), ""), 256)
    blocks = samples.groupBy(key, F.floor(F.col("seq") / HASH_BLOCK).alias("seq")).agg(joined(each).alias("h"))
    traces = blocks.groupBy(key).agg(joined(F.struct("seq", "h")).alias("trace"))
    return rows.join(traces, key, "left").withColumn("input_hash", F.sha2(F.concat_ws("|", head, F.coalesce("trace", F.lit(""))), 256)).drop("trace")


def append_new(existing: DataFrame, calculated: DataFrame, key: tuple[str, ...] = ("activity_id", "algorithm_version", "input_hash")) -> tuple[DataFrame, DataFrame]:
    """(rows to append, action counts): rows whose key is there are reused, the others created."""
    known = existing.select(*key).distinct().withColumn("known", F.lit(True))
    marked = calculated.join(known, list(key), "left").withColumn("action", F.when(F.col("known"), "reused").otherwise("created"))
    return marked.where("action = 'created'").drop("known", "action"), marked.groupBy("action").count()


def upsert(existing: DataFrame, calculated: DataFrame, key: tuple[str, ...], values: dict[str, str]) -> DataFrame:
    """The merged table with an ``action`` per row: created, updated, reused or kept.

    ``values`` maps each compared column to the type it is persisted in, so
    changes below that precision are none. Rows that were not calculated again
    are kept.
    """
    old = existing.select(*key, *[F.col(c).cast(t).alias(f"old_{c}") for c, t in values.items()], F.lit(True).alias("was"))
    new = calculated.select(*key, *[F.round(c, int(t.rstrip(")").split(",")[1])).cast(t).alias(c) if t.startswith("decimal") else F.col(c).cast(t).alias(c) for c, t in values.items()], F.lit(True).alias("now"))
    joined = old.join(new, list(key), "full")
    same: Column = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    action = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "kept").when(same, "reused").otherwise("updated")
    return joined.select(*key, *[F.when(F.col("now"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in values], action.alias("action"))


def preserve_reviews(old: DataFrame, new: DataFrame, key: tuple[str, ...], decisions: tuple[str, ...]) -> DataFrame:
    """A refreshed queue whose unreviewed rows keep the earlier decision of the same key."""
    before = old.select(*key, *[F.col(c).alias(f"old_{c}") for c in decisions])
    joined = new.join(before, list(key), "left")
    take = (F.col("review_status") == "unreviewed") & F.col("old_review_status").isNotNull()
    return joined.select(*[F.when(take, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) if c in decisions else F.col(c) for c in new.columns])


def repeated_keys(df: DataFrame, key: tuple[str, ...], code: str) -> DataFrame:
    """Keys that occur more than once, as findings."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("code", F.lit(code))
