"""Medians of all strictly earlier values, by blocks.

A short history is a growing window. In a longer one the values are dealt by
their order into buckets and by time into blocks, both of ``BLOCK`` rows. Counts
of earlier blocks by bucket are carried on by a window over that small grid, so
the block of a row tells in which bucket its median lies and at which place; the
bucket's own rows tell which value it is. No task sees more than a few blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1000
PLACES = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in ("block", "earlier", "turn", "bucket", "place"))])


def _places(rows: pa.Table, carried: pa.Table) -> pa.Table:
    """Bucket and place in it of the middle values for each number of earlier rows that is asked in a block."""
    t, bucket, earlier = (rows[c].to_numpy() for c in ("t", "bucket", "earlier"))
    asked, order = np.sort(earlier[t < 0]), np.argsort(t, kind="stable")
    t, bucket = t[order][len(asked) :], bucket[order][len(asked) :]
    places, n = carried["bucket"].to_numpy(), carried["n"].to_numpy()
    counts = np.zeros(int(max(places.max(initial=0), bucket.max(initial=0))) + 1, np.int64)
    counts[places] += n
    out, taken = [], 0
    for e in asked.tolist():
        while taken < len(t) and t[taken] < e:
            counts[bucket[taken]] += 1
            taken += 1
        ends = counts.cumsum()
        for turn, k in enumerate(((e - 1) // 2, e // 2)):
            b = int(np.searchsorted(ends, k, "right"))
            out.append((e, turn, b, k - int(ends[b - 1] if b else 0)))
    found = np.array(out, np.int64).reshape(-1, 4)
    same = {c: [rows[c][0].as_py()] * len(found) if len(rows) else [] for c in ("key", "block")}
    numbers = dict(zip(("earlier", "turn", "bucket", "place"), found.T))
    return pa.table([pa.array({**same, **numbers}[f.name], f.type) for f in PLACES], schema=PLACES)


def _values(asked: pa.Table, rows: pa.Table) -> pa.Table:
    """The values at the places of a bucket."""
    rows = rows.sort_by("r")
    t, v = rows["t"].to_numpy(), rows["value"].to_numpy()
    found = [v[np.flatnonzero(t < e)[p]] for e, p in zip(asked["earlier"].to_numpy(), asked["place"].to_numpy())]
    return asked.select(["key", "earlier", "turn"]).append_column("value", pa.array(found, pa.float64()))


def earlier_medians(rows: DataFrame, keys: list[str], time: str, value: str, ident: str) -> DataFrame:
    """``rows`` with ``median`` of the values at strictly earlier times under the same keys; null where there are none.

    Values must not be null; ``ident`` tells rows of one time and value apart.
    """
    by = Window.partitionBy(*keys)
    before = by.orderBy(F.unix_micros(time)).rangeBetween(Window.unboundedPreceding, -1)
    quick = lambda some: some.withColumn("median", F.expr(f"percentile({value}, 0.5)").over(before))
    if not rows.groupBy(*keys).count().where(F.col("count") > BLOCK).limit(1).count():
        return quick(rows)
    sized = rows.withColumn("__n", F.count("*").over(by))
    short, long = sized.where(F.col("__n") <= BLOCK), sized.where(F.col("__n") > BLOCK)

    in_time = by.orderBy(time, ident)
    placed = long.withColumns({
        "t": F.row_number().over(in_time).cast("long") - 1,
        "r": F.row_number().over(by.orderBy(value, time, ident)).cast("long") - 1,
        "earlier": F.rank().over(by.orderBy(time)).cast("long") - 1,
        "key": F.to_json(F.struct(*keys)),
    })
    number = lambda c: F.floor(F.col(c) / BLOCK)
    own = placed.select("key", number("t").alias("block"), number("r").alias("bucket"), "t", "r", F.col(value).cast("double").alias("value"))
    none = F.lit(-1).cast("long")
    asked = placed.where("earlier > 0").select("key", number("earlier").alias("block"), none.alias("bucket"), none.alias("t"), "earlier").distinct()
    grid = placed.groupBy("key").agg(F.floor(F.max("__n") / BLOCK).alias("last")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    counts = grid.join(own.groupBy("key", "block", "bucket").agg(F.count("*").alias("n")), ["key", "block", "bucket"], "left")
    so_far = Window.partitionBy("key", "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(F.col("key").alias("of"), F.col("block").alias("at"), "bucket", F.sum("n").over(so_far).alias("n")).where("n > 0")

    both = own.select("key", "block", "bucket", "t", none.alias("earlier")).unionByName(asked)
    places = both.groupBy("key", "block").cogroup(carried.groupBy("of", "at")).applyInArrow(_places, "key string, block long, earlier long, turn long, bucket long, place long")
    lists = places.select("key", "block", "bucket").distinct().join(own.drop("block"), ["key", "bucket"])
    lists = lists.select(F.col("key").alias("of"), F.col("block").alias("at"), F.col("bucket").alias("list"), "t", "r", "value")
    found = places.groupBy("key", "block", "bucket").cogroup(lists.groupBy("of", "at", "list")).applyInArrow(_values, "key string, earlier long, turn long, value double")
    medians = found.groupBy("key", "earlier").agg(F.avg("value").alias("median"))
    slow = placed.join(medians, ["key", "earlier"], "left").drop("key", "earlier", "t", "r", "__n")
    return quick(short.drop("__n")).unionByName(slow)
