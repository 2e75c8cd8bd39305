"""Connected components of a pair list: trees inside tasks, then alternating star contraction.

Each task first joins its own pairs to trees, with the smallest node as root. A
list that one task holds is done then, which spares short lists the rounds and
the driver their many plans. Longer ones go on with what the trees have left:
every round is two shuffles over the pairs; hot nodes are reduced by partial
aggregation (a smallest neighbour per node), never gathered into a group. The
rounds end when each component is a star around its smallest node; only whether
that is so reaches the driver. Each round is a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import _arrow, settle

#: Pairs for each task: a short list is not dealt over all partitions of the session. A task holds trees of up to twice as many nodes at a time.
PAIRS_PER_TASK = 100_000


def first_of_repeats(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one of the rows that repeat both an id and a text; ``marked`` has (doc_id, doc_key) of every row. Rows without an id stay."""
    repeated = marked.where("doc_id is not null").groupBy("doc_id", "doc_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key"))
    if not repeated.limit(1).count():
        return docs
    repeated = settle(repeated)
    same = (docs[id_col].cast("long") == F.col("__id")) & F.xxhash64(docs[text_col]).eqNullSafe(F.col("__key"))
    once = docs.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col])
    return docs.join(repeated, same, "left_anti").unionByName(once)


def _joined_in_tasks(pairs: DataFrame) -> DataFrame:
    """(node, least): each node of ``pairs`` with the smallest one that the pairs of its task join it to, roots with themselves.

    A task that meets more nodes than it may hold begins anew, so a node can have several rows.
    """
    kind, most = pairs.schema["a"].dataType, 2 * PAIRS_PER_TASK
    schema = pa.schema([("node", _arrow(kind)), ("least", _arrow(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(n):
            while above[n] != n:
                above[n] = n = above[above[n]]
            return n

        def trees() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(above), schema.field(0).type), pa.array([root(n) for n in above], schema.field(1).type)], schema=schema)

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = sorted((root(above.setdefault(a, a)), root(above.setdefault(b, b))))
                above[high] = low
            if len(above) > most:
                yield trees()
                above.clear()
        if above:
            yield trees()

    name = kind.simpleString()
    return pairs.select("a", "b").mapInArrow(run, f"node {name}, least {name}")


def connected_components(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``pairs`` (columns a, b, long).

    ``component`` is the smallest node that can be reached. Pairs may repeat,
    in either order; a pair of a node with itself only names the node. Rows
    with a null end are ignored. An empty table gives an empty table.
    """
    nodes = settle(pairs.where("a is not null and b is not null").select("a", "b").distinct())  # how they came about may be long, and is not done twice
    tasks = 1 + nodes.count() // PAIRS_PER_TASK
    trees = _joined_in_tasks(nodes.coalesce(tasks))
    if tasks == 1:  # fewer pairs than a task may hold: no node has two rows
        return trees.select("node", F.col("least").alias("component"))
    trees = settle(trees)
    # invariants: hi > lo; every hi points at some smaller node of its component
    edges = settle(trees.where("node <> least").select(F.col("node").alias("hi"), F.col("least").alias("lo")).distinct())
    all_nodes = trees.select("node").distinct()
    few = lambda df: df.coalesce(tasks)
    for _ in range(max_rounds):
        tasks = 1 + edges.count() // PAIRS_PER_TASK
        edges = few(edges)
        # large star: each node hands its larger neighbours to the smallest node among itself and its neighbours
        least = few(edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(edges.select(F.col("lo").alias("n"), F.col("lo").alias("m")))).groupBy("n").agg(F.min("m").alias("m"))
        large = edges.join(least, edges["lo"] == least["n"]).select("hi", F.col("m").alias("lo"))
        own = least.where("n <> m").select(F.col("n").alias("hi"), F.col("m").alias("lo"))
        stars = few(large.unionByName(own)).distinct()
        # small star: each node sends all its smaller neighbours, and itself, to the smallest of them
        lowest = few(stars).groupBy("hi").agg(F.min("lo").alias("m"))
        small = few(stars).join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = settle(few(few(small.unionByName(lowest.select("hi", F.col("m").alias("lo")))).distinct()))
        centres = few(edges.select(F.col("lo").alias("hi")).distinct())
        chained = edges.join(centres, "hi", "left_semi").select("hi")
        if not few(chained.unionByName(edges.groupBy("hi").count().where("count > 1").select("hi"))).limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return all_nodes.join(few(edges.groupBy("hi").agg(F.min("lo").alias("component"))), F.col("node") == F.col("hi"), "left").select("node", F.coalesce("component", "node").alias("component"))
