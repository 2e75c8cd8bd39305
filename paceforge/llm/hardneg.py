"""Hard-negative mining by exact integer products of quantised vectors.

Rows are dealt into candidate blocks, and the anchors, a stated set of queries,
into anchor blocks; each pair of blocks is one group of a co-grouped map. In it
the candidates' components are biased to be non-negative and packed into
separated fields of one wide integer per dimension. One multiplication per
component of an anchor, and their sum, give the products with all candidates at
once; the fields are wide enough never to meet, so unpacking them is exact.

Positives come first: candidates of the anchor's own label, a few of each block.
Their scores bound the negatives, which a second round looks for among the other
labels. What blocks find is merged by windows over an anchor's few rows.
"""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import store

#: Rows of a block of candidates and of a block of anchors, on average.
BLOCK = 1024
#: Components are multiplied by SCALE and rounded down. Rows with a component beyond LARGEST, or more than MOST components, have no product of 64 bits for sure.
SCALE, LARGEST, MOST = 256, 32768, 8192


class Packed:
    """Candidate vectors (one a row) with each component's column in one wide integer."""

    def __init__(self, rows: np.ndarray, reach: int):
        """``reach``: no anchor's component, once biased, is larger."""
        self.n, self.dims = rows.shape
        self.bias = -min(0, int(rows.min(initial=0)))
        biased = rows + self.bias
        self.width = 4 if self.dims * int(biased.max(initial=0)) * reach < 1 << 32 else 8
        self.kind = f"<u{self.width}"
        self.wide = [int.from_bytes(column.tobytes(), "little") for column in np.ascontiguousarray(biased.T.astype(self.kind))]
        self.sums = rows.sum(axis=1)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The inner products of ``anchor`` with all rows."""
        shift = -min(0, int(anchor.min(initial=0)))
        total = sum(map(mul, self.wide, (anchor + shift).tolist()))
        fields = np.frombuffer(total.to_bytes(self.n * self.width, "little"), self.kind).astype(np.int64)
        return fields - shift * self.sums - self.bias * int(anchor.sum()) - self.dims * self.bias * shift


def matrix(column: pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """List values as rows, shorter ones filled with zeros."""
    whole = column.combine_chunks()
    ends = np.asarray(whole.offsets, np.int64)
    values, sizes = np.asarray(whole.values, np.int64)[ends[0] : ends[-1]], np.diff(ends)
    out = np.zeros((len(sizes), max(dims or 0, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, label: Column | None = None) -> DataFrame:
    """(vec_id, label, q) of the rows that take part."""
    vec = vectors[vec_col]
    sound = vec.isNotNull() & (F.size(vec) <= MOST) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    label = vectors[label_col] if label is None else label
    rows = vectors.where(vectors[id_col].isNotNull() & vectors[label_col].isNotNull() & sound)
    return rows.select(vectors[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("q"))


def _cells(rows: DataFrame, anchors: DataFrame, n_blocks: int, n_anchor_blocks: int):
    """Candidates and anchors, grouped by the pair of their blocks."""
    block = lambda n: F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(block(n_blocks).alias("c"), every(n_anchor_blocks).alias("a"), "vec_id", "label", "q")
    right = anchors.withColumn("a", block(n_anchor_blocks)).withColumn("c", every(n_blocks))
    return left.groupBy("c", "a").cogroup(right.groupBy("c", "a"))


def _sides(candidates: pa.Table, anchors: pa.Table):
    candidates = candidates.sort_by("vec_id")
    q, v = matrix(candidates["q"]), matrix(anchors["q"])
    dims = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (q, v))
    reach = int(v.max(initial=0)) - min(0, int(v.min(initial=0)))
    return np.asarray(candidates["vec_id"]), np.asarray(candidates["label"]), q, v, reach


def _rows(schema: pa.Schema, parts: list[list]) -> pa.Table:
    columns = [np.concatenate([p[i] for p in parts]) if parts else [] for i in range(len(schema))]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _positives(n: int):
    schema = pa.schema([("row", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def find(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        parts: list[list] = []
        if len(candidates) and len(anchors):
            ids, labels, q, v, reach = _sides(candidates, anchors)
            own, names, rows = (np.asarray(anchors[c]) for c in ("label", "vec_id", "row"))
            for label in np.intersect1d(labels, own):
                same = np.flatnonzero(labels == label)
                packed = Packed(q[same], reach)
                for i in np.flatnonzero(own == label):
                    scores, at = packed.scores(v[i]), np.flatnonzero(ids[same] != names[i])
                    if len(at) > n:
                        least = np.partition(scores[at], len(at) - n)[len(at) - n]
                        at = at[scores[at] >= least]
                    at = at[np.argsort(-scores[at], kind="stable")][:n]
                    parts.append([np.full(len(at), rows[i]), ids[same][at], scores[at]])
        return _rows(schema, parts)

    return find


def _negatives(n: int, low: int, high: int):
    schema = pa.schema([(c, pa.int64()) for c in ("anchor_id", "row", "turn", "positive_id", "positive_score", "negative_id", "negative_score")])

    def find(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        parts: list[list] = []
        if len(candidates) and len(anchors):
            ids, labels, q, v, reach = _sides(candidates, anchors)
            packed = Packed(q, reach)
            columns = zip(*(anchors[c].to_pylist() for c in ("vec_id", "label", "row", "positives")))
            for i, (name, own, row, positives) in enumerate(columns):
                # low * positive <= 100 * score <= high * positive, in whole numbers
                bands = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in positives]
                if not any(a <= b for a, b in bands):
                    continue
                scores = packed.scores(v[i])
                at = np.flatnonzero((scores >= min(a for a, _ in bands)) & (scores <= max(b for _, b in bands)))
                at = at[labels[at] != own]
                at = at[np.argsort(-scores[at], kind="stable")]
                found = scores[at]
                for turn, (p, (a, b)) in enumerate(zip(positives, bands)):
                    good = at[(found >= a) & (found <= b)][:n]
                    if len(good):
                        parts.append([*(np.full(len(good), x) for x in (name, row, turn, p["positive_id"], p["positive_score"])), ids[good], scores[good]])
        return _rows(schema, parts)

    return find


def mine(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *, label: Column | None = None, anchors: Column | None = None, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` replaces the label column, ``anchors`` is a condition on vec_id
    and label that tells which rows are anchors (all by default). A score is
    the integer inner product of floor(256 x); higher ones come first, of equal
    ones the smaller vec_id. An anchor's positives are its first
    ``n_positives`` rows of its label with another vec_id. For each, the first
    ``n_negatives`` rows of other labels follow whose score lies within ``low``
    to ``high`` percent of the positive's; pairs without one give no row.

    Rows with a null id, label, vector or component, or one that is not finite
    or beyond +-32768, take no part. Shorter vectors count as filled with
    zeros. Rows that repeat an id are rows of their own. Other columns are not
    read.
    """
    rows = store(quantised(vectors, id_col, vec_col, label_col, label).withColumn("row", F.monotonically_increasing_id()))
    asked = rows if anchors is None else rows.where(anchors)
    n, m = rows.count(), asked.count()
    blocks = -(-max(n, 1) // BLOCK), -(-max(m, 1) // BLOCK)

    best = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    found = _cells(rows, asked, *blocks).applyInArrow(_positives(n_positives), "row long, positive_id long, positive_score long")
    positives = found.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= n_positives).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("turn", "positive_id", "positive_score"))).alias("positives"))
    asked = store(asked.join(positives, "row"))

    first = Window.partitionBy("row", "turn").orderBy(F.desc("negative_score"), "negative_id")
    schema = "anchor_id long, row long, turn long, positive_id long, positive_score long, negative_id long, negative_score long"
    mined = _cells(rows, asked, *blocks).applyInArrow(_negatives(n_negatives, low, high), schema)
    return mined.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """``mine`` with every fiftieth id as anchor and the labels of every seventh id moved on by one."""
    moved = F.when(vectors["vec_id"] % 7 == 0, (vectors["label"] + 1) % 10).otherwise(vectors["label"])
    return mine(vectors, label=moved, anchors=F.col("vec_id") % 50 == 0)
