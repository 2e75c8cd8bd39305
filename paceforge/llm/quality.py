"""Quality selection by an ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its score: P(grade > k) = sigmoid(w.x - t_k). Features are the
shares of hashed words, of word shapes (letter case, digits and signs) and of
neighbouring shapes in the whole text. Tasks hash a bounded sample of rated
rows, one task fits the weights, and every row is scored with the broadcast
model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold_remainder, hash_below, map_batches
from .toxicity import PAIR, SKIP, _WordHash

BITS = 17
#: Bytes by class: upper case A, lower case and beyond ASCII a, digits 9, blanks as a blank; signs stand for themselves.
CLASSES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else 32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))


def shapes(raw: bytes) -> list[bytes]:
    """The words of a text as classes, with runs of one class collapsed."""
    kinds = np.frombuffer(raw.translate(CLASSES), np.uint8)
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    return kinds[keep].tobytes().split()


class Features:
    """(text number, feature, share) triples; the shares of each of the three families add up to 1 in a text."""

    def __init__(self, bits: int = BITS):
        self.shift, self.words, self.shapes = np.uint64(64 - bits), _WordHash(), _WordHash()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [(t or "").encode("utf-8") for t in texts]
        docs, features, shares = [], [], []

        def add(doc: np.ndarray, hashed: np.ndarray) -> None:
            docs.append(doc)
            features.append(hashed >> self.shift)
            shares.append(1 / np.bincount(doc, minlength=len(texts))[doc])

        for found, known, salt in (([r.lower().split() for r in raw], self.words, None), ([shapes(r) for r in raw], self.shapes, SKIP)):
            sizes = np.array([len(x) for x in found], np.int64)
            doc = np.repeat(np.arange(len(texts)), sizes)
            h = np.fromiter((y for x in found for y in map(known.__getitem__, (w.decode("utf-8") for w in x))), np.uint64, int(sizes.sum()))
            if salt is None:
                add(doc, h)
                continue
            add(doc, (h ^ h >> np.uint64(29)) * salt)
            same = doc[1:] == doc[:-1]
            add(doc[1:][same], ((h[:-1] * PAIR + h[1:]) * salt)[same])
        return np.concatenate(docs), np.concatenate(features).astype(np.int64), np.concatenate(shares)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ordinal_fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, size: int, epochs: int, rate: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate gradient steps on the likelihood of each grade; thresholds are a first one plus positive gaps."""
    w, seen = np.zeros(size), np.full(size, 1e-8)
    raw, raw_seen = np.concatenate([[-1.0], np.full(max(0, grades - 2), np.log(0.5))]), np.full(grades - 1, 1e-8)

    def thresholds():
        return np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])

    for _ in range(epochs):
        for at, share, grade in rows:
            t = thresholds()
            above = _sigmoid(w[at] @ share - t)  # P(grade > k)
            upper = np.concatenate([[1.0], above])[grade]
            lower = np.concatenate([above, [0.0]])[grade]
            p = max(upper - lower, 1e-9)
            slope = above * (1 - above)
            # d(-log p)/d score, and the same to each threshold
            up = slope[grade - 1] if grade > 0 else 0.0
            down = slope[grade] if grade < grades - 1 else 0.0
            g = -(up - down) / p
            gt = np.zeros(grades - 1)
            if grade > 0:
                gt[grade - 1] += up / p
            if grade < grades - 1:
                gt[grade] -= down / p
            gw = g * share + l2 * w[at]
            seen[at] += gw * gw
            w[at] -= rate * gw / np.sqrt(seen[at])
            tail = np.cumsum(gt[::-1])[::-1]
            gr = np.concatenate([[tail[0]], tail[1:] * np.exp(raw[1:])])
            raw_seen += gr * gr
            raw -= 0.1 * rate * gr / np.sqrt(raw_seen)
    return w, thresholds()


def fit(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = 12_000, epochs: int = 3, rate: float = 0.5, l2: float = 1e-5, bits: int = BITS) -> dict:
    """{features, weights, thresholds} learned from ``ratings`` (doc_id, grade of 0 to grades - 1).

    About ``sample`` rated rows are used, chosen by a hash of their id. Null
    grades teach nothing; of several grades of a document the smallest counts.
    Without ratings all weights are 0.
    """
    known = ratings.where(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").cast("long").alias("grade"))
    share = min(1.0, sample / max(1, known.count()))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(known.where(hash_below(F.col("doc_id"), 5, F.lit(share))), "doc_id")

    def extract():
        features = Features(bits)

        def run(batch):
            at, shares = [], []
            for text in batch.column(1).to_pylist():
                _, f, s = features([text])
                f, inverse = np.unique(f, return_inverse=True)
                at.append(f.astype("<i4").tobytes())
                shares.append(np.bincount(inverse, s, len(f)).astype("<f4").tobytes())
            return [batch.column(0), batch.column(2), at, shares]

        return run

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        data = [(np.frombuffer(a, "<i4"), np.frombuffer(s, "<f4").astype(float), g) for a, s, g in zip(*(table.column(c).to_pylist() for c in ("at", "shares", "grade")))]
        order = np.random.default_rng(0).permutation(len(data))
        w, t = ordinal_fit([data[i] for i in order], grades, 1 << bits, epochs, rate, l2)
        at = np.nonzero(np.abs(w) > 1e-6)[0]
        # thresholds follow the features under negative numbers
        return pa.table({"feature": pa.array([*at.tolist(), *(-1 - k for k in range(grades - 1))], pa.int64()), "weight": pa.array([*w[at].tolist(), *t.tolist()], pa.float64())})

    hashed = map_batches(rows, "doc_id long, grade long, at binary, shares binary", extract)
    found = {r["feature"]: r["weight"] for r in hashed.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "feature long, weight double").collect()}
    features = np.array(sorted(k for k in found if k >= 0), np.int64)
    return {"features": features, "weights": np.array([found[k] for k in features.tolist()], float), "thresholds": np.array([found.get(-1 - k, -1.0 + 0.5 * k) for k in range(grades - 1)])}


def score(docs: DataFrame, model: dict, least: int, threshold: float, bits: int = BITS) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected) of every whole text.

    ``tail_probability`` is that of a grade of at least ``least``; a row is
    selected from ``threshold`` on. Null and empty texts have no features and
    get what the thresholds alone say. Repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = sent.value
        weight = np.zeros(1 << bits)
        weight[known["features"]] = known["weights"]
        features = Features(bits)

        def run(batch):
            texts, expected, tail = batch.column(1).to_pylist(), [], []
            for cut in range(0, len(texts), 256):
                part = texts[cut : cut + 256]
                doc, at, share = features(part)
                total = np.bincount(doc, weight[at] * share, len(part))
                above = _sigmoid(total[:, None] - known["thresholds"])
                expected += above.sum(1).tolist()
                tail += above[:, least - 1].tolist()
            return [batch.column(0), expected, tail, [int(p >= threshold) for p in tail]]

        return run

    return map_batches(docs.select(docs["doc_id"].cast("long"), docs["text"]), "doc_id long, expected_grade double, tail_probability double, selected int", make)


def grades_of(labels: DataFrame) -> DataFrame:
    """Three grades of the label table: 0 poor, 1 sound but toxic, 2 sound; null where quality is null."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("grade"))


def select(docs: DataFrame, labels: DataFrame, held_out_mod: int = 4, held_out_fold: int = 2, least: int = 1, threshold: float = 0.5, **options) -> DataFrame:
    """Learn from rows outside the held-out fold, score all: (doc_id, held_out, expected_grade, tail_probability, selected)."""
    fold = fold_remainder("doc_id", held_out_mod)
    model = fit(docs.where(fold != held_out_fold), grades_of(labels.where(fold != held_out_fold)), 3, **options)
    found = score(docs, model, least, threshold)
    return found.select("doc_id", (fold == held_out_fold).alias("held_out"), "expected_grade", "tail_probability", "selected")
