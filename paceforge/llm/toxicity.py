"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one word
between them of the whole text. Training follows the per-coordinate rates and
L1 shrinkage of FTRL-proximal. Tasks hash the texts of a bounded sample of
labelled rows, one task then learns from their features; a weight stays exactly
zero unless several texts speak for it, so what is broadcast is a short list.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold_remainder, hash_below, map_batches

WORD = re.compile(r"\w+")
BITS = 20
REMEMBERED_WORDS = 300_000
#: Multipliers that set apart words, neighbours and skip pairs.
PAIR, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest(), "little")
        return h


def hashed_features(texts: list[str | None], hash_of: dict, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each occurrence: words, neighbour pairs and pairs one apart."""
    each = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.array([len(w) for w in each], np.int64)
    h = np.fromiter((x for words in each for x in map(hash_of.__getitem__, words)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    shift = np.uint64(64 - bits)
    docs, features = [doc], [h >> shift]
    for gap, times in ((1, PAIR), (2, SKIP)):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        features.append((((h[:-gap] ^ (h[:-gap] >> np.uint64(31))) * times + h[gap:]) * PAIR >> shift)[same])
    return np.concatenate(docs), np.concatenate(features).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], size: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """FTRL-proximal over rows of (distinct features, label); coordinate 0 is the bias and is not shrunk."""
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        sign = np.sign(z[at])
        rate = (beta + np.sqrt(n[at])) / alpha + l2
        return np.where(at == 0, -z[at] / rate, np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - sign * l1) / rate))

    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 12_000,
    epochs: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 0.0,
    bits: int = BITS,
) -> tuple[np.ndarray, np.ndarray]:
    """The nonzero weights (features, values); feature 0 is the bias.

    About ``sample`` labelled rows are used, chosen by a hash of their id;
    rows with a null label teach nothing and a null text is an empty one. When
    a document has several labels, the largest counts.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    few = known.where(hash_below(F.col("doc_id"), 4, F.lit(share)))
    rows = docs.select("doc_id", "text").join(few, "doc_id").select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("long"))

    def extract():
        hash_of = _WordHash()

        def run(batch):
            packed = [np.union1d([0], hashed_features([t], hash_of, bits)[1]).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            return [batch.column(0), batch.column(2), packed]

        return run

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        examples = [(np.frombuffer(x, "<i4").astype(np.int64), y) for x, y in zip(table.column("features").to_pylist(), table.column("toxic").to_pylist())]
        order = np.random.default_rng(0).permutation(len(examples))
        w = ftrl([examples[i] for i in order], 1 << bits, epochs, alpha, beta, l1, l2)
        at = np.nonzero(w)[0]
        return pa.table({"feature": pa.array(at, pa.int64()), "weight": pa.array(w[at], pa.float64())})

    hashed = map_batches(rows, "doc_id long, toxic long, features binary", extract)
    found = hashed.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "feature long, weight double").collect()
    return np.array([r["feature"] for r in found], np.int64), np.array([r["weight"] for r in found], float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every whole text.

    Null and empty texts have the bias as their only feature. Repeated rows
    stay; other columns are not carried.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        features, values = sent.value
        weight = np.zeros(1 << bits)
        weight[features] = values
        bias, weight[0] = weight[0], 0
        hash_of = _WordHash()

        def run(batch):
            texts, out = batch.column(1).to_pylist(), []
            for cut in range(0, len(texts), 256):
                part = texts[cut : cut + 256]
                doc, at = hashed_features(part, hash_of, bits)
                hit = np.nonzero(weight[at])[0]
                pair = np.unique(doc[hit] << bits | at[hit])
                total = bias + np.bincount(pair >> bits, weight[pair & (1 << bits) - 1], len(part))
                out.append(1 / (1 + np.exp(-np.clip(total, -500, 500))))
            p = np.concatenate(out)
            return [batch.column(0), p.tolist(), (p >= threshold).astype("int32").tolist()]

        return run

    return map_batches(docs.select(docs["doc_id"].cast("long"), docs["text"]), "doc_id long, score double, predicted int", make)


def classify(docs: DataFrame, labels: DataFrame, held_out_mod: int = 4, held_out_fold: int = 2, threshold: float = 0.3, **options) -> DataFrame:
    """Learn from rows outside the held-out fold, score all: (doc_id, held_out, score, predicted)."""
    fold = fold_remainder("doc_id", held_out_mod)
    model = fit(docs.where(fold != held_out_fold), labels.where(fold != held_out_fold), **options)
    scored = score(docs, model, threshold=threshold)
    return scored.select("doc_id", (fold == held_out_fold).alias("held_out"), "score", "predicted")
