"""Benchmark decontamination against a broadcast hash set of normalised test n-grams.

The windows of the benchmark are hashed into a set that is broadcast in blocks
of a fixed number of windows, one at a time: a larger benchmark takes more
passes over the documents, whose outcome is stored in between, not more memory.
Each pass rolls over the words of the whole text, looks every window up,
compares the words of a hit with the item's own, and adds the hit words and
items. The documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_batches, store

#: Words after lower-casing A-Z, over UTF-8 bytes: runs without ASCII signs, blanks and controls.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words per window, and benchmark windows per broadcast block (about 400 bytes each in a task).
WINDOW, BLOCK_WINDOWS = 10, 100_000
#: Words whose hash a task remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 300_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8").lower())


def roll(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words (arithmetic modulo 2**64)."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = (out ^ (out >> np.uint64(29))) * _ODD + hashes[k : k + n]
    return out


def item_windows(text: str | None, window: int) -> list[tuple[bytes, ...]]:
    words = words_of(text or "")
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(width, hash, words, item) of every window of (item_id, text), each once; made in tasks."""

    def make():
        hasher = _WordHash()

        def run(batch):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for words in item_windows(text, window):
                    key = int(roll(np.array([hasher[w] for w in words], np.uint64), len(words))[0])
                    rows.append((len(words), key - (1 << 64) if key >> 63 else key, b" ".join(words), item))
                if len(rows) > 10_000:
                    yield [list(c) for c in zip(*rows)]
                    rows = []
            if rows:
                yield [list(c) for c in zip(*rows)]

        return run

    return map_batches(benchmark.select(F.col("item_id").cast("string"), "text"), "width int, hash long, words binary, item string", make).distinct()


def benchmark_blocks(windows: DataFrame, block_windows: int):
    """Yield {width: {hash: {words: [items]}}} for blocks of at most ``block_windows`` windows, read as a stream."""
    block: dict[int, dict[int, dict[bytes, set]]] = {}
    n = 0
    for row in windows.toLocalIterator():
        block.setdefault(row["width"], {}).setdefault(row["hash"] & 0xFFFFFFFFFFFFFFFF, {}).setdefault(bytes(row["words"]), set()).add(row["item"])
        n += 1
        if n >= block_windows:
            yield block
            block, n = {}, 0
    if n:
        yield block


class Matcher:
    """Finds the words of a text that lie in an occurrence of a window of one block."""

    def __init__(self, block: dict):
        self.hash_of = _WordHash()
        self.widths = [(w, found, np.sort(np.fromiter(found, np.uint64, len(found)))) for w, found in sorted(block.items())]

    def __call__(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text: its number of words, the merged hit runs [first, end) of words, and the items found."""
        each = [words_of(t) if t else [] for t in texts]
        sizes = np.array([len(w) for w in each], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flat = [w for words in each for w in words]
        hashes = np.fromiter(map(self.hash_of.__getitem__, flat), np.uint64, len(flat))
        hits: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for width, found, keys in self.widths:
            rolled = roll(hashes, width)
            at = np.searchsorted(keys, rolled)
            at[at == len(keys)] = 0
            for i in np.nonzero(keys[at] == rolled)[0].tolist():
                doc = int(np.searchsorted(starts, i, "right")) - 1
                named = found[int(rolled[i])].get(b" ".join(flat[i : i + width])) if i + width <= starts[doc + 1] else None
                if named is not None:
                    hits[doc].append((i - int(starts[doc]), i - int(starts[doc]) + width))
                    items[doc] |= named - {None}
        return [(int(n), merge(h), i) for n, h, i in zip(sizes, hits, items)]


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text_col: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, *keep, n_words, spans, items), one row per input row.

    ``spans`` are the hit words as merged [first, end) word numbers; ``items``
    are the sorted ids (text) of the items with an occurring window. An item
    of fewer than ``window`` words is one window; one without words has none.
    A null text has no words. Items may repeat; the windows of an item without
    an id are hit like any other, but nothing is named for them.
    Columns other than ``keep`` are not carried.
    """
    rows = docs.select(docs[id_col].cast("long").alias("c0"), *[docs[c].alias(f"c{k}") for k, c in enumerate(keep, 1)], docs[text_col].alias("__text"))
    found = _passes(rows, benchmark.select(F.col(item_col).alias("item_id"), F.col(benchmark_text_col).alias("text")), window, block_windows)
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate((id_col, *keep))], *[F.col(f"__{c}").alias(c) for c in ("n_words", "spans", "items")])


SPANS = "array<struct<first:int,end:int>>"
SPANS_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _passes(rows: DataFrame, benchmark: DataFrame, window: int, block_windows: int, finish=None) -> DataFrame:
    """Add (__n_words, __spans, __items) for the column ``__text``, which is the last of ``rows``; one pass per block.

    With ``finish``, the last pass returns what it makes of (batch, n_words,
    spans): columns like those of ``rows``, with the text as it shall be.
    """
    found = rows.withColumns({"__n_words": F.lit(-1).cast("long"), "__spans": F.array().cast(SPANS), "__items": F.array().cast("array<string>")})
    width = len(rows.columns)
    blocks = benchmark_blocks(store(benchmark_windows(benchmark, window)), block_windows)
    block = next(blocks, {})
    while block is not None:
        following = next(blocks, None)
        sent = rows.sparkSession.sparkContext.broadcast({"block": block})
        ends = following is None and finish is not None

        def make(sent=sent, ends=ends):
            match = Matcher(sent.value["block"])

            def run(batch):
                n, runs, items = [], [], []
                old = zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist())
                texts = batch.column(width - 1).to_pylist()
                for cut in range(0, len(texts), 256):
                    for (size, hit, named), (before, known) in zip(match(texts[cut : cut + 256]), old):
                        n.append(size)
                        runs.append(merge([(x["first"], x["end"]) for x in before] + hit))
                        items.append(sorted(named | set(known)))
                if ends:
                    return finish(batch, n, runs)
                return [*batch.columns[:width], n, pa.array([[{"first": a, "end": b} for a, b in r] for r in runs], SPANS_ARROW), items]

            return run

        found = map_batches(found, T.StructType(found.schema.fields[: width if ends else None]), make)
        if following is not None:
            found = store(found)  # one block is alive at a time
            sent.unpersist()
        block = following
    return found


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = scan(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_spans(text: str, runs: list[tuple[int, int]]) -> str:
    """Cut the hit words, and what stands between words of one run, out of the text."""
    raw = text.encode("utf-8")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, last = [], 0
    for first, end in runs:
        out.append(raw[last : at[first][0]])
        last = at[end - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    drop_share: float = 0.5,
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text_col: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The documents without benchmark passages, in their own columns.

    A document of whose words more than ``drop_share`` are hit goes; of the
    others the hit spans are removed. A text that changes is otherwise kept to
    the byte; null texts stay null.
    """
    others = {c: f"c{k}" for k, c in enumerate(c for c in docs.columns if c != text_col)}
    rows = docs.select(*[docs[c].alias(k) for c, k in others.items()], docs[text_col].alias("__text"))

    def finish(batch, n_words, runs):
        keep = [sum(b - a for a, b in r) <= drop_share * max(n, 0) for n, r in zip(n_words, runs)]
        left = batch.filter(pa.array(keep))
        text = left.column(len(others))
        spans = [r for r, k in zip(runs, keep) if k]
        if any(spans):
            text = pa.array([t if not r else remove_spans(t, r) for t, r in zip(text.to_pylist(), spans)], pa.string())
        return [*left.columns[: len(others)], text]

    cleaned = _passes(rows, benchmark.select(F.col(item_col).alias("item_id"), F.col(benchmark_text_col).alias("text")), window, block_windows, finish)
    return cleaned.select(*[F.col(others.get(c, "__text")).alias(c) for c in docs.columns])
