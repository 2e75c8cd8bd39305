"""Line dedup by a segment-partition edit join.

Two lines are near copies if they differ by at most as many edits as the
shorter one allows (``edits_allowed``: one from 20 characters on, two from 40).
A line that allows tau edits is split into tau + 1 segments; its near copies of
the same or a greater length contain one of them, at a place that the lengths
bound. The index keys of a line are its segments and the probe keys the few
substrings at those places, both as 64-bit hashes of (length, segment number,
content), which come from one table of prefix sums per batch of lines. Nearly
all keys belong to one line only, which an aggregation finds without pairing
anything; the lines of the others are paired, and verified on their texts by a
banded bit-parallel edit distance. Lines carry the parities of their bigram
counts in 128 bits: an edit changes at most four of them, so the join itself
drops pairs that differ in more.

A large group of near copies is not compared pair by pair: each list is first
linked to a few of its lines, and then only lines meet that are not yet in one
component. Pairs within a component would change nothing. A segment that very
many different lines share would still compare them all. If they are not in one
component by then, they are dealt by refined keys: an edit touches at most two
classes of characters, so of 2 tau + 2 classes near copies agree on the whole
subsequence of at least two. All filters are exact, so where a list counts as
long, and which lines it is linked to, changes no result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .frames import map_batches, settle, store

#: (edits allowed, from so many characters on), the longest lines first; shorter lines have only equals.
EDITS = ((2, 40), (1, 20))
MOST_EDITS = EDITS[0][0]
#: A list that holds several components and more different lines than this as index entries is dealt by refined keys.
LONG_LIST = 64
#: To how many of its lines each list is linked before what is left meets.
HEADS = 4
#: Sides of up to this many rows are broadcast (a few MB), and sorted arrays of up to so many keys (4 MB).
BROADCAST_ROWS, BROADCAST_KEYS = 50_000, 500_000
#: What is put before a line for the second half of its identity, which then does not follow from the first.
SALT = "\u0001line:"
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)


def edits_allowed(n_chars: int) -> int:
    return next((tau for tau, least in EDITS if n_chars >= least), 0)


def edits_within(a: str, b: str, k: int) -> bool:
    """Whether a and b differ by at most k edits: k + 1 bit sets of the 2k + 1 diagonals, moved along the band."""
    if abs(len(a) - len(b)) > k:
        return False
    low = _shared_prefix(a, b)
    a, b = a[low:], b[low:]
    high = _shared_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - high], b[: len(b) - high]
    n, band = len(a), 2 * k + 1
    full = (1 << band) - 1
    reach = [((1 << (d + 1)) - 1 << k) & full for d in range(k + 1)]
    for j, c in enumerate(b):
        window = sum(1 << x for x in range(max(0, k - j), band) if j - k + x < n and a[j - k + x] == c)
        new = [reach[0] & window]
        for d in range(1, k + 1):
            new.append(((reach[d] & window) | reach[d - 1] | reach[d - 1] >> 1 | new[d - 1] << 1) & full)
        reach = new
        if not reach[k]:
            return False
    return bool(reach[k] >> (n - len(b) + k) & 1)


def _shared_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def segment(length: np.ndarray, tau: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(start from 0, size) of segment i of lines of these lengths; the longer ones come last."""
    size, longer = length // (tau + 1), length % (tau + 1)
    return size * i + np.maximum(0, i - (tau + 1 - longer)), size + (i >= tau + 1 - longer)


class LineKeys:
    """The keys of many lines at once: a substring's hash is the difference of two sums over code * ODD**place, moved to place 0."""

    def __init__(self):
        self.power, self.back = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 1 << 16)
            self.power, self.back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, k, np.uint64)]), dtype=np.uint64) for k in (_ODD, pow(_ODD, -1, 1 << 64)))

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the line, key, own): substrings where a segment of a line that is no longer can lie.

        The line's own segments are among them; they carry ``own`` = 1 and are
        the index entries.
        """
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self._grow(len(codes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * self.power[: len(codes)], dtype=np.uint64)])
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        begins = np.cumsum(sizes) - sizes
        number, keys, owns = [], [], []
        longer = np.inf
        for tau, least in EDITS:
            for short in range(tau + 1):
                length = sizes - short
                of = np.nonzero((length >= least) & (length < longer))[0]
                for i in range(tau + 1):
                    start, size = segment(length[of], tau, i)
                    salt = (length[of] * (MOST_EDITS + 1) + i).astype(np.uint64) * np.uint64(_ODD)
                    for shift in range(max(-i, short - (tau - i)), min(i, short + (tau - i)) + 1):
                        at = begins[of] + start + shift
                        h = (sums[at + size] - sums[at]) * self.back[at] ^ salt
                        h = (h ^ h >> np.uint64(29)) * _MIX
                        number.append(of)
                        keys.append((h ^ h >> np.uint64(32)).view(np.int64))
                        owns.append(np.full(len(of), int(short == 0 == shift), np.int32))
            longer = least
        return np.concatenate(number), np.concatenate(keys), np.concatenate(owns)


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_key, line_no, line, h1, h2): one row per line of each whole text; a null text has no lines."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("text is not null")
    lines = rows.select("doc_id", F.xxhash64("text").alias("doc_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.concat(F.lit(SALT), "line"))})


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _line_batches(docs: DataFrame, text_col: str, schema: str, emit) -> DataFrame:
    """Run ``emit(keys_of, lines)`` on the different lines, long enough to have near copies, of a few texts at a time."""

    def make():
        keys_of, least = LineKeys(), EDITS[-1][1]

        def run(batch):
            texts = batch.column(0).to_pylist()
            for cut in range(0, len(texts), 100):
                lines = list({line for text in texts[cut : cut + 100] for line in text.split("\n") if len(line) >= least})
                if lines:
                    yield emit(keys_of, lines)

        return run

    return map_batches(docs.where(docs[text_col].isNotNull()).select(text_col), schema, make)


def _first_hash(lines: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(line.encode("utf-8"), 42) for line in lines), np.uint64, len(lines)).view(np.int64)


def _second_hash(lines: list[str]) -> np.ndarray:
    return _first_hash([SALT + line for line in lines])


def _shared_keys(docs: DataFrame, text_col: str) -> DataFrame:
    """The keys of several different lines, at least one of them as its own segment."""

    def emit(keys_of, lines):
        number, keys, own = keys_of(lines)
        return [keys, _first_hash(lines)[number], own]

    keyed = _line_batches(docs, text_col, "key long, h1 long, own int", emit)
    met = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("own").alias("own")).where("low < high and own = 1")
    return store(met.select("key"))


def _lists(docs: DataFrame, text_col: str, shared: DataFrame) -> DataFrame:
    """(key, own, h1, h2, line): the lines of each shared key, each once."""
    once = F.max("own").alias("own")
    if shared.count() <= BROADCAST_KEYS:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["key"] for r in shared.select("key").toLocalIterator()], np.int64)))

        def emit(keys_of, lines):
            number, keys, own = keys_of(lines)
            known = wanted.value
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            met = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            number, keys, own = number[met], keys[met], own[met]
            used, back = np.unique(number, return_inverse=True)
            texts = [lines[k] for k in used.tolist()]
            return [keys, own, _first_hash(texts)[back], _second_hash(texts)[back], [texts[k] for k in back.tolist()]]

        rows = _line_batches(docs, text_col, "key long, own int, h1 long, h2 long, line string", emit)
        return store(rows.groupBy("key", "h1", "h2").agg(once, F.first("line").alias("line")))

    # the texts are shuffled once, not with each key of a line
    def emit_all(keys_of, lines):
        number, keys, own = keys_of(lines)
        return [keys, own, _first_hash(lines)[number], _second_hash(lines)[number]]

    places = store(_line_batches(docs, text_col, "key long, own int, h1 long, h2 long", emit_all).join(shared, "key").groupBy("key", "h1", "h2").agg(once))
    wanted = store(places.select("h1", "h2").distinct())
    lines = docs.select(F.explode(F.split(text_col, "\n", -1)).alias("line")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.concat(F.lit(SALT), "line"))})
    own = store(lines.join(_small(wanted), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line")))
    return store(places.join(own, ["h1", "h2"]))


def bigram_parities(codes: np.ndarray) -> tuple[int, int]:
    """Which of 128 classes of neighbouring characters occur an odd number of times, as two signed longs."""
    pairs = codes[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + codes[1:] * np.uint64(0x85EBCA77)
    odd = np.bincount((pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    low, high = np.packbits(odd.astype(np.uint8)).view(">i8").tolist()
    return low, high


def _entries(rows: DataFrame, refine: bool) -> DataFrame:
    """(key, own, id, n, p1, p2) of (key, own, id, line); refined, each key is joined with the subsequence of each pair of character classes."""

    def make():
        from xxhash import xxh64_intdigest

        groups = list(combinations(range(2 * MOST_EDITS + 2), 2))

        def run(batch):
            out = []
            for key, own, line_id, line in zip(*(batch.column(i).to_pylist() for i in range(4))):
                codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
                parities = bigram_parities(codes)
                if not refine:
                    out.append((key, own, line_id, len(line), *parities))
                    continue
                group = codes % (2 * MOST_EDITS + 2)
                for n, (u, v) in enumerate(groups):
                    h = xxh64_intdigest(codes[(group == u) | (group == v)].tobytes(), (key + n) & 0xFFFFFFFFFFFFFFFF)
                    out.append((_signed(h), own, line_id, len(line), *parities))
            return [list(c) for c in zip(*out)]

        return run

    return map_batches(rows.select("key", "own", "id", "line"), "key long, own int, id string, n int, p1 long, p2 long", make)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if its counted rows are few, else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _can_be_near(x: str, y: str) -> Column:
    """Whether the lengths and bigram parities of two entries allow a link."""
    shorter = F.least(f"{x}.n", f"{y}.n")
    allowed = F.lit(0)
    for tau, least in reversed(EDITS):
        allowed = F.when(shorter >= least, tau).otherwise(allowed)
    changed = F.bit_count(F.col(f"{x}.p1").bitwiseXOR(F.col(f"{y}.p1"))) + F.bit_count(F.col(f"{x}.p2").bitwiseXOR(F.col(f"{y}.p2")))
    return (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) <= allowed) & (changed <= 4 * allowed)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines are near copies; each is compared once."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = once.join(texts.select(F.col("id").alias("a"), F.col("line").alias("a_line")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("b_line")), "b")

    def make():
        def run(batch):
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            good = [edits_within(p, q, edits_allowed(min(len(p), len(q)))) for p, q in zip(x, y)]
            return [[i for i, g in zip(a, good) if g], [i for i, g in zip(b, good) if g]]

        return run

    return map_batches(both.select("a", "b", "a_line", "b_line"), "a string, b string", make)


def _to_heads(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of near copies of each line and one of the ``HEADS`` lines that its list draws."""
    drawn = [F.min(F.struct(F.xxhash64("key", "id", F.lit(turn)).alias("draw"), "id", "n", "p1", "p2")).alias(f"h{turn}") for turn in range(HEADS)]
    heads = F.array_distinct(F.array(*[F.col(f"h{turn}").dropFields("draw") for turn in range(HEADS)]))
    drawn_heads = entries.groupBy("key").agg(*drawn).select("key", F.explode(heads).alias("h")).select("key", "h.*")
    near = entries.alias("x").join(drawn_heads.alias("y"), "key").where((F.col("x.id") != F.col("y.id")) & _can_be_near("x", "y"))
    return _verified(near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), texts)


def _apart(entries: DataFrame, known: DataFrame) -> DataFrame:
    """``entries`` of the lists that hold several components, with their ``component``."""
    placed = store(entries.join(_small(known.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return store(placed.join(mixed, "key", "left_semi"))


def near_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, component): ids of the lines that a chain of near copies joins to another line."""
    rows = _lists(docs, text_col, _shared_keys(docs, text_col)).withColumn("id", _line_id("h1", "h2"))
    entries = store(_entries(rows, False))
    texts = store(rows.groupBy("id").agg(F.first("line").alias("line")))

    known = store(connected_components(_to_heads(entries, texts)))
    left = _apart(entries, known)
    long = store(left.groupBy("key").agg(F.sum("own").alias("owners")).where(F.col("owners") > LONG_LIST).select("key"))
    if long.limit(1).count():
        long = _small(long)
        refined = _entries(left.join(long, "key", "left_semi").join(texts, "id"), True).groupBy("key", "id").agg(F.max("own").alias("own"), *[F.first(c).alias(c) for c in ("n", "p1", "p2")])
        refined = store(refined)
        known = store(connected_components(_stars(known).unionByName(_to_heads(refined, texts))))
        left = _apart(left.join(long, "key", "left_anti").drop("component").unionByName(refined), known)
    cross = left.where("own = 1").alias("x").join(left.alias("y"), "key").where((F.col("x.component") != F.col("y.component")) & _can_be_near("x", "y"))
    more = _verified(cross.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), texts)
    return settle(connected_components(_stars(known).unionByName(more)))


def _stars(known: DataFrame) -> DataFrame:
    """Components that are known, as pairs (a, b)."""
    return known.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _line_id(h1: str, h2: str) -> Column:
    return F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_key, line_no, line_class) of every line that is not the first of its class.

    A class holds equal lines and those that a chain of near copies joins
    (``edits_allowed``); lines under 20 characters are in a class with their
    equals only. The first is that with the smallest document id (a null id
    comes before all), then the smallest text hash, then the smallest line
    number. Rows that repeat both id and text are one document.
    """
    places = store(split_lines(docs, id_col, text_col).select("doc_id", "doc_key", "line_no", "h1", "h2"))
    equal = store(places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "doc_key", "line_no")).alias("first"), F.count("*").alias("n")).withColumn("node", _line_id("h1", "h2")))
    linked = near_lines(docs.select(docs[text_col].alias("text")))
    members = equal.join(linked, "node")
    heads = members.groupBy("component").agg(F.min("first").alias("head"))
    moved = members.join(heads, "component").select("h1", "h2", F.col("component").alias("line_class"), "head")
    alone = equal.where("n > 1").join(linked, "node", "left_anti").select("h1", "h2", F.col("node").alias("line_class"), F.col("first").alias("head"))
    classes = store(alone.unionByName(moved))
    met = places.join(_small(classes), ["h1", "h2"])
    return met.where(~F.struct("doc_id", "doc_key", "line_no").eqNullSafe(F.col("head"))).select("doc_id", "doc_key", "line_no", "line_class").distinct()


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_repeated, repeated_lines, classes_sha256), one row per input row.

    ``repeated_lines`` are the numbers (from 0) of the lines that are not the
    first of their class, comma-joined; ``classes_sha256`` digests their
    classes in that order. A null text has no lines, an empty one has one.
    """
    found = repeated_lines(docs, id_col, text_col)
    by_doc = found.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_list(F.struct("line_no", "line_class"))).alias("gone"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("doc_key"), F.when(docs[text_col].isNull(), 0).otherwise(F.size(F.split(docs[text_col], "\n", -1))).cast("long").alias("n_lines"))
    joined = rows.alias("r").join(by_doc.alias("g"), F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.doc_key") == F.col("g.doc_key")), "left")
    return joined.select(
        "r.doc_id",
        "n_lines",
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce(F.array_join(F.transform("gone", lambda x: x["line_no"].cast("string")), ","), F.lit("")).alias("repeated_lines"),
        F.sha2(F.coalesce(F.array_join(F.transform("gone", lambda x: x["line_class"]), ","), F.lit("")).cast("binary"), 256).alias("classes_sha256"),
    )


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts without the lines of these numbers; null where there are none."""
    out = []
    for t, numbers in zip(text, gone):
        if numbers is None:
            out.append(None)
        else:
            drop = set(numbers.tolist())
            out.append("\n".join(line for n, line in enumerate(t.split("\n")) if n not in drop))
    return pd.Series(out, dtype=object)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that repeat an earlier one, in their own columns.

    No document goes; one whose every line repeats keeps an empty text. Null
    texts stay null.
    """
    found = repeated_lines(docs, id_col, text_col)
    by_doc = found.groupBy("doc_id", "doc_key").agg(F.collect_list("line_no").alias("gone")).select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key"), F.col("gone").alias("__gone"))
    joined = docs.join(by_doc, docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__key")), "left")
    left = _without(F.when(F.col("__gone").isNotNull(), docs[text_col]), F.col("__gone"))
    return joined.select(*[F.when(F.col("__gone").isNotNull(), left).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])
