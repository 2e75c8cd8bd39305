"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of 64 bits has 8 positional bytes. Two that differ in at most two
bits share at least six of them. Lists of one byte would hold 1/256 of all
fingerprints each, and their tallies would grow with the square of the input;
the lists are therefore those of groups of five positional bytes. A pair that
shares six bytes meets in six lists, one that shares five in a single one. Hits
are counted per pair, pairs with the guaranteed number of hits are kept, and
these are verified on their bits. Equal fingerprints are one entry.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import map_batches, settle, store

SEED, SHINGLE_WORDS, MAX_BITS, GROUP_BYTES = 42, 3, 2, 5
#: Keys of lists with several entries are broadcast up to so many (8 bytes each).
BROADCAST_KEYS = 200_000
#: Shingles of one text that are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of the lower-cased (A-Z) words of a text; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for cut in range(0, n, CHUNK):
        some = zip(first[cut : cut + CHUNK], last[cut : cut + CHUNK])
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in some), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: the bits that are set in over half of them; 0 for none."""
    ones = np.zeros(64, np.int64)
    for cut in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[cut : cut + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text, as a signed long; one row per input row."""

    def make():
        def run(batch):
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            return [batch.column(0), values.view(np.int64).tolist()]

        return run

    return map_batches(docs.select(docs[id_col].cast("long"), docs[text_col]), "doc_id long, fp long", make)


def postings(distinct: DataFrame, group: int = GROUP_BYTES) -> DataFrame:
    """``distinct`` with ``key``: an entry of every ``fp`` in the list of each group of ``group`` positional bytes that it has.

    A key is a hash of the positions and the bytes; lists that share a key can only add hits.
    """
    lists = []
    for positions in combinations(range(8), group):
        mask = sum(0xFF << (8 * p) for p in positions)
        mask -= (mask >> 63) << 64
        lists.append(F.xxhash64(F.lit(mask), F.col("fp").bitwiseAND(F.lit(mask))))
    return distinct.select(*distinct.columns, F.explode(F.array(*lists)).alias("key"))


def tallied_pairs(distinct: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP_BYTES) -> DataFrame:
    """(fa, fb), fa < fb, of the distinct ``fp`` values with at least as many common list entries as ``max_bits`` differing bits guarantee.

    Two that share s bytes meet in as many lists as there are groups of
    ``group`` among s; ``max_bits`` bits leave at least 8 - ``max_bits`` bytes.
    """
    listed = postings(distinct, group)
    # a list with one entry makes no pair; partial least and greatest entries tell, no list is gathered
    shared = store(listed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("key"))
    few = shared.count() <= BROADCAST_KEYS
    entries = store(listed.join(F.broadcast(shared) if few else shared, "key", "left_semi"))
    met = entries.select("key", F.col("fp").alias("fa")).join(entries.select("key", F.col("fp").alias("fb")), "key").where("fa < fb")
    return met.groupBy("fa", "fb").agg(F.count("*").alias("hits")).where(F.col("hits") >= comb(8 - max_bits, group)).select("fa", "fb")


def linked_pairs(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fa, fb), fa < fb: all pairs of the distinct ``fp`` values that differ in at most ``max_bits`` bits, verified after the tally."""
    return tallied_pairs(distinct, max_bits).where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    ``component_id`` is the smallest doc_id that can be reached over links of
    at most ``max_bits`` differing bits, the row's own included. Null, empty and
    blank texts have fingerprint 0 and are linked like any other. Rows with a
    null id keep a null id and take part; a component of such rows only has a
    null component_id. Other columns are not carried.
    """
    marked = settle(fingerprints(docs, id_col, text_col))
    own = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    pairs = linked_pairs(own.select("fp"), max_bits)
    linked = connected_components(pairs.select(F.col("fa").alias("a"), F.col("fb").alias("b")))
    chained = linked.join(own, linked["node"] == own["fp"])
    smallest = chained.groupBy("component").agg(F.min("least").alias("smallest"))
    named = linked.join(smallest, "component").select(F.col("node").alias("fp"), "smallest")
    # a fingerprint of one row without links is its own component; only the others meet the rows again, as the side that is not split
    ids = own.join(named, "fp", "left").where("n > 1 or smallest is not null").select("fp", F.coalesce("smallest", "least").alias("component"))
    found = marked.join(ids, "fp", "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))
