"""Near copies by SimHash, verified and completed by the exact Jaccard similarity of five-word shingles.

Each shingle set has a SimHash fingerprint. Pairs whose fingerprints differ in at
most ``MAX_BITS`` bits come from the byte-position inverted index of ``simhash``:
entries meet the head of their list, and then hits are counted per pair of
entries that are not yet in one component; pairs with the guaranteed number are
verified on their bits. All candidates are verified on their shingles.

Near copies of 4/5 may differ in more bits than an index can bound, so the pairs
that fingerprints miss are found exactly, too. Under any total order of shingles, two such sets meet within the first n - ceil(4n/5) + 1
shingles of each (prefix filter); only these are listed. Shingles of classes that
few texts have come first, by counts over all texts in a table of fixed size:
that keeps lists short and changes no result. Equal sets are one entry.

A large group of near copies would be compared pair by pair. Each list is
therefore first linked to entries drawn from it, and then only entries that are
not yet in one component meet: pairs within a component change nothing. Parities
of 256 classes of shingles are compared inside the joins, signatures of about a
bit per shingle after them, and texts if they pass; both filters are exact.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, first_of_repeats
from .frames import map_batches, pack, settle, store, unpack
from .simhash import majority, postings

WORDS, SEED = 5, 42
#: Shingles are counted by so many leading bits of their hashes; the counts travel in so many rows.
CELL_BITS, COUNT_ROWS = 20, 64
CELLS = 1 << CELL_BITS
#: Fingerprints are candidates up to so many differing bits; the lists are those of groups of so many positional bytes.
MAX_BITS, GROUP_BYTES = 3, 4
#: To how many of its entries each list, then each longer one, is linked before all that is left meets; any numbers give the same components.
HEADS = (1, 16)
#: Columns of the parities that the joins compare, 64 classes of shingles in each.
PARITIES = ("p1", "p2", "p3", "p4")
#: Sides of up to this many rows are broadcast (a few MB).
BROADCAST_ROWS = 50_000


def shingles(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted: runs of five lower-cased (A-Z) words, or all words if fewer."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(parts) - WORDS + 1)
    pairs = zip((ends - sizes)[:n].tolist(), ends[min(WORDS, len(parts)) - 1 :].tolist())
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in pairs), np.uint64, n))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of at least 4/5; empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def shingle_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """In how many texts a shingle of each of 2^CELL_BITS classes occurs: every text is counted, and the size is fixed."""
    per_row = CELLS // COUNT_ROWS
    schema = pa.schema([("row", pa.int32()), ("part", pa.binary())])

    def run(batches):
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(total, shingles(t) >> np.uint64(64 - CELL_BITS), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_ROWS), pa.int32()), pa.array([pack(r) for r in total.reshape(COUNT_ROWS, per_row)], pa.binary())], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(per_row, np.uint64)
        for part in table["part"]:
            total += unpack(part.as_buffer().to_pybytes(), "<u4")[0]
        return pa.table([table["row"][:1], pa.array([pack(np.minimum(total, 0xFFFFFFFF).astype("<u4"))], pa.binary())], schema=schema)

    found = np.zeros((COUNT_ROWS, per_row), np.uint32)
    for r in docs.select(text_col).mapInArrow(run, "row int, part binary").groupBy("row").applyInArrow(add, "row int, part binary").collect():
        found[r["row"]] = unpack(r["part"], "<u4")[0]
    return found.ravel()


def signature(s: np.ndarray) -> bytes:
    """Of which of at least len(s) classes of shingles (a power of two) the set has an odd number, a bit for each."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def parities(s: np.ndarray) -> np.ndarray:
    """Of which of 64 * len(PARITIES) classes of shingles the set has an odd number, 64 bits to an integer."""
    odd = np.bincount((s & np.uint64(64 * len(PARITIES) - 1)).astype(np.int64), minlength=64 * len(PARITIES)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def can_be_alike(a: bytes, b: bytes, size: int) -> bool:
    """Whether sets of together ``size`` shingles can be alike: each of the at most size / 9 shingles that one of them lacks changes one bit."""
    x, y = (np.frombuffer(v, np.uint8) for v in ((a, b) if len(a) <= len(b) else (b, a)))
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return 9 * int(np.bitwise_count(x ^ folded).sum()) <= size


def prefixes(docs: DataFrame, counts: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_key, node, second, fp, n, keys, sig, p1 to p4, row): two digests, fingerprint, size, prefix, signature and parities of each text's shingle set; one row per input row."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def make():
        from xxhash import xxh64_intdigest

        common = sent.value

        def run(batch):
            nodes, second, prints, sizes, keys, signs, odd = [], [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                rare_first = np.lexsort((s, common[s >> np.uint64(64 - CELL_BITS)]))
                n = len(s)
                nodes.append(xxh64_intdigest(s.tobytes(), SEED))
                second.append(xxh64_intdigest(s.tobytes(), SEED + 1))
                prints.append(majority(s))
                sizes.append(n)
                keys.append(s[rare_first[: n - (4 * n + 4) // 5 + 1]].view(np.int64))
                signs.append(signature(s))
                odd.append(parities(s))
            return [batch.column(0), batch.column(1), np.array(nodes, np.uint64).view(np.int64), np.array(second, np.uint64).view(np.int64), np.array(prints, np.uint64).view(np.int64), sizes, keys, signs, *map(list, zip(*odd))]

        return run

    rows = docs.select(docs[id_col].cast("long"), F.xxhash64(docs[text_col]), docs[text_col])
    schema = "doc_id long, doc_key long, node long, second long, fp long, n int, keys array<long>, sig binary, " + ", ".join(f"{p} long" for p in PARITIES)
    return map_batches(rows, schema, make).withColumn("row", F.monotonically_increasing_id())


def told_apart(marked: DataFrame) -> DataFrame:
    """``marked`` with another ``node`` for sets that differ, by ``second``, from others of the same one."""
    clash = marked.groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low < high").select("node", F.lit(True).alias("clash"))
    if not clash.limit(1).count():
        return marked
    both = marked.join(store(clash), "node", "left")
    return store(both.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "second")).otherwise(F.col("node"))).select(*marked.columns))


def _can_reach(x: str, y: str) -> Column:
    """Whether sets that meet first at this entry can still share enough: their sizes, what follows the entry, and parities.

    Alike sets differ in at most a ninth of their shingles together, and each of these changes one parity.
    """
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differing = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITIES), F.lit(0))
    return (9 * (F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))) >= 4 * (nx + ny)) & (9 * differing <= nx + ny)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, once: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) whose sets are alike. Signatures meet first, so that few texts travel."""

    def sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
        return pairs

    def make_filter():
        def run(batch):
            a, b, x, y, size = (batch.column(i).to_pylist() for i in range(5))
            good = [(p, q) for p, q, v, w, n in zip(a, b, x, y, size) if can_be_alike(v, w, n)]
            return [[p for p, _ in good], [q for _, q in good]]

        return run

    signed = sides(pairs.distinct(), once, "sig", "n").select("a", "b", "a_sig", "b_sig", F.col("a_n") + F.col("b_n"))
    near = store(map_batches(signed, "a long, b long", make_filter))
    if not near.limit(1).count():
        return near
    wanted = store(once.select("node", "doc_key").join(_small(store(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())), "node", "left_semi"))
    found = docs.select(F.xxhash64(text_col).alias("doc_key"), F.col(text_col).alias("text")).join(_small(wanted.select("doc_key")), "doc_key", "left_semi").groupBy("doc_key").agg(F.first("text").alias("text"))
    texts = store(wanted.join(found, "doc_key").select("node", "text"))

    def make():
        def run(batch):
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            sets: dict[int, np.ndarray] = {}
            for node, text in zip(a + b, x + y):
                if node not in sets:
                    sets[node] = shingles(text)
            good = [(p, q) for p, q in zip(a, b) if alike(sets[p], sets[q])]
            return [[p for p, _ in good], [q for _, q in good]]

        return run

    return map_batches(sides(near, texts, "text").select("a", "b", "a_text", "b_text"), "a long, b long", make)


def linked_sets(marked: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, component) of the sets that a chain of pairs of at least 4/5 joins to another."""
    again = store(marked.groupBy("node").agg(F.min("row").alias("only"), F.count("*").alias("n")).where("n > 1").select("node", "only"))
    once = marked.join(_small(again), "node", "left").where("only is null or only = row")  # one row per set
    entries = once.select("node", "n", *PARITIES, F.posexplode("keys").alias("pos", "key"))
    left, prints = _shared(entries), _shared(postings(once.select("node", "fp"), GROUP_BYTES))

    # fingerprints at the heads of their lists, and shingles at theirs
    heads = prints.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("h")).select("key", "h.*")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS
    near = prints.alias("x").join(heads.alias("y"), "key").where((F.col("x.node") > F.col("y.node")) & close).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))
    left = left.withColumn("component", F.col("node"))
    known = store(connected_components(_verified(near.unionByName(_at_heads(left, HEADS[0])), once, docs, text_col)))
    # fingerprints of different components, tallied, and shingles at more heads
    left = _apart(left, known)
    near = tallied_pairs(_apart(prints, known)).unionByName(_at_heads(left, HEADS[1]))
    known = store(connected_components(_stars(known).unionByName(_verified(near, once, docs, text_col))))
    # shingles of different components: what fingerprints have missed
    left = _apart(left, known)
    cross = left.alias("x").join(left.alias("y"), "key").where((F.col("x.component") < F.col("y.component")) & _can_reach("x", "y"))
    more = _verified(cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), once, docs, text_col)
    return settle(connected_components(_stars(known).unionByName(more)))


def tallied_pairs(prints: DataFrame) -> DataFrame:
    """(a, b) of the entries (key, node, fp, component) of different components whose fingerprints differ in at most ``MAX_BITS`` bits: by hits first, then by bits."""
    met = prints.alias("x").join(prints.alias("y"), "key").where("x.component < y.component")
    hits = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.fp").alias("fa"), F.col("y.fp").alias("fb")).agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= comb(8 - MAX_BITS, GROUP_BYTES)).where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= MAX_BITS).select("a", "b")


def _shared(entries: DataFrame) -> DataFrame:
    """The entries (key, node, ...) of the lists that several sets are in."""
    shared = store(entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key"))
    return store(entries.join(_small(shared), "key"))


def _apart(entries: DataFrame, known: DataFrame) -> DataFrame:
    """``entries`` of the lists that hold several components, with their ``component``."""
    placed = entries.drop("component").join(_small(known), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return store(placed.join(mixed, "key", "left_semi"))


def _at_heads(left: DataFrame, n_heads: int) -> DataFrame:
    """(a, b): entries that are not yet in one component with one of the ``n_heads`` entries that their list draws.

    A list draws its own heads, so that a group of near copies is tied together
    through many of its members; short lists draw one only, they meet below anyway.
    """
    drawing = left
    if n_heads > 1:
        drawing = left.join(left.groupBy("key").agg(F.count("*").alias("entries")).where(F.col("entries") > 2 * n_heads).select("key"), "key", "left_semi")
    drawn = [F.min(F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("draw"), "node", "n", "pos", "component", *PARITIES)).alias(f"h{turn}") for turn in range(n_heads)]
    heads = drawing.groupBy("key").agg(*drawn).select("key", F.explode(F.array_distinct(F.transform(F.array(*[f"h{turn}" for turn in range(n_heads)]), lambda h: h.dropFields("draw")))).alias("h")).select("key", "h.*")
    near = left.alias("x").join(heads.alias("y"), "key").where((F.col("x.component") != F.col("y.component")) & _can_reach("x", "y"))
    return near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _stars(known: DataFrame) -> DataFrame:
    """Components that are known, as pairs (a, b)."""
    return known.select(F.col("node").alias("a"), F.col("component").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no near copy with a smaller id reaches, in their own columns.

    Near copies are joined by chains of texts with a Jaccard similarity of at
    least 4/5 over five-word shingles. Null, empty and blank texts are copies of
    each other. Rows without an id stay. Of texts with one id the one with the
    smaller hash goes first; of rows that repeat id and text one stays.
    """
    marked = told_apart(store(prefixes(docs, shingle_counts(docs, text_col), id_col, text_col)))
    component = F.coalesce("component", "node").alias("component")
    placed = marked.join(linked_sets(marked, docs, text_col), "node", "left").select("doc_id", "doc_key", component)
    least = placed.where("doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "doc_key")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = placed.join(_small(store(least)), "component").where(F.struct("doc_id", "doc_key") > F.col("least")).select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__key")).distinct()
    docs = first_of_repeats(docs, marked, id_col, text_col)
    return docs.join(gone, (docs[id_col].cast("long") == F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__key")), "left_anti").select(*docs.columns)
