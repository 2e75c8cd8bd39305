"""Hierarchical Pitman-Yor language model over context restaurants.

A token sits in the restaurant of its context: of the token before it where that
is one of the most frequent words, else of the class of that word's ending. All
context restaurants share one parent, the restaurant of all words, whose base is
uniform over the training vocabulary and one unknown word. A table of a context
restaurant is a customer of the parent.

Seating is sampled by blocked Gibbs. Given an auxiliary gamma variable of a
restaurant, the table counts of its dishes are independent, and a dish with c
customers has t tables with a weight of S(c, t) a^t, where S are generalised
Stirling numbers. Only dishes with two customers or more have anything to
sample. For over ``EXACT`` customers the same conditional is drawn through its
saddle point. Discounts come from counts of counts of the whole corpus.

Counts of (word, context) are dealt over shards by word, so that a word's own
restaurant and its place in the parent are local to one task; words that fill
more than 1/2000 of the corpus are dealt by (word, context), and only their
sums are shared. What crosses shards in a sweep are sums by context: a bounded
list. Tasks count tokens by sorted chunks; a chunk's list of documents travels
with its counts, so that scores return as sums by document and no text is
shuffled. Samples are not stored: their seeds are, and the scoring job draws
them again and weighs them with the sums of all shards. Predictive
probabilities are averaged over the samples. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold_remainder, map_batches, pack, store, unpack

#: Contexts of their own for so many words, and classes of endings for all others.
CONTEXT_WORDS, ENDINGS, ENDING_BYTES = 12_288, 4096, 3
CONTEXTS = CONTEXT_WORDS + ENDINGS
#: A context of its own has at least this share of all tokens.
CONTEXT_SHARE = 1e-6
#: A word with a larger share of all tokens than this is dealt by (word, context); there are fewer than its inverse.
HOT_SHARE = 1 / 2000
#: Tokens and documents of a chunk that a task sorts at once, and bytes of text for each shard.
CHUNK_TOKENS, CHUNK_DOCS, SHARD_BYTES = 2_000_000, 65_000, 24 << 20
#: Concentrations of the parent and of the context restaurants; sweeps before sums are first taken, and before and of the samples.
PARENT_STRENGTH, STRENGTH, FIRST_SWEEPS, BURN_IN, SAMPLES, SEED = 10.0, 5.0, 3, 2, 3, 13
#: Dishes with up to so many customers are drawn from exact weights.
EXACT = 64
#: What the end of a text is known by: the hash of the empty word.
END = np.uint64(0xEF46DB3751D8E999)
CHUNK_PARTS = ("<u8", "<u4", "<u2", "<u4", "<u4", "<u2", "<u4")


def words_of(text: bytes) -> list[bytes]:
    """Runs between blanks (bytes 9 to 13 and 32), A-Z lower-cased."""
    return text.lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mixed(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """A key of (word, context)."""
    x = words ^ (contexts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def places(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted table, and which of them are in it."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


@dataclass
class Vocabulary:
    """Sorted hashes of the words that are contexts of their own and of the hot ones, with what all training tokens come to."""

    contexts: np.ndarray
    hot: np.ndarray
    hot_counts: np.ndarray
    tokens: int
    types: int

    def dish_keys(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """What deals a dish to a shard: its word, for a hot word the word and its context."""
        return np.where(places(words, self.hot)[1], mixed(words, contexts), words)

    def contexts_of(self, hashed: np.ndarray, words: list[bytes]) -> np.ndarray:
        """The context that each token is for the next one (``words`` has no end of text)."""
        at, known = places(hashed, self.contexts)
        endings = hashes([words[i][-ENDING_BYTES:] for i in np.flatnonzero(~known).tolist()])
        at[~known] = CONTEXT_WORDS + (endings % np.uint64(ENDINGS)).astype(np.int64)
        return at


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts over all training documents of ``docs`` (text, train)."""

    def make():
        def run(batch):
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            found = [hashes(words_of(t or b"")) for t in texts]
            keys, n = np.unique(np.concatenate([*found, np.full(len(texts), END)]), return_counts=True)
            return [keys.view(np.int64), n]

        return run

    counts = store(map_batches(docs.where("train").select("text"), "w long, n long", make).groupBy("w").agg(F.sum("n").alias("n")))
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # every task sends its first words to the driver: all together there are at most 1 / CONTEXT_SHARE
    top = counts.where(F.col("n") >= tokens * CONTEXT_SHARE).orderBy(F.desc("n"), "w").limit(CONTEXT_WORDS - 1).collect()
    hashed = np.array([r["w"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], np.int64)
    hot = n > tokens * HOT_SHARE
    order = np.argsort(hashed[hot])
    return Vocabulary(np.unique(np.append(hashed, END)), hashed[hot][order], n[hot][order], tokens, types)


def _chunk(texts: list[bytes], train: np.ndarray, vocab: Vocabulary, n_shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed counts and documents) of a chunk."""
    ws, ks, docs = [], [], []
    end = np.array([places(np.array([END]), vocab.contexts)[0][0]])
    for i, text in enumerate(texts):
        words = words_of(text)
        hashed = hashes(words)
        ws += [hashed, np.array([END])]
        ks += [end, vocab.contexts_of(hashed, words)]
        docs.append(len(words) + 1)
    w, k = np.concatenate(ws), np.concatenate(ks).astype(np.uint64)
    rest = k << np.uint64(16) | np.repeat(np.arange(len(texts), dtype=np.uint64), docs)
    key = vocab.dish_keys(w, k)
    order = np.lexsort((rest, key))
    key, rest, w = key[order], rest[order], w[order]
    at = runs(key, rest)
    n = np.diff(np.append(at, len(key)))
    key, rest, w = key[at], rest[at], w[at]
    k, doc = (rest >> np.uint64(16)).astype(np.uint16), (rest & np.uint64(0xFFFF)).astype(np.uint16)
    dish = runs(key, k)
    known = np.add.reduceat(n * train[doc], dish)
    per_dish = np.diff(np.append(dish, len(key)))
    key, k, w = key[dish], k[dish], w[dish]
    shard = ((key >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
    ends, docs_end = np.searchsorted(shard, np.arange(n_shards + 1)), np.append(dish, len(doc))
    for s in np.unique(shard).tolist():
        a, b = ends[s], ends[s + 1]
        x, y = docs_end[a], docs_end[b]
        group = runs(key[a:b])
        sizes = np.diff(np.append(group, b - a))
        yield s, pack(w[a:b][group], sizes.astype("<u4"), k[a:b], known[a:b].astype("<u4"), per_dish[a:b].astype("<u4"), doc[x:y], n[x:y].astype("<u4"))


CHUNKED = "shard long, chunk long, part binary, ids array<long>, held array<boolean>, lengths array<long>"
MERGED = "shard long, dishes binary, entries binary, chunks array<long>, sizes array<int>, docs array<int>, chunk long, ids array<long>, held array<boolean>, lengths array<long>"


def chunks(docs: DataFrame, vocab: Vocabulary, n_shards: int) -> DataFrame:
    """Counts of every chunk by shard, and one row (shard below 0) with its documents."""
    schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("part", pa.binary()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, train, size, seq = [], [], [], 0, 0

        def full() -> Iterator[pa.RecordBatch]:
            chunk = (partition << 24) | seq
            for shard, part in _chunk(texts, np.array(train, bool), vocab, n_shards):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((shard, chunk, part, None, None, None), schema)], schema=schema)
            lengths = [len(words_of(t)) + 1 for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((-1 - chunk, chunk, None, ids, [not t for t in train], lengths), schema)], schema=schema)

        for batch in batches:
            partition = batch.column(3)[0].as_py() if batch.num_rows else 0
            for i, text, learn in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                ids.append(i)
                texts.append(text or b"")
                train.append(learn)
                size += len(texts[-1])
                if size >= CHUNK_TOKENS * 6 or len(texts) >= CHUNK_DOCS:
                    yield from full()
                    ids, texts, train, size, seq = [], [], [], 0, seq + 1
        if texts:
            yield from full()

    return docs.select("doc_id", "text", "train", F.spark_partition_id().alias("p")).mapInArrow(run, CHUNKED)


def merge(chunked: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One row for each shard: its dishes (word, context, customers), and the chunks' entries as places among them."""
    schema = pa.schema([("shard", pa.int64()), ("dishes", pa.binary()), ("entries", pa.binary()), ("chunks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        table = table.sort_by("chunk")
        none = [None] * len(table)
        if shard < 0:
            columns = [table["shard"], none, none, none, none, none, table["chunk"], table["ids"], table["held"], table["lengths"]]
            return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        w, k, known, per_dish, doc, n = ([] for _ in range(6))
        sizes, widths = [], []
        for part in table["part"]:
            words, counts, *rest = unpack(part.as_buffer().to_pybytes(), *CHUNK_PARTS)
            w.append(np.repeat(words, counts))
            for have, more in zip((k, known, per_dish, doc, n), rest):
                have.append(more)
            sizes.append(len(rest[0]))
            widths.append(int(rest[3].max(initial=0)) + 1)
        w, k, known, per_dish, doc, n = map(np.concatenate, (w, k, known, per_dish, doc, n))
        key = vocab.dish_keys(w, k)
        order = np.lexsort((k, key))
        dish = runs(key[order], k[order])
        place = np.empty(len(w), np.uint32)
        place[order] = np.repeat(np.arange(len(dish), dtype=np.uint32), np.diff(np.append(dish, len(w))))
        customers = np.add.reduceat(known[order].astype(np.uint64), dish)
        first = order[dish]
        group = runs(key[first])
        dishes = pack(w[first][group], np.diff(np.append(group, len(first))).astype("<u4"), k[first], customers)
        values = [shard, dishes, pack(place, per_dish, doc, n), table["chunk"].to_pylist(), sizes, widths, None, None, None, None]
        return pa.table([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    return chunked.groupBy("shard").applyInArrow(run, MERGED)


def stirling(discount: float, most: int) -> list[np.ndarray]:
    """Logarithms of S(c, t) for t = 1 to c, by c up to ``most``."""
    rows = [np.empty(0), np.zeros(1)]
    for c in range(1, most):
        stay = np.full(c + 1, -np.inf)
        with np.errstate(divide="ignore"):
            stay[:c] = rows[c] + np.log(c - discount * np.arange(1, c + 1))
        rows.append(np.logaddexp(stay, np.concatenate([[-np.inf], rows[c]])))
    return rows


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, table: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """A number of tables for each dish, given its customers and the weight of a new table."""
    out = np.ones(len(customers), np.int64)
    with np.errstate(divide="ignore"):
        logs = np.log(np.maximum(weight, 1e-300))
    for c in np.unique(customers[(customers > 1) & (customers <= EXACT)]).tolist():
        rows = np.flatnonzero(customers == c)
        for at in np.array_split(rows, -(-len(rows) * c // 2_000_000)):
            p = table[c] + logs[at][:, None] * np.arange(1, c + 1)
            p = np.exp(p - p.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[at] = 1 + (p < rng.random(len(at))[:, None] * p[:, -1:]).sum(axis=1)
    large = np.flatnonzero(customers > EXACT)
    if len(large):
        # tables come as a Poisson process with sizes of a known law; tilted until the customers are met on average
        c, a = customers[large].astype(float), np.maximum(weight[large], 1e-300)
        low, high = np.full(len(c), -745.0), np.full(len(c), 745.0)
        for _ in range(60):  # z is the logistic of x
            x = (low + high) / 2
            above = np.log(a) - np.logaddexp(0, -x) + (1 - discount) * np.logaddexp(0, x) > np.log(c)
            low, high = np.where(above, low, x), np.where(above, x, high)
        z, rest = np.exp(-np.logaddexp(0, -x)), np.exp(-np.logaddexp(0, x))
        mean = a * -np.expm1(discount * np.log(np.maximum(rest, 1e-300))) / discount
        second = c * (1 + (1 - discount) * z / np.maximum(rest, 1e-300))
        spread = np.sqrt(np.maximum(mean - c * c / second, 0))
        mean = mean + z * (1 - discount) / (2 * (1 - discount * z) ** 2)  # the saddle point's own width counts for about one table
        out[large] = np.clip(np.rint(mean + spread * rng.standard_normal(len(c))), 1, customers[large])
    return out


@dataclass
class State:
    """What all shards share in a round of sweeps."""

    discount: float = 0.5
    parent_discount: float = 0.5
    #: By sweep and context: the gamma variable of the restaurant.
    gammas: np.ndarray = field(default_factory=lambda: np.zeros((0, CONTEXTS)))
    #: The parent's customers and tables, and those of the hot words.
    customers: float = 0.0
    tables: float = 0.0
    hot_customers: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_tables: np.ndarray = field(default_factory=lambda: np.zeros(0))
    round: int = 0


class Shard:
    """The dishes of a shard and their seating, at first one table each."""

    def __init__(self, number: int, dishes: bytes, vocab: Vocabulary):
        self.words, sizes, self.k, customers = unpack(dishes, "<u8", "<u4", "<u2", "<u8")
        self.number, self.vocab = number, vocab
        self.c = customers.astype(np.int64)
        self.group = np.repeat(np.arange(len(self.words)), sizes)
        self.begin = np.cumsum(sizes, dtype=np.int64) - sizes
        self.hot_place, self.hot = places(self.words, vocab.hot)
        self.t = np.minimum(self.c, 1)
        self.seated()
        self.root = np.minimum(self.parent, 1)

    def seated(self) -> None:
        """Customers that the context restaurants send to the parent, by word."""
        self.parent = np.add.reduceat(self.t, self.begin)

    def sweeps(self, state: State) -> Iterator[None]:
        rng = np.random.default_rng([SEED, state.round, self.number])
        lower, upper = stirling(state.discount, EXACT), stirling(state.parent_discount, EXACT)
        some = np.flatnonzero(self.c > 1)
        group = self.group[some]
        hot, place = self.hot[group], self.hot_place[group]
        new = (PARENT_STRENGTH + state.parent_discount * state.tables) / (self.vocab.types + 1)
        shared = np.flatnonzero(~self.hot & (self.parent > 1))
        for gamma in state.gammas:
            others, tables = self.parent[group] - self.t[some], self.root[group]
            if hot.any():
                others = np.where(hot, np.maximum(state.hot_customers[place] - self.t[some], 0), others)
                tables = np.where(hot, state.hot_tables[place], tables)
            tables = np.minimum(tables, others)
            p = (others - state.parent_discount * tables + new) / (PARENT_STRENGTH + state.customers)
            self.t[some] = draw_tables(self.c[some], state.discount * gamma[self.k[some]] * p, state.discount, lower, rng)
            self.seated()
            self.root[shared] = draw_tables(self.parent[shared], np.full(len(shared), new), state.parent_discount, upper, rng)
            yield


def _sums(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables by context, customers of hot words in the parent, and (customers, tables) of the others there."""
    hot = np.bincount(shard.hot_place[shard.hot], shard.parent[shard.hot], len(shard.vocab.hot))
    cold = ~shard.hot
    return np.bincount(shard.k, shard.t, CONTEXTS), hot, np.array([shard.parent[cold].sum(), shard.root[cold].sum()])


def _gathered(model: DataFrame, width: int, make) -> np.ndarray:
    """The sum over all shards of an array of ``width`` columns that ``make`` draws from a shard: a bounded number of rows."""
    names = [f"v{i}" for i in range(width)]

    def start():
        def run(batch):
            total = sum(make(s, d) for s, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            some = np.flatnonzero(total.any(axis=1))
            return [some, *total[some].astype(np.int64).T]

        return run

    rows = map_batches(model.where("shard >= 0").select("shard", "dishes"), "id long, " + ", ".join(f"{v} long" for v in names), start)
    found = rows.groupBy("id").agg(*[F.sum(v).alias(v) for v in names]).collect()
    return {r["id"]: [r[v] for v in names] for r in found}


def _table(found: dict[int, list[int]], n: int, width: int) -> np.ndarray:
    out = np.zeros((n, width))
    for i, values in found.items():
        out[i] = values
    return out


def counts_of_counts(model: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, State]:
    """Customers of each context, its dishes, and the first state."""
    n_hot = len(vocab.hot)

    def make(number: int, dishes: bytes) -> np.ndarray:
        s = Shard(number, dishes, vocab)
        tables, hot, rest = _sums(s)
        out = np.zeros((CONTEXTS + n_hot + 1, 4))
        out[:CONTEXTS, 0], out[:CONTEXTS, 1] = np.bincount(s.k, s.c, CONTEXTS), tables
        out[CONTEXTS:-1, 0] = hot
        out[-1, :2] = rest
        out[-1, 2:] = [(s.c == 1).sum(), (s.c == 2).sum()]
        out[0, 2:] = [(s.parent[~s.hot] == 1).sum(), (s.parent[~s.hot] == 2).sum()]
        return out

    found = _table(_gathered(model, 4, make), CONTEXTS + n_hot + 1, 4)
    rate = lambda a, b: float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95))
    hot = found[CONTEXTS:-1, 0]
    state = State(discount=rate(*found[-1, 2:]), parent_discount=rate(*found[0, 2:]), customers=found[-1, 0] + hot.sum(), tables=found[-1, 1] + (hot > 0).sum(), hot_customers=hot, hot_tables=np.minimum(hot, 1))
    return found[:CONTEXTS, 0], found[:CONTEXTS, 1], state


def _after(state: State, sums: np.ndarray, vocab: Vocabulary, sample: int) -> tuple[np.ndarray, State]:
    """Tables by context, and the state of the parent after a sample."""
    hot, (customers, tables) = sums[CONTEXTS:-2], sums[-2:]
    rng = np.random.default_rng([SEED, 1000 + state.round, sample])
    new = (PARENT_STRENGTH + state.parent_discount * state.tables) / (vocab.types + 1)
    drawn = np.where(hot > 0, draw_tables(hot.astype(np.int64), np.full(len(hot), new), state.parent_discount, stirling(state.parent_discount, EXACT), rng), 0)
    after = State(state.discount, state.parent_discount, customers=customers + hot.sum(), tables=tables + drawn.sum(), hot_customers=hot, hot_tables=drawn, round=state.round + 1)
    return sums[:CONTEXTS], after


def _with_gammas(state: State, tables: np.ndarray, n: int) -> State:
    rng = np.random.default_rng([SEED, 2000 + state.round])
    state.gammas = rng.gamma(STRENGTH / state.discount + tables, size=(n, CONTEXTS))
    return state


def sampled(model: DataFrame, vocab: Vocabulary, state: State, keep: int) -> np.ndarray:
    """The sums of the last ``keep`` sweeps of a round, one column each."""

    def make(number: int, dishes: bytes) -> np.ndarray:
        s = Shard(number, dishes, vocab)
        return np.stack([np.concatenate(_sums(s)) for _ in s.sweeps(state)][-keep:], axis=1)

    n = CONTEXTS + len(vocab.hot) + 2
    return _table(_gathered(model, keep, make), n, keep)


def log_probabilities(shard: Shard, state: State, seen: np.ndarray, samples: list[tuple[np.ndarray, State]]) -> np.ndarray:
    """log10 of the predictive probability of each dish, averaged over the samples."""
    total = np.zeros(len(shard.c))
    skip = len(state.gammas) - len(samples)
    for i, _ in enumerate(shard.sweeps(state)):
        if i < skip:
            continue
        tables, after = samples[i - skip]
        new = (PARENT_STRENGTH + after.parent_discount * after.tables) / (shard.vocab.types + 1)
        customers, root = shard.parent.astype(float), shard.root.astype(float)
        customers[shard.hot] = after.hot_customers[shard.hot_place[shard.hot]]
        root[shard.hot] = after.hot_tables[shard.hot_place[shard.hot]]
        parent = (customers - after.parent_discount * root + new) / (PARENT_STRENGTH + after.customers)
        rest = STRENGTH + after.discount * tables[shard.k]
        total += (shard.c - after.discount * shard.t + rest * parent[shard.group]) / (STRENGTH + seen[shard.k])
    return np.log10(total / len(samples))


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``train`` is a condition that tells which rows are learned from; null is
    not. Tokens are the lower-cased (A-Z) runs between blanks and an end of
    text; a null or blank text is its end alone. ``base_score`` is the log10
    probability under add-one counts of single tokens, ``score`` that of the
    model. Rows that repeat are counted and scored each. With nothing to learn
    from, all words are unknown. Other columns are not read.
    """
    spark = docs.sparkSession
    read = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    vocab = vocabulary(read)
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    model = store(merge(chunks(read, vocab, n_shards), vocab))

    seen, tables, state = counts_of_counts(model, vocab)
    state = _with_gammas(state, tables, FIRST_SWEEPS)
    tables, state = _after(state, sampled(model, vocab, state, 1)[:, 0], vocab, 0)
    state = _with_gammas(state, tables, BURN_IN + SAMPLES)
    samples = [_after(state, sums, vocab, i) for i, sums in enumerate(sampled(model, vocab, state, SAMPLES).T)]
    # by value, as executors need not have this package
    sent = spark.sparkContext.broadcast(cloudpickle.dumps((vocab, state, seen, samples)))

    def make():
        vocab, state, seen, samples = pickle.loads(sent.value)

        def run(batch):
            for number, dishes, entries, names, sizes, widths in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(number, dishes, vocab)
                log_p = log_probabilities(shard, state, seen, samples)
                counts = np.add.reduceat(shard.c, shard.begin)
                counts[shard.hot] = vocab.hot_counts[shard.hot_place[shard.hot]]
                base = np.log10((counts + 1) / (vocab.tokens + vocab.types + 1))[shard.group]
                known = (counts > 0)[shard.group]
                place, per_dish, doc, n = unpack(entries, "<u4", "<u4", "<u2", "<u4")
                dish = np.repeat(place, per_dish)
                ends = np.append(0, np.cumsum(per_dish, dtype=np.int64))
                at = np.append(0, np.cumsum(sizes))
                for i, (name, width) in enumerate(zip(names, widths)):
                    x, y = ends[at[i]], ends[at[i + 1]]
                    d, who, often = dish[x:y], doc[x:y], n[x:y]
                    # only documents with a token here: their sums grow with the tokens, not with documents times shards
                    some = np.flatnonzero(np.bincount(who, minlength=width))
                    sums = [np.bincount(who, often * v[d], width)[some] for v in (known, base, log_p)]
                    yield [[name], [number], [pack(some.astype("<u2"), sums[0].astype("<u4"), *sums[1:])], None, None, None]

        return lambda batch: ([[None] if c is None else c for c in row] for row in run(batch))

    gathered = "chunk long, shard long, part binary, ids array<long>, held array<boolean>, lengths array<long>"
    parts = map_batches(model.where("shard >= 0").select("shard", "dishes", "entries", "chunks", "sizes", "docs"), gathered, make)
    named = model.where("shard < 0").select("chunk", "shard", F.lit(None).cast("binary").alias("part"), "ids", "held", "lengths")

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")  # the documents' own row is first
        ids, held, lengths = (table[c][0].as_py() for c in ("ids", "held", "lengths"))
        sums = [np.zeros(len(ids), kind) for kind in (np.int64, float, float)]
        for part in table["part"][1:]:
            at, *found = unpack(part.as_buffer().to_pybytes(), "<u2", "<u4", "<f8", "<f8")
            for total, more in zip(sums, found):
                total[at] += more.astype(total.dtype)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(lengths, pa.int64()), "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    scored = parts.unionByName(named).groupBy("chunk").applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(vocab.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of the model and of single counts, by ``held_out``."""
    per_token = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), per_token("score").alias("perplexity"), per_token("base_score").alias("base_perplexity"))


def score_documents(docs: DataFrame) -> DataFrame:
    """``score`` with six sevenths of the documents, by a checksum of their id, learned from."""
    return score(docs, fold_remainder("doc_id", 7) != 2)
