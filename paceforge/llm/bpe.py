"""Byte-pair encoding and decoding through a deterministic tokenization automaton.

The automaton reads tokens. It starts as one state that loops on every byte.
For each merge (a, b), by rank, a merge gadget is inserted: every state that is
entered by ``a`` and leaves by ``b`` is split into a copy without the arc ``b``,
``a`` is redirected to the copy, and each state with an arc ``a`` gains an arc
``ab`` to where ``b`` led. In this construction all arcs with one label enter
one state, and an arc ``ab`` is there if its ``a`` was when the merge was
inserted. So what a split removes from a copy is the arc ``b`` and every arc
that was later to grow from it on the left. With the tokens numbered along the
tree of left parts, later merges first, that is one interval, and the arcs a
state lacks are a short list of intervals. All of these tables are made before
any text is read; their size is fixed by the merges.

A path spells a string's one correct tokenization, and every prefix of a string
has one path as well. Encoding goes over the bytes once: the last token of each
prefix is the longest vocabulary entry that ends there and has an arc from the
state of the prefix before it. No step is taken back.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .frames import map_batches

#: How the byte-level pre-tokenizer splits text (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of which a task holds ids at a time.
SLICE_ROWS = 200
#: A run of blanks in which the pre-tokenizer looks past a blank, so that text cannot be cut there.
LONG_BLANKS = re.compile(r"\s (?:\s|$)")
#: Words, and chunks between blanks, that a worker remembers; beyond it the older half is forgotten.
REMEMBERED_WORDS = 160_000
#: New words that advance through the automaton together.
WORDS_TOGETHER = 4096
#: More than there are tokens.
STRIDE = 1 << 32


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Automaton:
    """Plain tables, so that they can be broadcast; the size is the vocabulary's.

    labels: the bytes that each token id emits. target: the state that an arc
    with this label enters. order: the tokens' numbers along the tree of left
    parts. missing: ends of half-open intervals of state * STRIDE + number, in
    ascending order; the arcs with these numbers are missing in the state.
    State 0 is the first state, which lacks none. arcs, token: the labels as a
    tree of bytes, whose node n + 1 is entered by arcs[n] = parent * 256 +
    byte; the token that ends at each node, or -1.
    """

    labels: list[bytes]
    special: dict[bytes, int]
    target: np.ndarray
    order: np.ndarray
    missing: np.ndarray
    arcs: np.ndarray
    token: np.ndarray


def compile_automaton(path: str) -> Automaton:
    """Insert one gadget per merge of a byte-level BPE file, in rank order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, vocab, merges = byte_alphabet(), spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    labels = [b""] * size
    for token, i in vocab.items():
        labels[i] = bytes(alphabet[c] for c in token)
    for content, i in special.items():
        labels[i] = content
    target = [0] * size
    grown: list[list[tuple[int, int]]] = [[] for _ in range(size)]  # by left part: (rank, token made), by rank
    splits = [(-1, -1, -1)]  # of each state: what it was split from, the arc removed, the merge
    for r, pair in enumerate(merges):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        x, y, made = vocab[a], vocab[b], vocab[a + b]
        grown[x].append((r, made))
        target[made] = target[y]
        splits.append((target[x], y, r))
        target[x] = len(splits) - 1
    order, past = _number(size, grown)
    dense = {state: n for n, state in enumerate(sorted({0, *target}))}
    missing = []
    for state, n in dense.items():
        gone = []
        while state > 0:
            state, arc, r = splits[state]
            # of what grows from the arc, merges from r on come first in the numbering
            later = bisect_left(grown[arc], (r, -1))
            gone.append((order[arc], past[grown[arc][later][1]] if later < len(grown[arc]) else order[arc] + 1))
        missing += [n * STRIDE + end for interval in merge_intervals(gone) for end in interval]
    arcs, token = _byte_tree({label: i for i, label in enumerate(labels) if label and label not in special})
    return Automaton(labels, special, np.array([dense[t] for t in target]), np.array(order), np.array(missing), arcs, token)


def _byte_tree(tokens: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(arcs, token), level by level, so that the arcs come out sorted."""
    arcs, token, level = [], [-1], {b"": 0}
    prefixes: dict[int, set[bytes]] = {}
    for label in tokens:
        for n in range(1, len(label) + 1):
            prefixes.setdefault(n, set()).add(label[:n])
    for n in sorted(prefixes):
        deeper = {}
        for prefix in sorted(prefixes[n], key=lambda x: (level[x[:-1]], x[-1])):
            arcs.append(level[prefix[:-1]] * 256 + prefix[-1])
            token.append(tokens.get(prefix, -1))
            deeper[prefix] = len(arcs)
        level = deeper
    return np.array(arcs, np.int64), np.array(token, np.int64)


def _number(size: int, grown: list[list[tuple[int, int]]]) -> tuple[list[int], list[int]]:
    """Number the tokens in preorder, what grew last first; (number, first number past its subtree) of each."""
    made = {token for tokens in grown for _, token in tokens}
    order, past, n = [0] * size, [0] * size, 0
    stack = [(token, False) for token in range(size) if token not in made]
    while stack:
        token, done = stack.pop()
        if done:
            past[token] = n
            continue
        order[token] = n
        n += 1
        stack.append((token, True))
        stack += [(child, False) for _, child in grown[token]]  # the latest is on top
    return order, past


def merge_intervals(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


class Coder:
    """Encodes and decodes with the tables, many words at a time."""

    def __init__(self, tables: Automaton):
        import regex

        self.tables, self.labels, self.special = tables, tables.labels, tables.special
        self.sizes = np.array(list(map(len, self.labels)))
        self.split = regex.compile(SPLIT).findall
        self.around = regex.compile("(" + "|".join(map(regex.escape, (s.decode() for s in self.special))) + ")").split if self.special else None
        self.words, self.chunks = _Remembered(), _Remembered()

    def candidates(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, token) of every occurrence of a token in the words, whose bytes follow each other in ``text``."""
        tree, last = self.tables.arcs, len(self.tables.arcs) - 1
        at = np.arange(len(text))
        until = np.repeat(ends, np.diff(ends, prepend=0))
        node, found = np.zeros(len(text), np.int64), []
        while len(at):
            key = node * 256 + text[at]
            n = np.minimum(np.searchsorted(tree, key), last)
            alive = tree[n] == key
            node, at, until = n[alive] + 1, at[alive] + 1, until[alive]
            token = self.tables.token[node]
            ended = token >= 0
            found.append((at[ended], token[ended]))
            inside = at < until
            node, at, until = node[inside], at[inside], until[inside]
        return np.concatenate([e for e, _ in found]), np.concatenate([t for _, t in found])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (none is empty), packed.

        All words advance together, a byte at a time. Of the tokens that end at
        a prefix one has an arc from the state of the prefix before it.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        by_size = np.argsort(sizes, kind="stable")
        out: list[bytes] = [b""] * len(words)
        for cut in range(0, len(words), WORDS_TOGETHER):
            part = by_size[cut : cut + WORDS_TOGETHER]
            ids, counts = self._encode_together([words[k] for k in part.tolist()], sizes[part])
            packed, at = ids.astype("<u4").tobytes(), 0
            for k, n in zip(part.tolist(), (4 * counts).tolist()):
                out[k] = packed[at : at + n]
                at += n
        return out

    def _encode_together(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        end, token = self.candidates(text, ends)
        begin, local = end - self.sizes[token], end - np.repeat(starts, sizes)[end - 1]
        turns = np.argsort(local, kind="stable")
        end, token, begin, local = end[turns], token[turns], begin[turns], local[turns]
        wanted = self.tables.order[token]
        # the state and the last token of each prefix, by where it ends; a word's first byte has the first state before it
        state, chosen = np.zeros(len(text) + 1, np.int64), np.full(len(text) + 1, -1, np.int64)
        first = begin == end - local
        turn_ends = np.cumsum(np.bincount(local, minlength=1)).tolist()
        for low, high in zip(turn_ends, turn_ends[1:]):
            before = np.where(first[low:high], 0, state[begin[low:high]])
            lacks = np.searchsorted(self.tables.missing, before * STRIDE + wanted[low:high], "right") & 1
            good = np.nonzero(lacks == 0)[0] + low
            chosen[end[good]] = token[good]
            state[end[good]] = self.tables.target[token[good]]
        on_path = np.zeros(len(text) + 1, bool)
        at, low = ends, starts
        while len(at):
            on_path[at] = True
            at = at - self.sizes[chosen[at]]
            at, low = at[at > low], low[at > low]
        marked = np.nonzero(on_path)[0]
        return chosen[marked], np.diff(np.searchsorted(marked, ends, "right"), prepend=0)

    def _pieces(self, text: str) -> list[tuple[str, object]]:
        """How the text is put together: ("id", packed), ("words", list) and ("chunks", list)."""
        parts = self.around(text) if self.around and any(s.decode() in text for s in self.special) else [text]
        out: list[tuple[str, object]] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(("id", self.special[part.encode()].to_bytes(4, "little")))
            elif LONG_BLANKS.search(part):
                out.append(("words", self.split(part)))
            else:
                # no word crosses a single blank that stands before it, so what lies between blanks can be looked up whole
                first, *rest = part.split(" ")
                out += [("words", self.split(first)), ("chunks", rest)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self._pieces(text) for text in texts]
        words: set[str] = set()
        chunks: set[str] = set()
        for kind, found in (x for p in pieces for x in p):
            if kind != "id":
                (words if kind == "words" else chunks).update(found)
        plain, made = [], {}
        for chunk in self.chunks.unknown(chunks):
            if chunk.isascii() and chunk.isalpha():
                plain.append(chunk)  # one word with its blank
            else:
                made[chunk] = self.split(" " + chunk)
        words.update(*made.values())
        new = list(self.words.unknown(words))
        packed = self.encode_words([w.encode() for w in new] + [b" " + c.encode() for c in plain])
        self.words.learn(zip(new, packed))
        word = self.words.of
        self.chunks.learn(zip(plain, packed[len(new) :]))
        self.chunks.learn((chunk, b"".join(map(word, parts))) for chunk, parts in made.items())
        lookup = {"words": word, "chunks": self.chunks.of}
        return [b"".join([found if kind == "id" else b"".join(map(lookup[kind], found)) for kind, found in p]) for p in pieces]

    def decode(self, ids: bytes) -> str:
        """Emit the label of each arc; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Remembered:
    """The packed ids of strings that a worker has met. ``unknown`` makes room, so what it returns and what it passes over can be looked up until the next call."""

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.of = self.known.__getitem__

    def unknown(self, keys: set[str]) -> set[str]:
        new = keys - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            # the older half goes, but for what is wanted now
            drop = [k for k in islice(self.known, len(self.known) // 2) if k not in keys]
            for k in drop:
                del self.known[k]
        return new

    def learn(self, pairs) -> None:
        self.known.update(pairs)


def coder_of(tables) -> Coder:
    """The coder of this worker process; it is kept beside the broadcast tables."""
    if "coder" not in tables.value:
        tables.value["coder"] = Coder(Automaton(**tables.value["tables"]))
    return tables.value["coder"]


def broadcast_tables(spark: SparkSession, path: str | None):
    """The compiled tables: a few MB, fixed by the vocabulary."""
    return spark.sparkContext.broadcast({"tables": compile_automaton(path or default_vocabulary()).__dict__})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: (id, n_tokens, ids binary), one row per input row.

    A null text is encoded as the empty text, which has no tokens. Ids may be
    null or repeat; rows are never merged. Other columns are not carried.
    ``ids`` holds little-endian unsigned 32-bit integers.
    """
    tables = broadcast_tables(docs.sparkSession, path)

    def make():
        coder = coder_of(tables)

        def encode(batch):
            for cut in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(cut, SLICE_ROWS)
                ids = coder.encode([text or "" for text in part.column(1).to_pylist()])
                yield [part.column(0), [len(x) // 4 for x in ids], ids]

        return encode

    rows = docs.select(docs[id_col].cast("long"), docs[text_col])
    return map_batches(rows, f"`{id_col}` long, n_tokens long, ids binary", make)


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Decode packed ids to (id, text); null ids decode to the empty text."""
    tables = broadcast_tables(encoded.sparkSession, path)

    def make():
        coder = coder_of(tables)
        return lambda batch: [batch.column(0), [coder.decode(x or b"") for x in batch.column(1).to_pylist()]]

    return map_batches(encoded.select(encoded[id_col].cast("long"), "ids"), f"`{id_col}` long, text string", make)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass and return digests of both.

    (id, n_tokens, ids_sha256, decoded_sha256), and ``ids`` too if asked; the
    rules are those of ``encode_documents``.
    """
    tables = broadcast_tables(docs.sparkSession, path)

    def make():
        coder = coder_of(tables)

        def both(batch):
            for cut in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(cut, SLICE_ROWS)
                n, ids_sha, text_sha, kept = [], [], [], []
                for ids in coder.encode([text or "" for text in part.column(1).to_pylist()]):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest())
                    if with_ids:
                        kept.append(ids)
                yield [part.column(0), n, ids_sha, text_sha] + [kept] * with_ids

        return both

    rows = docs.select(docs[id_col].cast("long"), docs[text_col])
    return map_batches(rows, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids, make)
