"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum, over all its segmentations into pieces,
of the product of their probabilities (a forward pass); a text's is the product
over its words. Pieces of every length and whole words count. Training is EM:
the forward-backward passes run in tasks over the word counts of a bounded
sample, and only piece counts reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold_remainder, hash_below, map_batches, settle

#: A word is a run of letters. Longer words than this are summed by logarithms, one by one, and not remembered.
LETTERS, LONGEST_TOGETHER = re.compile(r"[^\W\d_]+"), 24
#: Words that take the forward pass together.
WORDS_TOGETHER = 8192
#: Scored words that a worker remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 150_000
UNDETERMINED = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> dict[str, int]:
    """Lower-cased letter pieces of a sentencepiece model, with U+2581 as the word start; numbered densely."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        body = piece.removeprefix("▁")
        if body and body.isalpha():
            pieces.setdefault(piece, len(pieces))
    return pieces


def words_of(text: str) -> list[str]:
    """The whole letter runs of a text, lower-cased."""
    return LETTERS.findall(text.lower())


def longest_piece(pieces: dict[str, int]) -> int:
    return max(map(len, pieces), default=1)


class PieceTree:
    """The pieces as a tree of characters; node n + 1 is entered by arcs[n] = parent << 21 | code point."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces, self.longest, self.unknown = pieces, longest_piece(pieces), len(pieces)
        arcs, piece, level = [], [-1], {"": 0}
        prefixes: dict[int, set[str]] = {}
        for p in pieces:
            for n in range(1, len(p) + 1):
                prefixes.setdefault(n, set()).add(p[:n])
        for n in sorted(prefixes):
            deeper = {}
            for prefix in sorted(prefixes[n], key=lambda x: (level[x[:-1]], x[-1])):
                arcs.append(level[prefix[:-1]] << 21 | ord(prefix[-1]))
                piece.append(pieces.get(prefix, -1))
                deeper[prefix] = len(arcs)
            level = deeper
        self.arcs, self.piece = np.array(arcs or [-1], np.int64), np.array(piece, np.int64)

    def occurrences(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id, slot) of all pieces in the words; a lone letter that is no piece has the id ``unknown``.

        A word of n letters has n + 1 places, which follow those of the word
        before; ``slot`` is each word's first place.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        slot = np.cumsum(sizes + 1) - sizes - 1
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        start, until = np.arange(len(letters)) + word, np.repeat(slot + sizes, sizes)
        code, first = np.zeros(int((sizes + 1).sum()), np.int64), start
        code[start] = letters
        node, end, found = np.zeros(len(start), np.int64), start, []
        while len(start):
            key = node << 21 | code[end]
            n = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            alive = self.arcs[n] == key
            node, start, end, until = n[alive] + 1, start[alive], end[alive] + 1, until[alive]
            piece = self.piece[node]
            ended = piece >= 0
            found.append((start[ended], end[ended], piece[ended]))
            inside = end < until
            node, start, end, until = node[inside], start[inside], end[inside], until[inside]
        lone = np.ones(len(code), bool)
        for s, e, _ in found[:1]:
            lone[s] = False
        first = first[lone[first]]
        found.append((first, first + 1, np.full(len(first), self.unknown)))
        return (*(np.concatenate(x) for x in zip(*found)), slot)


class Lattice:
    """All pieces of some marked words, and the probabilities of what lies before and behind each."""

    def __init__(self, words: list[str], tree: PieceTree, table: np.ndarray):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.start, self.end, self.id, self.slot = tree.occurrences(words)
        self.table, self.places = table, int((self.sizes + 1).sum())
        self.base = np.repeat(self.slot, self.sizes + 1)

    def _sweep(self, at: np.ndarray, other: np.ndarray, sums: np.ndarray, backward: bool) -> np.ndarray:
        """Add up, place by place, the pieces with one side ``at`` a place times the sum at their ``other`` side; all words step together."""
        local = at - self.base[at]
        turns = np.lexsort((at, local))
        at, other, ids, local = at[turns], other[turns], self.id[turns], local[turns]
        stops = np.cumsum(np.bincount(local)).tolist() if len(local) else []
        steps = [(low, high) for low, high in zip([0, *stops], stops) if low < high]
        for low, high in reversed(steps) if backward else steps:
            begins = np.nonzero(np.diff(at[low:high], prepend=-1))[0]
            sums[at[low:high][begins]] = np.add.reduceat(sums[other[low:high]] * self.table[ids[low:high]], begins)
        return sums

    def forward(self) -> np.ndarray:
        """[place, language]: the summed probability of all segmentations of each prefix."""
        sums = np.zeros((self.places, self.table.shape[1]))
        sums[self.slot] = 1
        return self._sweep(self.end, self.start, sums, False)

    def backward(self) -> np.ndarray:
        sums = np.zeros((self.places, self.table.shape[1]))
        sums[self.slot + self.sizes] = 1
        return self._sweep(self.start, self.end, sums, True)


def endings(word: str, pieces: dict[str, int], longest: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """For each position j from 1 on: (j, starts, ids) of the pieces that end there; a lone unknown letter is one."""
    for j in range(1, len(word) + 1):
        starts = [i for i in range(max(0, j - longest), j - 1) if word[i:j] in pieces]
        yield j, [*starts, j - 1], [*(pieces[word[i:j]] for i in starts), pieces.get(word[j - 1], len(pieces))]


def long_score(word: str, pieces: dict[str, int], table: np.ndarray, longest: int) -> np.ndarray:
    """[language]: log probability of a marked word of any length; only the last ``longest`` positions are held."""
    logs = np.zeros((longest + 1, table.shape[1]))  # position j is in row j % (longest + 1)
    for j, starts, ids in endings(word, pieces, longest):
        last = logs[(j - 1) % len(logs)]
        logs[j % len(logs)] = last + np.log((np.exp(logs[np.array(starts) % len(logs)] - last) * table[ids]).sum(0))
    return logs[len(word) % len(logs)]


def add_long_counts(out: np.ndarray, word: str, counts: np.ndarray, pieces: dict[str, int], table: np.ndarray, longest: int) -> None:
    """Add the expected pieces of a marked word of any length to ``out``."""
    alpha, beta = np.zeros((len(word) + 1, table.shape[1])), np.full((len(word) + 1, table.shape[1]), -np.inf)
    ends = list(endings(word, pieces, longest))
    for j, starts, ids in ends:
        alpha[j] = alpha[j - 1] + np.log((np.exp(alpha[starts] - alpha[j - 1]) * table[ids]).sum(0))
    beta[-1] = 0
    for j, starts, ids in reversed(ends):
        through = np.log(table[ids]) + beta[j]
        beta[starts] = np.logaddexp(beta[starts], through)
        np.add.at(out, ids, np.exp(alpha[starts] + through - alpha[-1]) * counts)


def _parts(words: list[str]) -> tuple[list[int], list[np.ndarray]]:
    """(numbers of the very long words, numbers of the others in parts, shorter words first)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    short = np.argsort(sizes, kind="stable")[: int((sizes <= LONGEST_TOGETHER + 1).sum())]
    return np.nonzero(sizes > LONGEST_TOGETHER + 1)[0].tolist(), [short[cut : cut + WORDS_TOGETHER] for cut in range(0, len(short), WORDS_TOGETHER)]


def word_scores(words: list[str], pieces: dict[str, int], table: np.ndarray, tree: PieceTree | None = None) -> np.ndarray:
    """[word, language]: log probability of each marked word."""
    tree = tree or PieceTree(pieces)
    out = np.empty((len(words), table.shape[1]))
    long, parts = _parts(words)
    for k in long:
        out[k] = long_score(words[k], pieces, table, tree.longest)
    for part in parts:
        lattice = Lattice([words[k] for k in part.tolist()], tree, table)
        out[part] = np.log(np.maximum(lattice.forward()[lattice.slot + lattice.sizes], 1e-300))
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: dict[str, int], table: np.ndarray, tree: PieceTree | None = None) -> np.ndarray:
    """[piece, language]: how often each piece is expected, given the [word, language] counts."""
    tree = tree or PieceTree(pieces)
    out = np.zeros_like(table)
    long, parts = _parts(words)
    for k in long:
        add_long_counts(out, words[k], counts[k], pieces, table, tree.longest)
    for part in parts:
        lattice = Lattice([words[k] for k in part.tolist()], tree, table)
        before, behind = lattice.forward(), lattice.backward()
        scale = np.repeat(counts[part] / np.maximum(before[lattice.slot + lattice.sizes], 1e-300), lattice.sizes + 1, axis=0)
        share = before[lattice.start] * table[lattice.id] * behind[lattice.end] * scale[lattice.start]
        for lang in range(table.shape[1]):
            out[:, lang] += np.bincount(lattice.id, share[:, lang], len(out))
    return out


def fit(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_language: int = 1200,
    iterations: int = 2,
    smoothing: float = 0.1,
) -> dict:
    """Learn piece probabilities from the labelled rows of ``docs``.

    Rows with a null language or text teach nothing. About
    ``sample_per_language`` whole documents of each language are used, chosen
    by a hash of their id, so the cost is bounded whatever the table's size.
    The model is {languages, pieces, table}: languages x pieces numbers.
    """
    pieces = load_pieces(path or default_vocabulary())
    labelled = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    size, width = len(pieces) + 2, max(1, len(languages))
    table = np.full((size, width), 1.0 / (size - 1))
    table[-1] = 0
    if not languages:
        return {"languages": [], "pieces": pieces, "table": table}
    share = reduce(lambda c, l: c.when(F.col("lang") == l, F.lit(min(1.0, sample_per_language / sizes[l]))), languages, F.when(F.lit(False), F.lit(0.0)))
    number = {l: i for i, l in enumerate(languages)}

    def count_words():
        from collections import Counter

        def count(batch):
            totals: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals.setdefault(lang, Counter()).update(words_of(text))
            rows = [(number[lang], "▁" + w, n) for lang, c in totals.items() for w, n in c.items()]
            return [list(x) for x in zip(*rows)] if rows else [[], [], []]

        return count

    sample = labelled.where(hash_below(F.coalesce("id", F.lit(0)), 1, share)).select("text", "lang")
    counted = map_batches(sample, "lang int, word string, n long", count_words)
    words = settle(counted.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(width)]))
    for _ in range(iterations):
        now = words.sparkSession.sparkContext.broadcast((pieces, table))

        def expect(now=now):
            known, probabilities = now.value
            tree = PieceTree(known)

            def run(batch):
                counts = np.stack([np.asarray(batch.column(1 + i)) for i in range(width)], 1).astype(float)
                found = expected_counts(batch.column(0).to_pylist(), counts, known, probabilities, tree)
                piece, lang = np.nonzero(found > 1e-6)
                return [piece.astype("int32").tolist(), lang.astype("int32").tolist(), found[piece, lang].tolist()]

            return run

        summed = map_batches(words, "piece int, lang int, n double", expect).groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        found = np.full((size, width), smoothing)
        for r in summed.collect():  # at most languages x pieces rows
            found[r["piece"], r["lang"]] += r["n"]
        found[-1] = 0
        table = found / found.sum(0)
    return {"languages": languages, "pieces": pieces, "table": table}


class _Scorer(dict):
    """Word -> row of the score matrix; unseen words of a batch are scored together. Very long words are not remembered."""

    def __init__(self, model: dict):
        super().__init__()
        self.model, self.rows = model, np.empty((1024, model["table"].shape[1]))
        self.tree = PieceTree(model["pieces"])

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > REMEMBERED_WORDS:
            self.clear()
            new = list(words)
        start, end = len(self), len(self) + len(new)
        if end > len(self.rows):
            self.rows = np.resize(self.rows, (2 * end, self.rows.shape[1]))
        if new:
            self.rows[start:end] = word_scores(["▁" + w for w in new], self.model["pieces"], self.model["table"], self.tree)
            self.update(zip(new, range(start, end)))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages = self.model["languages"]
        langs, scores = [], []
        step = 64
        for cut in range(0, len(texts), step):
            each = [words_of(t) if t else [] for t in texts[cut : cut + step]]
            each = [w if any(map(str.isalpha, w)) else [] for w in each]
            known = [[w for w in words if len(w) <= LONGEST_TOGETHER] for words in each]
            self.learn(set().union(*known))
            for words, short in zip(each, known):
                if not words or not languages:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = self.rows[np.fromiter(map(self.__getitem__, short), np.int64, len(short))].sum(0)
                if len(short) < len(words):
                    for w in words:
                        if len(w) > LONGEST_TOGETHER:
                            total = total + long_score("▁" + w, self.model["pieces"], self.model["table"], self.tree.longest)
                best = int(total.argmax())
                langs.append(languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the likeliest language of each whole text and its posterior.

    A text that is null, empty or without letters is ``und`` with score 0, as
    is every text under a model without languages. Equal likelihoods go to the
    first language by name. Only id and text are read; repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast({"model": model})

    def make():
        state = sent.value
        if "scorer" not in state:
            state["scorer"] = _Scorer(model=state["model"])
        return lambda batch: [batch.column(0), *state["scorer"].score(batch.column(1).to_pylist())]

    rows = docs.select(docs[id_col].cast("long"), docs[text_col])
    return map_batches(rows, f"`{id_col}` long, lang_pred string, score double", make)


def keep_identified(docs: DataFrame, model: dict, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, in their own columns, whose language is determined with at least ``min_score``; ``und`` goes."""
    sent = docs.sparkSession.sparkContext.broadcast({"model": model})
    k = docs.columns.index(text_col)

    def make():
        state = sent.value
        if "scorer" not in state:
            state["scorer"] = _Scorer(model=state["model"])

        def run(batch):
            langs, scores = state["scorer"].score(batch.column(k).to_pylist())
            left = batch.filter(pa.array([lang != UNDETERMINED and p >= min_score for lang, p in zip(langs, scores)]))
            return list(left.columns)

        return run

    return map_batches(docs, docs.schema, make)


def identify(docs: DataFrame, held_out_mod: int = 5, **options) -> DataFrame:
    """Learn from rows whose fold is not 0, predict all: (doc_id, held_out, lang_pred, score)."""
    model = fit(docs.where(fold_remainder("doc_id", held_out_mod) != 0), **options)
    return predict(docs, model).select("doc_id", (fold_remainder("doc_id", held_out_mod) == 0).alias("held_out"), "lang_pred", "score")
