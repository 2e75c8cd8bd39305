"""Fill-in-middle transformation of whole texts.

A text is cut into units (code points, or the matches of a pattern). Its UTF-8
bytes are dealt into fixed blocks, and a Fenwick tree over the blocks holds how
many units and how many code points begin in each. A cut after k units is found
by binary-lifting descent to its block, then by a look into that block alone.
The two cuts and the form come from a digest of the document's id.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import map_batches

#: Bytes of a block.
BLOCK = 1024
#: Marks before the prefix, the suffix and the middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares, in percent, of texts that are transformed and, of these, of those that begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20


class BlockTree:
    """Counts of units and code points by fixed blocks of a text's bytes."""

    def __init__(self, data: bytes, unit: re.Pattern | None = None):
        raw = np.frombuffer(data, np.uint8)
        self.points = (raw & 0xC0) != 0x80
        if unit is None:
            self.units = self.points
        else:
            # text that no match covers belongs to the unit before it, at the beginning to the first
            offsets = np.flatnonzero(self.points)
            found = [m.start() for m in unit.finditer(data.decode("utf-8", "surrogateescape"))]
            self.units = np.zeros(len(raw), bool)
            if len(raw):
                self.units[offsets[found[1:]]] = True
                self.units[0] = True
        self.size, self.blocks = len(raw), -(-len(raw) // BLOCK)
        begins = np.arange(self.blocks) * BLOCK
        counts = np.zeros((self.blocks + 1, 2), np.int64)
        if self.blocks:
            counts[1:, 0] = np.add.reduceat(self.units, begins, dtype=np.int64)
            counts[1:, 1] = np.add.reduceat(self.points, begins, dtype=np.int64)
        sums = counts.cumsum(axis=0)
        at = np.arange(self.blocks + 1)
        self.tree = (sums - sums[at & (at - 1)]).tolist()
        self.n_units, self.n_points = sums[-1].tolist()

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if k >= self.n_units:
            return self.size, self.n_points
        block = points = 0
        step = 1 << (self.blocks.bit_length() - 1)
        while step:
            if block + step <= self.blocks and self.tree[block + step][0] <= k:
                block += step
                k -= self.tree[block][0]
                points += self.tree[block][1]
            step >>= 1
        begin = block * BLOCK
        local = int(np.flatnonzero(self.units[begin : begin + BLOCK])[k])
        return begin + local, points + int(self.points[begin : begin + local].sum())


def draws(doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of ``1:`` and the decimal id (nothing for a null id)."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else b"%d" % doc_id)).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(data: bytes, doc_id: int | None, unit: re.Pattern | None = None) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of a text."""
    tree = BlockTree(data, unit)
    n, (h1, h2, h3, h4) = tree.n_units, draws(doc_id)
    if not data or h3 % 100 >= TRANSFORMED or any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_points), (b, b_points) = tree.cut(low), tree.cut(high)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < SUFFIX_FIRST:
        form, out = "spm", b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    else:
        form, out = "psm", b"".join((p, data[:a], s, data[b:], m, data[a:b]))
    return n, form, a_points, b_points - a_points, out


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    ``unit`` is a pattern whose matches, from left to right, are the units;
    code points if None. A null text counts as empty. An empty text, one that
    holds a mark already and a tenth of all others stay ``plain``: output is
    the text, the lengths are null. Rows that repeat an id get the same cuts
    for the same text; a row without an id is drawn as if its id were blank.
    Other columns are left out.
    """

    def make():
        pattern = re.compile(unit, re.DOTALL) if unit else None

        def run(batch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            made = [rearranged(t or b"", i, pattern) for i, t in zip(ids, texts)]
            n, forms, prefix, middle, out = map(list, zip(*made))
            return [batch.column(0), n, forms, prefix, middle, pa.array(out, pa.binary()).view(pa.string())]

        return run

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_batches(docs.select(docs[id_col].cast("long"), docs[text_col]), schema, make)


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made of; a transformed text holds no mark of its own, so each mark is found at its first place."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(rest))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    last, first, between = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, between, last)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``transform`` with digests of the output and of the text restored from it, in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored("output", "form")).alias("restored_sha256"))
