"""Rows that exclude each other, decided in turn."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Decided rows of an Arrow batch.
OUT_ROWS = 1000


def in_turn(rows: DataFrame, key: tuple[str, ...], order: tuple[Column | str, ...], columns: tuple[str, ...], schema: str, decide: Callable[[Iterable[tuple]], Iterable[tuple]]) -> DataFrame:
    """The rows of ``schema`` that ``decide`` yields for each ``key``.

    It gets an iterator of the key's rows in their ``order``, as tuples of the
    key and ``columns``. Rows are dealt by key and sorted; groups run through a
    task one after the other and are not gathered: many small ones cost no
    more than their rows, and of a large one only what ``decide`` keeps is held.
    """
    n, arrow = len(key), to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        out = []
        for _, group in groupby((row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])), key=lambda row: row[:n]):
            for row in decide(group):
                out.append(row)
                if len(out) == OUT_ROWS:
                    yield made()
                    out = []
        if out:
            yield made()

    return rows.repartition(*key).sortWithinPartitions(*key, *order).select(*key, *columns).mapInArrow(run, schema)
