"""Small helpers that the text operators share."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of an Arrow batch: texts can be long, and a task holds a batch on both sides.
BATCH_ROWS, BATCH_SETTING, BATCH_DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterable]]) -> DataFrame:
    """Run ``make()`` once per task and its result on every Arrow batch.

    The function gets a record batch and returns the output columns as a list,
    in the order of ``schema``, or yields several such lists. A column is a
    list of values or an Arrow array, such as one of the batch, of any type.
    Nothing outlives the batch except what the function itself keeps. Where the
    session's batch size is Spark's default it is set to ``BATCH_ROWS``.
    """
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    names, kinds = [f.name for f in fields], [f.dataType for f in fields]

    if df.sparkSession.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                for cols in made if isinstance(made, Iterator) else [made]:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, _arrow(kind)) for c, kind in zip(cols, kinds)], names=names)

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
        T.BooleanType: pa.bool_(),
    }[type(kind)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one value: their bytes by place, each compressed."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        body = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        parts.append(struct.pack("<QQ", len(a), len(body)) + body)
    return b"".join(parts)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    at, out = 0, []
    for kind in map(np.dtype, kinds):
        n, size = struct.unpack_from("<QQ", data, at)
        at += 16
        raw = pa.decompress(data[at : at + size], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return out


def fold_remainder(id_col: str, mod: int) -> Column:
    """``crc32(doc_id as text) mod m``: the fold of a document; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(0))


def hash_below(key: Column, salt: int, share: Column) -> Column:
    """True for a fixed pseudo-random ``share`` (0 to 1) of the rows, chosen by their key."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000)) < share * 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    import tempfile

    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = found or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: for what is used several times and may be large."""
    import uuid

    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
