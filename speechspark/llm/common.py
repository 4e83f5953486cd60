"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechspark.session import checkpoint_dir

#: One run of the white space that parts words: blank, tab, line feed, vertical tab, form feed, return.
SPACES = "[\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the one that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; later readers know its size."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table of a few longs that are broadcast at most (some 16 MB); larger ones are joined by a shuffle.
BROADCAST = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """A stored table of a few longs a row, marked for a broadcast if its checked size allows one."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; the folder is the session's, or our own where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


def words(text: Column) -> Column:
    """Words of a text as an array; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def content_key(text: Column) -> Column:
    """Tells rows with one id apart by their text; null and empty texts share a key."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sha256_hex(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


def by_size(batch, column: int, most: int):
    """Slices of a record batch with about ``most`` bytes of a text column each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
