"""What the corpus operators share: input columns, staged tables, batches for Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_root, staged, unstage

__all__ = ["SPACE", "WORD", "Cache", "documents", "let", "pages", "shared_root", "sieve", "slices", "staged", "table", "unstage", "utf8"]

#: White space of every word rule of this package: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times inside body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8(name: str = "text") -> Column:
    """A string column as its UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named binary or string column has about most_bytes in each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        mean = max(1, batch.column(batch.schema.get_field_index(column)).nbytes // batch.num_rows)
        step = max(1, most_bytes // mean)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Bits of the bitmap that sieve() sends to every task: 8 MB, however many keys there are.
SIEVE_BITS = 1 << 26


def sieve(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test for long columns: whether a value may be one of keys, a column of hashes. A Bloom filter with one hash.

    It never rejects a key, so a join behind it gives the same rows; what it rejects needn't be shuffled to that join. Beyond
    some 10**8 keys it lets most values through. Only its bitmap comes to the driver, at most SIEVE_BITS / 64 words.
    """
    place = F.pmod(F.col(key), F.lit(SIEVE_BITS))
    words = keys.where(F.col(key).isNotNull()).select(F.floor(place / 64).alias("at"), (place % 64).cast("int").alias("bit"))
    words = words.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bitmap = np.zeros(SIEVE_BITS // 64, np.uint64)
    bitmap[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def may(value: pd.Series) -> pd.Series:
        at = value.fillna(0).to_numpy(np.int64).view(np.uint64) & np.uint64(SIEVE_BITS - 1)
        return pd.Series((sent.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    return may


class Cache(dict):
    """A memo of make(key) that is emptied when it has most entries, so its memory is bounded."""

    def __init__(self, make: Callable, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
