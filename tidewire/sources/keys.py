"""A table of stored keys, in buckets with a Bloom filter each, so that a batch reads only the buckets that may hold its keys (SNK-01, JON-08)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged, unstage
from .files import append, exists, read_table

KEYS = "kind string, key string, run string, bucket int"
FILTERS = "page int, bits binary, bucket int"
#: Bits of a bitmap of Spark's bitmap functions (fixed value).
PAGE_BITS = 32768


@dataclass
class KeyTable:
    """Keys (kind, key) with the run that stored them, under a shared path.

    A bucket's filter is `pages` bitmaps; a key sets two bits of one. Each batch appends its own bitmaps, which compact() unites. With n keys in a bucket
    about (2 n / (pages * 32768))^2 of the absent keys hit by chance; those read a bucket in vain, no result depends on them.
    buckets and pages stay as they were when the table was made.
    """

    spark: SparkSession
    path: str
    buckets: int = 256
    pages: int = 4

    def _placed(self, keys: DataFrame) -> DataFrame:
        rows = keys.where("key is not null")
        seed = lambda n, most: F.pmod(F.xxhash64(F.lit(n), "kind", "key"), F.lit(most)).cast("int")
        return rows.withColumns({"bucket": seed(1, self.buckets), "page": seed(2, self.pages), "one": seed(3, PAGE_BITS), "two": seed(4, PAGE_BITS)})

    def _filters(self) -> DataFrame:
        rows = read_table(self.spark, f"{self.path}/filters", FILTERS)
        return rows.groupBy("bucket", "page").agg(F.bitmap_or_agg("bits").alias("bits"))

    def may_hold(self, keys: DataFrame) -> DataFrame:
        """The keys (kind, key, ...) that the filters don't rule out, with their bucket."""
        return self._placed(keys).join(self._filters(), ["bucket", "page"]).where(_bit("one") & _bit("two")).drop("page", "one", "two", "bits")

    def folders(self, found: DataFrame) -> list[str]:
        """The folders of the buckets of found; there are at most `buckets`."""
        hit = [r["bucket"] for r in found.select("bucket").distinct().collect()]
        return [p for b in sorted(hit) if exists(self.spark, p := f"{self.path}/keys/bucket={b}")]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(kind, key, run) of those of keys (kind, key) that are stored; only the folders of buckets whose filter hits are read."""
        found = self.may_hold(keys.select("kind", "key").distinct())
        folders = self.folders(found)
        if not folders:
            return self.spark.createDataFrame([], "kind string, key string, run string")
        stored = self.spark.read.schema(KEYS).option("basePath", f"{self.path}/keys").parquet(*folders)
        return stored.join(found, ["bucket", "kind", "key"], "left_semi").select("kind", "key", "run")

    def add(self, keys: DataFrame, run: str) -> None:
        """Store keys (kind, key). The filters are written first: a filter without its keys costs a read, keys without their filter would be lost."""
        rows = staged(self._placed(keys.select("kind", "key").distinct()), "keys")
        bits = rows.select("bucket", "page", F.explode(F.array("one", "two")).alias("bit"))
        append(bits.groupBy("bucket", "page").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits")).select("page", "bits", "bucket").repartition("bucket"), f"{self.path}/filters", "bucket")
        append(rows.select("kind", "key", F.lit(run).alias("run"), "bucket").repartition("bucket"), f"{self.path}/keys", "bucket")
        unstage(rows)

    def compact(self) -> None:
        """One bitmap for each page again, and each key once. Nothing else may write meanwhile."""
        for name, rows in (("filters", self._filters().select("page", "bits", "bucket")), ("keys", read_table(self.spark, f"{self.path}/keys", KEYS).dropDuplicates(["bucket", "kind", "key", "run"]))):
            if exists(self.spark, f"{self.path}/{name}"):
                copy = staged(rows, name)
                copy.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
                unstage(copy)


def _bit(place: str) -> Column:
    """Whether a bitmap has a bit set: bit i is bit i % 8 of byte i / 8."""
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.col(place) % 8).bitwiseAND(F.lit(1)) == 1
