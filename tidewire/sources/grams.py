"""Substring search over keys by an index of their character pieces (FLT-14)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists

GRAMS = "gram string, key string, bucket int"
LONGEST = 3


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct pieces of a text of each size."""
    chars = F.split(text, "")

    def of(size: int) -> Column:
        parts = F.transform(F.array(chars), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(c, i, F.lit(size)), "")))[0]
        return F.filter(parts, lambda g: F.char_length(g) == size)

    return F.array_distinct(F.concat(*[of(s) for s in sizes]))


@dataclass
class GramIndex:
    """Postings (piece of one to three characters, key) in folders by the piece's hash, without regard to ASCII case."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def add(self, keys: DataFrame, key: str = "key") -> None:
        """Index the distinct keys; null ones and empty ones can't be found. Keys may be added again."""
        rows = keys.select(F.col(key).alias("key")).where("key <> ''").distinct()
        posted = rows.select("key", F.explode(grams(_fold(F.col("key")), list(range(1, LONGEST + 1)))).alias("gram"))
        posted.select("gram", "key", self._bucket(F.col("gram")).alias("bucket")).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def postings(self, needle: str) -> tuple[DataFrame, list[str]]:
        """The postings of the folders of the needle's pieces, and the pieces; other folders aren't read."""
        low = "".join(c.lower() if c.isascii() else c for c in needle)
        size = min(LONGEST, len(low))
        parts = sorted({low[i : i + size] for i in range(len(low) - size + 1)})
        wanted = self.spark.createDataFrame([(p,) for p in parts], "gram string").select("gram", self._bucket(F.col("gram")).alias("bucket")).collect()
        folders = [p for b in sorted({r["bucket"] for r in wanted}) if exists(self.spark, p := f"{self.path}/bucket={b}")]
        if not folders:
            return self.spark.createDataFrame([], GRAMS), parts
        rows = self.spark.read.schema(GRAMS).option("basePath", self.path).parquet(*folders)
        return rows.where(F.col("gram").isin(parts)), parts

    def find(self, needle: str) -> DataFrame:
        """(key): the keys that hold the needle, ASCII case aside; an empty needle finds none."""
        if not needle:
            return self.spark.createDataFrame([], "key string")
        rows, parts = self.postings(needle)
        meet = rows.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(parts))
        return meet.where(F.contains(_fold(F.col("key")), _fold(F.lit(needle)))).select("key")


def _fold(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())
