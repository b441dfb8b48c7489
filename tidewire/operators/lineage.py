"""Lineage: duplicate edges, publishers, verification evidence (JON-03..-05, AGG-16, -17, SCO-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PUBLISHERS


def duplicate_edges(assets: DataFrame, id_col: str = "id", order: str = "ord") -> DataFrame:
    """(from_id, to_id, relation): every asset of a hash points to the hash's first one.

    A star for each hash: as many edges as copies. All pairs of a group would grow with its square; degrees() gives the counts
    that all pairs would give.
    """
    first = assets.where("content_hash is not null").groupBy("content_hash").agg(F.min_by(id_col, order).alias("to_id"), F.count("*").alias("n")).where("n > 1")
    return assets.join(first, "content_hash").where(F.col(id_col) != F.col("to_id")).select(F.col(id_col).alias("from_id"), "to_id", F.lit("duplicate_of").alias("relation"))


def pair_edges(assets: DataFrame, id_col: str = "id", order: str = "ord") -> DataFrame:
    """All pairs i < j of equal hash, for tables known to have small groups."""
    a = assets.select(F.col("content_hash"), F.col(id_col).alias("to_id"), F.col(order).alias("i"))
    b = assets.select(F.col("content_hash"), F.col(id_col).alias("from_id"), F.col(order).alias("j"))
    return a.join(b, "content_hash").where("i < j").select("from_id", "to_id", F.lit("duplicate_of").alias("relation"))


def new_edges(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Edges to append: distinct, and not stored yet."""
    key = ["from_id", "to_id", "relation"]
    return found.select(*key).distinct().join(stored.select(*key), key, "left_anti")


def degrees(assets: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, edges): how many duplicate edges each asset has when every pair of its hash is one."""
    sizes = assets.where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n"))
    return assets.join(sizes, "content_hash", "left").select(id_col, F.coalesce(F.col("n") - 1, F.lit(0)).alias("edges"))


def edge_degrees(edges: DataFrame, relation: str = "duplicate_of") -> DataFrame:
    """(id, edges) of an edge table, both ends counted: a union of the two directions, never a join on either end."""
    some = edges.where(F.col("relation") == relation)
    return some.select(F.col("from_id").alias("id")).union(some.select("to_id")).groupBy("id").agg(F.count("*").alias("edges"))


def publishers(spark: SparkSession, rows: list[tuple] = PUBLISHERS) -> DataFrame:
    return spark.createDataFrame(rows, "alias string, canonical string, publisher_type string, trust_score int")


def with_publisher(df: DataFrame, dim: DataFrame, source: str = "source_id") -> DataFrame:
    """df plus canonical, publisher_type and trust_score; nulls where the source is no alias. The dimension is small: Spark broadcasts it by size."""
    return df.join(dim, F.lower(F.coalesce(F.col(source), F.lit(""))) == F.col("alias"), "left").drop("alias")


def evidence_count(publisher_type: Column, edges: Column) -> Column:
    base = F.when(publisher_type.isin("official", "academic"), 2).when(publisher_type == "media", 1).otherwise(0)
    return base + F.coalesce(edges, F.lit(0))


def origin_weight(publisher_type: Column, trust: Column) -> Column:
    """Weight by publisher type plus trust above or below 3 in fives, between -5 and 10; null for unknown publishers."""
    kind = F.when(publisher_type == "official", 15).when(publisher_type == "academic", 12).when(publisher_type == "media", 5).when(publisher_type == "personal", 3).otherwise(0)
    return F.when(publisher_type.isNotNull(), kind + F.greatest(F.lit(-5), F.least(F.lit(10), (trust - 3) * 5)))


def edge_weight(edges: Column) -> Column:
    return F.when(edges >= 4, 15).when(edges == 3, 10).when(edges == 2, 5).otherwise(0)


def source_chain(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, chain): 'publisher → publisher' along an event's duplicate edges, the event's own first."""
    via = edges.join(events.select(F.col("id").alias("to_id"), F.coalesce("canonical", "source_id").alias("name")), "to_id")
    after = via.groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    own = F.coalesce("canonical", "source_id")
    names = F.concat(F.array(own), F.coalesce("names", F.array().cast("array<string>")))
    return events.join(after, "id", "left").select("id", F.array_join(names, " → ").alias("chain"))
