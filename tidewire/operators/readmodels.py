"""Read models over stored events, clusters, feedback (SRC-07, -08, FLT-11..-14, JON-01, -02, -08, AGG-01, -30, SRT-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Events:
    """Queries on a table of events and its bridges (event_id, entity) and (event_id, topic)."""

    def __init__(self, events: DataFrame, entities: DataFrame | None = None, topics: DataFrame | None = None):
        self.events = events
        self.entities = entities if entities is not None else events.select(F.col("id").alias("event_id"), F.explode("entities").alias("entity")).distinct()
        self.topics = topics if topics is not None else events.select(F.col("id").alias("event_id"), F.explode("topics").alias("topic")).distinct()

    def load(self) -> DataFrame:
        return self.events.orderBy(F.desc_nulls_last("rank_total"), "ord")

    def window(self, start: Column, end: Column) -> DataFrame:
        """Effective in [start, end), best score first, nulls last."""
        return self.events.where((F.col("effective_at") >= start) & (F.col("effective_at") < end)).orderBy(F.desc_nulls_last("rank_total"), "ord")

    def _by(self, bridge: DataFrame, column: str, value: str) -> DataFrame:
        ids = bridge.where(F.col(column) == value).select(F.col("event_id").alias("id"))
        return self.events.join(ids, "id").orderBy(F.desc_nulls_last("effective_at"), "ord")

    def with_entity(self, name: str) -> DataFrame:
        return self._by(self.entities, "entity", name)

    def with_topic(self, name: str) -> DataFrame:
        return self._by(self.topics, "topic", name)

    def by_id(self, event_id) -> DataFrame:
        return self.events.where(F.col("id") == event_id)

    def in_cluster(self, cluster_id: str) -> DataFrame:
        return self.events.where(F.col("cluster_id") == cluster_id).orderBy(F.desc_nulls_last("rank_total"), "ord")

    def has_hash(self, content_hash: str) -> bool:
        return not self.events.where(F.col("content_hash") == content_hash).isEmpty()

    def known(self, new: DataFrame) -> DataFrame:
        """Rows of new whose hash is stored."""
        return new.join(self.events.select("content_hash"), "content_hash", "left_semi")

    def count(self) -> int:
        return self.events.count()

    def without(self, ids: DataFrame) -> DataFrame:
        return self.events.join(ids.select("id"), "id", "left_anti")

    def per_day(self, days: int = 7) -> DataFrame:
        return self.events.groupBy(F.col("effective_at").cast("date").alias("day")).agg(F.count("*").alias("events")).orderBy(F.desc("day")).limit(days)

    def top(self, n: int = 10) -> DataFrame:
        return self.load().limit(n)


class Clusters:
    def __init__(self, clusters: DataFrame):
        self.clusters = clusters

    def all(self) -> DataFrame:
        return self.clusters.orderBy(F.desc_nulls_last("last_updated"), "id")

    def by_id(self, cluster_id: str) -> DataFrame:
        return self.clusters.where(F.col("id") == cluster_id)

    def with_entity(self, name: str) -> DataFrame:
        return self.clusters.where(F.array_contains("entity_keys", name)).orderBy(F.desc_nulls_last("last_updated"), "id")

    def like_entity(self, part: str) -> DataFrame:
        """Substring match over the keys, letters in either case."""
        return self.clusters.where(F.exists("entity_keys", lambda k: F.contains(F.lower(k), F.lit(part.lower())))).orderBy(F.desc_nulls_last("last_updated"), "id")

    def first_seen(self, start: Column, end: Column) -> DataFrame:
        return self.clusters.where(F.col("first_seen").between(start, end)).orderBy(F.desc("first_seen"), "id")
