"""Clustering of events: entity overlap, fingerprints, title pairs (JON-06, STR-F7, STR-F8, WIN-06, SNK-19).

cluster() links what the rules link, in any order: three candidate generators, verification, connected components; clusters.Store does so over
many batches. cluster_in_order() is the first match in order, where an event joins the first cluster that matches and widens it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STOP_WORDS, Scoring
from ..functions.text import bigrams, folded, title_keywords, utf16_sorted
from ..functions.time import seventh_day_week
from .components import connected_components
from .greedy import cluster_in_order
from .scoring import entities, event_type
from .similar import similar_sets

__all__ = ["cluster", "cluster_fingerprint", "cluster_in_order", "cluster_rows", "event_fingerprint", "similar_sets"]


def cluster_fingerprint(names: Column, kind: Column, keywords: Column, week: Column) -> Column:
    """Sorted entities, type, sorted keywords and week in one key; null where there are neither entities nor keywords."""
    key = F.concat_ws("\x00", F.array_join(utf16_sorted(names), ","), F.coalesce(kind, F.lit("")), F.array_join(utf16_sorted(keywords), ","), F.coalesce(week, F.lit("")))
    return F.when((F.size(names) > 0) | (F.size(keywords) > 0), key)


def event_fingerprint(title: Column, published: Column, cfg: Scoring = Scoring()) -> Column:
    """entities|type|up to three keywords|week of one title. Entities in every lexicon tier, sorted, 'unknown' without any."""
    low = F.lower(F.coalesce(title, F.lit("")))
    names = entities(low, cfg.entity_tiers)
    words = F.slice(F.filter(title_keywords(title), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 1)), 1, 3)
    known = F.when(F.size(names) > 0, F.array_join(utf16_sorted(names), "+")).otherwise("unknown")
    return F.concat_ws("|", known, event_type(F.coalesce(title, F.lit("")), cfg), F.array_join(words, ","), seventh_day_week(published))


def cluster(events: DataFrame, entity_share: float = 0.5, title_share: float = 0.7) -> DataFrame:
    """(id, cluster_id): least id of the component. events: id bigint, title, entities, fingerprint (nullable)."""
    names = events.select("id", folded(F.col("entities")).alias("names"))
    titles = events.select("id", bigrams(F.col("title")).alias("pairs"))
    by_name = similar_sets(names, "id", "names", entity_share, links=True)
    by_title = similar_sets(titles, "id", "pairs", title_share, links=True)
    keyed = events.where("fingerprint <> ''")
    first = keyed.groupBy("fingerprint").agg(F.min("id").alias("a"))
    by_key = keyed.join(first, "fingerprint").where("a <> id").select("a", F.col("id").alias("b"))
    parts = connected_components(by_name.union(by_title).union(by_key))
    return events.select("id").join(parts, events["id"] == parts["node"], "left").select("id", F.coalesce("component", "id").alias("cluster_id"))


def cluster_rows(events: DataFrame) -> DataFrame:
    """One row for each cluster: title of its best score (else of its first event), count, entities, first and last time."""
    rows = events.where("cluster_id is not null")
    best = F.max_by("title", F.when(F.col("rank_total").isNotNull(), F.struct("rank_total", -F.col("ord"))))
    totals = rows.groupBy("cluster_id").agg(
        F.coalesce(best, F.min_by("title", "ord")).alias("title"), F.count("*").alias("event_count"), F.min("effective_at").alias("first_seen"), F.max("effective_at").alias("last_updated")
    )
    # an entity is one row of a cluster before the list is made
    names = rows.select("cluster_id", F.explode("entities").alias("name")).distinct().groupBy("cluster_id").agg(F.array_sort(F.collect_list("name")).alias("entity_keys"))
    none = F.array().cast("array<string>")
    return totals.join(names, "cluster_id", "left").select("cluster_id", "title", "event_count", F.coalesce("entity_keys", none).alias("entity_keys"), "first_seen", "last_updated")
