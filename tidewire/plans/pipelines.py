"""The two batch pipelines and the editorial pass, composed of operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Editorial, Scoring
from ..functions.hashing import stable_id
from ..functions.text import lower_text, title_keywords
from ..functions.time import iso_week
from ..staging import staged
from ..operators import candidates, cluster, dedup, filters, lineage, normalize, scoring, signals, weekly
from ..operators.clusters import Store


@dataclass
class Ingested:
    events: DataFrame
    quarantined: DataFrame
    edges: DataFrame
    clusters: DataFrame
    bridge: DataFrame


def ingest(items: DataFrame, stored: DataFrame, as_of: Column, cfg: Scoring = Scoring(), store: Store | None = None, number: int = 0) -> Ingested:
    """Raw items (with ord) to new events: normalize, quarantine noise, entities, type, clusters, scores, dedup, insert-if-absent.

    stored: id and content_hash of the events kept so far. Each table of the result is one sink. With a store of clusters, events that aren't
    stored yet join its clusters as batch number, and the store is written; else they make clusters among themselves, whose ids come from their least event's.
    """
    assets = normalize.normalize_assets(filters.required(items), as_of)
    assets = assets.withColumn("reason", filters.noise_reason(F.col("url"), F.col("title"), F.col("source_id")))
    noise, assets = assets.where("reason is not null"), assets.where("reason is null").drop("reason")
    raw = F.concat_ws(" ", "title", "summary")
    assets = assets.withColumns({"entities": scoring.entities(lower_text("title", "summary"), cfg.entity_tiers), "event_type": scoring.event_type(raw, cfg), "keywords": F.slice(title_keywords(F.col("title"), split_words=True), 1, 3), "week": iso_week(F.coalesce(F.col("effective_at").try_cast("timestamp"), as_of))})
    assets = assets.withColumn("fingerprint", cluster.cluster_fingerprint(F.col("entities"), F.col("event_type"), F.col("keywords"), F.col("week")))
    rows = assets.select("id", "title", "entities", "fingerprint")
    if store is None:
        parts = cluster.cluster(rows).dropDuplicates(["id"]).select("id", stable_id("c", "cluster_id").alias("cluster_id"))
    else:
        parts = store.add(rows.join(stored.select("id").distinct(), "id", "left_anti"), number).assigned
    assets = assets.join(parts, "id", "left")
    scored = scoring.cap_sources(scoring.score(assets, as_of, cfg), cfg)
    unique = dedup.keep_first(scored, "content_hash")
    events = normalize.to_events(dedup.insert_if_absent(stored, unique))
    return Ingested(events, noise, lineage.duplicate_edges(assets), cluster.cluster_rows(events), dedup.bridge(events, "entities", "entity"))


def editorial(events: DataFrame, snapshots: DataFrame | None, stories: DataFrame | None, day: Column, cfg: Editorial = Editorial(), most: int = 40) -> DataFrame:
    """Events (with domain) to the merged pool: dispatch to lanes, signals inside lanes, candidates, merge."""
    rows = staged(candidates.dispatch(events), "lanes")  # every rule reads them
    rules = [lambda e: signals.breaking(e, cfg, ["lane"])]
    if snapshots is not None:
        rules.append(lambda e: signals.memory(e, snapshots, day, cfg))
    if stories is not None:
        rules.append(lambda e: signals.story_dedup(e, stories, day, cfg))
    return candidates.merge(candidates.run_lanes(rows, signals.collect(rows, rules), cfg), most)


def weekly_report(events: DataFrame, clusters: DataFrame | None, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(rollup, top events) of the week before as_of."""
    rows = weekly.in_week(events, as_of)
    rollup = weekly.by_cluster(rows, clusters)
    return rollup, weekly.top_events(rows, rollup)
