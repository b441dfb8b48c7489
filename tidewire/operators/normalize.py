"""Raw items to assets and events: aliases, defaults, hashes, effective times (PRJ-01, -02, -06, -12..-15, -17, -18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, item_hash
from ..functions.text import clean_summary, first_of
from ..functions.time import effective_time, precision


def _field(df: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first non-empty one of the columns that df has."""
    got = [F.col(n).cast(kind) for n in names if n in df.columns]
    if not got:
        return F.lit(None).cast(kind)
    return first_of(*got) if kind == "string" else F.coalesce(*got)


def normalize_assets(items: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One asset for each item, whichever of the usual names its fields have.

    Missing titles and urls become empty, a missing tier 3, a missing category 'general', a missing collection time
    as_of. category, language and the date's reliability stay with the asset. keep names further columns to carry.
    """
    title = F.coalesce(_field(items, "title"), F.lit(""))
    summary = F.coalesce(_field(items, "summary", "description"), F.lit(""))
    url = F.coalesce(_field(items, "url", "link"), F.lit(""))
    published = _field(items, "publishedAt", "published_at", "pubDate")
    collected = F.coalesce(_field(items, "collectedAt", "collected_at", "fetchedAt", "fetched_at"), as_of.cast("string"))
    source_id = F.coalesce(_field(items, "sourceId", "source_id", "source"), F.lit("unknown"))
    return items.select(
        F.coalesce(_field(items, "id"), F.concat(source_id, F.lit("_"), item_hash(url))).alias("id"),
        F.coalesce(_field(items, "type"), F.lit("news")).alias("type"),
        title.alias("title"), summary.alias("summary"), url.alias("url"),
        content_hash(title, url, summary, F.coalesce(published, F.lit(""))).alias("content_hash"),
        published.alias("published_at"), collected.alias("collected_at"),
        effective_time(published, collected).alias("effective_at"), precision(published).alias("time_precision"),
        F.struct(F.coalesce(_field(items, "sourceName", "source_name"), source_id).alias("name"), F.coalesce(_field(items, "tier", "source_tier", kind="int"), F.lit(3)).alias("tier"), F.coalesce(_field(items, "source_url"), F.lit("")).alias("url")).alias("source"),
        source_id.alias("source_id"),
        F.coalesce(_field(items, "category"), F.lit("general")).alias("category"),
        F.coalesce(_field(items, "language"), F.lit("en")).alias("language"),
        F.coalesce(_field(items, "dateReliability", "date_reliability"), F.lit("normal")).alias("date_reliability"),
        _field(items, "ord", kind="bigint").alias("ord"),
        *keep,
    )


def to_events(assets: DataFrame) -> DataFrame:
    """Scored assets as stored events; source fields flat, entities and topics as arrays, category and type kept."""
    empty = F.array().cast("array<string>")
    has = lambda c, kind: F.col(c).cast(kind) if c in assets.columns else F.lit(None).cast(kind)
    return assets.select(
        "id", "type", "title", "summary", "url", "content_hash",
        F.col("published_at").try_cast("timestamp").alias("published_at"), F.col("collected_at").try_cast("timestamp").alias("collected_at"),
        F.col("effective_at").try_cast("timestamp").alias("effective_at"), "time_precision",
        has("total_score", "double").alias("rank_total"), has("tier_label", "string").alias("rank_tier"),
        F.col("source.name").alias("source_name"), F.col("source.tier").alias("source_tier"), F.col("source.url").alias("source_url"), "source_id",
        has("importance", "string").alias("curation_importance"), has("note", "string").alias("curation_note"),
        F.coalesce(has("entities", "array<string>"), empty).alias("entities"), F.coalesce(has("topics", "array<string>"), empty).alias("topics"),
        has("cluster_id", "string").alias("cluster_id"), F.array("id").alias("asset_ids"),
        has("metadata", "map<string,string>").alias("metadata"), "category", has("event_type", "string").alias("event_type"), "language", "ord",
    )


def nest_event(events: DataFrame) -> DataFrame:
    """Flat stored rows as documents with rank, curation, source, sources and timeline structs."""
    source = F.struct(F.col("source_name").alias("name"), F.col("source_tier").alias("tier"), F.col("source_url").alias("url"))
    return events.withColumns({
        "rank": F.struct(F.coalesce("rank_total", F.lit(0.0)).alias("total_score"), F.coalesce("rank_tier", F.lit("skip")).alias("tier_label")),
        "curation": F.struct(F.col("curation_importance").alias("importance"), F.col("curation_note").alias("note")),
        "source": source, "sources": F.array(source), "timeline": F.struct(F.col("published_at").alias("published"), F.col("collected_at").alias("collected")),
    })


def curated_score(importance: Column) -> Column:
    """The score of a curated item by its section."""
    return F.when(importance == "deep", 92).when(importance == "important", 70).when(importance == "brief", 50).otherwise(0)


def domain_of_source(source: Column, prefixes: dict[str, list[str]], default: str = "industry") -> Column:
    """The first domain one of whose prefixes starts the lower-cased source name."""
    out = F.lit(default)
    low = F.lower(F.coalesce(source, F.lit("")))
    for domain, starts in reversed(list(prefixes.items())):
        hit = F.lit(False)
        for s in starts:
            hit = hit | low.startswith(s.lower())
        out = F.when(hit, domain).otherwise(out)
    return out


def domain_paths(domain: Column, kind: Column, domains: dict[str, dict[str, str]], default: str) -> Column:
    """(base, baseline): the output folders of a domain, those of production unless kind says otherwise. A null domain is the default one; an unknown one is an error.

    domains: name -> production, test, baseline.
    """
    name = F.coalesce(domain, F.lit(default))
    pick = lambda key: reduce(lambda out, d: F.when(name == d, F.lit(domains[d].get(key))).otherwise(out), domains, F.lit(None).cast("string"))
    base = F.when(F.coalesce(kind, F.lit("production")) == "production", pick("production")).otherwise(pick("test"))
    known = F.struct(base.alias("base"), pick("baseline").alias("baseline"))
    return F.when(name.isin(*domains), known).otherwise(F.raise_error(F.concat(F.lit("unknown domain: "), name)))


def summary_column(raw: Column) -> Column:
    return clean_summary(raw)
