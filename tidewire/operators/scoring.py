"""Entities, event types and scores as column expressions; tiers and source caps (PRJ-24, SCO-01..-08, WIN-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HOT_TOPICS, MODEL_NAMES, SOTA_WORDS, EntityTier, EventType, Scoring
from ..functions.text import has_any, lower_text, matched
from ..functions.time import hours_between
from ..staging import staged
from .caps import past_cap


def entities(text: Column, tiers: tuple[EntityTier, ...]) -> Column:
    """Distinct lexicon entities in lower-cased text, in lexicon order."""
    return F.array_distinct(matched(text, [e for t in tiers for e in t.entities]))


def authority(tier: Column, cfg: Scoring) -> Column:
    out = F.lit(0)
    for t, score in cfg.tier_scores.items():
        out = F.when(F.coalesce(tier, F.lit(3)) == t, score).otherwise(out)
    return out


def timeliness(published: Column, as_of: Column, reliability: Column, cfg: Scoring) -> Column:
    """By age; rows without a date get the oldest score; halved, rounded down, where dates are unreliable."""
    age = hours_between(as_of, published)
    score = F.lit(cfg.oldest)
    for most, points in reversed(cfg.freshness):
        score = F.when(age <= most, points).otherwise(score)
    halved = F.when(reliability == "low", F.floor(score / 2).cast("int")).otherwise(score)
    return F.when(published.isNull(), cfg.oldest).otherwise(halved)


def entity_weight(text: Column, cfg: Scoring, most: int = 12) -> Column:
    """The best tier that occurs, and a bonus for two or more hits under a best of 10. A name in two tiers is two hits."""
    best, hits = F.lit(0), F.lit(0)
    for tier in cfg.entity_tiers:
        n = F.lit(0)
        for e in tier.entities:
            n = n + F.contains(text, F.lit(e.lower())).cast("int")
        best = F.greatest(best, F.when(n > 0, tier.score).otherwise(0))
        hits = hits + n
    bonus = F.when((hits >= 2) & (best >= 10), cfg.multi_entity_bonus).otherwise(0)
    return F.least(best + bonus, F.lit(most))


def type_matches(raw: Column, low: Column, kind: EventType) -> Column:
    out = has_any(low, kind.keywords)
    return out | raw.rlike(kind.pattern) if kind.pattern else out


def event_type_score(raw: Column, cfg: Scoring) -> Column:
    """The best score among matching types; the general score if none."""
    low = F.lower(raw)
    return F.greatest(F.lit(cfg.general_score), *[F.when(type_matches(raw, low, k), k.score).otherwise(0) for k in cfg.event_types])


def event_type(raw: Column, cfg: Scoring) -> Column:
    """The matching type of highest score, the first declared on ties; 'general' if none."""
    low = F.lower(raw)
    out = F.lit("general")
    for k in reversed(sorted(cfg.event_types, key=lambda k: -k.score)):
        out = F.when(type_matches(raw, low, k), k.name).otherwise(out)
    return out


def quantitative(raw: Column) -> Column:
    """Money 2, a rate 1, a magnitude 1."""
    money = raw.rlike(r"\$[\d.]+\s*[bBmM]") | raw.rlike(r"[\d.]+\s*亿")
    rate = raw.rlike(r"[\d.]+\s*%") | raw.rlike(r"(?i)\d+x\s*faster")
    size = raw.rlike(r"(?i)\d+\s*(billion|million|百万|千万)")
    return F.least(money.cast("int") * 2 + rate.cast("int") + size.cast("int"), F.lit(6))


def academic(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.least(has_any(low, HOT_TOPICS).cast("int") + has_any(low, MODEL_NAMES).cast("int") * 2 + has_any(low, SOTA_WORDS).cast("int") * 2, F.lit(5))


def collection_score(title: Column, text: Column, tier: Column, cfg: Scoring, most: int = 35) -> Column:
    """The score that collection gives before ranking: entities, type, quantities (accuracy words count as rates) and academic signals."""
    low = F.lower(text)
    rate = text.rlike(r"[\d.]+\s*%") | text.rlike(r"(?i)\d+x\s*faster") | text.rlike(r"(?i)accuracy|准确率")
    money = text.rlike(r"\$[\d.]+\s*[bBmM]") | text.rlike(r"[\d.]+\s*亿")
    size = text.rlike(r"(?i)\d+\s*(billion|million|百万|千万|亿)")
    quantities = F.least(money.cast("int") * 2 + rate.cast("int") + size.cast("int"), F.lit(6))
    return F.least(entity_weight(low, cfg) + event_type_score(text, cfg) + quantities + academic(title), F.lit(most))


def score(assets: DataFrame, as_of: Column, cfg: Scoring = Scoring()) -> DataFrame:
    """assets plus factors, base_score, bonus_score, total_score (at most 100) and tier_label before caps."""
    raw = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    published = F.col("published_at").try_cast("timestamp")
    tier = F.col("source.tier") if "source" in assets.columns else F.col("tier")
    reliability = F.col("date_reliability") if "date_reliability" in assets.columns else F.lit("normal")
    parts = {
        "authority": authority(tier, cfg), "timeliness": timeliness(published, as_of, reliability, cfg), "entity": entity_weight(lower_text("title", "summary"), cfg),
        "event_type": event_type_score(raw, cfg), "quantitative": quantitative(raw), "academic": academic(F.col("title")),
    }
    out = assets.withColumn("factors", F.struct(*[v.cast("int").alias(k) for k, v in parts.items()]))
    f = lambda k: F.col(f"factors.{k}")
    base, bonus = f("authority") + f("timeliness"), f("entity") + f("event_type") + f("quantitative") + f("academic")
    out = out.withColumns({"base_score": base, "bonus_score": bonus, "total_score": F.least(base + bonus, F.lit(100)), "age_filtered": F.coalesce(hours_between(as_of, published) > cfg.skip_after_hours, F.lit(False))})
    label = F.when(F.col("age_filtered"), "skip").when(F.col("total_score") >= cfg.auto, "auto").when(F.col("total_score") >= cfg.review, "review").otherwise("skip")
    return out.withColumn("tier_label", label)


def cap_sources(scored: DataFrame, cfg: Scoring = Scoring(), id_order: str = "ord") -> DataFrame:
    """tier_label becomes 'skip' beyond a source's cap, by descending score, then id_order (unique); rows that were skipped don't count.

    The scored rows are staged: both reads would else evaluate every rule, inlined into one piece of generated code.
    """
    scored = staged(scored, "scored")
    source = F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.nullif(F.col("source.name"), F.lit("")) if "source" in scored.columns else F.lit(None), F.lit("unknown"))
    cap = F.lit(cfg.default_cap)
    for name, n in cfg.source_caps.items():
        cap = F.when(source == name, n).otherwise(cap)
    most = max(cfg.default_cap, *cfg.source_caps.values()) if cfg.source_caps else cfg.default_cap
    rows = past_cap(scored, {"source": source}, "total_score", id_order, cap, most, F.col("tier_label").isin("auto", "review"))
    return rows.withColumn("tier_label", F.when(F.col("past_cap"), "skip").otherwise(F.col("tier_label"))).drop("past_cap")


def tier_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.count_if(F.col("tier_label") == t).alias(t) for t in ("auto", "review", "skip")])


def evidence_score(found: Column, wanted: Column, trust: Column, duplicates: Column) -> Column:
    """The mean of keyword share, authority (trust of 5, 0.3 unknown) and cross-checks (of 3), two decimals."""
    keyword = F.when(wanted > 0, found / wanted).otherwise(F.lit(0.0))
    authority_part = F.coalesce(trust / 5, F.lit(0.3))
    return F.round((keyword + authority_part + F.least(duplicates / 3, F.lit(1.0))) / 3, 2)
