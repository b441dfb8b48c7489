"""Row filters of collection and quarantine (FLT-01..FLT-16, SNK-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DROP_TITLE, DROP_URL, HARD_REJECT, KEEP_TITLE, NEUTRAL, RELEVANT, SOURCE_WHITELIST, TOPIC_KEYWORDS
from ..functions.text import has_any, has_any_word_or_part, lower_text
from ..functions.time import hours_between


def required(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose columns are neither null nor empty."""
    for c in cols or ("title", "url"):
        df = df.where(F.nullif(F.col(c), F.lit("")).isNotNull())
    return df


def recent(published: Column, as_of: Column, hours: Column | float = 24.0) -> Column:
    """Published within so many hours before as_of; undated rows pass."""
    hours = hours if isinstance(hours, Column) else F.lit(float(hours))
    return published.isNull() | (hours_between(as_of, published) <= hours)


def topical(tier: Column, needs_filter: Column, text: Column, terms: list[str] = TOPIC_KEYWORDS) -> Column:
    """Rows of tier 3 and beyond, and those of marked sources, must hold a topic term."""
    gated = (F.coalesce(tier, F.lit(3)) >= 3) | F.coalesce(needs_filter, F.lit(False))
    return ~gated | has_any(text, terms)


def on_day(published: Column, day: Column, from_hour: int = 18) -> Column:
    """Published on the target UTC day, or on the day before from this hour on; undated rows pass."""
    d = published.cast("date")
    return published.isNull() | (d == day) | ((d == F.date_sub(day, 1)) & (F.hour(published) >= from_hour))


def correct_dates(items: DataFrame, page_dates: DataFrame, day: Column, most_hours: float = 36.0) -> DataFrame:
    """items with published_at replaced by the page's own date where the days differ; rejected where it is too far from noon of day.

    page_dates: (url, page_date timestamp), one row for each url. Adds date_corrected and date_rejected.
    """
    joined = items.join(page_dates, "url", "left")
    differs = F.col("page_date").isNotNull() & (F.col("published_at").isNull() | (F.col("page_date").cast("date") != F.col("published_at").cast("date")))
    noon = day.cast("timestamp") + F.expr("interval 12 hours")
    return joined.withColumns({
        "date_corrected": differs, "date_rejected": differs & (F.abs(hours_between(noon, F.col("page_date"))) > most_hours),
        "published_at": F.when(differs, F.col("page_date")).otherwise(F.col("published_at")),
    }).drop("page_date")


def noise_reason(url: Column, title: Column, source_id: Column, on: bool = True, families: tuple[str, ...] = ("github", "atom")) -> Column:
    """Why a row of a code-hosting source is noise, or null: URL first, then titles to keep, then titles to drop."""
    if not on:
        return F.lit(None).cast("string")
    url, title = F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))
    any_of = lambda c, patterns: c.rlike("|".join(f"(?:{p})" for p in patterns))
    drop_title = F.lit(False)
    for p in DROP_TITLE:
        drop_title = drop_title | title.rlike(p)
    keep_title = F.lit(False)
    for p in KEEP_TITLE:
        keep_title = keep_title | title.rlike(p)
    ours = F.lower(F.coalesce(source_id, F.lit(""))).rlike("|".join(families))
    reason = F.when(any_of(url, DROP_URL), "url").when(keep_title, F.lit(None)).when(drop_title, "title")
    return F.when(ours, reason)


def quarantine(held: DataFrame, new: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """The quarantine after a run: rows that have not expired, and the new ones, which replace those of the same id."""
    kept = held.where(F.col("expires_at") >= as_of).join(new.select("id"), "id", "left_anti")
    fresh = new.withColumns({"quarantined_at": as_of, "expires_at": as_of + F.make_dt_interval(F.lit(days))})
    return kept.unionByName(fresh.select(*kept.columns))


def by_url_status(items: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, removed with reason): items by a table of probed urls (url, ok boolean, reason). Unprobed urls are removed."""
    joined = items.join(status, "url", "left")
    gone = joined.where(~F.coalesce("ok", F.lit(False))).withColumn("reason", F.coalesce("reason", F.lit("not probed"))).drop("ok")
    return joined.where("ok").drop("ok", "reason"), gone


def relevance_reason(title: Column, summary: Column, event_type: Column, source: Column, relevant: list[str] = RELEVANT, hard: list[str] = HARD_REJECT, neutral: list[str] = NEUTRAL, whitelist: list[str] = SOURCE_WHITELIST) -> Column:
    """Null where an event is relevant, else 'non_ai_keyword', 'neutral_only' or 'no_relevance'.

    Hard terms are compared as they are written with the lower-cased text, so capitals among them never match.
    """
    text = lower_text(title, summary, event_type)
    as_written = lambda terms: _flat_or(text, terms)
    passes = has_any(F.lower(F.coalesce(source, F.lit(""))), whitelist) | has_any_word_or_part(text, relevant)
    return F.when(passes, F.lit(None)).when(as_written(hard), "non_ai_keyword").when(as_written(neutral), "neutral_only").otherwise("no_relevance")


def _flat_or(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def story_signal(state: Column, last_seen: Column, day: Column, days: int = 3) -> Column:
    """STALE for a stale story, FOLLOW_UP for one seen within so many days, else null."""
    return F.when(state == "stale", "STALE").when(last_seen >= F.date_sub(day, days), "FOLLOW_UP")
