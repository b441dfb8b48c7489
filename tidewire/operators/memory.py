"""Editorial memory: stories, day snapshots, rejections (SNK-10..-15, AGG-10..-13, JON-15, FLT-20, STR-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("emerging", "developing", "peak", "follow-up", "stale")


def rollup_stories(mentions: DataFrame) -> DataFrame:
    """One row for each story_key: entity, first and last day, distinct event ids, latest non-empty title, mentions. mentions: story_key, entity, event_id, title, date, ord."""
    late = F.struct("date", "ord")
    return mentions.groupBy("story_key").agg(
        F.max_by("entity", late).alias("entity"), F.max_by("title", F.when(F.coalesce("title", F.lit("")) != "", late)).alias("title"),
        F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.array_sort(F.collect_set("event_id")).alias("event_ids"), F.lit("emerging").alias("state"),
    )


def track(stories: DataFrame, mentions: DataFrame) -> DataFrame:
    """stories after new mentions: spans widen, ids are united, states stay."""
    new = rollup_stories(mentions)
    both = stories.alias("s").join(new.alias("n"), "story_key", "full_outer")
    union = F.array_sort(F.array_union(F.coalesce("s.event_ids", F.array().cast("array<string>")), F.coalesce("n.event_ids", F.array().cast("array<string>"))))
    return both.select(
        "story_key", F.coalesce("n.entity", "s.entity").alias("entity"), F.coalesce("n.title", "s.title").alias("title"), F.least("s.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("s.last_seen", "n.last_seen").alias("last_seen"), union.alias("event_ids"), F.coalesce("s.state", "n.state").alias("state"),
    )


def set_state(stories: DataFrame, changes: DataFrame) -> DataFrame:
    """stories with the states of changes (story_key, state)."""
    new = changes.select("story_key", F.col("state").alias("_new"))
    return stories.join(new, "story_key", "left").withColumn("state", F.coalesce("_new", "state")).drop("_new")


def lifecycle(last_seen: Column, first_seen: Column, events: Column, day: Column) -> Column:
    """A state by rule: stale after 7 quiet days, follow-up after 3, peak from 5 events, developing from 2, else emerging."""
    quiet = F.date_diff(day, last_seen)
    return F.when(quiet > 7, "stale").when(quiet > 3, "follow-up").when(events >= 5, "peak").when(events >= 2, "developing").otherwise("emerging")


def timeline(stories: DataFrame, story_events: DataFrame) -> DataFrame:
    """stories plus timeline: array of (date, title, url) by date."""
    t = story_events.groupBy("story_key").agg(F.array_sort(F.collect_list(F.struct("event_date", "event_title", "event_url"))).alias("timeline"))
    return stories.join(t, "story_key", "left")


def snapshot(candidates: DataFrame, date: Column, most: int = 20) -> DataFrame:
    """One row for a day: the ids of its first candidates, their entities and categories."""
    top = candidates.orderBy(F.desc("final_rank"), "ord").limit(most)
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("final_rank")).alias("r"), "ord", F.col("id").cast("string").alias("id")))), lambda x: x["id"])
    return top.agg(ids.alias("top_event_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("top_entities"), F.array_sort(F.collect_set("category")).alias("top_categories")).select(date.alias("date"), "*")


def put_snapshot(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """snapshots with new in place of those of its dates."""
    return snapshots.join(new.select("date"), "date", "left_anti").unionByName(new)


def prune(snapshots: DataFrame, before: Column, inclusive: bool = False) -> DataFrame:
    """Drop snapshots older than before; inclusive drops that day as well."""
    return snapshots.where(F.col("date") > before if inclusive else F.col("date") >= before)


def since(snapshots: DataFrame, day: Column) -> DataFrame:
    return snapshots.where(F.col("date") >= day).orderBy("date")


def rejection_history(rejections: DataFrame) -> DataFrame:
    """(event_id, history): its rejections, latest first."""
    by = F.reverse(F.array_sort(F.collect_list(F.struct("rejected_at", "reject_type", "reason"))))
    return rejections.groupBy("event_id").agg(by.alias("history"))
