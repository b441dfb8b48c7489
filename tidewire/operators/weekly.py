"""Weekly rollup and reports (AGG-02..-04, WIN-04, JON-13, SRT-08, SNK-05, -09, REN-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_id


def week_bounds(as_of: Column) -> tuple[Column, Column]:
    """The half-open days of the report: seven days before as_of's day up to the day after it."""
    day = as_of.cast("date")
    return F.date_sub(day, 7).cast("timestamp"), F.date_add(day, 1).cast("timestamp")


def in_week(events: DataFrame, as_of: Column) -> DataFrame:
    start, end = week_bounds(as_of)
    return events.where((F.col("effective_at") >= start) & (F.col("effective_at") < end))


def by_cluster(events: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One row for each cluster, and one for each day of events without a cluster.

    cluster_id, title (the cluster's own, else its best event's), importance, event_count, top_score, event_ids by
    score. A missing score is 0; a missing time is the day 'unknown'. Only ids are listed, not whole events.
    """
    day = F.coalesce(F.date_format("effective_at", "yyyy-MM-dd"), F.lit("unknown"))
    score = F.coalesce("rank_total", F.lit(0.0))
    rows = events.select(F.coalesce("cluster_id", F.concat(F.lit("unclustered-"), day)).alias("cid"), F.col("cluster_id").isNull().alias("loose"), "id", "title", score.alias("score"), "ord")
    out = rows.groupBy("cid").agg(
        F.max("loose").alias("loose"), F.count("*").alias("event_count"), F.max("score").alias("top_score"), F.max_by("title", F.struct("score", -F.col("ord"))).alias("top_title"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "id"))), lambda x: x["id"]).alias("event_ids"),
    )
    if clusters is not None:
        out = out.join(clusters.select(F.col("id").alias("cid"), F.col("title").alias("own_title"), F.col("importance").alias("own_importance")), "cid", "left")
    else:
        out = out.withColumns({"own_title": F.lit(None).cast("string"), "own_importance": F.lit(None).cast("string")})
    return out.select(
        F.col("cid").alias("cluster_id"), F.when(F.col("loose"), F.lit("Unclustered")).otherwise(F.coalesce(F.nullif("own_title", F.lit("")), F.nullif("top_title", F.lit("")), F.lit("Untitled"))).alias("title"),
        F.when(F.col("loose"), "low").otherwise(F.coalesce("own_importance", F.lit("medium"))).alias("importance"), "event_count", "top_score", "event_ids",
    )


def top_events(events: DataFrame, clusters: DataFrame, per_cluster: int = 3, most_clusters: int = 10) -> DataFrame:
    """The best events of the best clusters, with cluster_place and place."""
    best = clusters.orderBy(F.desc("top_score"), "cluster_id").limit(most_clusters)
    best = best.withColumn("cluster_place", F.row_number().over(Window.orderBy(F.desc("top_score"), "cluster_id"))).select("cluster_id", F.col("title").alias("cluster_title"), "cluster_place")
    day = F.coalesce(F.date_format("effective_at", "yyyy-MM-dd"), F.lit("unknown"))
    rows = events.withColumn("cluster_id", F.coalesce("cluster_id", F.concat(F.lit("unclustered-"), day))).join(best, "cluster_id")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.coalesce("rank_total", F.lit(0.0))), "ord"))
    return rows.withColumn("place", place).where(F.col("place") <= per_cluster)


def total_events(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("events"), F.count("*").alias("clusters"))


def article_skeleton(top: DataFrame, heading: str = "Weekly report") -> DataFrame:
    """(markdown): one text of a bounded report; its rows are the top events only."""
    line = F.concat(F.lit("- ["), F.coalesce("title", F.lit("")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")"))
    parts = top.groupBy("cluster_place", "cluster_title").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    text = parts.select("cluster_place", F.concat(F.lit("## "), "cluster_title", F.lit("\n\n"), F.array_join("lines", "\n")).alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cluster_place", "part"))), lambda x: x["part"])
    return text.agg(F.concat(F.lit(f"# {heading}\n\n"), F.array_join(ordered, "\n\n")).alias("markdown"))


def report_row(clusters: DataFrame, as_of: Column, article_chars: Column, script_chars: Column) -> DataFrame:
    """The row to append to the table of weekly reports."""
    start, end = week_bounds(as_of)
    t = total_events(clusters)
    return t.select(stable_id("week_", start).alias("id"), start.cast("date").alias("week_start"), end.cast("date").alias("week_end"), F.col("clusters").alias("cluster_count"), F.col("events").alias("event_count"), article_chars.alias("article_chars"), script_chars.alias("script_chars"), as_of.alias("created_at"))
