"""Source health and run metrics (AGG-19..-21, WIN-09, SNK-16, -18, SRC-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(sources: DataFrame) -> DataFrame:
    """Sources that aren't disabled."""
    return sources.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("status", F.lit("active")) != "disabled"))


def registry_split(sources: DataFrame) -> DataFrame:
    status = F.when(~F.coalesce("enabled", F.lit(True)), "disabled").otherwise(F.coalesce("status", F.lit("active")))
    return sources.groupBy(status.alias("status")).agg(F.count("*").alias("sources"))


def streaks(runs: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, ok, failed, streak, last_ok, last_failed): counts, and the length of the run of failures at the end. runs: key, ts, ok, ord.

    The streak is the failures after the last success, so two aggregates do; nothing is sorted.
    """
    last = runs.groupBy(key).agg(F.max(F.when(F.col("ok"), F.struct("ts", "ord"))).alias("last"))
    rows = runs.join(last, key)
    after = F.col("last").isNull() | (F.struct("ts", "ord") > F.col("last"))
    return rows.groupBy(key).agg(
        F.count_if(F.col("ok")).alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.col("ok") & after).alias("streak"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_failed"),
    )


def longest_streaks(runs: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, longest): the longest run of failures, by gaps and islands."""
    w = Window.partitionBy(key).orderBy("ts", "ord")
    islands = runs.withColumn("island", F.sum(F.col("ok").cast("int")).over(w)).where("not ok").groupBy(key, "island").agg(F.count("*").alias("n"))
    return islands.groupBy(key).agg(F.max("n").alias("longest"))


def alerts(health: DataFrame, warn: int = 3, critical: int = 7) -> DataFrame:
    level = F.when(F.col("streak") >= critical, "critical").when(F.col("streak") >= warn, "warning")
    return health.withColumn("alert", level).where("alert is not null")


def collection_summary(results: DataFrame) -> DataFrame:
    """One row over per-source results (status, n_raw, n_kept, n_date_removed)."""
    return results.agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "disabled").alias("disabled"),
        F.coalesce(F.sum("n_raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("n_kept"), F.lit(0)).alias("deduped"), F.coalesce(F.sum("n_date_removed"), F.lit(0)).alias("date_removed"),
    )


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, object]:
    """df with metrics gathered while it runs; the second value gives them afterwards (.get)."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measures.items()]), o


def run_table(runs: DataFrame, most: int = 30) -> DataFrame:
    """The latest runs (run_id, started_at, status, counts) for a report."""
    return runs.orderBy(F.desc("started_at"), "run_id").limit(most)
