"""Judgment: qualification, backfill, prioritization, production limits (EDT-07..-10, FLT-19, SCO-14, -15, AGG-14, SRT-07, JON-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Editorial


class InvalidBudget(ValueError):
    code = "INVALID_BUDGET"


def qualify(events: DataFrame, signals: DataFrame, rejections: DataFrame | None = None) -> DataFrame:
    """events plus reject_type (null: qualified), reject_reason and priority_weight.

    In this order: content rejection, an earlier hard rejection, breaking passes, verification passes, a stale story, pass.
    rejections: (event_id, reject_type, reason, rejected_at) of earlier runs.
    """
    has = lambda s: F.coalesce(F.bool_or(F.col("subtype") == s), F.lit(False))
    first = lambda s: F.min_by(F.when(F.col("subtype") == s, F.col("reason")), F.when(F.col("subtype") == s, F.col("rule_no")))
    flags = signals.groupBy("event_id").agg(
        has("CONTENT_REJECTION").alias("content"), has("BREAKING").alias("breaking"), has("VERIFICATION").alias("verified"), has("STALE").alias("stale"),
        first("CONTENT_REJECTION").alias("content_reason"), first("STALE").alias("stale_reason"),
        F.coalesce(F.sum(F.when(F.col("phase") == "RANK", F.col("weight"))), F.lit(0)).alias("weight_sum"),
    )
    rows = events.join(flags, F.col("id").cast("string") == F.col("event_id"), "left").drop("event_id")
    if rejections is not None:
        before = rejections.where("reject_type = 'hard'").groupBy("event_id").agg(F.max_by("reason", "rejected_at").alias("before"))
        rows = rows.join(before, F.col("id").cast("string") == F.col("event_id"), "left").drop("event_id")
    else:
        rows = rows.withColumn("before", F.lit(None).cast("string"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.when(no("content") | F.col("before").isNotNull(), "hard").when(no("breaking") | no("verified"), F.lit(None)).when(no("stale"), "contextual")
    reason = F.when(no("content"), F.col("content_reason")).when(F.col("before").isNotNull(), F.concat(F.lit("previously rejected: "), F.col("before"))).when(kind == "contextual", F.col("stale_reason"))
    out = rows.withColumns({"reject_type": kind, "reject_reason": reason, "priority_weight": F.coalesce(F.col("weight_sum"), F.lit(0)), "is_breaking": no("breaking")})
    return out.drop("content", "breaking", "verified", "stale", "content_reason", "stale_reason", "weight_sum", "before")


def rejection_log(judged: DataFrame, at) -> DataFrame:
    """Rows to append to the rejection table."""
    return judged.where("reject_type is not null").select(F.col("id").cast("string").alias("event_id"), F.col("title").alias("event_title"), F.col("reject_reason").alias("reason"), "reject_type", "source_name", at.alias("rejected_at"))


def backfill(qualified: DataFrame, pool: DataFrame, cfg: Editorial = Editorial()) -> DataFrame:
    """qualified plus backfilled; where there are fewer than backfill_below rows, up to backfill_most of pool are added.

    pool has qualified's columns, its rows are tried by descending score. They get the priority weight -999. The count is part of the plan:
    one row of it is joined to the few rows that could be added.
    """
    free = pool.where(F.coalesce("rank_total", F.lit(0)) >= cfg.backfill_score).join(qualified.select("id"), "id", "left_anti").dropDuplicates(["id"])
    few = free.orderBy(F.desc("rank_total"), "ord").limit(cfg.backfill_most)
    n = qualified.agg(F.count("*").alias("_n"))
    added = few.crossJoin(F.broadcast(n)).where(F.col("_n") < cfg.backfill_below).drop("_n").withColumns({"priority_weight": F.lit(-999).cast("bigint"), "backfilled": F.lit(True)})
    return qualified.withColumn("backfilled", F.lit(False)).withColumn("priority_weight", F.col("priority_weight").cast("bigint")).unionByName(added, allowMissingColumns=True)


def prioritize(qualified: DataFrame, budget: int = 40, breaking_ids: DataFrame | None = None) -> DataFrame:
    """The first budget rows by final_rank: priority weight, score, and 50 for each breaking signal.

    breaking_ids: (event_id, n) of the prioritization signals; without it, is_breaking counts once.
    """
    if budget <= 0:
        raise InvalidBudget("budget must be over 0")
    if breaking_ids is not None:
        rows = qualified.join(breaking_ids, F.col("id").cast("string") == F.col("event_id"), "left").drop("event_id")
        bonus = 50 * F.coalesce("n", F.lit(0))
    else:
        rows, bonus = qualified, F.when(F.coalesce("is_breaking", F.lit(False)), 50).otherwise(0)
    rows = rows.withColumn("final_rank", F.col("priority_weight") + F.coalesce(F.col("rank_total").cast("double"), F.lit(0.0)) + bonus)
    return rows.orderBy(F.desc("final_rank"), "ord").limit(budget)


def metrics(judged: DataFrame) -> DataFrame:
    """One row: inputs, qualified, hard and contextual rejections."""
    return judged.agg(F.count("*").alias("total_input"), F.count_if(F.col("reject_type").isNull()).alias("qualified"), F.count_if(F.col("reject_type") == "hard").alias("hard_rejected"), F.count_if(F.col("reject_type") == "contextual").alias("contextual_rejected"))


def production_violations(judged: DataFrame, cfg: Editorial = Editorial()) -> DataFrame:
    """(violation, ratio): the share of hard rejections, and each source's share of the input, where over their limits."""
    m = metrics(judged).withColumn("ratio", F.col("hard_rejected") / F.greatest(F.col("hard_rejected") + F.col("qualified"), F.lit(1)))
    hard = m.where(F.col("ratio") > cfg.non_ai_ratio).select(F.lit("non_ai_ratio").alias("violation"), "ratio")
    by = judged.groupBy(F.coalesce(F.nullif("source_name", F.lit("")), F.lit("unknown")).alias("s")).agg(F.count("*").alias("n"))
    shares = by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).withColumn("ratio", F.col("n") / F.col("total"))
    return hard.unionByName(shares.where(F.col("ratio") > cfg.single_source_ratio).select(F.concat(F.lit("single_source_"), "s").alias("violation"), "ratio"))
