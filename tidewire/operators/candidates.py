"""Candidate pools: resolve signals, rank, cap, truncate; lanes and their merge (EDT-01, -04..-06, WIN-02, -03, SRT-03..-06, JON-17, -18).

A lane is a column and part of every partition key, so all lanes are one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LANES, Editorial, Lane
from ..staging import staged
from .signals import category_cap, resolve, uncapped


def rank(events: DataFrame, signals: DataFrame, cfg: Editorial = Editorial(), scope: Sequence[str] = ()) -> DataFrame:
    """events that aren't held, with breaking, boost, final_rank, context_hints, signals and capped."""
    return category_cap(staged(_ranked(events, signals, cfg), "ranked"), cfg, scope)


def _ranked(events: DataFrame, signals: DataFrame, cfg: Editorial) -> DataFrame:
    got = resolve(signals, cfg)
    rows = events.join(got, F.col("id").cast("string") == F.col("event_id"), "left").drop("event_id")
    rows = rows.withColumns({"breaking": F.coalesce("breaking", F.lit(False)), "held": F.coalesce("held", F.lit(False)), "boost": F.coalesce("boost", F.lit(0))}).where("not held").drop("held")
    rows = rows.withColumn("final_rank", F.coalesce(F.col("rank_total").cast("double"), F.lit(0.0)) + F.col("boost"))
    return rows.withColumn("context_hints", F.coalesce("hints", F.array().cast("array<string>"))).drop("hints")


def truncate(ranked: DataFrame, most: int | str, scope: Sequence[str] = (), bound: int | None = None) -> DataFrame:
    """The first most uncapped rows of each scope by final_rank, with their place. most: a number or the name of a column.

    bound, the largest value of that column, is a literal limit: with it every task keeps its own first rows before the shuffle.
    """
    limit = F.col(most) if isinstance(most, str) else F.lit(most)
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("final_rank"), "ord"))
    rows = ranked.where("not capped").withColumn("place", place)
    return (rows if bound is None else rows.where(F.col("place") <= bound)).where(F.col("place") <= limit)


def build(events: DataFrame, signals: DataFrame, cfg: Editorial = Editorial()) -> DataFrame:
    """One pool of at most pool_size candidates. Its ordering needs only the pool: Spark takes the top rows of each partition first."""
    ranked = uncapped(staged(_ranked(events, signals, cfg), "ranked"), cfg)
    return ranked.orderBy(F.desc("final_rank"), "ord").limit(cfg.pool_size)


def lane_table(spark, lanes: Sequence[Lane] = LANES) -> DataFrame:
    """(lane, domain, lane_most, lane_no). A fallback lane is required."""
    if not any(x.domain == "__fallback__" for x in lanes):
        raise ValueError("lanes need a fallback lane (domain '__fallback__')")
    return spark.createDataFrame([(x.lane, x.domain, x.most, i) for i, x in enumerate(lanes)], "lane string, domain string, lane_most int, lane_no int")


def dispatch(events: DataFrame, lanes: Sequence[Lane] = LANES, domain: str = "domain") -> DataFrame:
    """events plus lane, lane_most, lane_no: the lane of the row's domain, else the fallback lane. Exactly one for each row."""
    table = lane_table(events.sparkSession, lanes)
    back = next((i, x) for i, x in enumerate(lanes) if x.domain == "__fallback__")
    named = table.where("domain <> '__fallback__'").withColumnRenamed("domain", "_domain")
    rows = events.join(named, F.col(domain) == F.col("_domain"), "left").drop("_domain")
    return rows.withColumns({"lane": F.coalesce("lane", F.lit(back[1].lane)), "lane_most": F.coalesce("lane_most", F.lit(back[1].most)), "lane_no": F.coalesce("lane_no", F.lit(back[0]))})


def run_lanes(events: DataFrame, signals: DataFrame, cfg: Editorial = Editorial()) -> DataFrame:
    """Each lane's candidates: ranked, capped and truncated inside the lane. Ranked rows are staged, as two branches read them."""
    ranked = staged(_ranked(events, signals, cfg), "ranked")
    bound = ranked.agg(F.max("lane_most").alias("most")).first()["most"]
    return truncate(uncapped(ranked, cfg, ["lane"]), "lane_most", ["lane"], bound)


def merge(candidates: DataFrame, most: int = 40, representation: bool = True, breaking_first: bool = True) -> DataFrame:
    """The merged pool with its position (from 1).

    With representation each lane's best row is protected: protected rows come first and stay even beyond most (0: 40).
    With breaking_first breaking rows precede others in each block.
    """
    most = most or 40
    best = F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("final_rank"), "ord")) == 1
    rows = candidates.withColumn("protected", best if representation else F.lit(False))
    order = [F.desc("protected"), *([F.desc("breaking")] if breaking_first else []), F.desc("final_rank"), F.col("lane_no"), F.col("ord")]
    # each lane holds at most lane_most candidates, so this window ranks a bounded pool
    whole = Window.partitionBy()
    rows = rows.withColumn("position", F.row_number().over(whole.orderBy(*order))).withColumn("n_protected", F.sum(F.col("protected").cast("int")).over(whole))
    return rows.where(F.col("position") <= F.greatest(F.lit(most), F.col("n_protected"))).drop("n_protected")


def lane_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("lane").agg(F.count("*").alias("candidates"))


def group_shares(candidates: DataFrame, group: str) -> DataFrame:
    """(group, n, share): a group's share of the pool."""
    counts = candidates.groupBy(group).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(group, "n", (F.col("n") / F.col("total")).alias("share"))
