"""Caps on how many rows of a group count, without a window over whole groups (WIN-01, WIN-02)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def past_cap(rows: DataFrame, keys: Mapping[str, Column], score: str, order: str, cap: Column, bound: int, counted: Column) -> DataFrame:
    """rows plus past_cap: whether a counted row comes after the first cap ones of its keys, by descending score (nulls last), then order.

    Only the cap-th row of each group is looked for. The bound, which no cap exceeds, is a literal, so every task keeps its own
    first rows before the shuffle; the rows are then compared with that one row and stay where they are. A hot group is no large
    task. order tells rows of equal score apart. rows is read twice: stage it where it is costly.
    """
    place = F.struct(F.col(score).isNull().alias("none"), (-F.col(score)).alias("score"), F.col(order).alias("order"))
    names = [f"__{k}" for k in keys]
    held = rows.where(counted).select(*[c.alias(n) for n, c in zip(names, keys.values())], place.alias("__last"), cap.alias("__cap"))
    ranked = held.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy("__last"))).where(F.col("__n") <= bound)
    last = ranked.where(F.col("__n") == F.col("__cap")).drop("__n", "__cap")
    same = F.lit(True)
    for n, c in zip(names, keys.values()):
        same = same & c.eqNullSafe(F.col(n))
    return rows.join(last, same, "left").withColumn("past_cap", counted & F.coalesce(place > F.col("__last"), F.lit(False))).drop(*names, "__last")
