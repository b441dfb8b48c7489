"""Filter interaction audit (operator 13): what each of several filters removes, by every order of applying them.

The sets of filters already applied form a lattice; applying one more is an edge. Documents are counted once by part, failed filters and
labels, in every task before any shuffle. These few counts contribute to the lattice's edges (80 for five filters), and every step of every
order (600) is one edge on a path from the empty set up, so a small join replaces running the filters in 120 orders.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, staged

#: Limits of the filters (fixed values).
LEAST_WORDS = 100
LEAST_DISTINCT = 80
MOST_UPPER = 10
MARKS = "[#$%&*|]"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that isn't null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))[0]
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": sizes["n"] < LEAST_WORDS, "B": 100 * sizes["k"] < LEAST_DISTINCT * sizes["n"], "C": 100 * upper > MOST_UPPER * F.char_length(text), "D": text.rlike(MARKS)}


def _mask(failed: Mapping[str, Column], filters: str) -> Column:
    return sum((F.when(c, 1 << filters.index(name)).otherwise(0) for name, c in failed.items()), F.lit(0))


def profiles(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters A to E that they fail and what their labels say.

    E is judged on doc_ids and digests of whole texts: of equal texts all but those of least doc_id fail. A row without doc_id has no smaller
    one, is smaller than none, and has no labels. A document with several label rows has what any of them says.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(text, 256).alias("body"), _mask(text_filters(text), "ABCDE").alias("mask"))
    # rows that can't be told apart are one row from here on
    rows = staged(rows.groupBy("doc_id", "part", "body", "mask").agg(F.count("*").alias("n")), "audit-rows")
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = rows.where("doc_id is not null").join(said, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    known = known.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    # equal texts fail the same other filters, so a text is a few rows, one for each part and labels, however many copies it has
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    bodies = known.groupBy("body", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("apart"), first.alias("first"))
    bodies = staged(bodies, "audit-bodies")
    least = bodies.groupBy("body").agg(F.min("first.doc_id").alias("least"))
    bodies = bodies.join(least, "body")
    unique = F.col("apart") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    sides = F.explode(F.array(F.struct(F.col("mask").alias("m"), unique.alias("k")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("m"), (F.col("n") - unique).alias("k")))).alias("s")
    return bodies.select("part", "good", "toxic", sides).where("s.k > 0").groupBy("part", F.col("s.m").alias("mask"), "good", "toxic").agg(F.sum("s.k").alias("n"))


def audit(counted: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step, filter and COUNTS, shapley for every part, order of filters and step.

    counted: part, mask (bit i: fails the i-th filter), good, toxic, n. A part that has rows has all its steps, zeros included; an empty
    table gives none. shapley is the number its filter removes, summed over all orders.
    """
    spark, every = counted.sparkSession, len(filters)
    # all subsets without the next filter; subset sizes say how many orders use the edge
    edges = [(s, f, factorial(s.bit_count()) * factorial(every - 1 - s.bit_count())) for s in range(1 << every) for f in range(every) if not s >> f & 1]
    lattice = F.explode(F.array(*[F.struct(F.lit(s).alias("done"), F.lit(f).alias("next"), F.lit(w).cast("long").alias("paths")) for s, f, w in edges])).alias("e")
    at = counted.select("part", "mask", "good", "toxic", "n", lattice).select("*", "e.*")
    before, bit = F.col("mask").bitwiseAND(F.col("done")) != 0, F.expr("shiftleft(1, next)")
    fails = F.col("mask").bitwiseAND(bit) != 0
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    sums = {
        "kept": total(~before & ~fails), "removed": total(~before & fails), "redundant": total(before & fails), "unique_fails": total(F.col("mask") == bit),
        "good_lost": total(~before & fails & F.col("good")), "toxic_lost": total(~before & fails & F.col("toxic")),
    }
    counts = at.groupBy("part", "done", "next", "paths").agg(*[c.alias(k) for k, c in sums.items()])
    counts = staged(counts, "audit-edges")
    shares = counts.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    steps = []
    for order in permutations(range(every)):
        done = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), step, filters[f], done, f))
            done |= 1 << f
    # every! x every rows, whatever the data
    paths = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, done int, next int"))
    rows = counts.join(shares, ["part", "next"]).join(paths, ["done", "next"])
    return rows.select("part", "filter_order", "step", "filter", *COUNTS, "shapley")


def op13_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each lang, order and step.

    Null texts are empty, a null lang is the empty string's part. See profiles() for nulls, ties and repeated rows; an empty table gives no row.
    """
    return audit(profiles(docs, labels)).select("part", "filter_order", "step", *COUNTS, "shapley")
