"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

A golden-ratio sequence runs through the sources' cumulative targets and names a source for each slot. The k-th slot
of a source takes the k-th block of its stream: its documents in shuffled order, end to end, twice over if the
target needs it. Blocks hold the same number of words; a source's last one is cut at its target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Words in a block, weights of the sources in turn, share of all sizes that is mixed, most passes over a source.
BLOCK, WEIGHTS, SHARE, PASSES = 256, (3, 1, 2), 1.5, 2
#: Slots in a chunk, and documents in a bucket on average at most: what one window holds of a source.
CHUNK, BUCKET = 8192, 4096
#: Bins of [0, 1) by which a slot's point meets the sources' intervals.
BINS = 4096
GOLDEN = 0.6180339887498949


@dataclass
class Mix:
    """documents: the input's rows with size, source_size, target, taken_1, taken_2 (words in each pass). schedule: slot, source_no, block, first_word, last_word.

    seed and buckets: what bucket_of needs to tell where a row stands in its source's stream, which goes through the buckets in order.
    """

    documents: DataFrame
    schedule: DataFrame
    seed: int
    buckets: int

    def bucket_of(self, same: Column) -> Column:
        """A row's bucket by its doc_id and same, its text's hash."""
        return F.pmod(_at(self.seed, same), F.lit(self.buckets))


def _at(seed: int, same: Column) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", same)


def _frac(x: Column) -> Column:
    return x - F.floor(x)


def targets(sized: DataFrame) -> DataFrame:
    """source, source_no, source_size, target, goal (target in whole words), low, high (interval of the schedule).

    The shares go by weight; a source that would pass PASSES times its size stops there and the excess is shared again.
    Sorted by the size at which they stop, the sources that stop come first, so two running sums give the level of
    the others. One row for each source goes through these windows, never the documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.withColumn("source_no", F.row_number().over(turn).cast("long"))
    per = per.withColumn("w", F.element_at(weights, ((F.col("source_no") - 1) % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(PASSES)).withColumn("stop", F.col("cap") / F.col("w"))
    by = Window.orderBy("stop", "source_no")
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * SHARE
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_on = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (total - before) / weight_on)
    free = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "source_no", "level"))).over(everything)
    per = per.withColumn("free", free["level"])
    per = per.withColumn("target", F.least("cap", F.coalesce(F.col("free") * F.col("w"), F.lit(0.0))))
    per = per.withColumn("goal", F.least(F.floor(F.col("target") + 0.5), (F.col("cap")).cast("long")))
    order = Window.orderBy("source_no")
    whole = F.greatest(F.sum("goal").over(everything), F.lit(1))
    per = per.withColumn("high", F.sum("goal").over(order.rowsBetween(Window.unboundedPreceding, 0)) / whole)
    per = per.withColumn("low", F.col("high") - F.col("goal") / whole)
    return per.select("source", "source_no", "source_size", "target", "goal", "low", "high")


def schedule(sources: DataFrame, n_slots: int, block: int) -> DataFrame:
    """slot, source_no, block, first_word, last_word (exclusive). A source gets exactly the blocks that its goal needs.

    The sequence names a source within a few slots of its share. Slots beyond a source's goal fall out; the few that it
    still lacks follow after the last slot.
    """
    spark = sources.sparkSession
    need = F.ceil(F.col("goal") / block)
    points = spark.range(n_slots).withColumnRenamed("id", "slot")
    # the product in two parts keeps the fraction exact for large slot numbers
    high, low = F.floor(F.col("slot") / 1048576), F.col("slot") % 1048576
    step = (1048576 * GOLDEN) % 1.0
    points = points.withColumn("u", _frac(_frac(high * step) + _frac((low + 1) * GOLDEN)))
    points = points.withColumn("bin", F.floor(F.col("u") * BINS))
    spans = sources.where("goal > 0").select("source_no", "low", "high", "goal")
    spans = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.greatest(F.col("low"), F.lit(0.0)) * BINS), F.least(F.floor(F.col("high") * BINS), F.lit(BINS - 1)))))
    named = points.join(spans, "bin").where("u >= low and u < high").withColumn("chunk", F.floor(F.col("slot") / CHUNK)).select("slot", "source_no", "chunk")
    counts = named.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = named.withColumn("inside", inside).join(starts, ["source_no", "chunk"]).select("slot", "source_no", (F.col("base") + F.col("inside")).alias("block"))
    got = counts.groupBy("source_no").agg(F.sum("n").alias("n"))
    lacking = sources.join(got, "source_no", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(need > F.col("n"))
    late = lacking.select("source_no", F.explode(F.sequence(F.col("n"), need - 1)).alias("block")).select((F.col("block") + n_slots).alias("slot"), "source_no", "block")
    goals = sources.select("source_no", "goal")
    out = ranked.unionByName(late).join(goals, "source_no").where(F.col("block") < need)
    return out.select("slot", "source_no", "block", (F.col("block") * block).alias("first_word"), F.least((F.col("block") + 1) * block, F.col("goal")).alias("last_word"))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 11, keep: list[str] | None = None) -> Mix:
    """Mix all documents (see the module). keep: columns of docs that stay beside doc_id and source.

    A null text has no words. Rows without a source are a source of their own, the last one. Equal rows are rows
    of their own. The same table gives the same mix however it is partitioned: rows of one id, or without one, are shuffled and
    ordered by their text's hash, and rows that are equal in both can stand for each other. An empty table gives an empty mix.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    names = [f"keep_{i}" for i in range(len(keep or []))]  # their own names might clash
    sized = staged(docs.select("doc_id", "source", *[F.col(c).alias(n) for c, n in zip(keep or [], names)], size.alias("size"), F.xxhash64("text").alias("same")), "sized")
    n_docs = sized.count()
    sources = staged(targets(sized), "sources")
    n_slots = sources.agg(F.coalesce(F.sum(F.ceil(F.col("goal") / block)), F.lit(0)).alias("n")).first()["n"]
    plan = staged(schedule(sources, n_slots, block), "schedule")

    buckets = max(-(-n_docs // BUCKET), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = sized.join(sources.select(F.col("source").alias("s"), "source_no", "source_size", "target", "goal"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    known = known.withColumn("at", _at(seed, F.col("same"))).withColumn("bucket", F.pmod("at", F.lit(buckets)))
    line = Window.partitionBy("source_no", "bucket").orderBy("at", "doc_id", "size", "same")
    known = known.withColumn("row", F.row_number().over(line)).withColumn("inside", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    known = staged(known, "lines")
    held = known.groupBy("source_no", "bucket").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(held.select("source_no", "bucket", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base")), "bases")
    placed = known.join(bases, ["source_no", "bucket"]).withColumn("first", F.col("base") + F.col("inside"))

    turns = placed.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
    turns = turns.withColumn("from", F.col("first") + F.col("turn") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size")).where("from < goal")
    pieces = turns.select("source_no", "bucket", "row", "turn", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("block"))
    met = pieces.join(plan, ["source_no", "block"])
    words = F.greatest(F.least("to", "last_word") - F.greatest("from", "first_word"), F.lit(0))
    taken = met.groupBy("source_no", "bucket", "row").agg(*[F.sum(F.when(F.col("turn") == t, words).otherwise(0)).alias(f"taken_{t + 1}") for t in range(PASSES)])
    full = known.join(taken, ["source_no", "bucket", "row"], "left")
    full = full.select("doc_id", "source", *[F.col(n).alias(c) for c, n in zip(keep or [], names)], "size", "source_size", "target", *[F.coalesce(f"taken_{t + 1}", F.lit(0)).alias(f"taken_{t + 1}") for t in range(PASSES)])
    return Mix(full, plan, seed, buckets)


def op2_mixing(docs: DataFrame) -> DataFrame:
    """The rows of query op2."""
    out = mix(docs).documents
    return out.select("doc_id", "size", "source_size", "target", sum((F.col(f"taken_{t + 1}") for t in range(PASSES)), F.lit(0)).cast("long").alias("taken"))
