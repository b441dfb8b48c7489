"""Incremental ingest as a stream (STR-01..-04, SNK-01, -02, -06)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import bridge, insert_if_absent
from ..sources.files import append, exists, read_table
from ..sources.keys import KeyTable
from ..staging import staged, unstage

Normalizer = Callable[[DataFrame], DataFrame]


def keys_of(events: DataFrame) -> DataFrame:
    """(kind, key): what must not be stored twice."""
    both = F.explode(F.array(F.struct(F.lit("id").alias("kind"), F.col("id").cast("string").alias("key")), F.struct(F.lit("hash").alias("kind"), F.col("content_hash").cast("string").alias("key")))).alias("k")
    return events.select(both).select("k.*").where("key is not null")


def ingest(stream: DataFrame, events_path: str, entities_path: str, checkpoint: str, prepare: Normalizer = lambda df: df, once: bool = False, keys: KeyTable | None = None) -> StreamingQuery:
    """Write a stream of events so that each id and each content_hash is stored once, whatever is replayed or restarted.

    A batch looks its keys up in a key table, which reads only the buckets whose filters hit, so not all stored keys. Rows carry their run: the query's own id,
    which a new checkpoint changes, and the batch's number. A batch that runs again leaves its own run's rows out of the comparison and writes what
    its first attempt didn't. Events come first, then the bridge, then the keys, then a mark that the run is done; a run without
    a mark that this query can't repeat, as it had another checkpoint, is completed from its events when a query starts. Tables are partitioned by day.
    prepare turns raw rows into events (id, content_hash, entities, effective_at, ord and more).
    """
    spark = stream.sparkSession
    table = keys or KeyTable(spark, f"{events_path.rstrip('/')}-keys")
    recover(spark, events_path, entities_path, table)

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        run = f"{_query_id(spark, checkpoint)}-{number}"
        mine = F.coalesce(F.col("run") == run, F.lit(False))
        new = prepare(df).withColumn("day", F.coalesce(F.col("effective_at").cast("date"), F.lit("1970-01-01").cast("date")))
        new = staged(new.withColumn("run", F.lit(run)), "new")
        known = staged(table.lookup(keys_of(new)).where(~mine).select("kind", "key"), "known")
        stored = known.select(F.when(F.col("kind") == "id", F.col("key")).alias("id"), F.when(F.col("kind") == "hash", F.col("key")).alias("content_hash"))
        fresh = staged(insert_if_absent(stored.withColumn("id", F.col("id").cast(new.schema["id"].dataType)), new), "fresh")
        days = fresh.select("day").distinct()
        own = staged(read_table(spark, events_path, new.schema).join(days, "day", "left_semi").where(mine).select("id"), "own")
        append(fresh.join(own, "id", "left_anti").select(*new.columns), events_path, "day")
        _complete(spark, fresh, entities_path, table, run)
        unstage(new, known, fresh, own)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def _complete(spark: SparkSession, events: DataFrame, entities_path: str, table: KeyTable, run: str) -> None:
    """The bridge and the keys of a run's events as far as they aren't there, then its mark."""
    links = bridge(events, "entities", "entity").withColumn("run", F.lit(run))
    there = staged(read_table(spark, entities_path, links.schema).where(F.col("run") == run), "links")
    append(links.join(there, links.columns, "left_anti"), entities_path)
    table.add(keys_of(events), run)
    append(spark.createDataFrame([(run,)], "run string"), f"{table.path}/runs")
    unstage(there)


def recover(spark: SparkSession, events_path: str, entities_path: str, table: KeyTable) -> None:
    """Complete the runs whose events are stored but that have no mark: there is one for each query that was stopped in a batch, not more."""
    if not exists(spark, events_path):
        return
    events = spark.read.parquet(events_path)
    done = read_table(spark, f"{table.path}/runs", "run string")
    for row in events.select("run").distinct().join(done.distinct(), "run", "left_anti").collect():
        _complete(spark, events.where(F.col("run") == row["run"]), entities_path, table, row["run"])


def dedup_stream(stream: DataFrame, time: str = "effective_at", key: str = "content_hash", late: str = "1 day") -> DataFrame:
    """Each key once while its first row is within the watermark: state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "7 days", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out by Spark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), group).agg(F.count("*").alias("events"))


def late_rows(rows: DataFrame, day: Column, time: str = "published_at") -> DataFrame:
    """Rows that the day rule leaves out."""
    from ..operators.filters import on_day

    return rows.where(~on_day(F.col(time), day))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of landed JSON files."""
    return spark.readStream.schema(schema).json(path)
