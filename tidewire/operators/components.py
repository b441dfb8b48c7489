"""Connected components by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged, unstage


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links, self-links and repeats allowed -> (node, component); component is the least node reachable.

    A node's least neighbour comes from one aggregate, is written, and is joined back by node: both sides of that
    join are plain shuffles, so Spark's skew join splits a node with very many links. Rounds grow with the logarithm of
    a component's longest path. Every step is written to the shared folder, so a lost executor repeats one step at most.
    Null ends are ignored. An empty table gives an empty table.
    """
    links = staged(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = _fingerprint(links)
    for _ in range(most_rounds):
        for large in (True, False):
            near = (links.union(links.select("b", "a")) if large else links).toDF("node", "other")
            least = staged(near.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "least")
            tied = near.join(least, "node")
            if large:  # what lies above a node hangs on the node's least neighbour
                out = tied.where("other > node").select(F.col("other").alias("a"), F.col("root").alias("b"))
            else:  # a node and what lies below it hang on its least neighbour
                out = tied.select(F.col("other").alias("a"), F.col("root").alias("b")).union(least.select("node", "root"))
            after = staged(out.where("a <> b").distinct(), "links")
            unstage(links, least)
            links = after
        before, state = state, _fingerprint(links)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]
