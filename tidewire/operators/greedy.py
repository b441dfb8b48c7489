"""First match in order, in pieces of bounded size (JON-06).

An event joins the first cluster of its block, by the time of its founding, that it matches: by its entities and those of all members so far, by
the founder's fingerprint or by the founder's title. Each event waits for all earlier ones by definition. Rows are sorted by block and order over
all tasks and cut into pieces of about PIECE events of one block. The first pieces of all blocks are walked at once, a task for each, then the second
ones, so rounds are as many as the largest block's pieces. What a piece needs of earlier ones is joined to it before it is walked: the first
founder with its title or fingerprint, and the entities of the clusters that it may meet or widen. No task holds a block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from functools import reduce
from heapq import heappop, heappush
from math import ceil, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, folded
from ..staging import staged, unstage
from .similar import WORDS, coded, first_alike, joined_items, sketches

#: Events of a piece; a sorted part has an eighth of them.
PIECE = 1 << 15


def cluster_in_order(events: DataFrame, block: str = "week", entity_share: float = 0.5, title_share: float = 0.7) -> DataFrame:
    """(id, cluster_id): the founder's id, for events (id, ord, title, entities, fingerprint, block).

    Order is by ord, then id. A null block is a block of its own. Events with neither entities, title nor fingerprint found clusters that nothing joins.
    """
    rows = _placed(events, block)
    rounds = (rows.agg(F.max("piece")).first()[0] or 0) + 1
    done: list[DataFrame] = []
    founders = held = None
    for k in range(rounds):
        piece = rows.where(F.col("piece") == k)
        now, near = (piece.withColumn("first", F.lit(None).cast("long")), piece.select("block", "pos", "names").limit(0)) if founders is None else _prepared(piece, founders, held, title_share)
        walked = staged(_walk(now, near, entity_share, title_share), "walked")
        done.append(walked)
        if k + 1 < rounds:
            led = piece.join(walked, "pos")
            new = led.where("pos = leader").select("block", "pos", "items", "n", "print")
            names = led.select("block", "leader", F.explode("names").alias("name")).distinct()
            grown = staged(founders.union(new) if founders else new, "founders"), staged(held.union(names).distinct() if held else names, "held")
            unstage(*[x for x in (founders, held) if x])
            founders, held = grown
        if now is not piece:
            unstage(now, near)
    unstage(*[x for x in (founders, held) if x])
    ids = rows.select("pos", "id")
    led = reduce(DataFrame.unionAll, done).join(ids, "pos")
    return led.join(ids.select(F.col("pos").alias("leader"), F.col("id").alias("cluster_id")), "leader").select("id", "cluster_id")


def _placed(events: DataFrame, block: str) -> DataFrame:
    """(block, id, names, items, n, print, pos, piece), staged: pos grows in order within a block, and so does piece."""
    names, pairs = F.array_sort(F.filter(folded(F.col("entities")), lambda x: x.isNotNull())), F.col("pairs")
    rows = events.select(F.coalesce(F.concat(F.lit("="), F.col(block).cast("string")), F.lit("")).alias("block"), "ord", "id", names.alias("names"), F.nullif(F.col("fingerprint"), F.lit("")).alias("print"), bigrams(F.col("title")).alias("pairs"))
    rows = staged(rows.select("block", "ord", "id", "names", "print", F.size(pairs).alias("n"), joined_items(pairs).alias("items")), "rows")
    order, parts = ["block", "ord", "id"], max(1, ceil(rows.count() / max(1, PIECE // 8)))
    placed = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("pos", 33).alias("part")
    counts = placed.groupBy("block", part).agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part that a block lies in
    pieces = counts.select("block", "part", F.floor(F.coalesce(before, F.lit(0)) / PIECE).alias("piece"))
    out = staged(placed.withColumn("part", part).join(pieces, ["block", "part"]).drop("part", "ord"), "rows", "piece")
    unstage(rows, placed)
    return out


def _prepared(piece: DataFrame, founders: DataFrame, held: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(piece with the first earlier founder of its title or fingerprint; (block, pos, names) of earlier clusters that it may meet or widen), staged."""
    side = lambda df: df.select("block", F.col("pos").alias("id"), "n", "items")
    by_title = first_alike(side(piece), side(founders), share, "block")
    prints = founders.where("print is not null").groupBy("block", "print").agg(F.min("pos").alias("first"))
    by_print = piece.join(prints, ["block", "print"]).select(F.col("pos").alias("id"), "first")
    first = by_title.union(by_print).groupBy("id").agg(F.min("first").alias("first")).withColumnRenamed("id", "pos")
    now = staged(piece.join(first, "pos", "left"), "piece")
    unstage(by_title)
    named = now.where("size(names) > 0")
    met = held.join(named.select("block", F.explode("names").alias("name")).distinct(), ["block", "name"], "left_semi").select("block", "leader")
    widened = named.where("first is not null").select("block", F.col("first").alias("leader"))
    near = held.join(met.union(widened).distinct(), ["block", "leader"], "left_semi")
    return now, staged(near.select("block", F.col("leader").alias("pos"), F.array("name").alias("names")), "near")


def _walk(now: DataFrame, near: DataFrame, entity_share: float, title_share: float) -> DataFrame:
    """(pos, leader): each block's piece in order, on top of the earlier clusters near it."""

    def run(key: tuple, events: pa.Table, earlier: pa.Table) -> pa.Table:
        events = events.sort_by("pos")
        known = Held(entity_share)
        sets: dict[int, set] = defaultdict(set)
        for at, names in zip(earlier.column("pos").to_pylist(), earlier.column("names").to_pylist(), strict=True):
            sets[at].update(names)
        for at, names in sets.items():
            known.widen(at, frozenset(names))
        titles, prints, leaders = Titles(events, title_share), {}, []
        columns = (events.column(c).to_pylist() for c in ("pos", "names", "print", "first"))
        for i, (at, names, mark, first) in enumerate(zip(*columns, strict=True)):
            kind = frozenset(names)
            best = min(inf if first is None else first, known.first(kind), prints.get(mark, inf))
            best = min(best, titles.first(i, best))
            if best == inf:
                best = at
                titles.add(i, at)
                if mark is not None:
                    prints[mark] = at
            known.widen(best, kind)
            leaders.append(best)
        return pa.table({"pos": events.column("pos"), "leader": pa.array(leaders, pa.int64())})

    columns = ["block", "pos", "names", "items", "n", "print", "first"]
    return now.select(*columns).groupBy("block").cogroup(near.groupBy("block")).applyInArrow(run, "pos long, leader long")


class Held:
    """Clusters' entities as they grow. Clusters with the same entities are one set, which is compared once with each kind of event."""

    def __init__(self, share: float):
        self.share = share
        self.of: dict[int, frozenset] = {}
        self.leaders: dict[frozenset, list] = {}
        self.fits: dict[frozenset, list] = {}
        self.sets_with: dict[str, list] = defaultdict(list)
        self.kinds_with: dict[str, list] = defaultdict(list)

    def _fit(self, a: frozenset, b: frozenset) -> bool:
        both = len(a & b)
        return both >= self.share * (len(a) + len(b) - both)

    def first(self, kind: frozenset) -> float:
        """The least leader whose cluster has entities like these."""
        if kind and kind not in self.fits:
            self.fits[kind] = [h for h in {h for x in kind for h in self.sets_with[x]} if self._fit(kind, h)]
            for x in kind:
                self.kinds_with[x].append(kind)
        best = inf
        for h in self.fits.get(kind, ()):
            heap = self.leaders[h]
            while heap and self.of[heap[0]] != h:  # has grown since
                heappop(heap)
            best = min(best, heap[0]) if heap else best
        return best

    def widen(self, leader: int, kind: frozenset) -> None:
        old = self.of.get(leader, frozenset())
        new = old | kind
        if new == old:
            return
        self.of[leader] = new
        if new not in self.leaders:
            self.leaders[new] = []
            for k in {k for x in new for k in self.kinds_with[x]}:
                if self._fit(k, new):
                    self.fits[k].append(new)
            for x in new:
                self.sets_with[x].append(new)
        heappush(self.leaders[new], leader)


class Titles:
    """Founders' titles as they come: sketches in arrays leave few to compare, and an equal title goes on where the last one stopped."""

    def __init__(self, events: pa.Table, share: float):
        self.share, self.n, self.items = share, events.column("n").to_numpy(), events.column("items").to_pylist()
        row, self.code = coded(events)
        self.start = np.searchsorted(row, np.arange(len(self.n) + 1))
        self.marks = sketches(row, self.code, len(self.n))
        self.rows, self.at = np.zeros(len(self.n), np.int64), []
        self.own, self.sizes = np.zeros((WORDS, len(self.n)), np.uint64), np.zeros(len(self.n), np.int64)
        self.seen: dict[str, tuple[float, int]] = {}

    def _codes(self, i: int) -> list:
        return self.code[self.start[i] : self.start[i + 1]].tolist()

    def first(self, i: int, before: float) -> float:
        """The least founder of this piece, before another, that has a title like that of row i."""
        upto = bisect_left(self.at, before)
        if not self.n[i] or not upto:
            return inf
        found, low = self.seen.get(self.items[i], (inf, 0))
        if found == inf and low < upto:
            found = self._look(i, low, upto)
            self.seen[self.items[i]] = found, upto
        return found

    def _look(self, i: int, low: int, upto: int) -> float:
        n, size, t = self.n[i], self.sizes[low:upto], self.share
        apart = np.zeros(upto - low, np.uint16)
        for w in range(WORDS):
            apart += np.bitwise_count(self.own[w, low:upto] ^ self.marks[w, i])
        near = np.nonzero((apart <= (n + size) * ((1 - t) / (1 + t)) + 1e-9) & (size >= n * t - 1e-9) & (n >= size * t - 1e-9))[0]
        mine = set(self._codes(i)) if len(near) else ()
        for j in near.tolist():
            both = len(mine.intersection(self._codes(self.rows[low + j])))
            if both / (n + size[j] - both) >= t:
                return self.at[low + j]
        return inf

    def add(self, i: int, at: int) -> None:
        if self.n[i]:
            k = len(self.at)
            self.at.append(at)
            self.rows[k], self.own[:, k], self.sizes[k] = i, self.marks[:, i], self.n[i]


def versions(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """(block, leader, since, until, held): the entities of each cluster from just after since up to until, each time that they grew."""
    came = rows.where("kind is not null").groupBy("block", "leader", "kind").agg(F.min("at").alias("since")).join(kinds, ["block", "kind"])
    first = came.select("block", "leader", "since", F.explode("names").alias("name")).groupBy("block", "leader", "name").agg(F.min("since").alias("since"))
    grown = first.groupBy("block", "leader").agg(F.array_sort(F.collect_list(F.struct("since", "name"))).alias("came"))
    each = F.transform(F.sequence(F.lit(1), F.size("came")), lambda k: F.struct(F.element_at("came", k)["since"].alias("since"), F.try_element_at("came", k + 1)["since"].alias("until"), k.alias("n")))
    grown = grown.withColumn("v", F.explode(F.filter(each, lambda v: v["until"].isNull() | (v["until"] > v["since"]))))
    return grown.select("block", "leader", "v.since", "v.until", F.array_sort(F.slice("came", F.lit(1), F.col("v.n"))["name"]).alias("held"))


def _first_ones(spans: DataFrame, *keys: str) -> DataFrame:
    """spans without those that begin no earlier than a lasting one of an earlier leader: no event finds them first."""
    lasting = spans.where("until is null").groupBy(*keys).agg(F.min(F.struct("leader", "since")).alias("lasting"))
    return spans.join(lasting, [*keys], "left").where("lasting is null or leader <= lasting.leader or since < lasting.since").drop("lasting")
