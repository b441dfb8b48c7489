"""Merkle manifest of a document table (operator 11): leaves, subroots by source, a root, and a proof for each row.

Leaves are sorted over ranges. A task pushes its range onto a mountain-range stack: a counter in base FAN, whose carries turn completed
runs into parents. What a range can't complete, as a run begins or ends in another one, stays open: a few nodes a level. Blocks of
ranges merge their open nodes by the same stack, then blocks of blocks, until each tree has its root; the last run of a
level is hashed as short as it is, without padding. Going back down, each round hands its nodes the siblings above them. So a
task holds one range of leaves, or the open nodes of MERGED ranges, whatever a source holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Nodes of a run (fixed value), leaves of a range at most, ranges whose open nodes a task merges.
FAN = 3
LEAVES = 1 << 17
MERGED = 16
#: Leaves whose proofs are turned into Arrow at once.
CHUNK = 1 << 12

STEPS = "array<struct<left:string,right:string>>"
NODES = "block long, grp string, n long, level int, place long, digest string"
PATHS = f"block long, grp string, level int, place long, steps {STEPS}"
ARROW_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """Nodes of each level of a tree of n leaves, the root's 1 last."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


class Mountains:
    """The nodes that some of a tree's nodes complete. Nodes are pushed from left to right, each at its own level."""

    def __init__(self, n: int):
        self.sizes = level_sizes(n)
        self.made: list[list[tuple[int, str]]] = [[] for _ in self.sizes]

    def push(self, level: int, place: int, node: str) -> None:
        while True:
            here = self.made[level]
            here.append((place, node))
            if level + 1 == len(self.sizes) or ((place + 1) % FAN and place + 1 < self.sizes[level]):
                return  # the root, or the run goes on
            run = here[-(place % FAN + 1) :]
            if len(run) <= place % FAN or run[0][0] != place - place % FAN:
                return  # the run begins in an earlier range
            level, place, node = level + 1, place // FAN, digest("".join(d for _, d in run))

    def open(self) -> Iterable[tuple[int, int, str]]:
        """(level, place, digest) of the nodes without a parent here."""
        for level, nodes in enumerate(self.made):
            parents = {place for place, _ in self.made[level + 1]} if level + 1 < len(self.made) else set()
            yield from ((level, place, node) for place, node in nodes if place // FAN not in parents)

    def steps(self, above: dict[tuple[int, int], list]) -> list[dict[int, list]]:
        """For each level, place -> [(left siblings, right siblings), ...] up to the root; above has them for the open nodes but the root."""
        out: list[dict[int, list]] = [{} for _ in self.made]
        for level in range(len(self.made) - 1, -1, -1):
            up = out[level + 1] if level + 1 < len(out) else {}
            nodes = dict(self.made[level])
            for place in nodes:
                if place // FAN in up:
                    first = place - place % FAN
                    run = range(first, min(first + FAN, self.sizes[level]))
                    mine = ("".join(nodes[i] for i in run if i < place), "".join(nodes[i] for i in run if i > place))
                    out[level][place] = [mine, *up[place // FAN]]
                else:
                    out[level][place] = above.get((level, place), [])
        return out


def _grown(table: pa.Table) -> dict[str, tuple[Mountains, list[dict]]]:
    """By tree: the stack of a block's nodes, and the nodes themselves."""
    by: dict[str, list[dict]] = {}
    for row in table.to_pylist():
        by.setdefault(row["grp"], []).append(row)
    out = {}
    for grp, rows in by.items():
        grown = Mountains(rows[0]["n"])
        for row in sorted(rows, key=lambda r: r["place"] * FAN ** r["level"]):
            grown.push(row["level"], row["place"], row["digest"])
        out[grp] = (grown, rows)
    return out


def _pieces(rows: pa.Table, pieces: pa.Table) -> Iterable[tuple[dict, pa.Table, Mountains]]:
    """(piece, its rows in order, their stack) for each tree that a range has leaves of."""
    rows = rows.sort_by("at")
    at = 0
    for piece in sorted(pieces.to_pylist(), key=lambda p: p["first"]):
        own = rows.slice(at, piece["held"])
        at += piece["held"]
        grown = Mountains(piece["n"])
        for i, node in enumerate(own.column("digest").to_pylist()):
            grown.push(0, piece["base"] + i, node)
        yield piece, own, grown


NODE_FIELDS = pa.schema([("block", pa.int64()), ("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())])
PATH_FIELDS = pa.schema([("block", pa.int64()), ("grp", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("steps", ARROW_STEPS)])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _as_steps(steps: Sequence[tuple[str, str]]) -> list[dict]:
    return [{"left": left, "right": right} for left, right in steps]


def _lift_leaves(rows: pa.Table, pieces: pa.Table) -> pa.Table:
    return _table([(p["part"], p["grp"], p["n"], *node) for p, _, grown in _pieces(rows, pieces) for node in grown.open()], NODE_FIELDS)


def _lift(nodes: pa.Table) -> pa.Table:
    block = nodes.column("up")[0].as_py()
    return _table([(block, grp, grown.sizes[0], *node) for grp, (grown, _) in _grown(nodes).items() for node in grown.open()], NODE_FIELDS)


def _descend(nodes: pa.Table, paths: pa.Table) -> pa.Table:
    above: dict[str, dict] = {}
    for row in paths.to_pylist():
        above.setdefault(row["grp"], {})[row["level"], row["place"]] = [(s["left"], s["right"]) for s in row["steps"]]
    out = []
    for grp, (grown, rows) in _grown(nodes).items():
        steps = grown.steps(above.get(grp, {}))
        out += [(r["block"], grp, r["level"], r["place"], _as_steps(steps[r["level"]][r["place"]])) for r in rows]
    return _table(out, PATH_FIELDS)


@dataclass
class Forest:
    """Trees over sorted leaves. rows: part, at, grp and the leaves' columns. info, for each part and tree of it: first, held, base, n, root, paths."""

    rows: DataFrame
    info: DataFrame
    roots: DataFrame


def forest(leaves: DataFrame, order: Sequence[str]) -> Forest:
    """Trees over leaves: grp names a leaf's tree (not null), digest is the leaf; a tree's leaves ascend by order.

    leaves should be a table already, as it is read several times. Rows equal in grp and order have equal digests or are told
    apart by order's last column. No leaves: no trees.
    """
    spark = leaves.sparkSession
    n = leaves.count()
    ranges = min(max(1, n), max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / LEAVES)))
    dealt = leaves.repartitionByRange(ranges, "grp", *order).sortWithinPartitions("grp", *order)
    rows = staged(dealt.withColumn("part", F.spark_partition_id().cast("long")).withColumn("at", F.monotonically_increasing_id()), "merkle-rows")
    held = rows.groupBy("part", "grp").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    before = Window.partitionBy("grp").orderBy("part")
    base = F.coalesce(F.sum("held").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    pieces = staged(held.withColumn("base", base).withColumn("n", F.sum("held").over(Window.partitionBy("grp"))), "merkle-pieces")

    is_root = F.col("level") == _depth(F.col("n"))
    rounds = [staged(rows.groupBy("part").cogroup(pieces.groupBy("part")).applyInArrow(_lift_leaves, NODES), "merkle-open")]
    blocks = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while blocks > 1:
        up = rounds[-1].where(~is_root).withColumn("up", F.floor(F.col("block") / MERGED).cast("long"))
        rounds.append(staged(up.groupBy("up").applyInArrow(_lift, NODES), "merkle-open"))
        blocks = -(-blocks // MERGED)
    roots = rounds[0]
    for more in rounds[1:]:
        roots = roots.unionByName(more)
    roots = staged(roots.where(is_root).select("grp", F.col("digest").alias("root")), "merkle-roots")

    paths = spark.createDataFrame([], PATHS)
    for nodes in reversed(rounds[:-1]):
        up = nodes.where(~is_root).withColumn("up", F.floor(F.col("block") / MERGED).cast("long"))
        paths = staged(up.groupBy("up").cogroup(paths.groupBy("block")).applyInArrow(_descend, PATHS), "merkle-paths")
    own = paths.groupBy(F.col("block").alias("part"), "grp").agg(F.collect_list(F.struct("level", "place", "steps")).alias("paths"))
    return Forest(rows, pieces.join(own, ["part", "grp"], "left").join(roots, "grp"), roots)


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of n."""
    powers = [FAN**k for k in range(40) if FAN**k < 1 << 62]
    return sum((F.when(n > p, 1).otherwise(0) for p in powers), F.lit(0))


def proofs(trees: Forest, info: DataFrame, *carried: str) -> DataFrame:
    """carried columns of each leaf, its digest, its tree's root, and proof: the siblings on its way up, above's steps after those of its tree.

    info is the forest's, with more columns: above (steps from the tree's root on) and top (what they lead to).
    """
    schema = trees.rows.select(*carried, "digest").schema
    names = [*carried, "digest"]

    def run(rows: pa.Table, pieces: pa.Table) -> pa.Table:
        out = []
        for piece, own, grown in _pieces(rows, pieces):
            known = {(p["level"], p["place"]): [(s["left"], s["right"]) for s in p["steps"]] for p in piece["paths"] or []}
            after = [(s["left"], s["right"]) for s in piece["above"]]
            steps = grown.steps(known)[0]
            places = range(piece["base"], piece["base"] + own.num_rows)
            proof = pa.chunked_array([pa.array([_as_steps(steps[i] + after) for i in places[at : at + CHUNK]], ARROW_STEPS) for at in range(0, len(places), CHUNK)], ARROW_STEPS)
            part = own.select(names).append_column("subroot", pa.array([piece["root"]] * own.num_rows, pa.string()))
            out.append(part.append_column("root", pa.array([piece["top"]] * own.num_rows, pa.string())).append_column("proof", proof))
        return pa.concat_tables(out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return trees.rows.groupBy("part").cogroup(info.groupBy("part")).applyInArrow(run, f"{fields}, subroot string, root string, proof {STEPS}")


def leaf(text: Column | str = "text") -> Column:
    """H of a row's columns: '-' for null, else its length in bytes, a colon and the value."""

    def field(value: Column) -> Column:
        s = value.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def manifest(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (siblings from the leaf to the root) of every row, and the columns of more.

    Rows of one source ascend by doc_id, nulls first; rows equal in both by leaf, and equal leaves are interchangeable. Null is a source of its
    own, before all others. Null columns and empty or very long texts are hashed as they are. An empty table gives an empty table.
    """
    # a prefix keeps the order of sources and sets null apart from the empty string
    grp = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    slim = staged(docs.select("doc_id", grp.alias("grp"), leaf().alias("digest"), F.monotonically_increasing_id().alias("turn"), *[c.alias(k) for k, c in more.items()]), "merkle-leaves")
    own = forest(slim, ["doc_id", "digest", "turn"])
    subroots = staged(own.roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("root").alias("digest")), "merkle-subroots")
    top = forest(subroots, ["of"])
    none = F.array().cast(STEPS)
    ends = staged(proofs(top, top.info.withColumn("above", none).withColumn("top", F.col("root")), "of").select(F.col("of").alias("grp"), F.col("proof").alias("above"), F.col("root").alias("top")), "merkle-ends")
    rows = proofs(own, own.info.join(ends, "grp"), "doc_id", *more)
    return rows.withColumnRenamed("digest", "leaf")


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, node, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def op11_merkle(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row proven against the root, even crc32 ones after tampering.

    Tampering deletes the line feeds of the text; a row without doc_id isn't tampered with. See manifest() for nulls, ties, repeated rows and empty tables.
    """
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(odd & F.contains(F.col("text"), F.lit("\n")), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    rows = manifest(docs, changed=changed)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("changed", "leaf"), F.col("proof"))
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
