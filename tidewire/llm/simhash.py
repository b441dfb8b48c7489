"""SimHash near-duplicates: fingerprints of word shingles, compared as vertical bit planes.

Documents become fingerprints, equal fingerprints become one node, and nodes that agree on a block key meet in
one group. The key of a large group is divided by further blocks, and what is still large is cut into tiles of a fixed
number of fingerprints, of which every two meet in one task. In a task the fingerprints lie as bit planes (one machine word holds one bit of 64 fingerprints), differences are
added by carry-save counters, and words whose 64 lanes all exceed the radius are abandoned. A task gives the links of each
batch of groups as stars, so links grow with the nodes met, never with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import sieve, slices, staged, unstage, utf8

#: Fingerprints in a tile of a large group.
TILE = 2048
#: Shingles whose bits are counted at once: their byte counters can't overflow.
CHUNK = 255


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A second, third ... hash from a first one (the finaliser of SplitMix64)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * salt) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _majority(h: np.ndarray) -> int:
    """The word whose bits are set in over half of h."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK * 257):
        part = h[at : at + CHUNK * 257]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        sums = np.add.reduceat(bits, np.arange(0, len(part), CHUNK), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of A-Z-lowered text, in order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = len(words) - shingle + 1
    starts = [0, *(ends[: n - 1]).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)


def simhash(text: bytes, shingle: int = 4, words: int = 1) -> list[int]:
    """The fingerprint as 64-bit words; the first one is made of the shingles' own hashes. No words: zeros."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return [0] * words
    return [_majority(h if k == 0 else _mix(h, k)) for k in range(words)]


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp array<long>, n_words long) of every whole text; a null text has no words and the fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            texts = b.column(1).to_pylist()
            fps = np.array([simhash(t, shingle, words) for t in texts], np.uint64).reshape(len(texts), words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(fps), pa.list_(pa.int64())), pa.array([len(t.split()) for t in texts], pa.int64())], names=["doc_id", "fp", "n_words"]
            )

    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("body")).mapInArrow(run, f"doc_id {kind}, fp array<long>, n_words long")


# ---- comparison ----


def planes(fps: np.ndarray) -> np.ndarray:
    """(n, words) fingerprints -> (64 * words, ceil(n / 64)) bit planes: bit i of word j is one bit of fingerprint 64 j + i."""
    n, words = fps.shape
    pad = (-n) % 64
    full = np.concatenate([fps, np.zeros((pad, words), np.uint64)]) if pad else np.ascontiguousarray(fps)
    bits = np.unpackbits(full.view(np.uint8).reshape(len(full), words * 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query index, block index) at most radius bits apart, by carry-save counters over the planes of block."""
    p = planes(block)
    n_words = p.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(queries).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")
    flips = (np.uint64(0) - bits.astype(np.uint64))  # all ones where the query's bit is set
    q_at, w_at = np.divmod(np.arange(len(queries) * n_words), n_words)
    depth = int(radius + 1).bit_length()
    start = (1 << depth) - 1 - radius  # a lane overflows when it passes the radius
    counter = [np.full(len(q_at), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> k & 1 else np.uint64(0)) for k in range(depth)]
    over = np.zeros(len(q_at), np.uint64)
    # lanes past the end of the block never count
    tail = len(block) % 64
    if tail:
        over[w_at == n_words - 1] = ~np.uint64((1 << tail) - 1)
    for k in range(p.shape[0]):
        carry = p[k][w_at] ^ flips[q_at, k]
        for i in range(depth):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if k % 8 == 7 and len(q_at):
            live = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if live.mean() < 0.7:  # abandon words whose 64 lanes all exceed the radius
                q_at, w_at, over = q_at[live], w_at[live], over[live]
                counter = [c[live] for c in counter]
    if not len(q_at):
        return q_at, w_at
    hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(hits)
    return q_at[row], w_at[row] * 64 + lane


def aligned_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether a[i] and b[i] are at most radius bits apart: the pairs of many small runs side by side in the lanes, by the same counters."""
    p = planes(a ^ b)
    alive = np.arange(p.shape[1])
    depth = int(radius + 1).bit_length()
    start = (1 << depth) - 1 - radius
    counter = [np.full(len(alive), np.uint64(0xFFFFFFFFFFFFFFFF) if start >> k & 1 else np.uint64(0)) for k in range(depth)]
    over, out = np.zeros(len(alive), np.uint64), np.full(p.shape[1], np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(p.shape[0]):
        carry = p[k][alive]
        for i in range(depth):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if k % 8 == 7 and len(alive):
            live = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if live.mean() < 0.7:  # abandon blocks of 64 pairs that all exceed the radius
                alive, over = alive[live], over[live]
                counter = [c[live] for c in counter]
    out[alive] = over
    return np.unpackbits((~out).view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def _pair_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of aligned pairs: many pairs side by side, so lanes are pairs."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's component under the links a[i]-b[i]."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low, new = np.minimum(x, y), label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Runs of up to so many fingerprints are compared side by side with others: the lanes are their pairs, not the rows of a block.
SMALL_RUN = 48


def _links_in_runs(fps: np.ndarray, side: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run [start, end) of rows. side: 0 and 1 are two tiles of a large group (only pairs across), 2 all pairs.

    Links come as places of rows. A small run gives all its links, a large one a star for each component.
    """
    out_a, out_b = [], []
    size = ends - starts
    for n in np.unique(size[(size > 1) & (size <= SMALL_RUN)]).tolist():
        at = starts[size == n]
        i, j = np.triu_indices(n, 1)
        step = max(1, 200_000 // len(i))
        for k in range(0, len(at), step):
            x, y = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
            near = aligned_within(fps[x], fps[y], radius)
            out_a.append(x[near])
            out_b.append(y[near])
    for s, e in zip(starts[size > SMALL_RUN].tolist(), ends[size > SMALL_RUN].tolist()):
        rows = np.arange(s, e)
        left, right = rows[side[s:e] != 1], rows[side[s:e] != 0]
        xs, ys = [rows[:0]], [rows[:0]]
        for k in range(0, len(left), 256):
            q, b = within(fps[left[k : k + 256]], fps[right], radius)
            x, y = left[k + q], right[b]
            off = x != y
            x, y = x[off], y[off]
            xs.append(x)
            ys.append(y)
        x, y = np.concatenate(xs), np.concatenate(ys)
        label = _labels(e - s, x - s, y - s)
        tied = label != np.arange(e - s)
        out_a.append(rows[tied])
        out_b.append(s + label[tied])
    empty = np.empty(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _deal(key: np.ndarray, fp: np.ndarray, used: np.ndarray, radius: int, clean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, new key, bits used) of each choice of clean blocks among radius + clean blocks of the bits not used yet.

    Two fingerprints that agree on the used bits and differ in at most radius others leave clean blocks equal (pigeonhole), so
    they agree on a new key. A key is a hash of the old key, the choice and its bits; a collision only adds comparisons.
    """
    rows, keys, bits = [], [], []
    for u in np.unique(used).tolist():
        at = np.flatnonzero(used == u)
        free = [i for i in range(64) if not u >> i & 1]
        edge = [round(i * len(free) / (radius + clean)) for i in range(radius + clean + 1)]
        blocks = [sum(1 << i for i in free[a:b]) for a, b in zip(edge, edge[1:])]
        for m, pick in enumerate(combinations(blocks, clean)):
            mask = sum(pick)
            rows.append(at)
            keys.append(_mix(_mix(fp[at] & np.uint64(mask), m + 1) ^ key[at], 3))
            bits.append(np.full(len(at), u | mask, np.uint64))
    return tuple(np.concatenate(x) for x in (rows, keys, bits))


#: Most times that a hot key is divided by further blocks, and free bits that a division needs.
DIVISIONS, LEAST_FREE = 3, 16


def exact_keys(nodes: DataFrame, radius: int, clean: int) -> DataFrame:
    """(key long, node long): nodes, which are 64-bit fingerprints, within radius share a key; no key is held by many for want of bits.

    A key of over TILE nodes is divided by further blocks of the bits that it doesn't use, again and again up to DIVISIONS times; only
    nodes that agree on nearly all bits still share a hot key then, and these are near each other.
    """

    def dealt(rows: DataFrame, clean: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4000):
                    key, node, used = (c.to_numpy(zero_copy_only=False)[at : at + 4000].view(np.uint64) for c in b.columns)
                    row, new, bits = _deal(key, node, used, radius, clean)
                    yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(node[row].view(np.int64)), pa.array(bits.view(np.int64))], names=["key", "node", "used"])

        return rows.mapInArrow(run, "key long, node long, used long")

    zero = F.lit(0).cast("long")
    rows = staged(dealt(nodes.select(zero.alias("key"), "node", zero.alias("used")), clean), "keys")
    out = None
    for _ in range(DIVISIONS):
        hot = staged(rows.where(F.bit_count("used") <= 64 - LEAST_FREE).groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > TILE).select("key"), "hot")
        if hot.isEmpty():
            break
        calm, more = rows.join(hot, "key", "left_anti").select("key", "node"), rows.join(hot, "key", "left_semi").select("key", "node", "used")
        out = calm if out is None else out.unionByName(calm)
        rows = staged(dealt(more, 2), "keys")
    return rows.select("key", "node") if out is None else staged(out.unionByName(rows.select("key", "node")), "keys")


def near_links(keys: DataFrame, radius: int, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b): stars that join what links join: nodes that share a key and differ in at most radius bits.

    keys: (key long, node long). nodes: (node, fp array<long>); without it a node is its own 64-bit fingerprint. The components
    of the stars are those of all links. Keys held by over TILE nodes are cut into tiles, and every two tiles meet.
    """
    sizes = staged(keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "sizes")
    plain = keys.join(sizes.where(F.col("held") <= TILE).select("key"), "key", "left_semi").select("key", "node", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
    hot = sizes.where(F.col("held") > TILE).withColumn("tiles", F.ceil(F.col("held") / TILE).cast("int"))
    tile = F.pmod(F.xxhash64("node", F.lit(5)), F.col("tiles")).cast("int")
    dealt = keys.join(hot, "key").withColumn("t", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(
        "key", "node", F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"),
        F.when(F.col("t") == F.col("other"), 2).when(F.col("t") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    met = plain.unionByName(dealt)
    met = met.withColumn("fp", F.array("node")) if nodes is None else met.join(nodes.select("node", "fp"), "node")
    together = met.select("key", "node", "i", "j", "side", "fp").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = staged(together.mapInArrow(lambda it: _compare(it, radius), "a long, b long").distinct(), "stars")
    unstage(sizes)
    return links


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Stars of the links in the runs of equal (key, i, j) of sorted rows; the last run of a batch waits for the next one."""
    held: pa.Table | None = None

    def links(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        stop = table.num_rows if last else int(new[-1])
        starts = new if last else new[:-1]
        rest = None if last else table.slice(stop)
        if not len(starts):
            return None, rest
        ends = np.r_[starts[1:], stop]
        fps = np.ascontiguousarray(table.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(table.num_rows, -1).view(np.uint64)
        x, y = _links_in_runs(fps, table.column("side").to_numpy(), starts, ends, radius)
        # a node is in many runs: one star joins what all runs of the batch link, its centre is the least node
        node, place = np.unique(table.column("node").to_numpy(), return_inverse=True)
        label = _labels(len(node), place[x], place[y])
        tied = label != np.arange(len(node))
        return pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[label[tied]])], names=["a", "b"]), rest

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < 20_000:
            continue
        out, held = links(held, last=False)
        if out is not None:
            yield out
    if held is not None and held.num_rows:
        out, _ = links(held, last=True)
        if out is not None:
            yield out


def clean_blocks(n_nodes: int) -> int:
    """Clean blocks that a key holds: more nodes take longer keys and more of them; the links found are the same for every choice."""
    return 2 if n_nodes < 1 << 27 else 3 if n_nodes < 1 << 33 else 4


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp array<long>, component_id): one row for each row of docs, linked by 64-bit fingerprints at most radius bits apart.

    component_id is the least doc_id reachable, the document's own where it has no link. Every link is found. Null and
    empty texts have the fingerprint zero and are linked like any other. Equal rows are linked. doc_id is an
    integer; a row without one is linked like any other, and its component_id is null only if no row of its component has a
    doc_id. Other columns are ignored. An empty table gives an empty table.
    """
    fps = staged(fingerprints(docs, shingle, 1, id_col, text_col), "fps")
    nodes = staged(fps.groupBy(F.element_at("fp", 1).alias("node")).agg(F.min("doc_id").alias("least")), "nodes")
    keys = exact_keys(nodes.select("node"), radius, clean_blocks(nodes.count()))
    links = near_links(keys, radius)
    unstage(keys)
    linked = staged(connected_components(links).join(nodes, "node"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("node", "component_id", F.lit(True).alias("tied"))
    of = nodes.join(named, "node", "left").select("node", F.when(F.col("tied"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return fps.join(of, F.element_at("fp", 1) == F.col("node")).select("doc_id", "fp", "component_id")


# ---- near copies: candidates by min-wise keys, SimHash distance by bit planes, then the exact similarity ----

#: Words in a shingle and the least Jaccard similarity of two shingle sets that makes a link.
NEAR_SHINGLE, NEAR_LEAST = 5, 0.8
#: Wide fingerprints: at similarity 0.8 two of 256 bits differ in 39 on average, standard deviation 6; unrelated ones in 128.
#: The radius leaves four standard deviations, so what it loses is below one in ten thousand.
WIDE_WORDS, WIDE_RADIUS = 4, 64
#: Candidates share one of BANDS keys, each of ROWS min-wise hashes: 998 of 1000 pairs of similarity 0.8 do, all but a few of 10**5 at 0.85.
BANDS, ROWS = 16, 5
#: Texts and bytes that one task verifies together, and leaders of a larger component that every tile of it meets.
TILE_TEXTS, TILE_BYTES, LEADERS = 512, 32 << 20, 16
_A = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(12).integers(0, 2**63, BANDS * ROWS, np.uint64)


def min_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[None, at : at + 4096] * _A[:, None] + _B[:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mix(key ^ column, 5)
    return key.view(np.int64)


def text_key(text: str = "text") -> list:
    """Two hashes, 128 bits, that stand for a whole text."""
    return [F.xxhash64(F.col(text)).alias("h1"), F.xxhash64(F.lit(7), F.col(text)).alias("h2")]


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch], shingle: int, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b): enough verified links to join all that the links of each group join.

    Rows come sorted by group, (component, i, j). side 0 meets side 1; side 2 meets every row. Rows of equal mark are joined already.
    """
    held: list[tuple] = []

    def links() -> pa.RecordBatch:
        node, side, mark = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3))
        fps = np.array([r[4] for r in held], np.int64).view(np.uint64)
        sets = [np.unique(shingle_hashes(r[5], shingle)) for r in held]
        root = list(range(len(held)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        first: dict[int, int] = {}
        for x, m in enumerate(mark.tolist()):
            root[x] = find(first.setdefault(m, x))
        pairs = []
        for k in range(0, len(held), 256):
            q, b = within(fps[k : k + 256], fps, WIDE_RADIUS)
            x = q + k
            ok = (x < b) & ((side[x] == 2) | (side[b] == 2) | (side[x] != side[b])) & (mark[x] != mark[b])
            pairs.append(np.stack([_pair_distance(fps[x[ok]], fps[b[ok]]), x[ok], b[ok]]))
        pairs = np.concatenate(pairs, axis=1)
        out = []
        for x, y in pairs[1:, np.argsort(pairs[0], kind="stable")].T.tolist():  # the nearest first: most others are joined by then
            i, j = find(x), find(y)
            if i != j and similar(sets[x], sets[y], least):
                root[max(i, j)] = min(i, j)
                out.append((x, y))
        a, b = (node[[o[k] for o in out]] if out else np.empty(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("component", "i", "j", "node", "side", "mark", "fp", "body")]
        for component, i, j, *row in zip(*cols):
            if held and held[-1][0] != (component, i, j):
                yield links()
                held.clear()
            held.append(((component, i, j), *row))
    if held:
        yield links()


def verified_links(texts: DataFrame, shingle: int = NEAR_SHINGLE, least: float = NEAR_LEAST) -> DataFrame:
    """(a, b): links between texts of one component whose shingle sets have at least this Jaccard similarity.

    texts: node long, component long, fp array<long>, body binary. The links found join what all such links join. A component of
    up to TILE_TEXTS texts is one group. A larger one is cut into tiles; every tile also meets LEADERS of its texts, which
    joins nearly all of a group of copies at a cost linear in it. What is then not joined to the component's largest part meets all
    tiles. So no link is lost, and only components whose texts are hardly alike cost more than a few readings.
    """
    per = texts.groupBy("component").agg(F.count("*").alias("held"), F.sum(F.octet_length("body")).alias("bytes"))
    tiles = F.greatest(F.ceil(F.col("held") / TILE_TEXTS), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    per = staged(per.select("component", tiles.alias("tiles")), "tiles")
    cut = texts.join(per, "component").withColumn("i", F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int"))
    cols = ["component", "i", "j", "node", "side", "mark", "fp", "body"]
    own = cut.select("component", "i", F.lit(0).alias("j"), "node", F.lit(2).alias("side"), F.col("node").alias("mark"), "fp", "body")
    large = per.where("tiles > 1")
    check = lambda df: df.select(*cols).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(lambda it: _verify(it, shingle, least), "a long, b long")
    if large.isEmpty():
        links = staged(check(own), "verified")
        unstage(per)
        return links
    turn = Window.partitionBy("component").orderBy(F.xxhash64("node", F.lit(4)), "node")
    leaders = texts.join(large, "component").select("component", "node", "tiles").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= LEADERS)
    guests = texts.join(leaders.select("node", "tiles"), "node").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    guests = guests.where(F.col("i") != F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles"))).select("component", "i", F.lit(0).alias("j"), "node", F.lit(2).alias("side"), F.col("node").alias("mark"), "fp", "body")
    links = staged(check(own.unionByName(guests)), "verified")
    # a tile's leaders are joined by one tile only if they are alike; what stays apart from the largest part meets every tile
    parts = connected_components(links)
    marked = staged(cut.where("tiles > 1").select("component", "node", "i", "tiles").join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("mark", F.coalesce("part", "node")).drop("part"), "marked")
    most = marked.groupBy("component", "mark").count().groupBy("component").agg(F.max(F.struct("count", F.col("mark").alias("main")))["main"].alias("main"))
    apart = marked.join(most, "component").where("mark <> main")
    chunks = apart.groupBy("component").agg(F.ceil(F.count("*") / TILE_TEXTS).cast("int").alias("chunks"))
    apart = staged(apart.join(chunks, "component").withColumn("j", F.pmod(F.xxhash64("node", F.lit(6)), F.col("chunks")).cast("int")).select("component", "node", "j", "tiles", "chunks", "mark"), "apart")
    if apart.isEmpty():
        unstage(per, marked, apart)
        return links
    body = texts.select("node", "fp", "body")
    some = apart.select("component", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"), "j", "node", F.lit(1).alias("side"), "mark")
    every = marked.join(apart.groupBy("component").agg(F.first("chunks").alias("chunks")), "component")
    every = every.select("component", "i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), "node", F.lit(0).alias("side"), "mark")
    more = staged(check(some.unionByName(every).join(body, "node")), "verified")
    unstage(per, marked, apart)
    return links.unionByName(more)


def near_copies(docs: DataFrame, least: float = NEAR_LEAST, shingle: int = NEAR_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, h2, component): one row for each row of docs whose text has a word; near copies share a component.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least least; every link is checked on the whole
    texts. Candidates share a min-wise key (BANDS, ROWS), which 998 of 1000 pairs at 0.8 do, and nearly all above; SimHash distances
    by bit planes leave the pairs to check. h1, h2 (text_key) and doc_id tell the row; doc_id may be null or repeated. Equal texts share a
    component. Rows without words are left out, other columns too. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            made: dict[bytes, tuple] = {}
            got = []
            for text in b.column(3).to_pylist():
                if text not in made:
                    h = shingle_hashes(text, shingle)
                    made[text] = ([_majority(h if k == 0 else _mix(h, k)) for k in range(WIDE_WORDS)], min_keys(h)) if len(h) else (None, None)
                got.append(made[text])
            fps = [None if g[0] is None else np.array(g[0], np.uint64).view(np.int64) for g in got]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps, pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "fp", "keys"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(text_col), utf8(text_col).alias("body"))
    fps = staged(rows.mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, fp array<long>, keys array<long>").where("fp is not null"), "fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"].alias("one")
    texts = fps.groupBy("h1", "h2").agg(first, F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = staged(texts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = staged(nodes.select(F.explode("keys").alias("key"), "node"), "keys")
    stars = near_links(keys, WIDE_RADIUS, nodes)
    tied = staged(connected_components(stars).join(nodes.select("node", "h1", "h2", "one", "fp"), "node"), "tied")
    unstage(keys, stars)
    # one row for each text that has a candidate: the row of its least doc_id
    chosen = rows.select("doc_id", "h1", "h2", "body").where(sieve(tied, "h1")(F.col("h1"))).join(tied, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("one")))
    chosen = staged(chosen.select("node", "component", "fp", "body").dropDuplicates(["node"]), "texts")
    links = verified_links(chosen, shingle, least)
    of = nodes.join(connected_components(links), "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    named = staged(fps.select("doc_id", "h1", "h2").join(of, ["h1", "h2"]).select("doc_id", "h1", "h2", "component"), "groups")
    unstage(fps, nodes, tied, chosen, links)
    return named


def op3_simhash(docs: DataFrame) -> DataFrame:
    """The rows of query op3: doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    out = simhash_components(docs, 4, 4)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0")).alias("fingerprint"), "component_id")
