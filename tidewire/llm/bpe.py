"""Byte-level BPE: ranked merges folded over the byte pieces of distinct words.

encode_native and decode_native are the Spark form: higher-order functions fold the merges, the ranks are a literal,
and decoding concatenates binary pieces. It is right, but an interpreted lambda takes far too long for a corpus (see
README), so encode() folds the same merges in Arrow batches, once for each distinct word that a task meets.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cache, let, slices


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a piece in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the adjacent pair of least rank, leftmost first, until no pair has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 400:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a very long word, with a heap over linked pieces."""
    import heapq

    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here; 0: no piece starts here
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue
        nxt = after[mid]
        end[i], end[mid], after[i] = stop, 0, nxt
        if nxt < n:
            before[nxt] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoding and decoding by one rank file; made once in a task."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pieces = {str(r): p for p, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.memo = Cache(lambda w: " ".join(map(str, merge(w.encode("utf-8"), self.ranks))))

    def ids(self, text: str) -> str:
        """Token ids as decimal numbers joined by one space."""
        memo = self.memo
        return " ".join([memo[w] for w in self.find(text)])

    def bytes_of(self, ids: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.split()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with with_ids, ids array<int>. A null text is encoded
    as the empty one: no ids. Equal rows and null doc_ids stay as they are; other columns are left out. An empty table
    gives an empty table. path is read by each executor and has to exist there.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ids_kind = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for b in slices(batches, "body"):
            n, ids_sha, text_sha, lists = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = codec.ids(text)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.bytes_of(ids)).hexdigest())
                if with_ids:
                    lists.append(list(map(int, ids.split())))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids_kind}")


#: Maps of the literal rank table, so that a look-up scans a few entries.
BUCKETS = 4096


def _rank_literal(ranks: dict[bytes, int]) -> Column:
    """An array of small maps from a piece in hexadecimal to its rank; a piece's map is found by its crc32."""
    import zlib

    shelves: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        shelves[zlib.crc32(piece.hex().encode()) % BUCKETS][piece.hex()] = rank
    import json

    return F.from_json(F.lit(json.dumps(shelves)), "array<map<string,int>>")


def encode_native(words: DataFrame, ranks: dict[bytes, int], col: str = "word") -> DataFrame:
    """words plus ids array<int> of each distinct word: a fold of ranked merges in higher-order functions."""
    table = _rank_literal(ranks)

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.element_at(table, (F.crc32(piece.cast("binary")) % BUCKETS + 1).cast("int")), piece)

    def step(parts: Column, _: Column) -> Column:
        def joined(r: Column) -> Column:
            low = F.array_min(r)
            at = F.array_position(r, low).cast("int")
            both = F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))
            return F.when(low.isNull(), parts).otherwise(
                F.concat(F.slice(parts, F.lit(1), at - 1), F.array(both), F.slice(parts, at + 2, F.size(parts)))
            )

        ranked = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))
        return F.when(F.size(parts) < 2, parts).otherwise(let(ranked, joined))

    hexes = F.lower(F.hex(F.col(col).cast("binary")))
    first = F.transform(F.sequence(F.lit(0), F.octet_length(col) - 1), lambda i: F.substring(hexes, i * 2 + 1, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length(col)), first, step)
    return words.withColumn("ids", F.when(F.octet_length(col) > 0, F.transform(folded, rank)).otherwise(F.array().cast("array<int>")))


def decode_native(ids: Column, ranks: dict[bytes, int]) -> Column:
    """ids array<int> -> binary: the pieces, concatenated."""
    ordered = [p.hex() for p, _ in sorted(ranks.items(), key=lambda x: x[1])]
    table = F.split(F.lit(",".join(ordered)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), ""))


def op8_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of query op8."""
    return encode(docs, path, pattern, with_ids=False)
