"""Token ids in wavelet-matrix files: one shard holds a run of documents in ascending doc_id order.

A shard keeps one bit plane for each bit of the ids, highest first; each plane orders the ids stably by that bit for
the next one. With rank and select on the planes it gives access to a token, counts of an id in a range
and the places where an id occurs, without decoding the rest. Planes are compressed in blocks of BLOCK bits, and the file
holds where each block lies and how many ones come before it: a rank reads one block, a select one block after a search in
the samples.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cache, slices

MAGIC = b"WVM2"
#: Tokens after which a shard is closed at the end of a document.
SHARD_TOKENS = 1 << 20
#: Bits of a plane that are compressed together, and blocks that an open shard keeps decompressed.
BLOCK, KEPT_BLOCKS = 1 << 16, 64
#: The id that ends each document.
END = 1
_HEAD = "<QQBIQ"


def pack(ids: np.ndarray, doc_ids: list, lengths: list[int], block: int = BLOCK) -> bytes:
    """One shard file: magic, counts, the documents' ids and lengths, then for each plane its samples and its compressed blocks.

    Counts: ids, documents, planes, bits in a block, bytes of the documents' part. A plane: its zeros, then for each block the
    ones before it and its bytes, then the blocks.
    """
    if block % 8:
        raise ValueError("a block is whole bytes")
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    squeeze = zstandard.ZstdCompressor(level=1).compress
    head = squeeze(np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array(lengths, np.int64).tobytes())
    out = [MAGIC, struct.pack(_HEAD, len(ids), len(doc_ids), bits, block, len(head)), head]
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    starts = np.arange(0, len(ids), block)
    for level in range(bits - 1, -1, -1):
        bit = (seq >> seq.dtype.type(level)) & seq.dtype.type(1) != 0
        plane = np.packbits(bit, bitorder="little").tobytes()
        ones = np.flatnonzero(bit)
        blocks = [squeeze(plane[s // 8 : (s + block) // 8]) for s in starts.tolist()]
        samples = np.stack([np.searchsorted(ones, starts), [len(b) for b in blocks]]).astype("<u8") if blocks else np.empty((2, 0), "<u8")
        out += [struct.pack("<Q", len(seq) - len(ones)), samples.tobytes(), *blocks]
        if level:  # taking places is several times faster than a boolean index
            seq = np.concatenate([seq.take(np.flatnonzero(~bit)), seq.take(ones)])
    return b"".join(out)


class Shard:
    """A shard file opened for reading. Opening reads the head and the samples; a block is decompressed when it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.n, n_docs, self.bits, self.block, size = struct.unpack_from(_HEAD, data, 4)
        at = 4 + struct.calcsize(_HEAD)
        head = zstandard.decompress(data[at : at + size]) if n_docs else b""
        at += size
        null = np.frombuffer(head, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(head, np.int64, n_docs).tolist(), null.tolist())]
        self.lengths = np.frombuffer(head[9 * n_docs :], np.int64, n_docs)
        self.data, self.zeros, self._before, self._spans = data, [], [], []
        n_blocks = -(-self.n // self.block)
        for _ in range(self.bits):
            self.zeros.append(struct.unpack_from("<Q", data, at)[0])
            before, sizes = np.frombuffer(data, "<u8", 2 * n_blocks, at + 8).reshape(2, n_blocks).astype(np.int64)
            ends = at + 8 + 16 * n_blocks + sizes.cumsum()
            self._before.append(before)
            self._spans.append(np.stack([ends - sizes, ends], axis=1))
            at = int(ends[-1]) if n_blocks else at + 8
        self._open = zstandard.ZstdDecompressor().decompress
        self._blocks = Cache(self._read, KEPT_BLOCKS)
        self.blocks_read = 0

    def _read(self, which: tuple[int, int]) -> np.ndarray:
        self.blocks_read += 1
        start, end = self._spans[which[0]][which[1]].tolist()
        return np.frombuffer(self._open(self.data[start:end]), np.uint8)

    def _bits(self, level: int) -> np.ndarray:
        packed = [self._open(self.data[s:e]) for s, e in self._spans[level].tolist()]
        return np.unpackbits(np.frombuffer(b"".join(packed), np.uint8), count=self.n, bitorder="little")

    def all(self) -> np.ndarray:
        """Every id: the planes from the lowest up, each undoing one stable partition."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            bit = self._bits(level).view(bool)
            if level < self.bits - 1:
                up = np.empty(self.n, kind)
                up[np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)])] = seq
                seq = up
            seq |= bit.astype(kind) << kind(self.bits - 1 - level)
        return seq

    def rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane: the sample of the block that holds place i, and the ones before i in it."""
        if i >= self.n:
            return self.n - self.zeros[level]
        at, inside = divmod(i, self.block)
        held = self._blocks[level, at]
        total = int(self._before[level][at]) + int(np.bitwise_count(held[: inside >> 3]).sum())
        return total + (int(held[inside >> 3]) & ((1 << (inside & 7)) - 1)).bit_count()

    def select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane: the samples name its block, the bits of that block its place."""
        starts = np.arange(len(self._before[level])) * self.block
        before = self._before[level] if bit else starts - self._before[level]
        at = int(np.searchsorted(before, k, side="right")) - 1
        count = min(self.block, self.n - at * self.block)
        bits = np.unpackbits(self._blocks[level, at], count=count, bitorder="little")
        return at * self.block + int(np.flatnonzero(bits == bit)[k - int(before[at])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            at, inside = divmod(i, self.block)
            one = int(self._blocks[level, at][inside >> 3]) >> (inside & 7) & 1
            ones = self.rank(level, i)
            value = value << 1 | one
            i = self.zeros[level] + ones if one else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self.rank(level, start), self.rank(level, end)
            one = value >> (self.bits - 1 - level) & 1
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if one else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [start, end)."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def find(self, value: int, k: int = 0) -> int | None:
        """The place of the k-th (from 0) occurrence of an id."""
        a, b = self._range(value, 0, self.n)
        if k >= b - a:
            return None
        at = a + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            at = self.select(level, one, at - self.zeros[level] if one else at)
        return at


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Whole texts to the ids of the library's plain encode(text, add_special_tokens=False), each distinct word once.

    A word is a run without ASCII white space. The tokenizer drops white space, and neither a piece nor a special token's
    string spans it, so a text's ids are its words' ids in a row. Words that were met before are looked up by Arrow. A new
    word goes to the library whole, special tokens and all, but for the commonest kind: letters below U+0250 with marks at
    the end. There both parts are pieces of their own, so the library's model splits the letters and words that differ in
    marks or capitals share them. U+0130 is no such letter: lower-casing makes a letter and a combining mark of it.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normal, self.letters = self.tokenizer.model, self.tokenizer.normalizer, _byte_letters()
        self.parts = Cache(self._part, 300_000)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.first, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _part(self, part: str) -> bytes:
        if _plain(part):
            if not part.isascii():
                part = "".join(map(self.letters.__getitem__, self.normal.normalize_str(part).encode()))
            return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if _plain(core):
            return self.parts[core.lower()] + (self.parts[word[len(core) :]] if len(core) < len(word) else b"")
        return self.parts[word]

    def _learn(self, words: list[str]) -> None:
        got = list(map(self._word, words))
        size = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        self.first = np.concatenate([self.first, len(self.flat) + size.cumsum() - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, np.frombuffer(b"".join(got), np.uint32)])
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids in each text)."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        if len(self.words) + len(distinct) > self.most:
            self._forget()
        known = pc.index_in(distinct, value_set=self.words)
        if known.null_count:
            self._learn(distinct.filter(known.is_null()).to_pylist())
            known = pc.index_in(distinct, value_set=self.words)
        code = known.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
        each = self.size[code]
        ends = each.cumsum()
        ids = self.flat.take(np.repeat(self.first[code] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0))
        edges = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, np.diff(edges)


#: Marks that are never part of a contraction or of a special token's string.
_MARKS = ".,;:!?#*$%&"


def _plain(word: str) -> bool:
    """Letters below U+0250 only, none of which lower-cases to more than a letter."""
    return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file; a worker keeps it for its later tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, tokenizer: str, path: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text and write the shards to the table at path, in ascending doc_id order.

    One row is one shard: part and seq (its order), before (tokens before it in its part), n_tokens, payload (the
    file). A null text is empty and holds the end id only. A null doc_id sorts first. Rows of one doc_id, or without any, are in order of their text's hash and then the text, so
    reruns agree however the rows are dealt out; rows equal in both are interchangeable. An empty table gives a table without rows. Texts are dealt out by ranges of
    (doc_id, hash, place in the input), so neither a repeated doc_id nor a repeated text fills one task.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        stop = np.array([end], np.uint32)
        ids, docs_in, lengths, seq, before, held = [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            data = pack(np.concatenate(ids), docs_in, lengths)
            row = {"part": part, "seq": seq, "before": before, "n_tokens": held, "payload": data}
            return pa.RecordBatch.from_pylist([row], schema=_SHARD)

        for b in slices(batches, "body", 16 << 20):
            got, sizes = enc.encode(b.column(1))
            for doc, own in zip(b.column(0).to_pylist(), np.split(got, sizes.cumsum()[:-1])):
                ids += [own, stop]
                docs_in.append(doc)
                lengths.append(len(own) + 1)
                held += len(own) + 1
                if held >= shard_tokens:
                    yield shard()
                    ids, docs_in, lengths, seq, before, held = [], [], [], seq + 1, before + held, 0
        if docs_in:
            yield shard()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    texts = texts.withColumns({"tie": F.xxhash64("body"), "turn": F.monotonically_increasing_id()})
    ordered = texts.repartitionByRange(n, "doc_id", "tie", "turn").sortWithinPartitions("doc_id", "tie", "body").select("doc_id", "body")
    rows = ordered.mapInArrow(build, "part int, seq int, before long, n_tokens long, payload binary")
    rows.write.option("compression", "uncompressed").parquet(path)


_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, decoded from the planes.

    start counts the ids of all documents before. Its base is one sum for each part of the table; there
    are as many as write partitions, and each shard holds what precedes it in its part.
    """
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, payload in zip(b.column(0).to_pylist(), b.column(1)):
                shard = Shard(payload.as_py())
                ids = shard.all().astype("<u4")
                ends = shard.lengths.cumsum()
                starts = ends - shard.lengths
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + at), pa.array(shard.lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("at"), "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
