"""Benchmark decontamination (operator 12): a prefix-filtered join of document words with item windows.

An item's windows are WIDTH consecutive words (a shorter item is one window). A window is contained if all its shingles of SHINGLE words
are, so by the prefix filter one shingle of a window is enough to find it: the one that is rarest in the documents. Documents are read
twice. The first pass counts the items' shingles; the second one meets the rarest shingle of each window, bounds the window's place by where
the shingle stands in it and by the document's length, and compares all its words. A bitmap of fixed size keeps other
shingles out of both shuffles; what it lets through by chance falls out in the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, slices, staged, unstage, utf8

#: Words of a window (fixed value), words of a shingle, bits of the bitmap that goes to every task.
WIDTH = 10
SHINGLE = 3
BITS = 1 << 24

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest separates words.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
LETTERS = bytes(b if b >= 0x80 or b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_TURN = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def _hashes(words: list[bytes], known: Cache) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of size consecutive words, for each place where they fit."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count] + np.uint64(size)
    for k in range(1, size):
        out = out * _TURN ^ hashes[k : k + count]
    return out ^ out >> np.uint64(29)


def _known() -> Cache:
    return Cache(lambda w: xxhash.xxh64_intdigest(w, 7))


def item_windows(items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, size, k, offset, shingle): every shingle, of k words, of every window of size words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(width, len(words))
                k = min(shingle, size)
                marks = _shingles(_hashes(words, known), k).view(np.int64).tolist() if size else []
                for at in range(len(words) - size + 1 if size else 0):
                    window = b" ".join(words[at : at + size]).decode()
                    out += [(item, window, size, k, offset, marks[at + offset]) for offset in range(size - k + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)

    kind = items.schema["item_id"].dataType.simpleString()
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = ["item_id", "words", "size", "k", "offset", "shingle"]
    schema = "item_id string, words string, size int, k int, offset int, shingle long"
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), utf8("text").alias("text")).mapInArrow(run, schema)
    return rows.withColumn("item_id", F.col("item_id").cast(kind)).distinct()


def _bitmap(shingles: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of BITS bits with those of the shingles set, and the shingles' sizes. At most BITS / 64 rows come to the driver."""
    place = F.pmod(F.col("shingle"), F.lit(BITS))
    rows = shingles.select("k", F.floor(place / 64).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(shingle, {BITS}) % 64 as int))").alias("bit"))
    # sizes are at most SHINGLE numbers
    cells = rows.groupBy("at").agg(F.bit_or("bit").alias("bits"), F.collect_set("k").alias("ks")).collect()
    out = np.zeros(BITS // 64, np.int64)
    for cell in cells:
        out[cell["at"]] = cell["bits"]
    return out.view(np.uint64), sorted({k for cell in cells for k in cell["ks"]})


def _found(marks: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places whose shingle the bitmap holds."""
    place = marks & np.uint64(BITS - 1)
    return np.flatnonzero(bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))


def shingle_counts(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(shingle, often): how often each shingle of the items stands in the documents, all of them."""
    bitmap, sizes = _bitmap(shingles)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        for batch in slices(batches, "text"):
            hits = []
            for text in batch.column(0):
                hashes = _hashes(words_of(text.as_py()), known)
                for k in sizes:
                    marks = _shingles(hashes, k)
                    hits.append(marks[_found(marks, sent.value)])
            values, counts = np.unique(np.concatenate(hits) if hits else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["shingle", "often"])

    counted = docs.select(utf8("text").alias("text")).mapInArrow(run, "shingle long, often long")
    return counted.groupBy("shingle").agg(F.sum("often").alias("often")).join(shingles.select("shingle").distinct(), "shingle", "left_semi")


def rarest(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(words, size, k, offset, shingle): of each window's shingles the one that is rarest in the documents; windows with an absent one can't occur."""
    distinct = windows.select("words", "size", "k", "offset", "shingle").distinct()
    known = distinct.join(counts, "shingle", "left").groupBy("words", "size", "k").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shingle", "offset")).alias("least"))
    return known.where("least.often > 0").select("words", "size", "k", "least.offset", "least.shingle")


def scan(docs: DataFrame, prefixes: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_words, met): met holds, for each place of a prefix shingle, the words around it that a window may have."""
    bitmap, sizes = _bitmap(prefixes)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    fields = pa.struct([("place", pa.int32()), ("first", pa.int32()), ("shingle", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        for batch in slices(batches, "text"):
            counts, met = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hashes = _hashes(words, known)
                own = []
                for k in sizes:
                    marks = _shingles(hashes, k)
                    at = _found(marks, sent.value)
                    for place, mark in zip(at.tolist(), marks[at].view(np.int64).tolist(), strict=True):
                        first = max(0, place + k - width)
                        own.append({"place": place, "first": first, "shingle": mark, "words": b" ".join(words[first : place + width]).decode()})
                counts.append(len(words))
                met.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(met, pa.list_(fields))], ["doc_id", "n_words", "met"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, met array<struct<place:int,first:int,shingle:long,words:string>>")


def occurrences(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): doc_id, n_words and row of every document; row, item_id, start and size of every occurrence of an item's window.

    Null and empty texts have no words: such an item has no window. Items with equal windows all hit. Rows are told apart by row,
    not by doc_id, so null and repeated doc_ids are fine. An item without an id marks words, but has no name to be listed or counted by.
    """
    windows = staged(item_windows(items, width, shingle), "leak-windows")
    counts = staged(shingle_counts(docs, windows), "leak-counts")
    prefixes = staged(rarest(windows, counts), "leak-prefixes")
    rows = staged(scan(docs, prefixes, width).withColumn("row", F.monotonically_increasing_id()), "leak-rows")
    unstage(counts)
    met = rows.where("size(met) > 0").select("row", "n_words", F.explode("met").alias("m")).select("row", "n_words", "m.*")
    start = F.col("place") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.slice(F.split(F.col("around"), " "), F.greatest(start - F.col("first") + 1, F.lit(1)), F.col("size"))
    near = met.withColumnRenamed("words", "around").join(prefixes, "shingle").where(fits)
    found = near.where(F.array_join(same, " ") == F.col("words")).select("row", start.alias("start"), "size", "words")
    hits = found.join(windows.select("words", "item_id").distinct(), "words").select("row", "item_id", "start", "size")
    return rows.select("row", "doc_id", "n_words"), hits


def op12_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document row; see occurrences() for nulls, ties and repeated rows.

    A document without words isn't contaminated; without items none is. Empty documents give an empty table.
    """
    rows, hits = occurrences(docs, items)
    # stretches by their ends; each adds the words past the last one's end
    spans = F.array_sort(F.collect_set(F.struct("start", "size")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(s["start"] + s["size"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["start"] + s["size"]).alias("end"))
    items_of = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    by_row = hits.groupBy("row").agg(F.aggregate(spans, start, step)["n"].alias("n_hit"), items_of.alias("items"))
    none = F.array().cast("array<string>")
    named = F.coalesce("items", none)
    out = rows.join(by_row, "row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return out.select("doc_id", "n_words", "n_hit", F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
