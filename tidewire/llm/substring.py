"""Substring dedup: remove words covered by windows of words that occur more than once in the corpus.

First pass: a count-min sketch of ROWS rows of counters. A window is counted under its anchor, the run of ANCHOR words with the
least hash inside it (equal windows have equal anchors at equal places), once for all windows of a stretch that share the anchor's
place; so a counter is never below the count of any window of its anchors, and a window's estimate is the least of its ROWS
counters. Each task counts its part (Spark's partial aggregation), the parts are merged by cell, and the cells lie spread over the
executors: the width of a row follows the corpus, and nothing of it is broadcast. Second pass: only windows whose estimate is two
or more are grouped exactly, by a digest of their words. Both passes send back what turned out single: a counter of one names
its only stretch, so it is found without joining the counts to their members, and a passage in a third of all documents is no
hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, utf8

#: Words in a window; words in an anchor; rows of the sketch; bytes of text for each cell of a row (a stretch of windows takes
#: about 60 bytes of text, so a tenth of the cells or less are taken and two rows agree by chance for one stretch in a hundred).
WINDOW, ANCHOR, ROWS, CELL_BYTES = 35, 8, 2, 4
#: Bytes of text hashed at once, and documents named by one row for a run of equal texts.
CHUNK, NAMED = 1 << 20, 1000
_B1, _B2, _B3 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64; kept and widened as needed, up to a few MB for each base."""
    held = _tables.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 4 * CHUNK:
            _tables[base] = held
    return held[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


_I1, _I2, _I3 = _inverse(_B1), _inverse(_B2), _inverse(_B3)


def _rolling(h: np.ndarray, n: int, base: int, inverse: int) -> np.ndarray:
    """A polynomial of each run of n hashes, modulo 2**64; equal runs give equal values wherever they stand."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * _powers(base, len(h)))])
    return (sums[n:] - sums[:-n]) * _powers(inverse, len(h) - n + 1)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words: a polynomial of a word's bytes, taken from running sums over all texts at once."""
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[joined], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((joined.astype(np.uint64) + np.uint64(1)) * _powers(_B3, len(joined)))])
    h = _stir((sums[ends] - sums[starts]) * _powers(_I3, len(joined))[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))
    after = np.cumsum([len(t) + 1 for t in texts])
    return np.split(h, np.searchsorted(starts, after[:-1]))


def _leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values, where its least value stands first. Values are compared by their upper 40 bits."""
    at = (x >> np.uint64(24) << np.uint64(24)) | np.arange(len(x), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        at = np.minimum(at[: len(at) - step], at[step:])
        done += step
    return (at & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchors(h: np.ndarray, window: int, width: int = 1 << 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, first window, windows) for each stretch of windows that share an anchor place. h: word hashes of one text.

    cells: one of width cells in each row of the sketch, numbered row after row.
    """
    grams = _stir(_rolling(h, ANCHOR, _B1, _I1))
    at = [_leftmost_least(grams[s : s + (1 << 23) + window - ANCHOR], window - ANCHOR + 1) + s for s in range(0, max(1, len(h) - window + 1), 1 << 23)]
    at = at[0] if len(at) == 1 else np.concatenate(at)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    held = grams[at[first]]
    cells = [(_stir(held + np.uint64(_B2 * r % 2**64)) % np.uint64(width) + np.uint64(r * width)).view(np.int64) for r in range(ROWS)]
    return np.stack(cells), first, np.diff(np.concatenate([first, [len(at)]]))


def _places(spans: list[int]) -> np.ndarray:
    """(first, windows) pairs, flat -> every window's place."""
    first, count = np.array(spans, np.int64).reshape(-1, 2).T
    return np.repeat(first - (count.cumsum() - count), count) + np.arange(count.sum())


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): each text without the words in windows that also start elsewhere.

    Windows are judged on the input, so every copy of a repeated passage goes. A null text, or one of fewer words than the
    window, loses nothing. Equal rows repeat each other. Texts are split at spaces and U+0009 to U+000D; kept
    words are joined by one space. kept_text is null where nothing was removed; with_text=False leaves it out. Other columns
    are left out. An empty table gives an empty table. Equal texts that meet in a task are worked on once.
    """
    if window < ANCHOR + 1:
        raise ValueError(f"a window needs over {ANCHOR} words")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("body"))
    # a text is told by 96 bits of hashes
    rows = rows.select("doc_id", F.xxhash64("body").alias("row"), F.shiftright(F.xxhash64(F.lit(7), "body"), 32).cast("int").alias("row2"), "body")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")).first()["bytes"]
    width = 1 << max(16, (size // CELL_BYTES).bit_length())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body", CHUNK):
            hashed = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_hashes(b.column(2).to_pylist()))
            got = [(row, row2, *anchors(h, window, width)) for row, row2, h in hashed if len(h) >= window]
            if got:
                n = [len(g[3]) for g in got]
                row_of, row2_of = np.repeat(np.array([g[0] for g in got], np.int64), n), np.repeat(np.array([g[1] for g in got], np.int32), n)
                cells, firsts = np.concatenate([g[2] for g in got], axis=1), np.concatenate([g[3] for g in got]).astype(np.int32)
                for line in cells:
                    yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(row_of), pa.array(row2_of), pa.array(firsts)], names=["cell", "row", "row2", "first"])

    counted = rows.select("row", "row2", "body").mapInArrow(sketch, "cell long, row long, row2 int, first int")
    # a counter of one was raised by one stretch, and the least values are that stretch's own
    merged = counted.groupBy("cell").agg(F.count("*").alias("counter"), F.min("row").alias("row"), F.min("row2").alias("row2"), F.min("first").alias("first"))
    # the estimate is the least counter: one counter of one is enough
    single = merged.where("counter = 1").groupBy("row", "row2").agg(F.collect_set("first").alias("single"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body", CHUNK):
            docs_of, row_of, row2_of, texts, ones_of = [], [], [], [], []
            for doc, row, row2, text, ones in zip(*(b.column(i).to_pylist() for i in range(5))):
                if row_of and row_of[-1] == row and texts[-1] == text and len(docs_of[-1]) < NAMED:
                    docs_of[-1].append(doc)
                    continue
                docs_of.append([doc])
                row_of.append(row)
                row2_of.append(row2)
                texts.append(text)
                ones_of.append(ones)
            n, shas, bodies, spans = [], [], [], []
            for text, h, ones in zip(texts, word_hashes(texts), ones_of):
                left = []
                if len(h) >= window:
                    _, first, count = anchors(h, window)
                    again = ~np.isin(first, np.array(ones or [], np.int64))
                    left = np.stack([first[again], count[again]], axis=1).ravel().tolist()
                n.append(len(h))
                spans.append(left)
                bodies.append(text if left else None)
                shas.append(None if left else hashlib.sha256(b" ".join(text.split())).hexdigest())
            cols = [pa.array(docs_of, _docs_type(b)), pa.array(row_of, pa.int64()), pa.array(row2_of, pa.int32()), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(bodies, pa.binary()), pa.array(spans, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["docs", "row", "row2", "n_words", "sha", "body", "spans"])

    judged = rows.join(single, ["row", "row2"], "left").select("doc_id", "row", "row2", "body", "single").sortWithinPartitions("row")
    judged = staged(judged.mapInArrow(candidates, f"docs array<{kind}>, row long, row2 int, n_words long, sha string, body binary, spans array<int>"), "windows")
    open_rows = judged.where("body is not null").select("docs", "row", "row2", "body", "spans")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body", CHUNK // 2):
            parts = []
            for row, row2, copies, h, spans in zip(*(b.column(i).to_pylist() for i in range(3)), word_hashes(b.column(3).to_pylist()), b.column(4).to_pylist()):
                at = _places(spans)
                one, two = _rolling(h, window, _B1, _I1)[at], _rolling(_stir(h), window, _B2, _I2)[at] >> np.uint64(32)
                parts.append((one.view(np.int64), two.astype(np.uint32).view(np.int32), np.full(len(at), row, np.int64), np.full(len(at), row2, np.int32), (at if copies == 1 else ~at).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["one", "two", "row", "row2", "place"])

    # a negative place stands for a text with copies: its windows count twice
    windows = open_rows.select("row", "row2", F.size("docs").alias("copies"), "body", "spans").mapInArrow(digests, "one long, two int, row long, row2 int, place int")
    exact = windows.groupBy("one", "two").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("row2").alias("row2"), F.min("place").alias("place"))
    alone = exact.where("n = 1 and place >= 0").groupBy("row", "row2").agg(F.collect_list("place").alias("alone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            n, removed, shas, texts = [], [], [], []
            for text, spans, ones in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                words = text.split()
                hit = np.zeros(len(words) + 1, np.int64)
                at = np.setdiff1d(_places(spans), np.array(ones or [], np.int64))
                hit[at] += 1
                hit[at + window] -= 1
                gone = hit.cumsum()[:-1] > 0
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                n.append(len(words))
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
            names = ["docs", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    text_kind = ", kept_text string" if with_text else ""
    ended = open_rows.join(alone, ["row", "row2"], "left").select("docs", "body", "spans", "alone")
    ended = ended.mapInArrow(cut, f"docs array<{kind}>, n_words long, n_removed long, kept_sha256 string{text_kind}")
    clean = judged.where("body is null").select("docs", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    if with_text:
        clean = clean.withColumn("kept_text", F.lit(None).cast("string"))
    out = ended.unionByName(clean)
    return out.select(F.explode("docs").alias("doc_id"), *[c for c in out.columns if c != "docs"])


def _docs_type(b: pa.RecordBatch) -> pa.DataType:
    return pa.list_(b.column(0).type)


def op7_substring(docs: DataFrame) -> DataFrame:
    """The rows of query op7."""
    return remove_repeats(docs, with_text=False)
