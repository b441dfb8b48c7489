"""Quality rules by repetition: suffix arrays over the words of each text.

A task sorts the word suffixes of many texts at once by prefix doubling; suffixes leave the sort when their prefix is
unique in their text. Longest common prefixes of neighbours give the repeated substrings; each place's longest one is
maximal to the right, and the union of these spans is what the text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Words of a repeat that counts, share of words in repeats and words of the longest repeat that a kept text may have.
LEAST_REPEAT, MOST_COVERED, MOST_LONGEST = 5, 0.3, 100
SYMBOLS = b"#*$%&|<>"


def repeats(words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each place, the length of the longest repeat that starts there and occurs elsewhere in the same text; 0 below least.

    words: word numbers; doc: text number of each place, ascending.
    """
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n == 0:
        return longest
    end = np.searchsorted(doc, doc, side="right")
    # group = first place in suffix order of the suffixes with the same prefix so far
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    group = np.empty(n, np.int64)
    group[order] = _heads(key[order])
    live = order[_shared(group[order])]
    levels, k = [group.copy()], 1
    while len(live):
        after = live + k
        inside = after < end[live]
        second = np.where(inside, group[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, group[live]))
        live, second = live[by], second[by]
        g = group[live]
        new = np.r_[True, (g[1:] != g[:-1]) | (second[1:] != second[:-1])]
        old = np.r_[True, g[1:] != g[:-1]]
        at = np.arange(len(live))
        first_old = np.maximum.accumulate(np.where(old, at, 0))
        first_new = np.maximum.accumulate(np.where(new, at, 0))
        group = group.copy()
        group[live] = g + (first_new - first_old)
        k *= 2
        live = live[_shared(group[live])]
        if len(live):
            levels.append(group)
    # unique suffixes are in their final place; LCP of neighbours by going down the levels
    rank_of = np.empty(n, np.int64)
    rank_of[group] = np.arange(n)
    a, b = rank_of[:-1], rank_of[1:]
    same = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = (x < end[a]) & (y < end[b])
        eq = ok & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)])
        lcp += np.where(eq, 1 << level, 0)
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    longest[longest < least] = 0
    return longest


def _heads(sorted_key: np.ndarray) -> np.ndarray:
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_key)), 0))


def _shared(sorted_group: np.ndarray) -> np.ndarray:
    """Whether a place's group has another member; equal groups lie side by side."""
    same = sorted_group[1:] == sorted_group[:-1]
    return np.r_[False, same] | np.r_[same, False]


def _union(longest: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which places lie in a span [i, i + longest[i])."""
    delta = np.zeros(len(longest) + 1, np.int64)
    at = np.flatnonzero(longest)
    delta[at] += 1
    np.subtract.at(delta, at + longest[at], 1)
    return delta.cumsum()[:-1] > 0


def measure(texts: list[bytes], least: int) -> dict[str, np.ndarray]:
    numbers: dict[bytes, int] = {}
    number = lambda w: numbers.setdefault(w, len(numbers))
    split = [t.split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((number(w) for ws in split for w in ws), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(len(texts)), n_words)
    longest = repeats(words, doc, 1)
    windows = np.where(longest >= 8, 8, 0)
    longest = np.where(longest >= least, longest, 0)
    starts = n_words.cumsum() - n_words
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest")}
    out["n_words"] = n_words
    np.add.at(out["n_repeat_words"], doc, _union(windows, starts).astype(np.int64))
    np.add.at(out["n_covered"], doc, _union(longest, starts).astype(np.int64))
    np.maximum.at(out["longest"], doc, longest)
    for i, t in enumerate(texts):
        held = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        out["word_chars"][i] = len(t) - held[0x80:0xC0].sum() - held[9:14].sum() - held[32]
        out["n_symbols"][i] = held[list(SYMBOLS)].sum()
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def quality(docs: DataFrame, least: int = LEAST_REPEAT, most_covered: float = MOST_COVERED, most_longest: int = MOST_LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its measures, base_failed and kept.

    n_covered: words in repeats of least or more words; longest: the longest repeat. kept: not base_failed, at most
    most_covered of the words in repeats, and no repeat of over most_longest words. A null or empty text has zeros and
    fails the base rule. Texts are measured alone, whole, so copies among rows change nothing. Other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body", 2 << 20):
            m = measure(b.column(1).to_pylist(), least)
            failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            kept = ~failed & (m["n_covered"] <= most_covered * m["n_words"]) & (m["longest"] <= most_longest)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, m.values()), pa.array(failed), pa.array(kept)], names=["doc_id", *m, "base_failed", "kept"])

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest long, base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("body")).mapInArrow(run, schema)


def op6_quality(docs: DataFrame) -> DataFrame:
    """The rows of query op6."""
    return quality(docs)
