import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken

from tidewire.llm import bpe, repetition, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "hello world", "  spaces   and\ttabs\n\nlines ", "naïve café — 日本語 🙂", "a" * 1500, "don't we'll 12345 x_y", "the cat " * 400, " non breaking　wide"]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_bpe_against_the_library(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encode(df, path, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode_ordinary(t or "")
        assert list(got[i].ids) == ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))
    assert bpe.encode(df.limit(0), path, P.PATTERN).count() == 0


def test_bpe_native_fold(spark):
    """The higher-order form agrees on a small rank table."""
    ranks = {bytes([i]): i for i in range(256)} | {b"th": 256, b"he": 257, b"the": 258, b"in": 259, b"ing": 260, b"er": 261}
    words = ["the", "there", "hething", "a", "", "é"]
    df = bpe.encode_native(spark.createDataFrame([(w,) for w in words], "word string"), ranks)
    df = df.withColumn("back", bpe.decode_native(df["ids"], ranks))
    for r in df.collect():
        assert list(r.ids) == bpe.merge(r.word.encode(), ranks), r.word
        assert bytes(r.back) == r.word.encode()


@pytest.mark.parametrize("word", ["a" * 401, "ab" * 300, "the" * 200, "x" * 5000])
def test_bpe_long_words(word):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.merge(word.encode(), ranks) == lib.encode_ordinary(word)


def brute_quality(text, least):
    w = WORD.findall(text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    longest = [max((n for j in range(len(w)) if j != i for n in [next((k for k in range(len(w)) if max(i, j) + k >= len(w) or w[i + k] != w[j + k]), 0)]), default=0) for i in range(len(w))]
    longest = [n if n >= least else 0 for n in longest]
    covered = {j for i, n in enumerate(longest) for j in range(i, i + n)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(covered), max(longest, default=0)


def test_repetition_against_brute_force(spark):
    texts = ["", None, "one two", "a b c d e f g h " * 3, "x " * 40, "line one\nline one\n\n \nother # * & <b>", "é ü 日本 " * 5, "a b c a b d a b c e f g h i j k a b c e f g h i j k l"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.quality(df, 3).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_quality(t or "", 3)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered, r.longest) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert repetition.op6_quality(df.limit(0)).count() == 0


def brute_substring(texts, window):
    starts = {}
    split = [WORD.findall(t or "") for t in texts]
    for d, w in enumerate(split):
        for i in range(len(w) - window + 1):
            starts.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = {(d, j) for v in starts.values() if len(v) > 1 for d, i in v for j in range(i, i + window)}
    return {d: (len(w), sum((d, j) in gone for j in range(len(w))), sha(" ".join(x for j, x in enumerate(w) if (d, j) not in gone))) for d, w in enumerate(split)}


@pytest.mark.parametrize("window", [9, 12, 35])
def test_substring_against_brute_force(spark, window):
    import random

    rng = random.Random(window)
    words = [f"w{i}" for i in range(60)] + ["the", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 34, 35, 36, 90, 300]))) for _ in range(40)]
    shared = " ".join(rng.choice(words) for _ in range(50))
    texts += [f"{t[: len(t) // 2]} {shared}\t{t[len(t) // 2 :]}" for t in texts[:8]] + [texts[7]] * 5 + ["again " * 80, None, "", "  ", " ".join(texts[:6])]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, window).collect()}
    assert got == brute_substring(texts, window)
    if window == 35:
        out = substring.remove_repeats(df.limit(0), window)
        assert out.count() == 0


def test_substring_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df).collect())
    assert got == [(0, 1, 0, None), (1, 40, 40, ""), (1, 40, 40, "")]
