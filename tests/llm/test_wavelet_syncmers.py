import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import syncmers as Y
from tidewire.llm import wavelet as V

TEXTS = ["", None, "Hello, World!", "don't <|endoftext|> stop", "Tab\tand  two\nlines", "é́ café ÅNGSTRÖM", "日本語 text 🙂.", "x" * 3000, "a.b.c 12.5% (yes)", " nbsp　wide", "it's we'll I'm;"]


def test_shard_operations():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (700, 3), (5000, 49408), (3000, 90000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        shard = V.Shard(V.pack(ids, [5, None], [n, 0]))
        assert shard.all().astype(np.uint32).tolist() == ids.tolist()
        assert shard.doc_ids == [5, None] and shard.lengths.tolist() == [n, 0]
        for i in rng.integers(0, n, 30).tolist() if n else []:
            assert shard.access(i) == ids[i]
            v, at = int(ids[i]), np.flatnonzero(ids == ids[i])
            assert shard.count(v) == len(at) and shard.count(v, i) == (ids[i:] == v).sum()
            k = int(rng.integers(0, len(at)))
            assert shard.find(v, k) == at[k] and shard.find(v, len(at)) is None
        assert shard.count(1 << 20) == 0


def test_one_access_reads_one_block_of_each_plane():
    ids = np.random.default_rng(1).integers(0, 49000, 300_000).astype(np.uint32)
    shard = V.Shard(V.pack(ids, [1], [len(ids)], block=4096))
    assert shard.blocks_read == 0 and shard.access(123_456) == ids[123_456] and shard.blocks_read == shard.bits
    assert shard.find(int(ids[7]), 0) == np.flatnonzero(ids == ids[7])[0]


def test_encoder_equals_the_plain_library_call():
    lib, rng = Tokenizer.from_file(P.path("word_bpe_49k.json")), random.Random(3)
    bits = ["\u0130", "I", "i", "\u0307", "\u0301", "e", "E", "ß", "ẞ", "ſ", "Σ", "ς", "é", "É", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "'s", "'S", "'ll", "don't", "abc", "Hello", "12"]
    bits += [".", ",", "!", "|", "&", "#", " ", "\n", "\t", "\u00a0", "\u3000", "\u0085", "\x1c", "\x0b", "日本", "🙂", "Ⱥ", "\u212a", "ﬁ", "ǅ", "J", "\u030c", "\u200b", "_", "-", "ª", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(4000)] + ["a <|endoftext|> b", "x" * 20_000 + "\u0130"]
    ids, sizes = V.Encoder(P.path("word_bpe_49k.json")).encode(pa.array(texts))
    for text, got in zip(texts, np.split(ids, sizes.cumsum()[:-1])):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_files_round_trip(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(2)
    rows = [(rng.randrange(10**9), t, "x") for t in TEXTS for _ in range(7)] + [(None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    out = f"file://{tmp_path}/shards"
    V.write_shards(df, path, out, shard_tokens=200)
    got = sorted(V.read_shards(spark, out).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc, text, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)


def test_repeated_ids_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(7, "one"), (7, "two words"), (7, "two words"), (None, "three of them"), (None, None), (None, "a"), (3, "x"), *[(5, f"text {i % 9} " * (i % 4)) for i in range(60)]]
    seen = set()
    for k in range(3):
        rng.shuffle(rows)
        out = f"file://{tmp_path}/files{k}"
        V.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(k + 1), P.path("word_bpe_49k.json"), out, shard_tokens=50)
        seen.add(tuple(sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in V.read_shards(spark, out).collect())))
    assert len(seen) == 1 and len(next(iter(seen))) == len(rows)


def test_empty_files(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    V.write_shards(df, P.path("word_bpe_49k.json"), f"file://{tmp_path}/none")
    assert V.read_shards(spark, f"file://{tmp_path}/none").count() == 0


def frame(spark, texts, step=3):
    """Rows with columns whose names clash with those of the operator."""
    rows = [(i * step, t, "z", "f", 7, 8) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, next string, fp string, n_chars int, __key int")


def spark_hash(values) -> int:
    """XXH64 of a string, or of an array of long, seed 42, as a signed number."""
    if isinstance(values, str):
        h = xxhash.xxh64_intdigest(values.encode(), 42)
    else:
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def plain_sketch(text: str) -> list[tuple[int, int]]:
    """(36 bits of the hash, place) of the least anchors."""
    units = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        units += [word] if len(word) <= Y.LONG_WORD else list(word)
    h, k = [spark_hash(u) for u in units], Y.K
    if len(h) < k:
        starts = [0] * bool(h)
    else:
        runs = range(len(h) - k + 1)
        starts = [i for i in runs if min(h[i : i + k]) in (h[i], h[i + k - 1])] or [min((spark_hash(h[i : i + k]), i) for i in runs)[1]]
    first = {}
    for i in starts:
        first.setdefault((spark_hash(h[i : i + k]) % 2**64) >> 28, i)
    return sorted(first.items())[: Y.SKETCH]


def plain_likeness(a, b) -> float:
    if not a and not b:
        return 1.0
    both = sorted({h for h, _ in a} | {h for h, _ in b})[: Y.SKETCH]
    at, bt = dict(a), dict(b)
    offsets = [at[h] - bt[h] for h in both if h in at and h in bt]
    return max((sum(o <= x <= o + Y.BAND for x in offsets) for o in offsets), default=0) / len(both)


def as_text(fp) -> str:
    return "".join(f"{h << Y.PLACE_BITS | at:016x}" for h, at in fp)


def check(rows, got):
    """Every row against the plain version; rows: (doc_id, text)."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash(r[1] or "")))
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(nxt)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), plain_likeness(a, b), plain_likeness(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_fingerprints_and_likeness_against_a_plain_version(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 5) + str(rng.randrange(500)) for _ in range(rng.choice([0, 3, 6, 7, 80, 400]))) for _ in range(60)]
    texts += [None, "", "é🙂 ü", "same text " * 20, "same text " * 20, "one two three four five six seven", "p q r s t u v", "日本語の文章には空白がないので文字ごとに読みます" * 3, "x" * 3000, " ".join(f"w{i}" for i in range(20_000))]
    df = frame(spark, texts).drop("n_chars", "fp")
    got = Y.op5_fingerprints(df.repartition(6)).collect()
    check([(3 * i, t) for i, t in enumerate(texts)], got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[64 * 3].fingerprint == by_id[63 * 3].fingerprint and by_id[64 * 3].near_next == 1.0
    assert all(r.fingerprint for r in got if (texts[r.doc_id // 3] or "").strip())  # every text with a word has an anchor
    assert by_id[67 * 3].near_edited > 0.3  # a text without spaces is like its edited form
    assert by_id[65 * 3].near_next == 0.0  # neither has a closed syncmer


def test_matches_count_in_one_alignment_only(spark):
    words = [f"w{i}" for i in range(120)]
    moved = " ".join([*[f"n{i}" for i in range(500)], *words])  # one alignment, shifted
    apart = " ".join(x for i in range(0, 120, 12) for x in [*words[i : i + 12], *[f"m{i}_{j}" for j in range(200)]])  # ten offsets
    df = spark.createDataFrame([(" ".join(words), moved, apart)], "a string, b string, c string")
    fp = {c: F.col(c) for c in "abc"}
    made = spark.createDataFrame(df.select(*[Y.sketch(F.col(c), size=10_000).alias(c) for c in "abc"]).collect(), "a array<long>, b array<long>, c array<long>")
    r = made.select(Y.likeness(fp["a"], fp["a"], 10_000).alias("own"), Y.likeness(fp["a"], fp["b"], 10_000).alias("shifted"), Y.likeness(fp["a"], fp["c"], 10_000).alias("torn"), Y.likeness(fp["a"], fp["c"], 10_000, 1 << 20).alias("loose")).first()
    assert r.own == 1.0 and r.shifted > 0.1 and 0 < r.torn < 0.5 * r.loose


def test_repeated_and_null_ids_do_not_depend_on_the_dealing(spark):
    rows = [(5, "a b c"), (5, "d e f g"), (5, "zz top"), (None, "n1 x"), (None, "n2 y"), (None, None), (None, None), (7, "one two"), (7, "one two"), (-(2**63), "least"), (2**63 - 1, "most")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 3, 7):
        check(rows, Y.op5_fingerprints(df.repartition(n)).collect())


def test_closed_syncmers(spark):
    """Anchors are the runs whose least word hash is at an edge, wherever the passage stands."""
    words = [f"w{i % 37}" for i in range(80)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "other words first " + " ".join(words))], "doc_id long, text string")
    a, b = (r.anchors for r in Y.fingerprints(df).orderBy("doc_id").collect())
    h = {w: spark_hash(w) for w in words}
    want = [i for i in range(len(words) - Y.K + 1) if min(h[w] for w in words[i : i + Y.K]) in (h[words[i]], h[words[i + Y.K - 1]])]
    assert [x.unit for x in a] == want
    assert [(x.unit - 3, x.hash) for x in b if x.unit >= 3] == [(x.unit, x.hash) for x in a]


def test_single_row_and_none(spark):
    (r,) = Y.op5_fingerprints(frame(spark, ["one two three four five six seven eight"])).collect()
    assert r.near_next == 1.0
    assert Y.op5_fingerprints(frame(spark, ["x"]).limit(0)).count() == 0
