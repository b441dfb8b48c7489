import numpy as np
import pytest
import xxhash

from tidewire.llm import simhash as S


def brute_fingerprint(text: str, k: int = 4) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids: list[int], fps: list[int], radius: int) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c", "A b c D", "the same the same the same", "wörd " * 900, " ".join(f"w{i}" for i in range(70_000))])
def test_fingerprint(text):
    assert S.simhash(text.encode())[0] == brute_fingerprint(text)


def test_within_agrees_with_counting():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    near = [base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for _ in range(150)]
    fps = np.array(near + rng.integers(0, 2**63, 90, dtype=np.uint64).tolist(), np.uint64).reshape(-1, 1)
    for radius in (0, 1, 3, 4, 7):
        q, b = S.within(fps[:100], fps, radius)
        want = {(i, j) for i in range(100) for j in range(len(fps)) if int(fps[i, 0] ^ fps[j, 0]).bit_count() <= radius}
        assert set(zip(q.tolist(), b.tolist())) == want


def test_near_pairs_share_a_key():
    rng = np.random.default_rng(5)
    for clean in (2, 3, 4):
        for _ in range(100):
            a = int(rng.integers(0, 2**63))
            fp = np.array([a, a ^ sum(1 << int(x) for x in rng.choice(64, 4, replace=False))], np.uint64)
            level = (np.zeros(2, np.uint64), fp, np.zeros(2, np.uint64))
            for _ in range(3):  # and again when shared keys are divided
                row, key, used = S._deal(*level, 4, clean)
                both = set(key[row == 0].tolist()) & set(key[row == 1].tolist())
                assert both
                at = [np.flatnonzero((row == r) & (key == next(iter(both))))[0] for r in (0, 1)]
                level = (key[at], fp, used[at])


def rows(spark, texts, kind="long"):
    return spark.createDataFrame(list(enumerate(texts)), f"doc_id {kind}, text string")


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 8)  # keys are divided, groups are cut into tiles
    monkeypatch.setattr(S, "SMALL_RUN", 4)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    for t in texts[:12]:
        for _ in range(6):
            w = t.split()
            w[int(rng.integers(0, len(w)))] = "new"
            texts.append(" ".join(w))
    for k in range(40):  # one group of many near fingerprints
        texts.append(" ".join([*texts[20].split(), f"x{k}"]))
    texts += [texts[3]] * 30 + [None, "", " ", "One", "one"]
    ids = [None if i % 7 == 5 else i // 2 for i in range(len(texts))]  # repeated and missing ids
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id int, text string, node string")
    got = [tuple(r) for r in S.op3_simhash(df).collect()]
    fps = [brute_fingerprint(t or "") for t in texts]
    part = brute_components(list(range(len(texts))), fps, 4)
    least = {c: min((ids[i] for i in range(len(texts)) if part[i] == c and ids[i] is not None), default=None) for c in set(part.values())}
    want = [(ids[i], f"{fps[i]:016x}", least[part[i]]) for i in range(len(texts))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp string, node int, component_id string")
    assert S.op3_simhash(df).count() == 0
    df = spark.createDataFrame([(1, "a b c d", "x", 1, "y"), (2, "a b c d", "z", 2, "y")], df.schema)
    assert {tuple(r) for r in S.op3_simhash(df).select("doc_id", "component_id").collect()} == {(1, 1), (2, 1)}


def edited(rng, base: list[str], share: float) -> list[str]:
    """base with words replaced at random, so that the shingle sets are about share alike."""
    w = list(base)
    n = max(1, round(len(w) * (1 - share) / (1 + share) / 5))
    for at in rng.choice(len(w), n, replace=False).tolist():
        w[at] = f"e{rng.integers(1 << 40)}"
    return w


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def test_recall_of_near_pairs_by_similarity(spark):
    """Pairs by band of their exact similarity: nearly all at 0.8 and more are linked, none below."""
    rng = np.random.default_rng(2)
    texts = []
    for k in range(700):
        base = [f"w{k}_{rng.integers(5000)}" for _ in range(int(rng.choice([30, 60, 200, 400])))]
        texts += [" ".join(base), " ".join(edited(rng, base, float(rng.choice([0.72, 0.78, 0.82, 0.86, 0.93]))))]
    texts += [f"just {k} short" for k in range(5)] + ["a b c d e f g h", "a b c d e f g h i", "a b c d e f X Y"]  # 4 of 5 shingles alike; 2 of 6
    got = {r.doc_id: r.component for r in S.near_copies(rows(spark, texts)).collect()}
    found, total = {}, {}
    for i in range(0, 1400, 2):
        sim = jaccard(shingles(texts[i]), shingles(texts[i + 1]))
        linked = got[i] == got[i + 1]
        assert sim >= 0.8 or not linked, sim
        band = 0.8 if 0.8 <= sim < 0.85 else 0.85 if 0.85 <= sim < 0.9 else 0.9
        if sim >= 0.8:
            total[band], found[band] = total.get(band, 0) + 1, found.get(band, 0) + linked
    assert min(total.values()) > 50
    assert found[0.8] >= 0.98 * total[0.8] and found[0.85] >= 0.99 * total[0.85] and found[0.9] == total[0.9], (found, total)
    assert got[1405] == got[1406] != got[1407]


def test_verified_links_join_what_all_links_join(spark, monkeypatch):
    """Large components in tiles, with leaders and the rest: the same groups as all pairs give."""
    monkeypatch.setattr(S, "TILE_TEXTS", 8)
    monkeypatch.setattr(S, "LEADERS", 2)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, 0.93)) for _ in range(30)]
    chain = base
    for _ in range(40):  # each like the one before it, the ends unlike
        chain = edited(rng, chain, 0.9)
        texts.append(" ".join(chain))
    texts += [" ".join(edited(rng, base, 0.75)) for _ in range(30)]
    fps = [np.array([S._majority(h if k == 0 else S._mix(h, k)) for k in range(S.WIDE_WORDS)], np.uint64).view(np.int64).tolist() for t in texts for h in [S.shingle_hashes(t.encode(), 5)]]
    df = spark.createDataFrame([(i, 7, fp, t.encode()) for i, (fp, t) in enumerate(zip(fps, texts))], "node long, component long, fp array<long>, body binary")
    root = list(range(len(texts)))

    def find(root, x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(root, a), find(root, b)
                root[max(x, y)] = min(x, y)
    got = list(range(len(texts)))
    for r in S.verified_links(df).collect():
        assert jaccard(sets[r.a], sets[r.b]) >= 0.8
        x, y = find(got, r.a), find(got, r.b)
        got[max(x, y)] = min(x, y)
    assert [find(got, i) for i in range(len(texts))] == [find(root, i) for i in range(len(texts))]
    assert len({find(root, i) for i in range(len(texts))}) > 3


def test_near_copies_of_odd_rows(spark):
    data = [(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 3), (None, "A B c d e F", 4), (5, None, 5), (6, " ", 6), (4, "other words", 7)]
    got = S.near_copies(spark.createDataFrame(data, "doc_id long, text string, node int")).collect()
    assert len(got) == 5 and len({r.component for r in got}) == 2
    assert S.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_in_lanes_against_popcounts():
    rng = np.random.default_rng(3)
    for words, radius in ((1, 4), (1, 0), (4, 64)):
        for n in (0, 1, 63, 64, 65, 1000):
            a = rng.integers(0, 1 << 63, (n, words), dtype=np.uint64)
            flips = rng.integers(0, 1 << 63, (n, words), dtype=np.uint64)
            for _ in range(4):  # few bits, so that distances lie about the radius
                flips &= rng.integers(0, 1 << 63, (n, words), dtype=np.uint64)
            flips[::7] = 0
            assert (S.aligned_within(a, a ^ flips, radius) == (np.bitwise_count(flips).sum(axis=1) <= radius)).all()


def test_runs_of_any_size_are_compared_by_planes(monkeypatch):
    """No branch of the links takes distances another way."""
    monkeypatch.setattr(S, "_pair_distance", lambda *a: 1 / 0)
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, (300, 1), dtype=np.uint64)
    fps[1::2] = fps[::2] ^ np.uint64(5)
    starts, ends = np.array([0, 10, 12, 60]), np.array([10, 12, 60, 300])
    a, b = S._links_in_runs(fps, np.full(300, 2), starts, ends, 4)
    assert {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist())} == {(i, i + 1) for i in range(0, 300, 2)}
