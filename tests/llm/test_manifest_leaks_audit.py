"""Merkle manifest, benchmark decontamination and filter audit against plain versions."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest

from tidewire.llm import decontam, interactions, merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, grp string, digest string, row long, part string, n long, mask int"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def frame(spark, rows, schema=DOC):
    """rows with extra columns whose names the operators use themselves."""
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


# ---------------------------------------------------------------- manifest


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H("".join(map(field, (r[0], r[3], r[2], r[4], t))))

    def tree(nodes):
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                first = i - i % 3
                ways[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
                at[k] = i // 3
            nodes = [H("".join(nodes[j : j + 3])) for j in range(0, len(nodes), 3)]
        return nodes[0], ways

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    trees = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((own, *tree([leaf(r, r[1]) for r in own])))
    root, above = tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, ways), up in zip(trees, above, strict=True):
        for r, way in zip(own, ways, strict=True):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in way + up:
                node = H(left + node + right)
            out.append((r[0], leaf(r, r[1]), subroot, root, H("".join(a + b for a, b in way + up)), node, node == root))
    return sorted(out, key=str)


def manifest_rows(seed, n):
    rnd = random.Random(seed)
    sources = [None, "", "a", "é", "b" * 300, *[f"s{i}" for i in range(rnd.randrange(12))]]
    weights = [n] + [1] * (len(sources) - 1)  # one source holds most rows
    rows = []
    for i in range(n):
        text = rnd.choice([None, "", "x\ny", "\n", "plain", "🙂\n\n", f"t{i}\n"])
        rows.append((rnd.choice([None, i, i, i, rnd.randrange(9)]), text, rnd.choice([None, "en", ""]), rnd.choices(sources, weights)[0], rnd.choice([None, i])))
    return rows + rows[: n // 5]


@pytest.mark.parametrize(("seed", "n"), [(1, 1), (2, 2), (3, 9), (4, 28), (5, 300)])
def test_manifest(spark, seed, n):
    rows = manifest_rows(seed, n)
    got = merkle.op11_merkle(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_manifest_over_rounds(spark, monkeypatch):
    """Ranges of a few leaves, blocks of two ranges: several rounds of merging in one source."""
    monkeypatch.setattr(merkle, "LEAVES", 7)
    monkeypatch.setattr(merkle, "MERGED", 2)
    rows = [(i, f"text {i}\n", "en", "one" if i % 10 else f"s{i % 70}", i) for i in range(200)]
    assert sorted(map(tuple, merkle.op11_merkle(frame(spark, rows)).collect()), key=str) == plain_manifest(rows)


def test_manifest_long_text_and_empty_table(spark):
    rows = [(2, "line\n" * 400_000, "en", "a", 1), (3, None, None, None, None)]
    assert sorted(map(tuple, merkle.op11_merkle(frame(spark, rows)).collect()), key=str) == plain_manifest(rows)
    assert merkle.op11_merkle(frame(spark, [])).count() == 0


def test_stack_leaves_few_open_nodes():
    """Open nodes of a range grow with the logarithm of its length; all ranges together make every node once."""
    grown = merkle.Mountains(100_000)
    for i in range(31_111, 64_444):
        grown.push(0, i, "x")
    assert len(list(grown.open())) <= 4 * 11
    whole = merkle.Mountains(28)
    for i in range(28):
        whole.push(0, i, f"{i}")
    assert [len(level) for level in whole.made] == merkle.level_sizes(28) == [28, 10, 4, 2, 1]
    assert whole.made[1][-1] == (9, H("27")) and [x[:2] for x in whole.open()] == [(4, 0)]


# ---------------------------------------------------------------- decontamination

ITEM = "item_id long, text string, row long, words string, size int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_leaks(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for at in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[at : at + size]), set()).update([] if item is None else [str(item)])
    sizes = {len(w) for w in windows}
    out = []
    for r in docs:
        w, hit, ids = words(r[1]), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[at : at + size]))) is not None:
                    hit |= set(range(at, at + size))
                    ids |= found
        out.append((r[0], len(w), len(hit), len(ids), H(",".join(sorted(ids))), bool(hit)))
    return sorted(out, key=str)


def leak_rows(seed):
    """Few words, so that windows overlap, repeat within themselves and share their rarest shingles."""
    rnd = random.Random(seed)
    say = lambda n: " ".join(rnd.choice(["a", "B", "ñ", "c3", "日本", "d"][: rnd.choice([2, 6])]) for _ in range(n))
    items = [(i, say(rnd.choice([0, 1, 2, 5, 9, 10, 11, 12, 14]))) for i in range(25)] + [(90, None), (90, say(12)), (None, say(11)), (7, "... !!")]
    docs = []
    for i in range(60):
        parts = [say(rnd.randrange(12))]
        for _ in range(rnd.randrange(4)):
            parts.append(re.sub(" ", lambda m: rnd.choice([" ", "\n", "-", "_", ", "]), rnd.choice(items)[1] or ""))
            parts.append(say(rnd.randrange(6)))
        docs.append((rnd.choice([None, i, i, 5]), " ".join(parts), "en", "a", 1))
    return docs + [(1, None), (1, ""), (2, "?!")] + docs[:9], items


@pytest.mark.parametrize("seed", range(3))
def test_leaks(spark, seed):
    docs, items = leak_rows(seed)
    got = decontam.op12_decontamination(frame(spark, docs), frame(spark, items, ITEM))
    assert sorted(map(tuple, got.collect()), key=str) == plain_leaks(docs, items)


def test_leaks_planted(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    item = " ".join(word() for _ in range(30))
    near = " ".join(w if i % 9 else word() for i, w in enumerate(item.split()))  # never ten words in a row
    long = " ".join(word() for _ in range(200_000))
    docs = [(1, f"{long} {item.upper()}, {long}"), (2, near), (3, long), (4, " ".join(item.split()[7:17])), (5, " ".join(item.split()[7:16]))]
    items = [(3, item), (20, item)]
    got = {r["doc_id"]: r for r in decontam.op12_decontamination(frame(spark, docs), frame(spark, items, ITEM)).collect()}
    assert [got[i]["n_hit"] for i in range(1, 6)] == [30, 0, 0, 10, 0]
    assert got[1]["items_sha256"] == H("20,3") and got[1]["n_words"] == 400_030


def test_leaks_empty(spark):
    docs, items = leak_rows(1)
    got = decontam.op12_decontamination(frame(spark, docs), frame(spark, [], ITEM)).collect()
    assert len(got) == len(docs) and not any(r["contaminated"] for r in got)
    assert decontam.op12_decontamination(frame(spark, []), frame(spark, items, ITEM)).count() == 0


def test_prefix_is_the_rarest_shingle(spark):
    """A window is met at one shingle only, and it is one of the rarest."""
    common, rare = "the cat sat", "on quite purple"
    docs = frame(spark, [(i, f"{common} here") for i in range(20)] + [(50, f"{common} {rare} mats")])
    windows = decontam.item_windows(frame(spark, [(1, f"{common} {rare}")], ITEM))
    found = decontam.rarest(windows, decontam.shingle_counts(docs, windows)).collect()
    assert len(found) == 1 and found[0]["offset"] in (1, 2, 3)


# ---------------------------------------------------------------- audit

LABEL = "doc_id long, quality int, toxic int, part string, n long"


def plain_audit(docs, labels):
    text = [r[1] or "" for r in docs]
    masks = []
    for r, t in zip(docs, text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = r[0] is not None and any(o[0] is not None and o[0] < r[0] and u == t for o, u in zip(docs, text, strict=True))
        masks.append({k for k, v in fails.items() if v})
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    out, shares = [], {}
    for part in {r[2] or "" for r in docs}:
        for order in permutations("ABCDE"):
            left = [i for i, r in enumerate(docs) if (r[2] or "") == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [i for i in left if f in masks[i]]
                left = [i for i in left if f not in masks[i]]
                alone = sum(1 for i, r in enumerate(docs) if (r[2] or "") == part and masks[i] == {f})
                out.append([part, "".join(order), step, len(left), len(lost), sum(f in masks[i] for i in gone), alone, sum(docs[i][0] in good for i in lost), sum(docs[i][0] in toxic for i in lost), f])
                gone += lost
                shares[part, f] = shares.get((part, f), 0) + len(lost)
    return sorted((*r[:9], shares[r[0], r[9]]) for r in out)


def audit_rows(seed):
    rnd = random.Random(seed)
    docs = []
    for i in range(80):
        n = rnd.choice([0, 3, 99, 100, 101, 150])
        vocabulary = rnd.choice([5, int(n * 0.8) + 1, 1000])
        text = " ".join(f"{rnd.choice(['w', 'W', 'WWW'])}{rnd.randrange(vocabulary)}" for _ in range(n)) + rnd.choice(["", "", "#", " | "])
        docs.append((i, rnd.choice([text, None, ""]) if rnd.random() < 0.2 else text, rnd.choice(["en", "de", None, ""]), "a", 1))
    docs += [(rnd.choice([i + 100, None, 3]), rnd.choice(docs)[1], rnd.choice(["en", "fr", None]), "b", 1) for i in range(60)]
    docs += docs[:5]
    labels = [(rnd.choice([None, rnd.randrange(170)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(150)]
    return docs, labels


@pytest.mark.parametrize("seed", range(3))
def test_audit(spark, seed):
    docs, labels = audit_rows(seed)
    got = interactions.op13_interactions(frame(spark, docs), frame(spark, labels, LABEL))
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)


def test_audit_corners(spark):
    assert interactions.op13_interactions(frame(spark, []), frame(spark, [], LABEL)).count() == 0
    docs = [(1, "Word " * 300_000, "en"), (2, "Word " * 300_000, "en"), (1, None, None)]
    got = interactions.op13_interactions(frame(spark, docs), frame(spark, [], LABEL)).collect()
    assert sorted(map(tuple, got)) == plain_audit(docs, []) and len(got) == 2 * 600


def test_audit_edges_are_eighty(spark):
    counted = spark.createDataFrame([("p", 0, False, False, 4)], "part string, mask int, good boolean, toxic boolean, n long")
    rows = interactions.audit(counted).collect()
    assert len(rows) == 600 and {r["kept"] for r in rows} == {4} and sum(r["removed"] for r in rows) == 0
