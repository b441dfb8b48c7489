"""The pipeline against a plain version of each stage."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from tests.llm.test_mixing import targets
from tidewire.llm import bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEEDS = {"en": "the of and that with for was this from have which not but are", "de": "der die und nicht mit ein auf für sich über ist dem den von", "fr": "le la les des est que pour dans une avec qui pas sur vous", "es": "el los las del que por una con para más está como pero sus"}


def corpus():
    rng = random.Random(7)
    texts = []
    for i in range(240):
        lang = list(SEEDS)[i % 4]
        words = [rng.choice(SEEDS[lang].split()) + rng.choice(["", "", f"{rng.choice('aeiou')}{rng.choice('nrst')}"]) for _ in range(rng.choice([200, 300]))]
        if i % 10 == 0:
            words.insert(5, f"password=b7db7aa4a5fcc{i:03}")
        texts.append((lang, " ".join(words)))
    rows = [(i, t, lang, f"src{i % 5}") for i, (lang, t) in enumerate(texts)]
    rows += [(1000 + k, texts[k % 7][1], texts[k % 7][0], "src0") for k in range(60)]  # exact copies
    for k in range(20, 40):  # near copies: two words of each changed, similarity over 0.9
        w = texts[k][1].split()
        w[10] = w[40] = "edited"
        rows.append((2000 + k, " ".join(w), texts[k][0], None))
    rows += [(3000, None, "en", "src1"), (3001, "", "de", "src1"), (3002, "12 34", None, "src2")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_pipeline(spark, tmp_path):
    rows = corpus()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = C.documents(spark, str(tmp_path)), {}
    for name, stage in C.STAGES:
        docs = C.staged(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text = {r[0]: r[1] for r in rows}

    assert {r.doc_id for r in seen["language"]} == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}

    near = {r.doc_id for r in seen["near_dedup"]}
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in text.items() if t and (w := t.lower().split())}
    kept = set()
    for i in sorted(r.doc_id for r in seen["language"]):  # least id first, so a copy finds its original
        if not any(len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j]) >= 0.8 for j in kept):
            kept.add(i)
    assert near == kept

    redacted = {r.doc_id: r.text for r in seen["secrets"]}
    assert redacted == {i: re.sub(r"password=[0-9a-f]+", "[secret]", text[i]) for i in near}
    assert all(r.n_chars == len(r.text) for r in seen["secrets"])

    source = {r.doc_id: r.source for r in seen["secrets"]}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, t in redacted.items():
        sizes[source[i]] += len(WORD.findall(t))
    for r in seen["mixing"]:
        taken[r.source] += len(WORD.findall(r.text))
        whole = WORD.findall(redacted[r.doc_id])
        assert WORD.findall(r.text) == whole[: len(WORD.findall(r.text))] and r.n_chars == len(r.text)
    names = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    for s, want in zip(names, targets([sizes[s] for s in names])):
        assert abs(taken[s] - want) <= 0.5 + 1e-6
    assert max(Counter(r.doc_id for r in seen["mixing"]).values()) <= 2

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((r.doc_id, tuple(lib.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in seen["mixing"])
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in seen["tokens"]) == want


def test_stages_on_odd_tables(spark):
    """Empty tables, null columns, repeated rows and rows without ids go through every stage."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, hex string, row int, component_id long, score string, lang_pred string, taken int, turn int"
    rest = (*(None,) * 2, "h", 1, 2, "s", None, 3, 4)
    rows = [(None, "der und nicht", None, None, None, *rest), (1, "same text here and there", "en", "s", 24, *rest), (1, "same text here and there", "en", "s", 24, *rest), (2, None, None, None, None, *rest)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, kind)
        for name, stage in C.STAGES:
            out = stage(spark, docs, "")
            n = out.count()
            assert name == "tokens" or out.columns == docs.columns
            assert n == 0 or data, name
            if name == "near_dedup" and data:
                assert n == 3
            if name == "secrets" and data:
                assert n == 4


def test_sieve_loses_no_key(spark):
    """Keys of either sign pass, few others do, nulls and an empty table of keys are no trouble."""
    rng = random.Random(3)
    held = [-(2**63), 2**63 - 1, -1, 0, 63, 64, *(rng.randrange(-(2**63), 2**63) for _ in range(500))]
    others = [rng.randrange(-(2**63), 2**63) for _ in range(2000)]
    keys = spark.createDataFrame([(k,) for k in [*held, None]], "a long")
    rows = spark.createDataFrame([(k,) for k in [*held, *others]], "b long")
    passed = {r.b for r in rows.where(C.sieve(keys, "a")(rows["b"])).collect()}
    assert set(held) <= passed and len(passed - set(held)) < 20
    assert rows.where(C.sieve(keys.limit(0), "a")(rows["b"])).count() == 0
