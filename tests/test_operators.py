"""Literal cases of the news operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.config import Editorial, Lane, Scoring
from tidewire.functions import hashing, text, time
from tidewire.operators import candidates, cluster, clusters, dedup, filters, judgment, lineage, memory, readmodels, reports, scoring, signals, similar

NOW = lambda: F.lit("2026-06-24 12:00:00").cast("timestamp")
DAY = lambda: F.lit("2026-06-24").cast("date")


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


EVENT = "id string, ord long, title string, summary string, url string, entities array<string>, source_name string, source_id string, source_tier int, source_url string, rank_total double, category string, domain string, event_type string, cluster_id string, cluster_size int, published_at timestamp"


def events(spark, *rows):
    base = {"title": "t", "summary": "", "url": "", "entities": [], "source_name": "s", "source_id": "s", "source_tier": 2, "source_url": None, "rank_total": 50.0, "category": "media", "domain": "industry", "event_type": None, "cluster_id": None, "cluster_size": None, "published_at": None}
    names = [c.split()[0] for c in EVENT.split(", ")]
    return spark.createDataFrame([tuple({"id": f"e{i}", "ord": i, **base, **r}[n] for n in names) for i, r in enumerate(rows)], EVENT)


def test_time_model(spark):
    p = lambda s: time.precision(F.lit(s))
    r = one(spark, a=p("2026-06-24T09:15:00Z"), b=p("2026-06-24"), c=p(None), d=time.effective_time(F.lit(None).cast("string"), F.lit("x")), e=p("2026-06-24T09:15"), f=p("2026-06-24T09"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("second", "day", "unknown", "x", "minute", "hour")
    r = one(spark, a=time.iso_week(F.lit("2027-01-01").cast("date")), b=time.iso_week(F.lit(None).cast("date")), c=time.seventh_day_week(F.lit("2024-12-31").cast("date")))
    assert (r.a, r.b, r.c) == ("2026-W53", None, "2024-W53")


@pytest.mark.parametrize("s", ["", "https://example.com/a?b=c", "日本語", "z" * 300])
def test_poly31(spark, s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    h = h - 2**32 if h >= 2**31 else h
    r = one(spark, h=hashing.poly31(F.lit(s)), x=hashing.item_hash(F.lit(s)))
    assert (r.h, r.x) == (h, f"{abs(h):08x}")


def test_similarities(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(spark, a=text.jaccard(arr("openai", "gpt-6"), arr("openai", "chatgpt")), b=text.jaccard(arr("openai", "gpt-6"), arr("openai", "gpt-6", "api")), c=text.overlap(arr("a", "b"), arr("b", "c", "d")), d=text.jaccard(F.array().cast("array<string>"), arr("x")), e=text.bigrams(F.lit("AbcAb")), f=text.bigrams(F.lit("a")), g=text.title_keywords(F.lit("New GPT, 大模型!")), h=text.title_keywords(F.lit("New GPT, 大模型!"), True))
    assert r.a == pytest.approx(1 / 3) and r.b == pytest.approx(2 / 3) and r.c == 0.5 and r.d == 0
    assert r.e == ["ab", "bc", "ca"] and r.f == [] and r.g == ["newgpt", "大模", "模型"] and r.h == ["new", "gpt", "大模", "模型"]


def test_noise(spark):
    cases = [("/issues/1", "x", True), ("/pull/2", "x", True), ("/commit/ab", "x", True), ("/actions/", "x", True), ("/a", "fix: x", True), ("/a", "feat: x", False), ("/a", "v1.2", False), ("/a", "Bump y", True), ("/a", "Merge pull request", True), ("/a", "plain", False)]
    df = spark.createDataFrame(cases, "url string, title string, drop boolean")
    got = df.withColumn("why", filters.noise_reason(F.col("url"), F.col("title"), F.lit("github-x"))).withColumn("other", filters.noise_reason(F.col("url"), F.col("title"), F.lit("blog")))
    assert all((r.why is not None) == r.drop and r.other is None for r in got.collect())


def test_insert_if_absent(spark):
    kind = "id string, content_hash string, ord long"
    stored = spark.createDataFrame([], kind)
    first = spark.createDataFrame([("a", "h1", 1)], kind)
    assert dedup.insert_if_absent(stored, first).count() == 1
    assert dedup.insert_if_absent(first, spark.createDataFrame([("b", "h1", 2)], kind)).count() == 0
    new = spark.createDataFrame([("c", "h2", 3), ("d", "h3", 4), ("d", "h3", 5), ("e", None, 6), ("f", None, 7)], kind)
    assert sorted(r.id for r in dedup.insert_if_absent(first, new).collect()) == ["c", "d", "e", "f"]


def test_read_models(spark):
    e = events(spark, {"rank_total": 10.0, "entities": ["OpenAI"]}, {"rank_total": None}, {"rank_total": 90.0, "entities": ["OpenAI", "LLM"]}).withColumns({"effective_at": F.lit("2026-06-24 05:00:00").cast("timestamp"), "topics": F.array(F.lit("LLM")), "content_hash": F.concat(F.lit("h"), "id")})
    m = readmodels.Events(e)
    rows = m.window(F.lit("2026-06-24").cast("timestamp"), F.lit("2026-06-25").cast("timestamp")).collect()
    assert [r.rank_total for r in rows] == [90.0, 10.0, None]
    assert m.with_entity("LLM").count() == 1 and m.with_topic("LLM").count() == 3 and m.has_hash("he1") and not m.has_hash("zz") and m.count() == 3


def brk(spark, *rows):
    e = events(spark, *rows)
    return {r.event_id: r.reason for r in signals.breaking(e).collect()}


def test_breaking(spark):
    assert brk(spark, {"entities": ["OpenAI"]}) == {"e0": "entity"}
    assert brk(spark, *[{"entities": ["OpenAI"]}] * 3) == {}
    assert brk(spark, {"url": "https://openai.com/blog/x", "cluster_size": 1}) == {"e0": "official"}
    assert brk(spark, {"url": "https://openai.com/blog/x", "cluster_size": 3}) == {}
    assert brk(spark, {"event_type": "acquisition"}, {"event_type": "policy"}) == {"e0": "type"}
    assert brk(spark, {"entities": None, "title": None, "source_name": None}) == {}


def test_category_cap_and_boost(spark):
    e = events(spark, *[{"rank_total": float(i)} for i in range(10)])
    none = signals.collect(e, [])
    assert candidates.rank(e, none).where("capped").count() == 2
    e = events(spark, *[{"rank_total": float(i), "event_type": "acquisition" if i < 3 else None} for i in range(12)])
    assert candidates.rank(e, signals.collect(e, [signals.breaking])).where("capped").count() == 1
    e = events(spark, {})
    add = lambda w: lambda d: signals.signal(d, "RANK", "X", "x", weight=w)
    assert candidates.rank(e, signals.collect(e, [add(10)] * 5)).first().final_rank == 80.0
    bad = lambda d: d.select("no_such_column")
    with pytest.raises(Exception, match="no_such_column"):
        signals.collect(e, [bad, add(-40)])
    got, failed = signals.collect_isolated(e, [bad, add(-40)])
    assert candidates.rank(e, got).first().final_rank == 10.0
    assert [(r.rule_no, "no_such_column" in r.reason) for r in failed.collect()] == [(0, True)]


def test_uncapped_is_what_the_cap_leaves(spark):
    e = events(spark, *[{"rank_total": float(i % 9), "event_type": "acquisition" if i % 5 == 0 else None} for i in range(40)])
    ranked = candidates.rank(e, signals.collect(e, [signals.breaking]))
    left = signals.uncapped(ranked.drop("capped"))
    assert sorted(r.ord for r in left.collect()) == sorted(r.ord for r in ranked.where("not capped").collect())


def test_pool_sizes(spark):
    none = lambda e: signals.collect(e, [])
    e = events(spark, *[{"category": f"c{i % 20}"} for i in range(100)])
    assert candidates.build(e, none(e)).count() == 40
    assert candidates.build(e, none(e), Editorial(pool_size=1)).count() == 1
    assert candidates.build(e.limit(0), none(e)).count() == 0


def pool(spark, *rows):
    kind = "id string, ord long, lane string, lane_no int, final_rank double, breaking boolean"
    return spark.createDataFrame([(f"e{i}", i, *r) for i, r in enumerate(rows)], kind)


def merged(df, *a, **k):
    return [r.final_rank for r in candidates.merge(df, *a, **k).orderBy("position").collect()]


def test_merge(spark):
    assert merged(pool(spark, ("r", 0, 90.0, False), ("r", 0, 80.0, False), ("i", 1, 85.0, False))) == [90.0, 85.0, 80.0]
    assert 30.0 in merged(pool(spark, ("r", 0, 95.0, False), ("r", 0, 90.0, False), ("i", 1, 30.0, False)), 2)
    assert merged(pool(spark, ("r", 0, 90.0, False), ("i", 1, 40.0, True)))[0] == 40.0
    assert len(merged(pool(spark, ("a", 0, 9.0, False), ("b", 1, 8.0, False), ("c", 2, 7.0, False)), 2)) == 3
    assert merged(pool(spark, ("a", 0, 9.0, False), ("a", 0, 8.0, False)), 1, representation=False) == [9.0]


def test_lanes(spark):
    e = events(spark, *[{"domain": d} for d in ("research", "industry", "policy", "unknown_xyz", None)])
    assert [r.lane for r in candidates.dispatch(e).orderBy("ord").collect()] == ["research", "industry", "policy", "fallback", "fallback"]
    with pytest.raises(ValueError):
        candidates.dispatch(e, [Lane("research", "research", 3)])
    d = candidates.dispatch(e, [Lane("research", "research", 0), Lane("fallback", "__fallback__", 1)])
    assert {r.lane for r in candidates.run_lanes(d, signals.collect(d, [])).collect()} == {"fallback"}


def test_judgment(spark):
    e = events(spark, {"title": "A new AI model"}, {"title": "公司 IPO 上市"})
    j = judgment.qualify(e, signals.collect(e, [signals.content_relevance]))
    assert {r.id: r.reject_type for r in j.collect()} == {"e0": None, "e1": "hard"}
    q = events(spark, *[{"rank_total": float(i)} for i in range(10)])
    q = judgment.qualify(q, signals.collect(q, []))
    assert [r.final_rank for r in judgment.prioritize(q, 3).collect()] == [9.0, 8.0, 7.0]
    with pytest.raises(judgment.InvalidBudget):
        judgment.prioritize(q, 0)
    few = q.limit(1)
    wide = events(spark, *[{"id": f"x{i}", "rank_total": 60.0} for i in range(3)])
    assert judgment.backfill(few, wide, Editorial(backfill_below=1)).count() == 1
    assert judgment.backfill(few, wide, Editorial(backfill_below=5)).where("backfilled").count() == 3
    assert judgment.backfill(few, wide, Editorial(backfill_below=5, backfill_most=2)).count() == 3
    assert judgment.backfill(few, few.select(*wide.columns), Editorial(backfill_below=5, backfill_score=0)).count() == 1
    src = spark.createDataFrame([("a", None)] * 65 + [("a", "hard")] * 5 + [("b", None)] * 25 + [("b", "hard")] * 5, "source_name string, reject_type string")
    assert sorted(r.violation for r in judgment.production_violations(src).collect()) == ["non_ai_ratio", "single_source_a"]


def test_stories(spark):
    d = lambda n: dt.date(2026, 6, 24) - dt.timedelta(days=n)
    s = spark.createDataFrame([("k1", "OpenAI", d(1), "developing"), ("k2", "Old", d(5), "developing"), ("k3", "Gone", d(1), "stale"), ("c9", "C", d(2), "developing")], "story_key string, entity string, last_seen date, state string")
    e = events(spark, {"entities": ["OpenAI"]}, {"entities": ["Old"]}, {"entities": ["Gone"]}, {"entities": ["Gone"], "cluster_id": "c9"}, {"entities": ["None", "OpenAI"]}, {})
    got = {r.event_id: (r.subtype, r.weight) for r in signals.story_dedup(e, s, DAY()).collect()}
    assert got == {"e0": ("FOLLOW_UP", -10), "e2": ("STALE", 0), "e3": ("FOLLOW_UP", -10), "e4": ("FOLLOW_UP", -10)}
    rows = spark.createDataFrame([("k", "E", "1", "A", d(2), 1), ("k", "E", "2", "", d(1), 2)], "story_key string, entity string, event_id string, title string, date date, ord long")
    r = memory.rollup_stories(rows).first()
    assert (r.first_seen, r.last_seen, r.title, r.event_ids) == (d(2), d(1), "A", ["1", "2"])
    more = memory.track(memory.rollup_stories(rows.where("ord = 1")), rows.where("ord = 2")).first()
    assert (more.first_seen, more.last_seen, more.event_ids) == (d(2), d(1), ["1", "2"])


def test_memory_notes_and_prune(spark):
    snaps = spark.createDataFrame([(dt.date(2026, 6, 24 - i), ["OpenAI"], ["e1"]) for i in (1, 2, 3)] + [(dt.date(2026, 6, 1), ["OpenAI"], [])], "date date, top_entities array<string>, top_event_ids array<string>")
    e = events(spark, {"entities": ["X", "OpenAI"]}, {"cluster_id": "c"}, {})
    got = {r.event_id: (r.entity, r.recent_days) for r in signals.memory(e, snaps, DAY()).collect()}
    assert got == {"e0": ("OpenAI", 3), "e1": (None, 1)}
    hints = {r.id: r.context_hints for r in candidates.rank(e, signals.collect(e, [lambda d: signals.memory(d, snaps, DAY())])).collect()}
    assert len(hints["e0"]) == 2 and len(hints["e1"]) == 1 and hints["e2"] == []
    days = spark.createDataFrame([(dt.date(2026, 6, 25),), (dt.date(2026, 7, 2),)], "date date")
    assert [r.date for r in memory.prune(days, F.lit("2026-06-30").cast("date")).collect()] == [dt.date(2026, 7, 2)]
    assert memory.prune(days, F.lit("2026-06-25").cast("date")).count() == 2 and memory.prune(days, F.lit("2026-06-25").cast("date"), inclusive=True).count() == 1


def test_scores(spark):
    cfg = Scoring()
    raw = F.lit("OpenAI and Google release GPT-5: $3.5B, 40% at 10x faster, 2 billion")
    r = one(spark, e=scoring.entity_weight(F.lower(raw), cfg), t=scoring.event_type_score(raw, cfg), k=scoring.event_type(raw, cfg), q=scoring.quantitative(raw), d=scoring.entity_weight(F.lit("deepseek"), cfg), a=scoring.academic(F.lit("GPT agent beats SOTA")), v=scoring.evidence_score(F.lit(2), F.lit(4), F.lit(None).cast("double"), F.lit(6)))
    assert (r.e, r.t, r.k, r.q, r.a) == (12, 10, "model_release", 4, 5)
    assert r.d == 12  # a name in two tiers is two hits
    assert r.v == pytest.approx(round((0.5 + 0.3 + 1) / 3, 2))
    ages = spark.createDataFrame([(0.5, 15), (3.0, 13), (5.0, 11), (12.0, 8), (24.0, 5), (30.0, 2)], "h double, want int").withColumn("p", NOW() - F.make_dt_interval(hours=F.floor("h").cast("int"), mins=((F.col("h") % 1) * 60).cast("int")))
    got = ages.withColumn("s", scoring.timeliness(F.col("p"), NOW(), F.lit("normal"), cfg)).withColumn("l", scoring.timeliness(F.col("p"), NOW(), F.lit("low"), cfg)).collect()
    assert all(r.s == r.want and r.l == r.want // 2 for r in got)


def test_lineage(spark):
    a = spark.createDataFrame([(1, 1, "x"), (2, 2, "x"), (3, 3, "x"), (4, 4, "y"), (5, 5, None), (6, 6, None)], "id long, ord long, content_hash string")
    assert {(r.from_id, r.to_id) for r in lineage.duplicate_edges(a).collect()} == {(2, 1), (3, 1)}
    assert {(r.from_id, r.to_id) for r in lineage.pair_edges(a).collect()} == {(2, 1), (3, 1), (3, 2)}
    pairs = {r.id: r.edges for r in lineage.edge_degrees(lineage.pair_edges(a)).collect()}
    assert {r.id: r.edges for r in lineage.degrees(a).collect()} == {**{i: 0 for i in (4, 5, 6)}, **pairs}
    stored = lineage.duplicate_edges(a.where("id <= 2"))
    assert {(r.from_id, r.to_id) for r in lineage.new_edges(stored, lineage.duplicate_edges(a)).collect()} == {(3, 1)}


def test_clusters(spark):
    rows = [(1, 1, "Alpha beta gamma delta", ["OpenAI", "GPT-6"], None, "w"), (2, 2, "x", ["openai", "GPT-6", "API"], None, "w"), (3, 3, "Alpha beta gamma delta!", [], None, "w"), (4, 4, "other", ["Meta"], "k", "w"), (5, 5, "thing", [], "k", "w"), (6, 6, "", [], None, "w"), (7, 7, None, None, None, "w")]
    df = spark.createDataFrame(rows, "id long, ord long, title string, entities array<string>, fingerprint string, week string")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {r.id: r.cluster_id for r in cluster.cluster(df).collect()} == want
    assert {r.id: r.cluster_id for r in cluster.cluster_in_order(df).collect()} == want


def share(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("longest", [None, 1, 6])
def test_similar_sets_against_all_pairs(spark, longest):
    """Over few items; with short lists everything is met in tiles."""
    rng = random.Random(3)
    near = [rng.choices("abcdefghijkl", k=rng.randrange(1, 12)) for _ in range(12)]
    sets = [[x for x in rng.choice(near) if rng.random() < 0.9] + rng.choices("abcdefghijkl", k=rng.randrange(2)) for _ in range(90)] + [[], None, [None], ["a", None]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, items array<string>")
    plain = {}
    for i, s in enumerate(sets):
        if s := frozenset(x for x in s or [] if x):
            plain.setdefault(s, []).append(i)
    for t in (0.5, 0.7):
        want = {tuple(sorted((plain[x][0], plain[y][0]))) for x in plain for y in plain if x != y and share(x, y) >= t} | {(ids[0], i) for ids in plain.values() for i in ids[1:]}
        got = [(r.a, r.b) for r in similar.similar_sets(df, "id", "items", t, longest).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert similar.similar_sets(df.limit(0), "id", "items", 0.5).count() == 0


def test_similar_between(spark):
    rng = random.Random(4)
    draw = lambda: sorted(set(rng.choices("abcdefghij", k=rng.randrange(1, 9))))
    old, new = {f"o{i}": draw() for i in range(60)}, {f"n{i}": draw() for i in range(25)}
    sets = lambda rows: similar.prepared(spark.createDataFrame(list(rows.items()), "id string, items array<string>"), "id", "items")
    often = similar.item_counts(sets(dict(list(old.items())[:10])))  # an old order: later items are unknown to it
    want = {(a, b) for a in new for b in old if share(set(new[a]), set(old[b])) >= 0.6}
    for longest in (None, 2):
        got = similar.similar_between(sets(new), sets(old), often, similar.postings(sets(old), often, 0.6), 0.6, longest)
        assert {(r.a, r.b) for r in got.collect()} == want


def plain_in_order(rows):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[5], []).append(r)
    for block in by.values():
        held = []
        for i, _, title, names, key, _ in sorted(block, key=lambda r: (r[1], r[0])):
            names, low = {x.lower() for x in names or [] if x}, (title or "").lower()
            pairs = {low[k : k + 2] for k in range(len(low) - 1)}
            for c in held:
                if share(names, c[1]) >= 0.5 or (key and key == c[2]) or share(pairs, c[3]) >= 0.7:
                    c[1] |= names
                    out[i] = c[0]
                    break
            else:
                held.append([i, set(names), key, pairs])
                out[i] = i
    return out


def story_rows(seed, n):
    rng = random.Random(seed)
    titles = [None, "", "Alpha beta gamma", "Alpha beta gamme", "delta epsilon zeta", "delta epsilon zet"]
    return [
        (i, rng.randrange(n // 2), rng.choice([*titles, f"x{i % 7}" * 3, f"x{i}" * 3]), rng.choice([None, [], [None]] + [rng.sample("ABCDefgh", rng.randrange(1, 5)) for _ in range(6)]), rng.choice([None, None, "", f"k{rng.randrange(9)}"]), rng.choice(["w1", "w2", None]))
        for i in range(n)
    ]


EVENTS_IN_ORDER = "id long, ord long, title string, entities array<string>, fingerprint string, week string"


@pytest.mark.parametrize("seed", range(2))
def test_first_match_in_order(spark, seed):
    rows = story_rows(seed, 100)
    got = cluster.cluster_in_order(spark.createDataFrame(rows, EVENTS_IN_ORDER))
    assert {r.id: r.cluster_id for r in got.collect()} == plain_in_order(rows)
    assert cluster.cluster_in_order(spark.createDataFrame([], EVENTS_IN_ORDER)).count() == 0


def test_clusters_across_batches(spark, tmp_path):
    """Batches, one of them run twice, give the clusters of all events at once; ids stay with the oldest cluster and none is given twice."""
    rng = random.Random(1)
    # few links, so that clusters meet late
    rows = [(f"e{i}", rng.choice(["", None, f"story {i} {i * 7919} {i * 104729}"]), rng.choice([[], rng.sample("ABCDefghijklmnopqrstu", rng.randrange(2, 5))]), rng.choice([None, None, "", f"k{rng.randrange(20)}"])) for i in range(60)]
    df = lambda part: spark.createDataFrame(part, "id string, title string, entities array<string>, fingerprint string")
    whole = {r.id: r.cluster_id for r in cluster.cluster(df(rows)).collect()}
    store = clusters.Store(spark, f"file://{tmp_path}/clusters")
    rng.shuffle(rows)
    before: dict = {}
    for number, part in enumerate([rows[:25], rows[25:26], rows[26:]]):
        added = store.add(df(part), number)
        assert {r.id for r in added.assigned.collect()} == {r[0] for r in part}
        merged = {r.cluster_id: r.into for r in added.merged.collect()}
        now = {r.id: r.cluster_id for r in store.clusters().collect()}
        assert all(now[i] == merged.get(c, c) for i, c in before.items())
        before = now
    store.add(df(rows[26:]), 2)
    assert {r.id: r.cluster_id for r in store.clusters().collect()} == before
    parts = lambda of: sorted(sorted(i for i in of if of[i] == c) for c in set(of.values()))
    assert parts(before) == parts(whole)


def test_unrelated_batches_get_their_own_ids(spark, tmp_path):
    store = clusters.Store(spark, f"file://{tmp_path}/clusters")
    kind = "id string, title string, entities array<string>, fingerprint string"
    store.add(spark.createDataFrame([("a", "Markets rally on earnings", [], None)], kind), 0)
    store.add(spark.createDataFrame([("b", "Volcano erupts at dawn", [], None)], kind), 1)
    assert len({r.cluster_id for r in store.clusters().collect()}) == 2


def test_overlapping_against_all_pairs(spark):
    rng = random.Random(5)
    rows = lambda n: [(i, sorted(set(rng.choices("abcdefghijkl", k=rng.randrange(0, 14))))) for i in range(n)]
    x, y = rows(40), rows(50)
    for t in (0.5, 0.8):
        got = dedup.overlapping(spark.createDataFrame(x, "a long, xs array<string>"), spark.createDataFrame(y, "b long, ys array<string>"), t)
        want = {(i, j) for i, p in x for j, q in y if p and q and len(set(p) & set(q)) >= t * min(len(p), len(q))}
        assert {tuple(r) for r in got.collect()} == want


_DATED = "ord long, url string, fingerprint string, keywords array<string>"


@pytest.mark.parametrize("url, most", [("u", 3), (None, 8)])
def test_history_is_compared_up_to_the_first_hit(spark, monkeypatch, url, most):
    """All rows overlap: a url finds the fourth of history, or words the first, and later history makes no pairs."""
    monkeypatch.setattr(dedup, "FIRST", 8, raising=False)
    join, made = dedup.overlapping, []

    def counted(*args):
        made.append((out := join(*args)).count())
        return out

    monkeypatch.setattr(dedup, "overlapping", counted)
    history = spark.createDataFrame([(i, url if i == 3 else None, None, ["a", "b", "c", f"h{i}"]) for i in range(100)], _DATED)
    today = spark.createDataFrame([(1000 + i, url, None, ["a", "b", "c", f"t{i}"]) for i in range(40)], _DATED)
    got = {(r.removed_by, r.repeats) for r in dedup.against_history(today, history, threshold=0.7).collect()}
    assert got == {("similarity", 0)} and sum(made) <= 40 * most


@pytest.mark.parametrize("keys", [40, None])
def test_against_history_by_all_pairs(spark, monkeypatch, keys):
    monkeypatch.setattr(dedup, "FIRST", 8)
    monkeypatch.setattr(dedup, "STEP", 4)
    rng = random.Random(7)
    key = lambda mark: f"{mark}{rng.randrange(keys)}" if keys and rng.random() < 0.7 else rng.choice(["", None]) if mark == "u" else None
    rows = lambda at, n: [(at + i, key("u"), key("f"), sorted(set(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(0, 9))))) for i in range(n)]
    history, today = rows(0, 90), rows(1000, 70)
    history += [(500 + i, None, None, w) for i, (*_, w) in enumerate(history[:9])]
    today += [(2000, None, None, None), (2001, None, None, today[0][3])]

    def first(t):
        for o, u, f, w in sorted(history):
            if u and u == t[1]:
                return "url", o
            if f is not None and f == t[2]:
                return "fingerprint", o
            if w and t[3] and len(set(w) & set(t[3])) >= 0.6 * min(len(w), len(t[3])):
                return "similarity", o
        return None, None

    got = dedup.against_history(spark.createDataFrame(today, _DATED), spark.createDataFrame(history, _DATED), threshold=0.6)
    assert {r.ord: (r.removed_by, r.repeats) for r in got.collect()} == {t[0]: first(t) for t in today}


def test_overlapping_at_a_threshold_that_is_rounded_up(spark):
    """25 * 0.56 is above 14 as a double, but 14 of 25 words are enough."""
    x, y = [(0, [f"w{i:02}" for i in range(25)])], [(1, [f"w{i:02}" for i in range(11, 36)])]
    got = dedup.overlapping(spark.createDataFrame(x, "a long, xs array<string>"), spark.createDataFrame(y, "b long, ys array<string>"), 0.56)
    assert [tuple(r) for r in got.collect()] == [(0, 1)]


def test_reports(spark):
    item = ("T", "in 2024", "https://a/b", "src", [])
    rows = [("1", "A hook of more than twenty characters", ["s"], [item], [(*item[:3], "b", [])], [(*item[:3], "c", [])], ("obs " * 5, "ev " * 5, "judge " * 5)), ("2", None, None, None, None, None, None)]
    a = spark.createDataFrame(rows, reports.ARTICLE)
    checked = reports.checks(a)
    got = {r.id: r for r in reports.accepted(checked).collect()}
    assert got["1"].accepted and got["1"].failed == [] and not got["2"].accepted
    md = {r.id: r.markdown for r in reports.render_article(a).collect()}
    assert "### T" in md["1"] and "https://a/b" in md["1"] and "Sources: b, c, src" in md["1"]
    known = events(spark, {"url": "https://known"})
    assert {r.url for r in reports.unknown_urls(reports.render_article(a), known).collect()} == {"https://a/b"}
    assert one(spark, x=reports.substitute(F.lit("{{a}}-{{b}}"), {"a": F.lit("1"), "b": F.lit(None).cast("string")})).x == "1-"


@pytest.mark.parametrize("bits", [4096, 8])
def test_tiles_give_similar_pairs_only(monkeypatch, bits):
    """Of sets that share most of a small alphabet, and of items beyond those with a bit of their own."""
    import pyarrow as pa

    monkeypatch.setattr(similar, "BITS", bits)
    rng = random.Random(5)
    sets = sorted({tuple(sorted(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randrange(8, 22)))) for _ in range(150)}, key=len)
    table = lambda some: pa.table({"id": list(range(len(some))), "n": [len(x) for x in some], "items": ["\x00".join(x) for x in some]})
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if share(set(x), set(y)) >= 0.7}
    i, j, likeness = similar._joined(table(sets), table(sets), 0.7, True, False)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted((a, b) for a, b in want if a < b)
    assert all(s == share(set(sets[a]), set(sets[b])) for a, b, s in zip(i, j, likeness, strict=True))
    few = [x for x in sets if "a" in x]
    i, j, _ = similar._joined(table(few), table(sets), 0.7, False, False)
    assert {(sets.index(few[a]), b) for a, b in zip(i, j, strict=True)} == {(a, b) for a, b in want if "a" in sets[a]}


@pytest.mark.parametrize("longest", [None, 1])
def test_links_connect_what_pairs_connect(spark, longest):
    rng = random.Random(6)
    sets = [sorted(rng.sample("abcdefghijkl", rng.randrange(7, 12))) for _ in range(120)] + [["q", "r"], ["q", "r", "s"], ["z"]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, items array<string>")

    def parts(links):
        root = list(range(len(sets)))
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in links:
            root[find(a)] = find(b)
        return [min(y for y in range(len(sets)) if find(y) == find(x)) for x in range(len(sets))]

    want = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and share(set(x), set(y)) >= 0.6]
    got = [tuple(r) for r in similar.similar_sets(df, "id", "items", 0.6, longest, links=True).collect()]
    assert parts(got) == parts(want) and (longest is None or len(got) < len(sets) < len(want))


def test_spans_that_no_event_finds_first_are_left_out(spark):
    """Before anything is matched every event leads: of those with equal entities only the first can be found."""
    from tidewire.operators import greedy

    rows = spark.createDataFrame([("w", i, "a") for i in range(50)] + [("w", 50, "b")], "block string, at long, kind string").withColumn("leader", F.col("at"))
    kinds = spark.createDataFrame([("w", "a", ["a"]), ("w", "b", ["b"])], "block string, kind string, names array<string>")
    every = greedy.versions(rows, kinds)
    assert every.count() == 51 and {(r.leader, *r.held) for r in greedy._first_ones(every, "block", "held").collect()} == {(0, "a"), (50, "b")}


def test_first_match_in_order_over_pieces(spark, monkeypatch):
    """Pieces of a block go one after another: what earlier ones founded and widened is met by title, fingerprint and entities."""
    from tidewire.operators import greedy

    monkeypatch.setattr(greedy, "PIECE", 16)
    rows = story_rows(7, 100)
    got = cluster.cluster_in_order(spark.createDataFrame(rows, EVENTS_IN_ORDER))
    assert {r.id: r.cluster_id for r in got.collect()} == plain_in_order(rows)


def test_decisions_that_overturn_each_other_take_no_rounds(spark, monkeypatch):
    """Each title is like the last one only, so every second event leads; by rounds of guesses each decision waited for the one before."""
    from tidewire.operators import greedy

    made, real = [], greedy.staged
    monkeypatch.setattr(greedy, "staged", lambda df, name, *by: made.append(name) or real(df, name, *by))
    rows = [(k, k, "".join(chr(0x4E00 + 2 * k + j) for j in range(20)), [], None, "w") for k in range(30)]
    got = {r.id: r.cluster_id for r in cluster.cluster_in_order(spark.createDataFrame(rows, EVENTS_IN_ORDER)).collect()}
    assert got == plain_in_order(rows) == {k: k - k % 2 for k in range(30)} and len(made) < 10


@pytest.mark.parametrize("links", [False, True])
def test_small_alphabets_are_compared_without_lists(spark, monkeypatch, links):
    """Where nearly all lists are too long no postings are made, and the pairs, or what links connect, are the same."""
    rng = random.Random(8)
    sets = [sorted(rng.sample("abcdefghijkl", rng.randrange(4, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, items array<string>")
    monkeypatch.setattr(similar, "postings", None)
    got = {(r.a, r.b) for r in similar.similar_sets(df, "id", "items", 0.6, 3, links=links).collect()}
    first = {}
    for i, s in enumerate(map(tuple, sets)):
        first.setdefault(s, i)
    want = {(i, j) for i in first.values() for j in first.values() if i < j and share(set(sets[i]), set(sets[j])) >= 0.6} | {(first[s], i) for i, s in enumerate(map(tuple, sets)) if first[s] < i}
    assert len(got) < len(want) if links else got == want


def test_lists_and_tiles_meet(spark):
    """Some sets have long lists only, some short ones, some both."""
    rng = random.Random(9)
    sets = [sorted(rng.sample("abcdefgh", rng.randrange(3, 7))) for _ in range(40)] + [[*rng.sample("abcdefgh", 2), *(f"r{rng.randrange(20)}" for _ in range(3))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, items array<string>")
    got = {(r.a, r.b) for r in similar.similar_sets(df, "id", "items", 0.5, 12).where("similarity < 1").collect()}
    first = {}
    for i, s in enumerate(map(frozenset, sets)):
        first.setdefault(s, i)
    assert got == {(i, j) for i in first.values() for j in first.values() if i < j and share(set(sets[i]), set(sets[j])) >= 0.5}
    assert not similar.mostly_long(similar.item_counts(similar.plain_sets(df, "id", "items")), 0.5, 12)
