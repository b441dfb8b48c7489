"""Queries of lineage, similarity, clusters, read models, weekly rollups, evidence, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import PUBLISHERS, STOP_WORDS, Scoring
from ..functions import text
from ..operators import cluster, clusters, dedup, evidence, lineage, readmodels, reports, scoring, weekly
from ..staging import shared_root
from .tables import ASSETS, EVENTS, as_of, assets, events_of, query, sql_list, table

_TEXTS = "d AS (SELECT doc_id AS id, doc_id AS ord, sha256(text) AS content_hash, source FROM documents)"


def _hashed(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("content_hash"), "source")


@query("q_duplicate_edges", f"WITH {_TEXTS}, f AS (SELECT content_hash, min(id) AS to_id FROM d WHERE content_hash IS NOT NULL GROUP BY content_hash) SELECT id AS from_id, to_id, 'duplicate_of' AS relation FROM d JOIN f USING (content_hash) WHERE id <> to_id")
def duplicate_edges(spark, sf):
    return lineage.duplicate_edges(_hashed(spark, sf))


@query("q_edge_degree", f"WITH {_TEXTS}, e AS (SELECT b.id AS from_id, a.id AS to_id FROM d a JOIN d b ON a.content_hash = b.content_hash AND a.ord < b.ord) SELECT id, (SELECT count(*) FROM e WHERE from_id = d.id OR to_id = d.id) AS edges FROM d")
def edge_degree(spark, sf):
    return lineage.degrees(_hashed(spark, sf))


@query("q_star_degree", f"WITH {_TEXTS}, f AS (SELECT content_hash, min(id) AS to_id FROM d GROUP BY content_hash), e AS (SELECT id AS from_id, to_id FROM d JOIN f USING (content_hash) WHERE id <> to_id) SELECT id, count(*) AS edges FROM (SELECT from_id AS id FROM e UNION ALL SELECT to_id FROM e) GROUP BY id")
def star_degree(spark, sf):
    return lineage.edge_degrees(lineage.duplicate_edges(_hashed(spark, sf)))


_ALIAS = [p[0] for p in PUBLISHERS]
_DIM = "p(alias, canonical, publisher_type, trust_score) AS (VALUES " + ", ".join(f"('{a}', '{c}', '{k}', {t})" for a, c, k, t in PUBLISHERS) + ")"


def _suppliers(spark, sf):
    s = table(spark, sf, "supplier")
    names = F.array(*[F.lit(a) for a in _ALIAS])
    return s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "unknown").otherwise(F.upper(F.element_at(names, (F.col("s_suppkey") % len(_ALIAS) + 1).cast("int")))).alias("source_id"))


_SRC = f"s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE upper({_ALIAS!r}[s_suppkey % {len(_ALIAS)} + 1]) END AS source_id FROM supplier)"
_WEIGHT = "CASE publisher_type WHEN 'official' THEN 15 WHEN 'academic' THEN 12 WHEN 'media' THEN 5 WHEN 'personal' THEN 3 ELSE 0 END + greatest(-5, least(10, (trust_score - 3) * 5))"


@query("q_publisher_resolve", f"WITH {_DIM}, {_SRC} SELECT id, canonical, publisher_type, coalesce(CAST(trust_score AS INTEGER), -1) AS trust_score, coalesce(CASE WHEN publisher_type IS NOT NULL THEN CAST({_WEIGHT} AS INTEGER) END, -99) AS origin_weight FROM s LEFT JOIN p ON lower(source_id) = alias")
def publisher_resolve(spark, sf):
    rows = lineage.with_publisher(_suppliers(spark, sf), lineage.publishers(spark))
    weight = F.coalesce(lineage.origin_weight(F.col("publisher_type"), F.col("trust_score")).cast("int"), F.lit(-99))
    return rows.select("id", "canonical", "publisher_type", F.coalesce("trust_score", F.lit(-1)).alias("trust_score"), weight.alias("origin_weight"))


@query("q_verification", f"WITH {_DIM}, {_SRC}, e AS (SELECT id, id % 5 AS edges FROM s) SELECT id, CAST(CASE WHEN publisher_type IN ('official', 'academic') THEN 2 WHEN publisher_type = 'media' THEN 1 ELSE 0 END + edges AS BIGINT) AS evidence, CAST(CASE WHEN edges >= 4 THEN 15 WHEN edges = 3 THEN 10 WHEN edges = 2 THEN 5 ELSE 0 END AS INTEGER) AS edge_weight FROM s LEFT JOIN p ON lower(source_id) = alias JOIN e USING (id)")
def verification(spark, sf):
    rows = lineage.with_publisher(_suppliers(spark, sf), lineage.publishers(spark)).withColumn("edges", F.col("id") % 5)
    return rows.select("id", lineage.evidence_count(F.col("publisher_type"), F.col("edges")).cast("bigint").alias("evidence"), lineage.edge_weight(F.col("edges")).alias("edge_weight"))


_PARTS = "w AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS words FROM part)"


@query("q_entity_jaccard_pairs", f"WITH {_PARTS} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.words, b.words)) / len(list_distinct(a.words || b.words)), 6) AS similarity FROM w a JOIN w b ON a.id < b.id WHERE len(list_intersect(a.words, b.words)) / len(list_distinct(a.words || b.words)) >= 0.8 AND list_sort(a.words) <> list_sort(b.words)")
def entity_jaccard_pairs(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ")).alias("words"))
    rows = cluster.similar_sets(p, "id", "words", 0.8).where("similarity < 1")
    # pairs between representatives of equal sets, brought back to every member
    same = p.select("id", F.array_sort("words").alias("s"))
    first = same.groupBy("s").agg(F.min("id").alias("rep"))
    of = same.join(first, "s").select("id", "rep")
    x = rows.join(of.select(F.col("rep").alias("a"), F.col("id").alias("i")), "a").join(of.select(F.col("rep").alias("b"), F.col("id").alias("j")), "b")
    return x.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.round("similarity", 6).alias("similarity"))


_PAIRS = f"{ASSETS}, t AS (SELECT ord AS id, lower(title) AS title FROM assets WHERE title <> ''), g AS (SELECT id, list_distinct(list_transform(range(1, length(title)), lambda i: substr(title, i, 2))) AS p FROM t WHERE length(title) >= 2), u AS (SELECT min(id) AS id, p FROM (SELECT id, list_sort(p) AS p FROM g) GROUP BY p)"


@query("q_title_bigram_pairs", f"WITH {_PAIRS} SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.p, b.p)) / len(list_distinct(a.p || b.p)), 6) AS similarity FROM u a JOIN u b ON a.id < b.id WHERE len(list_intersect(a.p, b.p)) / len(list_distinct(a.p || b.p)) >= 0.7")
def title_bigram_pairs(spark, sf):
    a = assets(spark, sf).select(F.col("ord").alias("id"), text.bigrams(F.col("title")).alias("p"))
    return cluster.similar_sets(a, "id", "p", 0.7).where("similarity < 1").select("a", "b", F.round("similarity", 6).alias("similarity"))


_HIST = "h AS (SELECT doc_id AS ord, split_part(coalesce(text, ''), chr(10), 1) AS title, 'u' || (doc_id % 700) AS url, 'f' || (doc_id % 900) AS fp, doc_id * 7919 % 43200 >= 32400 AS today FROM documents), k AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(title), '[^a-z]+'), lambda w: w <> '')) AS words FROM h)"
_LEVEL = "CASE WHEN t.url = y.url THEN 1 WHEN t.fp = y.fp THEN 2 WHEN len(t.words) > 0 AND len(y.words) > 0 AND len(list_intersect(t.words, y.words)) >= 0.8 * least(len(t.words), len(y.words)) THEN 3 END"


@query("q_overlap_dedup", f"WITH {_HIST}, m AS (SELECT t.ord, min((y.ord, {_LEVEL})) AS hit FROM k t JOIN k y ON t.today AND NOT y.today AND {_LEVEL} IS NOT NULL GROUP BY t.ord) SELECT k.ord, CASE hit[2] WHEN 1 THEN 'url' WHEN 2 THEN 'fingerprint' WHEN 3 THEN 'similarity' END AS removed_by, coalesce(hit[1], -1) AS repeats FROM k LEFT JOIN m ON k.ord = m.ord WHERE k.today".replace("hit[2]", "struct_extract_at(hit, 2)").replace("hit[1]", "struct_extract_at(hit, 1)"))
def overlap_dedup(spark, sf):
    """The month's last days, by the time that assets() gives a document, against the days before."""
    d = table(spark, sf, "documents")
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    rows = d.select(F.col("doc_id").alias("ord"), F.concat(F.lit("u"), (F.col("doc_id") % 700).cast("string")).alias("url"), F.concat(F.lit("f"), (F.col("doc_id") % 900).cast("string")).alias("fingerprint"), F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z]+"), lambda w: w != "")).alias("keywords"), (F.col("doc_id") * 7919 % 43200 >= 32400).alias("today"))
    return dedup.against_history(rows.where("today"), rows.where("not today"), threshold=0.8).select("ord", "removed_by", F.coalesce("repeats", F.lit(-1)).alias("repeats"))


_MARKS, _CJK = text.TITLE_MARKS.replace("'", "''"), r"[^\x{4e00}-\x{9fff}]"


def _in_order(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def _found(gap: str) -> str:
    latin = f"list_transform(regexp_extract_all(regexp_replace(title, '{_MARKS}', '{gap}', 'g'), '{text.LATIN_WORD}'), lambda w: lower(w))"
    return f"{latin} || list_transform(range(1, length(regexp_replace(title, '{_CJK}', '', 'g'))), lambda j: substring(regexp_replace(title, '{_CJK}', '', 'g'), j, 2))"


_FOUND = f"found AS (SELECT *, {_found('')} AS g, {_found(' ')} AS s FROM assets), kw AS (SELECT *, {_in_order('g')} AS glued, {_in_order('s')} AS words FROM found)"


@query("q_title_keywords", f"WITH {ASSETS}, {_FOUND} SELECT id, array_to_string(glued, ',') AS glued, array_to_string(words, ',') AS words FROM kw")
def title_keywords(spark, sf):
    return assets(spark, sf).select("id", F.array_join(text.title_keywords(F.col("title")), ",").alias("glued"), F.array_join(text.title_keywords(F.col("title"), split_words=True), ",").alias("words"))


def _kind(k) -> str:
    """Whether a title is of a type. DuckDB's patterns have no look-around; a neighbour that is no word character says the same."""
    words = f"len(list_filter({sql_list(k.keywords)}, lambda t: contains(lower(title), lower(t)))) > 0"
    if not k.pattern:
        return words
    pattern = k.pattern.replace("(?<![A-Za-z0-9_])", "(?:^|[^A-Za-z0-9_])").replace("(?![A-Za-z0-9_])", "(?:$|[^A-Za-z0-9_])")
    return f"{words} OR regexp_matches(title, '{pattern}')"


_DEFAULT = Scoring()
_PRINT = f"""fp AS (
    SELECT list_sort(list_distinct(list_filter({sql_list(e for t in _DEFAULT.entity_tiers for e in t.entities)}, lambda t: contains(lower(title), lower(t))))) AS names,
        CASE {" ".join(f"WHEN {_kind(k)} THEN '{k.name}'" for k in sorted(_DEFAULT.event_types, key=lambda k: -k.score))} ELSE 'general' END AS kind,
        list_filter(glued, lambda w: NOT list_contains({sql_list(STOP_WORDS)}, w) AND length(w) > 1)[1:3] AS first,
        coalesce(year(published_at) || '-W' || lpad(CAST(CAST(ceil(dayofyear(published_at) / 7) AS INTEGER) AS VARCHAR), 2, '0'), 'unknown') AS week
    FROM kw)"""


@query("q_fingerprint_groups", f"WITH {ASSETS}, {_FOUND}, {_PRINT} SELECT CASE WHEN len(names) > 0 THEN array_to_string(names, '+') ELSE 'unknown' END || '|' || kind || '|' || array_to_string(first, ',') || '|' || week AS fingerprint, count(*) AS n FROM fp GROUP BY 1")
def fingerprint_groups(spark, sf):
    return assets(spark, sf).groupBy(cluster.event_fingerprint(F.col("title"), F.col("published_at")).alias("fingerprint")).agg(F.count("*").alias("n"))


@query("q_cluster_cc", "SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS cluster_id FROM customer")
def cluster_cc(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("title"), F.array(F.concat_ws("/", "c_nationkey", "c_mktsegment")).alias("entities"), F.lit(None).cast("string").alias("fingerprint"))
    return cluster.cluster(c)


def _clusterable(spark, sf):
    e = events_of(spark, sf)
    return e.select(F.col("ord").alias("id"), "ord", "title", "entities", F.lit(None).cast("string").alias("fingerprint"), F.coalesce(F.date_format("effective_at", "yyyy-MM-dd"), F.lit("none")).alias("week"))


_SETS = "sets AS (SELECT ord AS id, list_distinct(list_transform(entities, lambda e: lower(e))) AS names, list_distinct(list_transform(range(1, length(title)), lambda i: substring(lower(title), i, 2))) AS p FROM events_v)"
_LINKS = (
    "links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM sets a JOIN sets b ON a.id = b.id OR (len(a.names) > 0 AND len(b.names) > 0 AND len(list_intersect(a.names, b.names)) >= 0.5 * len(list_distinct(a.names || b.names)))"
    " OR (len(a.p) > 0 AND len(b.p) > 0 AND least(len(a.p), len(b.p)) >= 0.7 * greatest(len(a.p), len(b.p)) AND len(list_intersect(a.p, b.p)) / len(list_distinct(a.p || b.p)) >= 0.7))"
)
#: The least id that is reached within 25 links, more than the chains of the test tables have.
_LEAST = "least_id AS (SELECT id, id AS cluster_id, 0 AS step FROM sets UNION ALL SELECT l.a, min(r.cluster_id), min(r.step) + 1 FROM least_id r JOIN links l ON l.b = r.id WHERE r.step < 25 GROUP BY l.a)"


@query("q_cluster_documents", f"WITH RECURSIVE {EVENTS}, {_SETS}, {_LINKS}, {_LEAST} SELECT id, min(cluster_id) AS cluster_id FROM least_id GROUP BY id")
def cluster_documents(spark, sf):
    return cluster.cluster(_clusterable(spark, sf))


#: One event of each block a step: the first cluster that it matches takes it and its entities, or it founds one.
_IN_ORDER = f"""WITH RECURSIVE {EVENTS}, {_SETS}, b AS (
    SELECT id, coalesce(strftime(effective_at, '%Y-%m-%d'), 'none') AS week, names, p, row_number() OVER (PARTITION BY coalesce(strftime(effective_at, '%Y-%m-%d'), 'none') ORDER BY ord) AS k FROM sets JOIN (SELECT ord AS id, ord, effective_at FROM events_v) USING (id)
), e AS MATERIALIZED (
    SELECT x.id, x.week, x.k, any_value(x.names) AS names, list(y.id) FILTER (y.id IS NOT NULL) AS alike FROM b x
    LEFT JOIN b y ON x.week = y.week AND y.k < x.k AND len(x.p) > 0 AND len(y.p) > 0 AND len(list_intersect(x.p, y.p)) / len(list_distinct(x.p || y.p)) >= 0.7 GROUP BY x.id, x.week, x.k
), walk AS (
    SELECT week, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS cluster_id, [{{'c': -1::BIGINT, 'u': ['']}}] AS held FROM (SELECT DISTINCT week FROM e)
    UNION ALL
    SELECT week, k, id, coalesce(hit, id), CASE WHEN hit IS NULL THEN held || [{{'c': id, 'u': names}}] ELSE list_transform(held, lambda h: CASE WHEN h.c = hit THEN {{'c': h.c, 'u': list_distinct(h.u || names)}} ELSE h END) END
    FROM (SELECT w.week, e.k, e.id, e.names, w.held, list_filter(w.held, lambda h: h.c >= 0 AND (coalesce(list_contains(e.alike, h.c), false)
        OR (len(h.u) > 0 AND len(e.names) > 0 AND len(list_intersect(h.u, e.names)) >= 0.5 * len(list_distinct(h.u || e.names)))))[1].c AS hit FROM walk w JOIN e ON e.week = w.week AND e.k = w.k + 1)
)
SELECT id, cluster_id FROM walk WHERE k > 0"""


@query("q_cluster_leader", _IN_ORDER)
def cluster_leader(spark, sf):
    return cluster.cluster_in_order(_clusterable(spark, sf))


#: Components of the first half month and of all events. A cluster is named by its least event; of those that meet later the least name stays.
_BATCHES = f"""WITH RECURSIVE {EVENTS}, {_SETS}, {_LINKS}, first AS (
    SELECT ord AS id FROM events_v WHERE effective_at IS NULL OR effective_at < TIMESTAMP '2024-01-16'
), {_LEAST}, whole AS (
    SELECT id, min(cluster_id) AS part FROM least_id GROUP BY id
), early AS (
    SELECT id, id AS cluster_id, 0 AS step FROM first UNION ALL SELECT l.a, min(r.cluster_id), min(r.step) + 1 FROM early r JOIN links l ON l.b = r.id JOIN first f ON f.id = l.a WHERE r.step < 25 GROUP BY l.a
), parts AS (
    SELECT id, min(cluster_id) AS part FROM early GROUP BY id
), named AS (
    SELECT id, 'c' || left(sha256(min(CAST(id AS VARCHAR)) OVER (PARTITION BY part)), 16) AS name FROM parts
), kept AS (
    SELECT part, min(name) AS name, min(CAST(whole.id AS VARCHAR)) AS least FROM whole LEFT JOIN named USING (id) GROUP BY part
)
SELECT CAST(id AS VARCHAR) AS id, coalesce(name, 'c' || left(sha256(least), 16)) AS cluster_id FROM whole JOIN kept USING (part)"""


@query("q_cluster_batches", _BATCHES)
def cluster_batches(spark, sf):
    """The first half month stored, then the rest against the stored clusters."""
    store = clusters.Store(spark, f"{shared_root(spark)}/clusters-{uuid.uuid4().hex}")
    events = events_of(spark, sf).select(F.col("ord").alias("id"), "title", "entities", F.lit(None).cast("string").alias("fingerprint"), "effective_at")
    early = F.col("effective_at").isNull() | (F.col("effective_at") < F.lit("2024-01-16").cast("timestamp"))
    store.add(events.where(early), 0)
    store.add(events.where(~early), 1)
    return store.clusters()


@query("q_cluster_rows", f"WITH {EVENTS} SELECT cluster_id, arg_max(title, (rank_total, -ord)) AS title, count(*) AS event_count, array_to_string(list_sort(list_distinct(flatten(list(entities)))), ',') AS entity_keys, strftime(min(effective_at), '%Y-%m-%d %H:%M') AS first_seen FROM events_v WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def cluster_rows(spark, sf):
    return cluster.cluster_rows(events_of(spark, sf)).select("cluster_id", "title", "event_count", F.array_join("entity_keys", ",").alias("entity_keys"), F.date_format("first_seen", "yyyy-MM-dd HH:mm").alias("first_seen"))


@query("q_find_by_window", f"WITH {EVENTS} SELECT id, rank_total FROM events_v WHERE effective_at >= TIMESTAMP '2024-01-10' AND effective_at < TIMESTAMP '2024-01-12'")
def find_by_window(spark, sf):
    return readmodels.Events(events_of(spark, sf)).window(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")).select("id", "rank_total")


@query("q_find_by_entity", f"WITH {EVENTS} SELECT id FROM events_v WHERE list_contains(entities, 'thest')")
def find_by_entity(spark, sf):
    return readmodels.Events(events_of(spark, sf)).with_entity("thest").select("id")


@query("q_find_by_topic", f"WITH {EVENTS} SELECT id, event_type FROM events_v WHERE event_type = 'policy'")
def find_by_topic(spark, sf):
    e = events_of(spark, sf).withColumn("topics", F.array("event_type"))
    return readmodels.Events(e).with_topic("policy").select("id", "event_type")


@query("q_find_by_cluster", f"WITH {EVENTS} SELECT id, rank_total FROM events_v WHERE cluster_id = 'c7'")
def find_by_cluster(spark, sf):
    return readmodels.Events(events_of(spark, sf)).in_cluster("c7").select("id", "rank_total")


@query("q_entity_bridge", f"WITH {EVENTS} SELECT DISTINCT id AS event_id, unnest(entities) AS entity FROM events_v")
def entity_bridge(spark, sf):
    return dedup.bridge(events_of(spark, sf), "entities", "entity")


@query("q_feedback_daily", "SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS events FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def feedback_daily(spark, sf):
    e = table(spark, sf, "events").withColumn("effective_at", F.col("ts")).withColumn("entities", F.array().cast("array<string>")).withColumn("topics", F.array().cast("array<string>")).withColumn("id", F.col("event_id"))
    return readmodels.Events(e).per_day().select(F.col("day").cast("string").alias("day"), "events")


_WEEKLY = EVENTS + """, wk AS (SELECT * FROM events_v WHERE effective_at >= TIMESTAMP '2024-01-24' AND effective_at < TIMESTAMP '2024-02-01'), roll AS (
    SELECT coalesce(cluster_id, 'unclustered-' || coalesce(strftime(effective_at, '%Y-%m-%d'), 'unknown')) AS cluster_id, bool_or(cluster_id IS NULL) AS loose, count(*) AS event_count, max(rank_total) AS top_score,
        coalesce(nullif(arg_max(title, (rank_total, -ord)), ''), 'Untitled') AS t, string_agg(id, ',' ORDER BY rank_total DESC, ord) AS event_ids FROM wk GROUP BY 1)"""


@query("q_weekly_rollup", f"WITH {_WEEKLY} SELECT cluster_id, CASE WHEN loose THEN 'Unclustered' ELSE t END AS title, CASE WHEN loose THEN 'low' ELSE 'medium' END AS importance, event_count, top_score, event_ids FROM roll")
def weekly_rollup(spark, sf):
    rows = weekly.by_cluster(weekly.in_week(events_of(spark, sf), as_of()))
    return rows.withColumn("event_ids", F.array_join("event_ids", ","))


@query("q_weekly_top3", f"WITH {_WEEKLY}, b AS (SELECT cluster_id AS cid, row_number() OVER (ORDER BY top_score DESC, cluster_id) AS cluster_place FROM roll QUALIFY cluster_place <= 10) SELECT id, cid AS cluster_id, cluster_place, row_number() OVER (PARTITION BY cid ORDER BY rank_total DESC, ord) AS place FROM wk JOIN b ON coalesce(cluster_id, 'unclustered-' || strftime(effective_at, '%Y-%m-%d')) = cid QUALIFY place <= 3")
def weekly_top3(spark, sf):
    e = weekly.in_week(events_of(spark, sf), as_of())
    return weekly.top_events(e, weekly.by_cluster(e)).select("id", "cluster_id", F.col("cluster_place").cast("bigint").alias("cluster_place"), F.col("place").cast("bigint").alias("place"))


@query("q_html_paragraph_score", r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS part FROM pages), p AS (SELECT page_id, unnest(regexp_extract_all(part, '(?is)<p[^>]*>(.*?)</p>', 1)) AS raw, generate_subscripts(regexp_extract_all(part, '(?is)<p[^>]*>(.*?)</p>', 1), 1) - 1 AS n FROM a),
    t AS (SELECT page_id, n, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS paragraph FROM p)
    SELECT page_id, CAST(n AS INTEGER) AS "at", CAST((CASE WHEN contains(lower(paragraph), 'thing') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(paragraph), 'eau') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(paragraph), 'keitung') THEN 2 ELSE 0 END) AS INTEGER) AS score FROM t WHERE length(paragraph) >= 20""")
def html_paragraph_score(spark, sf):
    rows = evidence.paragraphs(table(spark, sf, "pages"))
    words = F.array(F.lit("thing"), F.lit("eau"), F.lit("keitung"))
    return rows.select("page_id", "at", evidence.paragraph_score(F.col("paragraph"), words).alias("score"))


@query("q_evidence_score", f"WITH {ASSETS} SELECT id, round(((tier / 3.0) + CASE WHEN ord % 4 = 0 THEN 0.3 ELSE (ord % 5 + 1) / 5.0 END + least(ord % 6 / 3.0, 1.0)) / 3.0 + 1e-9, 2) AS score FROM assets")
def evidence_score(spark, sf):
    trust = F.when(F.col("ord") % 4 != 0, (F.col("ord") % 5 + 1).cast("double"))
    return assets(spark, sf).select("id", scoring.evidence_score(F.col("tier"), F.lit(3), trust, F.col("ord") % 6).alias("score"))


@query("q_url_anti", "SELECT DISTINCT page_id AS id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) AND NOT contains(url, ' ') AND NOT contains(url, ')')")
def url_anti(spark, sf):
    p = table(spark, sf, "pages")
    articles = p.select(F.col("page_id").alias("id"), F.concat(F.lit("see "), "url", F.lit(" and more")).alias("markdown"))
    return reports.unknown_urls(articles, p.where("page_id % 3 = 0"))


@query("q_title_consistency", "WITH c AS (SELECT conv_id, role, unnest(string_split_regex(lower(text), '[^a-z]+')) AS t FROM conversations), x AS (SELECT conv_id, list(DISTINCT t) AS x FROM c WHERE role = 'user' GROUP BY 1), y AS (SELECT conv_id, list(DISTINCT t) AS y FROM c WHERE role <> 'user' GROUP BY 1), b AS (SELECT conv_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM x FULL JOIN y USING (conv_id)) SELECT conv_id, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) AS similarity, len(list_intersect(x, y)) / len(list_distinct(x || y)) < 0.5 AS warn FROM b")
def title_consistency(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "role", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("t"))
    return reports.title_consistency(c.where("role = 'user'"), c.where("role <> 'user'"), "conv_id", "t").select("conv_id", F.round("similarity", 6).alias("similarity"), "warn")


def _scripts(spark, sf):
    c = table(spark, sf, "conversations")
    line = F.struct(F.col("role").alias("speaker"), "text", (F.char_length("text") / 4.0).alias("duration_s"))
    rows = c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    none = F.array().cast("array<struct<title:string,dialogue:array<struct<speaker:string,text:string,duration_s:double>>>>")
    rest = F.slice(F.col("lines"), F.lit(2), F.size("lines"))
    return rows.select("id", F.slice("lines", 1, 1).alias("hook"), F.slice("lines", 1, 0).alias("overview"), F.array(F.struct(F.lit("t").alias("title"), rest.alias("dialogue"))).alias("deep_items"), none.alias("quick_items"), F.slice("lines", 1, 0).alias("closing"))


@query("q_dialogue_segments", "SELECT conv_id::VARCHAR AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS at, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'hook' ELSE 'deep' END AS section, role AS speaker, text FROM conversations")
def dialogue_segments(spark, sf):
    return reports.dialogue(_scripts(spark, sf)).select("id", "at", "section", "speaker", "text")


@query("q_script_duration", "SELECT conv_id::VARCHAR AS id, round(sum(length(text) / 4.0), 4) AS seconds, sum(length(text) / 4.0) BETWEEN 180 AND 300 AS in_range FROM conversations GROUP BY conv_id")
def script_duration(spark, sf):
    return reports.script_duration(_scripts(spark, sf)).select("id", F.round("seconds", 4).alias("seconds"), "in_range")


_STATS = "i AS (SELECT CAST(doc_id % 10 AS BIGINT) AS date, CASE doc_id % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'important' ELSE 'brief' END AS section, source, text FROM documents), s AS (SELECT date, count(*) FILTER (section = 'deep') AS deep, count(*) FILTER (section = 'important') AS important, count(*) FILTER (section = 'brief') AS brief, count(DISTINCT source) AS n_sources, sum(length(text))::BIGINT AS chars FROM i GROUP BY date)"


@query("q_output_stats", f"WITH {_STATS} SELECT *, (SELECT round(avg(deep), 1) FROM s) AS baseline, round(deep - (SELECT round(avg(deep), 1) FROM s), 1) AS diff FROM s")
def output_stats(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id") % 3
    items = d.select((F.col("doc_id") % 10).alias("date"), F.when(i == 0, "deep").when(i == 1, "important").otherwise("brief").alias("section"), "source", "text")
    return reports.against_baseline(reports.output_stats(items), "deep").drop("latin_sources_pct")


@query("q_article_checks", "WITH a AS (SELECT c_custkey, c_name, c_mktsegment, c_custkey % 2 = 0 AS deep FROM customer) SELECT CAST(c_custkey AS VARCHAR) AS id, length(c_name) > 20 AS hook_over_20, deep AS deep_items, c_custkey % 3 = 0 AS editorial_triple FROM a")
def article_checks(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    item = F.struct(F.col("c_name").alias("title"), F.lit("in 2024").alias("summary"), F.lit("https://a.b/c").alias("url"), F.col("c_mktsegment").alias("source"), F.array().cast("array<string>").alias("entities"))
    none = F.array().cast(f"array<{reports.ITEM}>")
    text_or_not = F.when(k % 3 == 0, "reason enough to say so")
    rows = c.select(k.cast("string").alias("id"), F.col("c_name").alias("hook"), F.array(F.lit("s")).alias("summary_items"), F.when(k % 2 == 0, F.array(item)).otherwise(none).alias("deep_items"), none.alias("important_items"), none.alias("brief_items"), F.struct(text_or_not.alias("observation"), text_or_not.alias("evidence"), text_or_not.alias("judgment")).alias("editorial"))
    named = reports.checks(rows).where(F.col("check").isin("hook_over_20", "deep_items", "editorial_triple"))
    return named.groupBy("id").pivot("check", ["hook_over_20", "deep_items", "editorial_triple"]).agg(F.first("passed"))
