"""Queries of single functions and smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text, time
from ..operators import dedup, evidence, health, memory, normalize, readmodels, reports, signals, weekly
from ..sources import feeds
from .tables import ASSETS, EVENTS, SNAPSHOTS, as_of, assets, day, events_of, query, snapshots, table


@query("q_url_functions", "SELECT page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS host, CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END AS url, 'https://' || split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS rebuilt FROM pages")
def url_functions(spark, sf):
    host = text.url_host(F.col("url"))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), text.with_scheme(F.col("url")).alias("url"), text.with_scheme(host).alias("rebuilt"))


@query("q_evidence_id", "SELECT page_id, 'evt_' || substr(md5(page_id::VARCHAR || url), 1, 8) AS evidence_id FROM pages")
def evidence_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", hashing.evidence_id(F.col("page_id").cast("string"), F.col("url")).alias("evidence_id"))


@query("q_week_buckets", "SELECT year(o_orderdate) || '-W' || lpad(CAST(CAST(ceil(dayofyear(o_orderdate) / 7.0) AS INTEGER) AS VARCHAR), 2, '0') AS week, count(*) AS n FROM orders GROUP BY 1")
def week_buckets(spark, sf):
    return table(spark, sf, "orders").groupBy(time.seventh_day_week(F.col("o_orderdate")).alias("week")).agg(F.count("*").alias("n"))




@query("q_parse_dates", "SELECT event_id, CASE event_id % 5 WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 4 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events")
def parse_dates(spark, sf):
    e, m = table(spark, sf, "events"), F.col("event_id") % 5
    f = lambda p: F.date_format("ts", p)
    raw = F.when(m == 0, f("EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(m == 1, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(m == 2, f("dd MMM yyyy HH:mm:ss '+0000'")).when(m == 3, f("yyyy-MM-dd'T'HH:mm'Z'")).otherwise("no date")
    return e.select("event_id", F.date_format(time.parse_date(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("q_json_fallback", "SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END, -1) AS k FROM events")
def json_fallback(spark, sf):
    raw = F.when(F.col("event_id") % 4 != 0, F.col("props")).otherwise("{broken")
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object(raw, "$.k").try_cast("bigint"), F.lit(-1)).alias("k"))


@query("q_source_domain", f"WITH {ASSETS} SELECT id, CASE WHEN starts_with(source_id, 'src1') THEN 'research' WHEN starts_with(source_id, 'src2') OR starts_with(source_id, 'src3') THEN 'policy' ELSE 'industry' END AS domain FROM assets")
def source_domain(spark, sf):
    return assets(spark, sf).select("id", normalize.domain_of_source(F.col("source_id"), {"research": ["src1"], "policy": ["SRC2", "src3"]}).alias("domain"))


@query("q_curated_score", "SELECT doc_id, CASE quality WHEN 1 THEN CASE toxic WHEN 0 THEN 92 ELSE 70 END ELSE 50 END AS score FROM labels")
def curated_score(spark, sf):
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "deep").when(F.col("quality") == 1, "important").otherwise("brief")
    return table(spark, sf, "labels").select("doc_id", normalize.curated_score(kind).alias("score"))




@query("q_images_and_page_dates", "SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'http://i/e.png' WHEN 1 THEN 'http://i/m.png' WHEN 2 THEN 'http://i/t.png' ELSE 'http://i/i.png' END AS image, CASE n_nationkey % 3 WHEN 0 THEN '2024-01-05 10:00' WHEN 1 THEN '2024-01-06 11:00' END AS page_date FROM nation")
def images_and_page_dates(spark, sf):
    k = F.col("n_nationkey")
    item = F.when(k % 4 == 0, '<enclosure url="http://i/e.png" type="image/png"/><img src="http://i/x.png">').when(k % 4 == 1, '<media:content medium="image" url="http://i/m.png"/>').when(k % 4 == 2, '<media:thumbnail url="http://i/t.png"/>').otherwise('<p><img alt="" src="http://i/i.png"></p>')
    html = F.when(k % 3 == 0, '<script type="application/ld+json">{"datePublished": "2024-01-05T10:00:00Z"}</script>').when(k % 3 == 1, '<meta property="article:published_time" content="2024-01-06T11:00:00Z">').otherwise("<p>no date</p>")
    return table(spark, sf, "nation").select(k.alias("k"), feeds.image(item).alias("image"), F.date_format(feeds.page_date(html), "yyyy-MM-dd HH:mm").alias("page_date"))


@query("q_find_clusters", f"WITH {EVENTS}, c AS (SELECT cluster_id AS id, flatten(list(entities)) AS keys, min(effective_at) AS first_seen FROM events_v WHERE cluster_id IS NOT NULL GROUP BY 1) SELECT id, len(list_filter(keys, lambda k: k = 'thest')) > 0 AS exact FROM c WHERE len(list_filter(keys, lambda k: contains(lower(k), 'the'))) > 0 AND first_seen BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20'")
def find_clusters(spark, sf):
    from ..operators.cluster import cluster_rows

    c = readmodels.Clusters(cluster_rows(events_of(spark, sf)).withColumnRenamed("cluster_id", "id"))
    both = c.like_entity("THE").join(c.first_seen(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).select("id"), "id")
    return both.join(c.with_entity("thest").select("id", F.lit(True).alias("exact")), "id", "left").select("id", F.coalesce("exact", F.lit(False)).alias("exact"))


@query("q_known_hashes", "SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def known_hashes(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("topics"))
    return readmodels.Events(d.where("id % 2 = 0")).known(d.where("id % 2 = 1")).select(F.col("id").alias("doc_id"))


@query("q_remove_by_ids", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def remove_by_ids(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("topics"))
    return readmodels.Events(n).without(table(spark, sf, "region").select(F.col("r_regionkey").alias("id"))).select("id")


@query("q_top_events", f"WITH {EVENTS} SELECT id, rank_total FROM events_v ORDER BY rank_total DESC, ord LIMIT 10")
def top_events(spark, sf):
    return readmodels.Events(events_of(spark, sf)).top(10).select("id", "rank_total")


@query("q_cluster_titles", f"WITH {EVENTS}, r AS (SELECT cluster_id, arg_max(title, (rank_total, -ord)) AS t FROM events_v WHERE cluster_id IS NOT NULL AND effective_at >= TIMESTAMP '2024-01-24' AND effective_at < TIMESTAMP '2024-02-01' GROUP BY 1) SELECT cluster_id, CASE WHEN CAST(substr(cluster_id, 2) AS INTEGER) % 2 = 0 THEN 'Known ' || cluster_id ELSE coalesce(nullif(t, ''), 'Untitled') END AS title, CASE WHEN CAST(substr(cluster_id, 2) AS INTEGER) % 2 = 0 THEN 'high' ELSE 'medium' END AS importance FROM r")
def cluster_titles(spark, sf):
    e = weekly.in_week(events_of(spark, sf), as_of()).where("cluster_id is not null")
    known = e.where("ord % 40 % 2 = 0").select(F.col("cluster_id").alias("id")).distinct().select("id", F.concat(F.lit("Known "), "id").alias("title"), F.lit("high").alias("importance"))
    return weekly.by_cluster(e, known).select("cluster_id", "title", "importance")


@query("q_week_totals", f"WITH {EVENTS} SELECT count(*) AS events, count(DISTINCT coalesce(cluster_id, 'unclustered-' || strftime(effective_at, '%Y-%m-%d'))) AS clusters FROM events_v WHERE effective_at >= TIMESTAMP '2024-01-24' AND effective_at < TIMESTAMP '2024-02-01'")
def week_totals(spark, sf):
    return weekly.total_events(weekly.by_cluster(weekly.in_week(events_of(spark, sf), as_of())))


@query("q_paywall", "SELECT page_id, page_id % 4 = 0 AS walled FROM pages")
def paywall(spark, sf):
    wall = F.when(F.col("page_id") % 4 == 0, F.lit('<div class="x paywall-box">')).otherwise(F.lit("<div class='wall'>"))
    return table(spark, sf, "pages").select("page_id", evidence.is_paywalled(F.concat(wall, "html")).alias("walled"))


@query("q_best_paragraph", r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) AS part FROM pages), p AS (SELECT page_id, unnest(regexp_extract_all(part, '(?is)<p[^>]*>(.*?)</p>', 1)) AS raw, generate_subscripts(regexp_extract_all(part, '(?is)<p[^>]*>(.*?)</p>', 1), 1) AS n FROM a),
    t AS (SELECT page_id, n, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS paragraph FROM p), s AS (SELECT *, (CASE WHEN contains(lower(paragraph), 'thing') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(paragraph), 'eau') THEN 1 ELSE 0 END) AS score FROM t WHERE length(paragraph) >= 20)
    SELECT page_id, arg_max(paragraph, (score, -n)) AS paragraph, CAST(max(score) AS INTEGER) AS score FROM s WHERE score > 0 GROUP BY page_id""")
def best_paragraph(spark, sf):
    rows = evidence.paragraphs(table(spark, sf, "pages"))
    scored = rows.withColumn("score", evidence.paragraph_score(F.col("paragraph"), F.array(F.lit("thing"), F.lit("eau"))))
    return evidence.best_paragraph(scored)


@query("q_evidence_injection", "WITH e AS (SELECT page_id AS event_id, url, 'claim ' || page_id AS claim FROM pages WHERE page_id % 3 = 0), u AS (SELECT url, arg_min(claim, claim) AS c2 FROM e GROUP BY url) SELECT page_id AS id, coalesce(e.claim, u.c2) AS claim FROM pages p LEFT JOIN e ON e.event_id = p.page_id LEFT JOIN u ON u.url = p.url")
def evidence_injection(spark, sf):
    p = table(spark, sf, "pages")
    claims = p.where("page_id % 3 = 0").select(F.col("page_id").alias("event_id"), "url", F.concat(F.lit("claim "), F.col("page_id").cast("string")).alias("claim")).withColumn("evidence_id", F.col("claim"))
    return evidence.inject(p.select(F.col("page_id").alias("id"), "url"), claims).select("id", "claim")


_KEYWORDS = (
    r"raw AS (SELECT id, entities, title || ' ' || summary AS raw FROM events_v), k AS (SELECT id, list_distinct(regexp_extract_all(raw, '\b[A-Z][a-z]{2,}\b') || regexp_extract_all(raw, '\b[A-Z]{2,5}\b') || entities"
    r" || list_filter(regexp_extract_all(raw, '[^\x00-\x7F]{2,10}'), lambda p: len(list_filter(entities, lambda n: contains(p, n))) > 0)) AS w FROM raw)"
)


@query("q_evidence_keywords", f"WITH {EVENTS}, {_KEYWORDS} SELECT id, array_to_string(list_transform(list_sort(list_transform(w, lambda x: {{'n': -length(x), 'w': x}})), lambda s: s.w)[1:15], ',') AS keywords FROM k")
def evidence_keywords(spark, sf):
    return events_of(spark, sf).select("id", F.array_join(evidence.keywords(F.col("title"), F.col("summary"), F.col("entities")), ",").alias("keywords"))


@query("q_collection_summary", "SELECT count(*) FILTER (c_nationkey % 3 = 0) AS ok, count(*) FILTER (c_nationkey % 3 = 1) AS errors, count(*) FILTER (c_nationkey % 3 = 2) AS disabled, sum(c_custkey)::BIGINT AS raw, sum(c_custkey % 7)::BIGINT AS deduped, sum(c_custkey % 2)::BIGINT AS date_removed FROM customer")
def collection_summary(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_nationkey") % 3
    return health.collection_summary(c.select(F.when(k == 0, "ok").when(k == 1, "error").otherwise("disabled").alias("status"), F.col("c_custkey").alias("n_raw"), (F.col("c_custkey") % 7).alias("n_kept"), (F.col("c_custkey") % 2).alias("n_date_removed")))


@query("q_health_alerts", "WITH r AS (SELECT user_id % 50 AS source_id, ts, event_id AS ord, value > 20 AS ok FROM events), l AS (SELECT source_id, max(CASE WHEN ok THEN (ts, ord) END) AS last FROM r GROUP BY 1), s AS (SELECT source_id, count(*) FILTER (NOT ok AND (last IS NULL OR (ts, ord) > last)) AS streak FROM r JOIN l USING (source_id) GROUP BY 1) SELECT source_id, streak, CASE WHEN streak >= 2 THEN 'critical' ELSE 'warning' END AS alert FROM s WHERE streak >= 1")
def health_alerts(spark, sf):
    e = table(spark, sf, "events")
    runs = e.select((F.col("user_id") % 50).alias("source_id"), "ts", F.col("event_id").alias("ord"), (F.col("value") > 20).alias("ok"))
    return health.alerts(health.streaks(runs), 1, 2).select("source_id", "streak", "alert")


@query("q_phrase_counts", "SELECT doc_id, (length(text) - length(replace(text, 'thing', ''))) // 5 + (length(text) - length(replace(text, 'eaux', ''))) // 4 AS n FROM documents")
def phrase_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", reports.empty_phrases(F.col("text"), ["thing", "eaux"]).cast("bigint").alias("n"))


@query("q_signal_summary", f"WITH {EVENTS}, h AS (SELECT 'RANK' AS phase, 'AUTHORITY' AS subtype FROM events_v UNION ALL SELECT 'RANK', 'SOURCE_DIVERSITY' FROM events_v WHERE source_name IN (SELECT source_name FROM events_v GROUP BY 1 HAVING count(*) > 3)) SELECT phase, subtype, count(*) AS signals FROM h GROUP BY ALL")
def signal_summary(spark, sf):
    return signals.summary(signals.collect(events_of(spark, sf), [signals.authority, signals.source_diversity]))


@query("q_snapshot_upsert", f"WITH {SNAPSHOTS}, s AS (SELECT date, count(DISTINCT id) AS n FROM snaps GROUP BY 1) SELECT strftime(date, '%Y-%m-%d') AS date, CASE WHEN date >= DATE '2024-01-25' THEN 0 ELSE n END AS events FROM s")
def snapshot_upsert(spark, sf):
    s = snapshots(spark, sf)
    new = s.where("date >= '2024-01-25'").withColumn("top_event_ids", F.array().cast("array<string>"))
    return memory.put_snapshot(s, new).select(F.col("date").cast("string").alias("date"), F.size("top_event_ids").cast("bigint").alias("events"))


@query("q_story_update", "WITH m AS (SELECT user_id % 100 AS k, ts, event_id FROM events) SELECT 's' || k AS story_key, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen, count(DISTINCT event_id) AS n, CASE WHEN k % 10 = 0 THEN 'stale' ELSE 'emerging' END AS state FROM m GROUP BY k")
def story_update(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.concat(F.lit("s"), (F.col("user_id") % 100).cast("string")).alias("story_key"), F.col("event_type").alias("entity"), F.col("event_id").cast("string").alias("event_id"), F.lit("t").alias("title"), F.col("ts").alias("date"), F.col("event_id").alias("ord"))
    s = memory.track(memory.rollup_stories(rows.where("ord % 2 = 0")), rows.where("ord % 2 = 1"))
    s = memory.set_state(s, s.where(s.story_key.endswith("0") & (F.length("story_key") <= 3)).select("story_key", F.lit("stale").alias("state")))
    return s.select("story_key", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), F.size("event_ids").cast("bigint").alias("n"), "state")


@query("q_story_timeline", "SELECT 's' || user_id % 100 AS story_key, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M') AS first FROM events GROUP BY 1")
def story_timeline(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 100).cast("string")).alias("story_key"), F.col("ts").alias("event_date"), F.col("event_type").alias("event_title"), F.lit("u").alias("event_url"))
    t = memory.timeline(e.select("story_key").distinct(), e)
    return t.select("story_key", F.size("timeline").cast("bigint").alias("n"), F.date_format(F.element_at("timeline", 1)["event_date"], "yyyy-MM-dd HH:mm").alias("first"))


@query("q_history_days", f"WITH {SNAPSHOTS} SELECT strftime(date, '%Y-%m-%d') AS date, count(DISTINCT id) AS events FROM snaps WHERE date > DATE '2024-01-30' - 5 AND date <= DATE '2024-01-30' GROUP BY 1")
def history_days(spark, sf):
    s = snapshots(spark, sf).where((F.col("date") > F.date_sub(day(), 5)) & (F.col("date") <= day()))
    return s.select(F.col("date").cast("string").alias("date"), F.size("top_event_ids").cast("bigint").alias("events"))


@query("q_cooldown", "SELECT n_nationkey AS k, least(10.0 * pow(2, n_nationkey % 8 + 3 - 3), 120.0) AS minutes FROM nation")
def cooldown(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.alias("k"), time.cooldown_minutes(k % 8 + 3).alias("minutes"))


@query("q_bridge_growth", "SELECT c_mktsegment AS segment, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def bridge_growth(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("id"), F.array(F.col("c_nationkey").cast("string")).alias("names"))
    return dedup.bridge(c, "names", "name").groupBy(F.col("event_id").alias("segment")).agg(F.count("*").alias("nations"))


@query("q_lifecycle", "WITH s AS (SELECT user_id % 300 AS k, max(ts) AS last, count(*) AS n FROM events GROUP BY 1) SELECT k, CASE WHEN date_diff('day', CAST(last AS DATE), DATE '2024-02-04') > 7 THEN 'stale' WHEN date_diff('day', CAST(last AS DATE), DATE '2024-02-04') > 3 THEN 'follow-up' WHEN n >= 5 THEN 'peak' WHEN n >= 2 THEN 'developing' ELSE 'emerging' END AS state FROM s")
def lifecycle(spark, sf):
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 300).alias("k")).agg(F.max("ts").cast("date").alias("last"), F.min("ts").cast("date").alias("first"), F.count("*").alias("n"))
    return e.select("k", memory.lifecycle(F.col("last"), F.col("first"), F.col("n"), F.lit("2024-02-04").cast("date")).alias("state"))


