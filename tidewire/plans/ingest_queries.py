"""Queries of collection, normalization, quarantine, scoring and dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text, time
from ..operators import dedup, filters, health, scoring
from ..sources import feeds
from .tables import ASSETS, CFG, SCORED, as_of, assets, day, query, scored, table


@query("q_normalize_hash", f"WITH {ASSETS} SELECT id, title, summary, source_id, 'sha256:' || substr(sha256(title || '|' || url || '|' || summary || '|' || coalesce(strftime(published_at, '%Y-%m-%d %H:%M:%S'), '')), 1, 16) AS content_hash FROM assets")
def normalize_hash(spark, sf):
    a = assets(spark, sf)
    when = F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return a.select("id", "title", "summary", "source_id", hashing.content_hash("title", "url", "summary", when).alias("content_hash"))


_RAW = "CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%MZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H') WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN 'unknown' END"


@query(
    "q_time_precision",
    f"""WITH r AS (SELECT event_id, {_RAW} AS raw FROM events)
    SELECT event_id, coalesce(CASE WHEN raw <> 'unknown' THEN raw END, 'collected') AS effective,
        CASE WHEN raw IS NULL OR raw = 'unknown' THEN 'unknown' WHEN regexp_matches(raw, 'T\\d{{2}}:\\d{{2}}:\\d{{2}}') THEN 'second' WHEN regexp_matches(raw, 'T\\d{{2}}:\\d{{2}}') THEN 'minute'
            WHEN regexp_matches(raw, 'T\\d{{2}}') THEN 'hour' WHEN regexp_matches(raw, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'day' ELSE 'unknown' END AS time_precision FROM r""",
)
def time_precision(spark, sf):
    e, m = table(spark, sf, "events"), F.col("event_id") % 6
    f = lambda p: F.date_format("ts", p)
    raw = F.when(m == 0, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(m == 1, f("yyyy-MM-dd'T'HH:mm'Z'")).when(m == 2, f("yyyy-MM-dd'T'HH")).when(m == 3, f("yyyy-MM-dd")).when(m == 4, "unknown")
    return e.select("event_id", time.effective_time(raw, F.lit("collected")).alias("effective"), time.precision(raw).alias("time_precision"))


@query("q_iso_week_counts", "SELECT strftime(ts, '%G-W%V') AS week, event_type, count(*) AS n FROM events GROUP BY ALL")
def iso_week_counts(spark, sf):
    return table(spark, sf, "events").groupBy(time.iso_week(F.col("ts")).alias("week"), "event_type").agg(F.count("*").alias("n"))


@query("q_summary_clean", r"SELECT page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g'), '\s+', ' ', 'g')), 500) AS summary FROM pages")
def summary_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_summary(F.col("html")).alias("summary"))


@query(
    "q_int32_hash",
    f"""WITH {ASSETS}, h AS (SELECT id, list_reduce(list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, CAST(0 AS BIGINT)) AS n FROM assets)
    SELECT id, n AS poly31, lpad(printf('%x', abs(n)), 8, '0') AS item_hash FROM h""",
)
def int32_hash(spark, sf):
    return assets(spark, sf).select("id", hashing.poly31(F.col("url")).alias("poly31"), hashing.item_hash(F.col("url")).alias("item_hash"))


_TERMS = ["thest", "eauou", "keit", "AI", "LLM", "RAG"]


@query("q_keyword_gate", f"WITH {ASSETS} SELECT tier, source_id, count(*) AS n FROM assets WHERE tier < 3 AND source_id <> 'src1' OR len(list_filter({_TERMS!r}, lambda t: contains(lower(title || ' ' || summary), lower(t)))) > 0 GROUP BY ALL")
def keyword_gate(spark, sf):
    a = assets(spark, sf)
    keep = filters.topical(F.col("tier"), F.col("source_id") == "src1", text.lower_text("title", "summary"), _TERMS)
    return a.where(keep).groupBy("tier", "source_id").agg(F.count("*").alias("n"))


@query("q_day_window_tolerance", "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' OR CAST(ts AS DATE) = DATE '2024-01-14' AND hour(ts) >= 18 GROUP BY ALL")
def day_window(spark, sf):
    e = table(spark, sf, "events").where(filters.on_day(F.col("ts"), F.lit("2024-01-15").cast("date")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("q_age_window", f"WITH {ASSETS} SELECT source_id, count(*) AS n FROM assets WHERE published_at IS NULL OR epoch(TIMESTAMP '2024-01-31' - published_at) / 3600.0 <= CASE WHEN tier = 1 THEN 72 ELSE 24 END GROUP BY ALL")
def age_window(spark, sf):
    a = assets(spark, sf)
    hours = F.when(F.col("tier") == 1, 72.0).otherwise(24.0)
    return a.where(filters.recent(F.col("published_at"), as_of(), hours)).groupBy("source_id").agg(F.count("*").alias("n"))


_CODE = "p AS (SELECT page_id, url || CASE page_id % 7 WHEN 0 THEN '/issues/12' WHEN 1 THEN '/pull/3' WHEN 2 THEN '/commit/ab12' WHEN 3 THEN '/actions/runs' ELSE '' END AS url, CASE page_id % 5 WHEN 0 THEN 'fix: x' WHEN 1 THEN 'feat: x' WHEN 2 THEN 'v1.2' WHEN 3 THEN 'Bump y' ELSE 'Title' END AS title, CASE WHEN page_id % 2 = 0 THEN 'github-x' ELSE 'other' END AS source_id FROM pages)"
_REASON = r"CASE WHEN source_id NOT LIKE '%github%' THEN NULL WHEN regexp_matches(url, '/issues/\d+|/pull/\d+|/commit/[a-f0-9]+|/actions/') THEN 'url' WHEN regexp_matches(title, '(?i)^(feat|release|breaking)(\(|:)') OR regexp_matches(title, 'v\d+\.\d+') THEN NULL WHEN regexp_matches(title, '(?i)^(fix|chore|ci|docs|build|test|refactor)(\(|:)') OR regexp_matches(title, '^Merge pull request') OR regexp_matches(title, '^Bump ') THEN 'title' END"


def _code_pages(spark, sf):
    p, i = table(spark, sf, "pages"), F.col("page_id")
    tail = F.when(i % 7 == 0, "/issues/12").when(i % 7 == 1, "/pull/3").when(i % 7 == 2, "/commit/ab12").when(i % 7 == 3, "/actions/runs").otherwise("")
    title = F.when(i % 5 == 0, "fix: x").when(i % 5 == 1, "feat: x").when(i % 5 == 2, "v1.2").when(i % 5 == 3, "Bump y").otherwise("Title")
    rows = p.select("page_id", F.concat("url", tail).alias("url"), title.alias("title"), F.when(i % 2 == 0, "github-x").otherwise("other").alias("source_id"))
    return rows.withColumn("reason", filters.noise_reason(F.col("url"), F.col("title"), F.col("source_id")))


@query("q_noise_filter", f"WITH {_CODE} SELECT page_id, {_REASON} AS reason FROM p")
def noise_filter(spark, sf):
    return _code_pages(spark, sf).select("page_id", "reason")


@query("q_noise_quarantine", f"WITH {_CODE}, n AS (SELECT page_id AS id, {_REASON} AS reason FROM p), held AS (SELECT page_id AS id, 'old' AS reason, TIMESTAMP '2024-01-31' + to_days(CAST(page_id % 9 - 5 AS INTEGER)) AS expires_at FROM pages WHERE page_id % 3 = 0) SELECT id, reason, strftime(expires_at, '%Y-%m-%d') AS expires FROM held WHERE expires_at >= TIMESTAMP '2024-01-31' AND id NOT IN (SELECT id FROM n WHERE reason IS NOT NULL) UNION ALL SELECT id, reason, '2024-02-03' FROM n WHERE reason IS NOT NULL")
def noise_quarantine(spark, sf):
    new = _code_pages(spark, sf).where("reason is not null").select(F.col("page_id").alias("id"), "reason")
    old = table(spark, sf, "pages").where("page_id % 3 = 0").select(F.col("page_id").alias("id"), F.lit("old").alias("reason"), (as_of() + F.make_dt_interval((F.col("page_id") % 9 - 5).cast("int"))).alias("expires_at"), as_of().alias("quarantined_at"))
    return filters.quarantine(old, new, as_of()).select("id", "reason", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


@query("q_entity_extract", f"WITH {SCORED} SELECT id, array_to_string(entities, ',') AS entities, event_type FROM labelled")
def entity_extract(spark, sf):
    return scored(spark, sf).select("id", F.array_join("entities", ",").alias("entities"), "event_type")


@query("q_entity_counts", f"WITH {SCORED} SELECT entity, count(*) AS n FROM (SELECT unnest(entities) AS entity FROM labelled) GROUP BY entity")
def entity_counts(spark, sf):
    return scored(spark, sf).select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


@query("q_score_factors", f"WITH {SCORED} SELECT id, authority, timeliness, entity, type_score AS event_type, quantitative, total_score FROM labelled")
def score_factors(spark, sf):
    f = lambda k: F.col(f"factors.{k}").alias(k)
    return scored(spark, sf).select("id", f("authority"), f("timeliness"), f("entity"), f("event_type"), f("quantitative"), "total_score")


def _any(terms):
    return " OR ".join(f"contains(low, '{t.lower()}')" for t in terms)


@query("q_academic", f"WITH {ASSETS}, t AS (SELECT id, lower(title || ' ' || summary) AS low FROM assets) SELECT id, least(CASE WHEN {_any(scoring.HOT_TOPICS)} THEN 1 ELSE 0 END + CASE WHEN {_any(scoring.MODEL_NAMES)} THEN 2 ELSE 0 END + CASE WHEN {_any(scoring.SOTA_WORDS)} THEN 2 ELSE 0 END, 5) AS academic FROM t")
def academic(spark, sf):
    return assets(spark, sf).select("id", scoring.academic(F.concat_ws(" ", "title", "summary")).alias("academic"))


@query("q_tiering", f"WITH {SCORED} SELECT tier_label, age_filtered, count(*) AS n, sum(CAST(total_score AS BIGINT))::BIGINT AS total FROM labelled GROUP BY ALL")
def tiering(spark, sf):
    return scored(spark, sf).groupBy("tier_label", "age_filtered").agg(F.count("*").alias("n"), F.sum(F.col("total_score").cast("bigint")).alias("total"))


@query("q_source_cap", f"WITH {SCORED}, r AS (SELECT *, tier_label IN ('auto', 'review') AS counted, row_number() OVER (PARTITION BY source_id, tier_label IN ('auto', 'review') ORDER BY total_score DESC, ord) AS place FROM labelled) SELECT id, CASE WHEN counted AND place > 3 THEN 'skip' ELSE tier_label END AS tier_label FROM r")
def source_cap(spark, sf):
    return scoring.cap_sources(scored(spark, sf), CFG).select("id", "tier_label")


_TEXTS = "d AS (SELECT doc_id AS ord, CASE WHEN doc_id % 50 <> 7 THEN sha256(text) END AS content_hash FROM documents)"


def _hashed(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 50 != 7, F.sha2("text", 256)).alias("content_hash"))


@query("q_dedup_keep_first", f"WITH {_TEXTS} SELECT ord FROM d WHERE content_hash IS NULL UNION ALL SELECT min(ord) FROM d WHERE content_hash IS NOT NULL GROUP BY content_hash")
def dedup_keep_first(spark, sf):
    return dedup.keep_first(_hashed(spark, sf), "content_hash").select("ord")


@query("q_insert_if_absent", f"WITH {_TEXTS} SELECT 'doc_' || min(ord) AS id FROM d WHERE ord % 4 <> 0 AND content_hash NOT IN (SELECT content_hash FROM d WHERE ord % 4 = 0 AND content_hash IS NOT NULL) GROUP BY content_hash UNION ALL SELECT 'doc_' || ord FROM d WHERE ord % 4 <> 0 AND content_hash IS NULL")
def insert_if_absent(spark, sf):
    rows = _hashed(spark, sf).withColumn("id", F.concat(F.lit("doc_"), F.col("ord").cast("string")))
    return dedup.insert_if_absent(rows.where("ord % 4 = 0"), rows.where("ord % 4 <> 0")).select("id")


@query("q_cluster_upsert", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'new ' || n_name ELSE n_name END AS title FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def cluster_upsert(spark, sf):
    old = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    new = old.where("id % 3 = 0").select("id", F.concat(F.lit("new "), "title").alias("title")).unionByName(table(spark, sf, "region").select((F.lit(100) + F.col("r_regionkey")).alias("id"), F.col("r_name").alias("title")))
    return dedup.upsert(old, new)


@query("q_url_status", "WITH s AS (SELECT DISTINCT url, length(url) % 3 <> 0 AS ok FROM pages WHERE page_id % 4 <> 1) SELECT page_id, CASE WHEN ok THEN 'valid' WHEN ok IS NULL THEN 'not probed' ELSE 'dead' END AS state FROM pages LEFT JOIN s USING (url)")
def url_status(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    status = p.where("page_id % 4 <> 1").select("url", (F.length("url") % 3 != 0).alias("ok")).distinct().withColumn("reason", F.when(~F.col("ok"), "dead"))
    good, gone = filters.by_url_status(p, status)
    return good.select("page_id", F.lit("valid").alias("state")).unionByName(gone.select("page_id", F.col("reason").alias("state")))


@query("q_page_dates", "SELECT page_id, page_id % 4 <> 3 AND CAST(d AS DATE) <> DATE '2024-01-20' AS date_corrected, page_id % 4 <> 3 AND CAST(d AS DATE) <> DATE '2024-01-20' AND abs(epoch(TIMESTAMP '2024-01-20 12:00:00' - d)) / 3600.0 > 36 AS date_rejected FROM (SELECT page_id, TIMESTAMP '2024-01-18' + to_hours(CAST(page_id * 7 % 120 AS INTEGER)) AS d FROM pages)")
def page_dates(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), F.lit("2024-01-20 09:00:00").cast("timestamp").alias("published_at"))
    known = p.where("page_id % 4 <> 3").select("url", (F.lit("2024-01-18 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("page_id") * 7 % 120).cast("int"))).alias("page_date"))
    return filters.correct_dates(p, known, F.lit("2024-01-20").cast("date")).select("page_id", "date_corrected", "date_rejected")


@query(
    "q_feed_items",
    r"""WITH f AS (SELECT n_nationkey, '<rss><item><title><![CDATA[' || n_name || ' & co]]></title><link>http://x/' || n_nationkey || '</link><pubDate>Mon, 0' || (n_nationkey % 9 + 1) || ' Jan 2024 10:00:00 GMT</pubDate></item></rss>' AS xml FROM nation)
    SELECT n_nationkey, regexp_extract(xml, 'CDATA\[(.*?)\]\]', 1) AS title, regexp_extract(xml, '<link>(.*?)</link>', 1) AS link, '2024-01-0' || (n_nationkey % 9 + 1) || ' 10:00:00' AS published FROM f""",
)
def feed_items(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("string")
    xml = F.concat(F.lit("<rss><item><title><![CDATA["), "n_name", F.lit(" & co]]></title><link>http://x/"), k, F.lit("</link><pubDate>Mon, 0"), (F.col("n_nationkey") % 9 + 1).cast("string"), F.lit(" Jan 2024 10:00:00 GMT</pubDate></item></rss>"))
    rows = feeds.parse_items(feeds.split_items(n.select("n_nationkey", xml.alias("xml"))))
    return rows.select("n_nationkey", "title", "link", F.date_format(time.parse_date(F.col("raw_date")), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("q_fail_streak", """WITH r AS (SELECT user_id % 50 AS source_id, ts, event_id AS ord, event_type <> 'error' AND value > 20 AS ok FROM events), l AS (SELECT source_id, max(CASE WHEN ok THEN (ts, ord) END) AS last FROM r GROUP BY source_id)
    SELECT source_id, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok AND (last IS NULL OR (ts, ord) > last)) AS streak FROM r JOIN l USING (source_id) GROUP BY source_id""")
def fail_streak(spark, sf):
    e = table(spark, sf, "events")
    runs = e.select((F.col("user_id") % 50).alias("source_id"), "ts", F.col("event_id").alias("ord"), ((F.col("event_type") != "error") & (F.col("value") > 20)).alias("ok"))
    return health.streaks(runs).select("source_id", "ok", "failed", "streak")


@query("q_longest_streak", """WITH r AS (SELECT user_id % 50 AS source_id, ts, event_id AS ord, value > 20 AS ok FROM events), i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY source_id ORDER BY ts, ord) AS island FROM r), n AS (SELECT source_id, count(*) AS n FROM i WHERE NOT ok GROUP BY source_id, island) SELECT source_id, max(n) AS longest FROM n GROUP BY source_id""")
def longest_streak(spark, sf):
    e = table(spark, sf, "events")
    return health.longest_streaks(e.select((F.col("user_id") % 50).alias("source_id"), "ts", F.col("event_id").alias("ord"), (F.col("value") > 20).alias("ok")))


@query("q_recent_signal_entities", f"WITH {SCORED} SELECT id FROM labelled WHERE len(entities) > 0 AND published_at >= TIMESTAMP '2024-01-29'")
def recent_signal_entities(spark, sf):
    return scored(spark, sf).where((F.size("entities") > 0) & (F.col("published_at") >= F.date_sub(day(), 1).cast("timestamp"))).select("id")


