"""Queries of stores, logs, indexes, sessions, renderers and the smaller projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import cluster, dedup, filters, health, lineage, memory, normalize, reports, scoring, weekly
from ..sources import files, grams, keys, landed, logs
from ..staging import shared_root
from ..streaming import stories
from .tables import ASSETS, CFG, EVENTS, SCORED, SNAPSHOTS, as_of, assets, events_of, query, scored, snapshots, table


def _path(spark, name):
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("q_required", f"WITH {ASSETS} SELECT id FROM assets WHERE title <> '' AND summary <> ''")
def required(spark, sf):
    return filters.required(assets(spark, sf), "title", "summary").select("id")


@query("q_staged_json", "SELECT event_id, user_id, event_type, value FROM events")
def staged_json(spark, sf):
    """Items written as JSON and read again by their schema."""
    path = _path(spark, "items")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.mode("overwrite").json(path)
    return files.read_json(spark, path, "event_id long, user_id long, event_type string, value double", multi_line=False)


@query("q_key_documents", "SELECT DISTINCT event_type AS key, 'known' AS found FROM events UNION ALL SELECT 'absent', NULL")
def key_documents(spark, sf):
    """A document of values by key, and one that isn't there."""
    path, kind = _path(spark, "kv"), "key string, found string"
    files.replace(table(spark, sf, "events").select(F.col("event_type").alias("key"), F.lit("known").alias("found")).distinct(), path)
    there, absent = files.read_table(spark, path, kind), files.read_table(spark, f"{path}-absent", kind)
    wanted = spark.createDataFrame([("absent",)], "key string").join(absent, "key", "left")
    return there.unionByName(wanted)


@query("q_health_overwrite", "SELECT user_id AS source_id, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def health_overwrite(spark, sf):
    """Source health written, then written over by that of all events."""
    runs = table(spark, sf, "events").select(F.col("user_id").alias("source_id"), "ts", F.col("event_id").alias("ord"), (F.col("event_type") != "error").alias("ok"))
    path = _path(spark, "health")
    for part in (runs.where("ok"), runs):
        files.replace(health.streaks(part).select("source_id", "ok", "failed"), path)
    return files.read_table(spark, path, "source_id long, ok long, failed long")


@query("q_log_objects", "SELECT CAST(user_id AS VARCHAR) AS log, event_id, props AS object FROM events WHERE props IS NOT NULL")
def log_objects(spark, sf):
    """Each user's log holds its events' objects between noise, each cut in two chunks in the middle of the object."""
    e = table(spark, sf, "events").where("props is not null")
    line, half = F.concat(F.lit('} "at" '), "event_id", F.lit(": "), "props", F.lit(" done")), F.floor(F.char_length("props") / 2).cast("int") + 12
    both = F.explode(F.array(F.struct((F.col("event_id") * 2).alias("chunk"), F.substring(line, F.lit(1), half).alias("text")), F.struct((F.col("event_id") * 2 + 1).alias("chunk"), F.substring(line, half + 1, F.char_length(line)).alias("text")))).alias("c")
    found = logs.objects_in_chunks(e.select(F.col("user_id").cast("string").alias("log"), both).select("log", "c.*"))
    return found.select("log", F.floor(F.col("chunk") / 2).alias("event_id"), "object")


@query("q_latest_day", "SELECT max(CAST(ts AS DATE)) AS date FROM events")
def latest_day(spark, sf):
    path = _path(spark, "days")
    files.append(table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("date")).repartition("date"), path, "date")
    return files.latest_partition(spark, path)


@query(
    "q_feedback_append",
    "SELECT 'fb_' || left(sha256(concat_ws(chr(31), CAST(event_id AS VARCHAR), '', event_type, CAST(user_id AS VARCHAR), 'reader', '2024-01-31 00:00:00')), 16) AS id, event_id, event_type AS type, CAST(user_id AS DOUBLE) AS value FROM events",
)
def feedback_append(spark, sf):
    """Two appends of feedback, read back."""
    e = table(spark, sf, "events").select("event_id", F.lit(None).cast("string").alias("cluster_id"), F.col("event_type").alias("type"), F.col("user_id").alias("value"), F.lit("reader").alias("source"))
    path = _path(spark, "feedback")
    for part in (e.where("type = 'error'"), e.where("type <> 'error' or type is null")):
        files.append_feedback(part, path, as_of())
    return spark.read.parquet(path).select("id", "event_id", "type", F.col("value").cast("double").alias("value"))


_WEEK = f"{EVENTS}, wk AS (SELECT *, coalesce(cluster_id, 'unclustered-' || strftime(effective_at, '%Y-%m-%d')) AS cid FROM events_v WHERE effective_at >= TIMESTAMP '2024-01-24' AND effective_at < TIMESTAMP '2024-02-01')"


def _week(spark, sf):
    rows = weekly.in_week(events_of(spark, sf), as_of())
    return rows, weekly.by_cluster(rows)


@query("q_weekly_report_row", f"WITH {_WEEK} SELECT 'week_' || left(sha256('2024-01-24 00:00:00'), 16) AS id, DATE '2024-01-24' AS week_start, DATE '2024-02-01' AS week_end, count(DISTINCT cid) AS cluster_count, count(*) AS event_count, 100 AS article_chars, 50 AS script_chars FROM wk")
def weekly_report_row(spark, sf):
    path = _path(spark, "reports")
    files.append(weekly.report_row(_week(spark, sf)[1], as_of(), F.lit(100), F.lit(50)), path)
    return spark.read.parquet(path).drop("created_at")


@query(
    "q_weekly_article",
    f"""WITH {_WEEK}, best AS (SELECT cid, max(rank_total) AS top, CASE WHEN cid LIKE 'unclustered-%' THEN 'Unclustered' ELSE arg_max(title, (rank_total, -ord)) END AS name FROM wk GROUP BY cid ORDER BY top DESC, cid LIMIT 10),
    placed AS (SELECT *, row_number() OVER (ORDER BY top DESC, cid) AS place FROM best), lines AS (SELECT p.place, CASE WHEN name = '' THEN 'Untitled' ELSE name END AS name, row_number() OVER (PARTITION BY cid ORDER BY rank_total DESC, ord) AS k, '- [' || title || '](' || coalesce(url, '') || ')' AS line FROM wk JOIN placed p USING (cid)),
    parts AS (SELECT place, '## ' || any_value(name) || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY k) AS part FROM lines WHERE k <= 3 GROUP BY place)
    SELECT '# Weekly report' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY place) AS markdown FROM parts""",
)
def weekly_article(spark, sf):
    rows, rollup = _week(spark, sf)
    return weekly.article_skeleton(weekly.top_events(rows, rollup))


@query("q_report_archive", "WITH w AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS week FROM events) SELECT week, name, name || ' of ' || week AS content FROM w, (VALUES ('article.md'), ('script.md'), ('manifest.json')) n(name)")
def report_archive(spark, sf):
    """A report for each day, archived and read back."""
    weeks = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("week")).distinct()
    rows = weeks.select("week", F.explode(F.array(*[F.lit(n) for n in landed.WEEK_FILES])).alias("name")).withColumn("content", F.concat("name", F.lit(" of "), "week"))
    path = _path(spark, "archive")
    landed.write_archive(rows, path)
    read = spark.read.text(f"{path}/*/*", wholetext=True).select(F.split(F.col("_metadata.file_path"), "/").alias("p"), F.col("value").alias("content"))
    return read.select(F.element_at("p", -2).alias("week"), F.element_at("p", -1).alias("name"), "content")


_TEXTS = "d AS (SELECT doc_id AS id, sha256(text) AS content_hash, CAST(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 7919 % 43200 AS INTEGER)) AS DATE) AS day FROM documents)"


def _texts(spark, sf):
    a = table(spark, sf, "documents")
    minutes = F.make_dt_interval(mins=(F.col("doc_id") * 7919 % 43200).cast("int"))
    return a.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("content_hash"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + minutes).cast("date").alias("day"))


@query("q_lineage_assets", f"WITH {_TEXTS} SELECT min(id) AS id FROM d WHERE day >= DATE '2024-01-16' AND content_hash NOT IN (SELECT content_hash FROM d WHERE day < DATE '2024-01-16') GROUP BY content_hash")
def lineage_assets(spark, sf):
    """Assets of the second half month that the first half doesn't hold."""
    d = _texts(spark, sf)
    return dedup.insert_if_absent(d.where("day < '2024-01-16'"), d.where("day >= '2024-01-16'")).select("id")


@query("q_lineage_edges", f"WITH {_TEXTS}, e AS (SELECT id AS from_id, min(id) OVER (PARTITION BY content_hash) AS to_id, 'duplicate_of' AS relation FROM d), s AS (SELECT id AS from_id, min(id) OVER (PARTITION BY content_hash) AS to_id FROM d WHERE day < DATE '2024-01-16') SELECT * FROM e WHERE from_id <> to_id AND (from_id, to_id) NOT IN (SELECT (from_id, to_id) FROM s WHERE from_id <> to_id)")
def lineage_edges(spark, sf):
    d = _texts(spark, sf)
    return lineage.new_edges(lineage.duplicate_edges(d.where("day < '2024-01-16'")), lineage.duplicate_edges(d))


@query("q_key_lookup", f"WITH {_TEXTS} SELECT id FROM d WHERE day >= DATE '2024-01-16' AND content_hash IN (SELECT content_hash FROM d WHERE day < DATE '2024-01-16')")
def key_lookup(spark, sf):
    """Rows of the second half month whose hash a key table of the first half holds."""
    d = _texts(spark, sf).where("content_hash is not null").withColumns({"kind": F.lit("hash"), "key": F.col("content_hash")})
    store = keys.KeyTable(spark, _path(spark, "keys"), buckets=16, pages=1)
    store.add(d.where("day < '2024-01-16'"), "first")
    new = d.where("day >= '2024-01-16'")
    return new.join(store.lookup(new).select("key").distinct(), "key", "left_semi").select("id")


@query("q_key_search", "WITH k AS (SELECT DISTINCT unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS key FROM part), n(needle) AS (VALUES ('ST'), ('ran'), ('d#1'), ('e'), ('zzz'), ('ee')) SELECT needle, key FROM n JOIN k ON key ILIKE '%' || needle || '%'")
def key_search(spark, sf):
    index = grams.GramIndex(spark, _path(spark, "grams"))
    index.add(table(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")).alias("key")))
    found = [index.find(n).select(F.lit(n).alias("needle"), "key") for n in ("ST", "ran", "d#1", "e", "zzz", "ee")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_GAP = "CASE event_type WHEN 'error' THEN 6 WHEN 'purchase' THEN 12 ELSE 24 END"


@query(
    "q_mention_sessions",
    f"""WITH m AS (SELECT user_id, ts, ts + to_hours({_GAP}) AS until FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), s AS (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY ts, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, until ROWS UNBOUNDED PRECEDING) AS island FROM s)
    SELECT CAST(user_id AS VARCHAR) AS story_key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(until), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS mentions FROM i GROUP BY user_id, island""",
)
def mention_sessions(spark, sf):
    """Bursts of a user's events; errors hold a session open for 6 hours, purchases for 12, others for 24."""
    e = table(spark, sf, "events")
    rows = stories.sessions(e.select(F.col("user_id").cast("string").alias("story_key"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(3).alias("tier")))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("story_key", show("started"), show("ended"), "mentions")


_MENTIONS = "m AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id, ts FROM events WHERE event_type = 'error'), g AS (SELECT k, count(DISTINCT event_id) AS n, max(ts) AS last FROM m GROUP BY k)"


@query("q_story_clock", f"WITH {_MENTIONS} SELECT k AS story_key, CAST(n AS INTEGER) AS events, CASE WHEN date_diff('day', CAST(last AS DATE), DATE '2024-02-02') > 7 THEN 'stale' WHEN date_diff('day', CAST(last AS DATE), DATE '2024-02-02') > 3 THEN 'follow-up' WHEN n >= 5 THEN 'peak' WHEN n >= 2 THEN 'developing' ELSE 'emerging' END AS state FROM g")
def story_clock(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    rows = e.select(F.col("user_id").cast("string").alias("story_key"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("at"))
    return stories.batch_stories(rows, F.lit("2024-02-02 12:00:00").cast("timestamp")).select("story_key", "events", "state")


@query("q_since", f"WITH {SNAPSHOTS} SELECT date, list_sort(list(id)) AS ids FROM snaps WHERE date >= DATE '2024-01-20' GROUP BY date".replace("list_sort(list(id))", "array_to_string(list_sort(list(id)), ',')"))
def since(spark, sf):
    return memory.since(snapshots(spark, sf), F.lit("2024-01-20").cast("date")).select("date", F.array_join("top_event_ids", ",").alias("ids"))


@query("q_generic_hash", "SELECT event_id, 'k_' || left(sha256(concat_ws(chr(31), event_type, coalesce(props, ''))), 16) AS key, 'sha256:' || left(sha256(concat_ws('|', event_type, coalesce(props, ''))), 16) AS hash FROM events")
def generic_hash(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", hashing.stable_id("k_", "event_type", "props").alias("key"), hashing.content_hash("event_type", "props").alias("hash"))


_FLAT = "id, title, url, CAST(total_score AS DOUBLE) AS rank_total, tier_label AS rank_tier, source_id AS source_name, tier AS source_tier, category, event_type, len(entities) AS n_entities"


@query("q_event_rows", f"WITH {SCORED} SELECT {_FLAT} FROM labelled")
def event_rows(spark, sf):
    """Scored assets as flat stored events."""
    return _flat(spark, sf).select("id", "title", "url", "rank_total", "rank_tier", "source_name", "source_tier", "category", "event_type", F.size("entities").cast("long").alias("n_entities"))


def _flat(spark, sf):
    rows = scored(spark, sf).withColumns({"type": F.lit("news"), "content_hash": hashing.content_hash("title", "url", "summary"), "collected_at": as_of(), "effective_at": F.col("published_at"), "time_precision": F.lit("minute")})
    return normalize.to_events(rows)


@query("q_event_documents", f"WITH {SCORED} SELECT id, CAST(total_score AS DOUBLE) AS total_score, tier_label, source_id AS source_name, tier AS source_tier, 1 AS n_sources, strftime(published_at, '%Y-%m-%d %H:%M') AS published FROM labelled")
def event_documents(spark, sf):
    """Flat events as nested documents."""
    n = normalize.nest_event(_flat(spark, sf))
    return n.select("id", "rank.total_score", "rank.tier_label", F.col("source.name").alias("source_name"), F.col("source.tier").alias("source_tier"), F.size("sources").alias("n_sources"), F.date_format("timeline.published", "yyyy-MM-dd HH:mm").alias("published"))


@query("q_template", "SELECT c_custkey AS id, 'Dear ' || c_name || ' of ' || c_mktsegment || ', {{none}}' AS text FROM customer")
def template(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), reports.substitute(F.lit("Dear {{name}} of {{segment}}, {{none}}"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("text"))


@query("q_domain_paths", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'out/test/' ELSE 'out/production/' END || CASE WHEN user_id < 50 THEN 'ai' ELSE 'robotics' END AS base, 'out/baseline/' || CASE WHEN user_id < 50 THEN 'ai' ELSE 'robotics' END || '.json' AS baseline FROM events")
def domain_paths(spark, sf):
    domains = {d: {"production": f"out/production/{d}", "test": f"out/test/{d}", "baseline": f"out/baseline/{d}.json"} for d in ("ai", "robotics")}
    e = table(spark, sf, "events")
    paths = normalize.domain_paths(F.when(F.col("user_id") >= 50, "robotics"), F.when(F.col("event_type") == "error", "test"), domains, "ai")
    return e.select("event_id", paths.alias("p")).select("event_id", "p.*")


@query("q_prescore", f"""WITH {SCORED} SELECT id, CAST(least(entity + type_score + quant, 35) AS INTEGER) AS score FROM (SELECT *, least((CASE WHEN regexp_matches(raw, '\\$[\\d.]+\\s*[bBmM]') OR regexp_matches(raw, '[\\d.]+\\s*亿') THEN 2 ELSE 0 END)
    + (CASE WHEN regexp_matches(raw, '[\\d.]+\\s*%') OR regexp_matches(raw, '(?i)\\d+x\\s*faster') OR regexp_matches(raw, '(?i)accuracy|准确率') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(raw, '(?i)\\d+\\s*(billion|million|百万|千万|亿)') THEN 1 ELSE 0 END), 6) AS quant FROM scored)""")
def prescore(spark, sf):
    a = assets(spark, sf)
    # the academic factor has its own query; a title without words has none
    score = scoring.collection_score(F.lit(""), F.concat_ws(" ", "title", "summary"), F.col("tier"), CFG)
    return a.select("id", score.cast("int").alias("score"))


@query("q_source_union", "SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name AS title FROM customer UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part")
def source_union(spark, sf):
    """Items of three sources in one table, by name."""
    of = lambda t, i, n: table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(i).cast("string").alias("id"), F.col(n).alias("title"))
    return of("customer", "c_custkey", "c_name").unionByName(of("supplier", "s_suppkey", "s_name")).unionByName(of("part", "p_partkey", "p_name"))


@query("q_cluster_fingerprint", f"WITH {SCORED} SELECT id, array_to_string(list_sort(entities), ',') || chr(0) || event_type || chr(0) || '' || chr(0) || language AS fingerprint FROM labelled WHERE len(entities) > 0")
def cluster_fingerprint(spark, sf):
    rows = scored(spark, sf)
    none = F.array().cast("array<string>")
    return rows.select("id", cluster.cluster_fingerprint(F.col("entities"), F.col("event_type"), none, F.col("language")).alias("fingerprint")).where("fingerprint is not null")


#: printf rounds by the exact value; a tie, whose eighths are odd, is pushed up.
_FIXED = "printf('%.2f', CASE WHEN abs({0}) * 8 = floor(abs({0}) * 8) AND CAST(floor(abs({0}) * 8) AS BIGINT) % 2 = 1 THEN {0} + sign({0}) * 0.001 ELSE {0} END)"


@query("q_to_fixed", "SELECT event_id, {} AS third, {} AS eighth, {} AS below FROM events".format(*[_FIXED.format(x) for x in ("(value / 3)", "(floor(value) / 8)", "(-value / 1000)")]))
def to_fixed(spark, sf):
    e = table(spark, sf, "events")
    fixed = lambda x: text.to_fixed(x, signed_zero=True)
    return e.select("event_id", fixed(F.col("value") / 3).alias("third"), fixed(F.floor("value").cast("double") / 8).alias("eighth"), fixed(-F.col("value") / 1000).alias("below"))


#: Below U+E000 a text's code points and code units agree in order; the test texts stay below, and two marks beyond are put to each word.
@query("q_utf16_order", "WITH w AS (SELECT doc_id, list_sort(list_distinct(string_split(coalesce(text, ''), ' '))) AS words FROM documents) SELECT doc_id, array_to_string(list_transform(words, lambda x: chr(128512) || x) || list_transform(words, lambda x: chr(57344) || x), ' ') AS words FROM w")
def utf16_order(spark, sf):
    d = table(spark, sf, "documents")
    words = F.array_distinct(F.split(F.coalesce("text", F.lit("")), " "))
    marked = F.concat(F.transform(words, lambda w: F.concat(F.lit("\ue000"), w)), F.transform(words, lambda w: F.concat(F.lit("\U0001f600"), w)))
    return d.select("doc_id", F.array_join(text.utf16_sorted(marked), " ").alias("words"))


@query("q_has_cjk", "SELECT doc_id, regexp_matches(coalesce(text, ''), '[\\x{4e00}-\\x{9fff}]') AS cjk FROM documents")
def has_cjk(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.has_cjk(F.col("text")).alias("cjk"))


@query("q_source_chain", "WITH d AS (SELECT doc_id AS id, doc_id AS ord, sha256(text) AS h, source FROM documents), f AS (SELECT h, min(id) AS first FROM d WHERE h IS NOT NULL GROUP BY h) SELECT d.id, coalesce(d.source, '') || CASE WHEN d.id <> f.first THEN ' → ' || o.source ELSE '' END AS chain FROM d LEFT JOIN f USING (h) LEFT JOIN d o ON o.id = f.first")
def source_chain(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("content_hash"), F.col("source").alias("source_id"), F.lit(None).cast("string").alias("canonical"))
    return lineage.source_chain(d, lineage.duplicate_edges(d))


def _articles(spark, sf):
    """An article for each customer, its orders by size in three sections."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    item = F.struct(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("summary"), F.concat(F.lit("https://a.b/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("source"), F.array().cast("array<string>").alias("entities"))
    section = F.when(F.col("o_totalprice") > 300000, "deep").when(F.col("o_totalprice") > 150000, "important").otherwise("brief")
    rows = o.groupBy("o_custkey").agg(*[F.transform(F.array_sort(F.collect_list(F.when(section == s, F.struct("o_orderkey", item.alias("i"))))), lambda x: x["i"]).alias(f"{s}_items") for s in ("deep", "important", "brief")])
    said = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("balance of customer "), F.col("c_custkey").cast("string")))
    return c.join(rows, c["c_custkey"] == rows["o_custkey"]).select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("hook"), F.array("c_name").alias("summary_items"), "deep_items", "important_items", "brief_items", F.struct(said.alias("observation"), said.alias("evidence"), said.alias("judgment")).alias("editorial"))


_ITEMS = """i AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderpriority AS src, CASE WHEN o_totalprice > 300000 THEN 'deep' WHEN o_totalprice > 150000 THEN 'important' ELSE 'brief' END AS section FROM orders),
    a AS (SELECT c_custkey AS k, c_name AS hook, CASE WHEN c_acctbal > 0 THEN 'balance of customer ' || c_custkey END AS said FROM customer WHERE c_custkey IN (SELECT k FROM i))"""
_BLOCK = "'### Order ' || o || chr(10) || chr(10) || src || chr(10) || chr(10) || src || ' https://a.b/' || o"


@query(
    "q_render_article",
    f"""WITH {_ITEMS}, p AS (SELECT k, '## In depth' || chr(10) || chr(10) || string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY o) FILTER (section = 'deep') AS d, '## Important' || chr(10) || chr(10) || string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY o) FILTER (section = 'important') AS m,
        '## In brief' || chr(10) || chr(10) || string_agg('- Order ' || o || ' https://a.b/' || o, chr(10) ORDER BY o) FILTER (section = 'brief') AS b, 'Sources: ' || string_agg(DISTINCT src, ', ' ORDER BY src) AS s FROM i GROUP BY k)
    SELECT CAST(k AS VARCHAR) AS id, concat_ws(chr(10) || chr(10), hook, d, m, b, concat_ws(chr(10) || chr(10), '## Editorial', said, said, said), s) AS markdown FROM a JOIN p USING (k)""",
)
def render_article(spark, sf):
    return reports.render_article(_articles(spark, sf))


@query(
    "q_accepted",
    f"""WITH {_ITEMS}, n AS (SELECT k, count(DISTINCT src) AS sources, count(*) FILTER (section = 'deep') AS deep FROM i GROUP BY k) SELECT CAST(k AS VARCHAR) AS id, deep > 0 AND said IS NOT NULL AND sources >= 3 AS accepted FROM a JOIN n USING (k)""",
)
def accepted(spark, sf):
    return reports.accepted(reports.checks(_articles(spark, sf))).select("id", "accepted")


@query("q_run_table", "SELECT event_id AS run_id, ts AS started_at, event_type AS status FROM events ORDER BY ts DESC, event_id LIMIT 30")
def run_table(spark, sf):
    return health.run_table(table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.col("event_type").alias("status")))


@query("q_run_metrics", "SELECT 'events' AS step, 'ok' AS status, count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors FROM events")
def run_metrics(spark, sf):
    """Counts gathered while a step's rows are written."""
    df, seen = health.observed(table(spark, sf, "events"), "events", errors=F.count_if(F.col("event_type") == "error"))
    df.write.parquet(_path(spark, "step"))
    return spark.createDataFrame([("events", "ok", seen.get["rows"], seen.get["errors"])], "step string, status string, rows long, errors long")
