"""Queries of signals, candidates, lanes, judgment, memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Editorial
from ..operators import candidates, filters, judgment, memory, signals
from ..staging import staged
from ..streaming import breaker
from .tables import CFG, DAY, EVENTS, NEWS, NOTED, SNAPSHOTS, STORIES, TIERS, as_of, day, events_of, query, snapshots, sql_list, stories, table

_TOP = sql_list(TIERS[0].entities)

def _brk(*scope: str) -> str:
    cols = "".join(f"{s}, " for s in scope)
    counts = f"(SELECT {cols}top, count(*) AS n FROM (SELECT {cols}unnest(entities) AS top FROM events_v) GROUP BY ALL)"
    return f"""brk AS (
    SELECT * FROM (SELECT e.*, CASE WHEN top IS NOT NULL AND n <= 2 THEN 'entity' WHEN contains(split_part(replace(url, 'https://', ''), '/', 1), 'src7.example.com') OR contains(lower(source_name), 'src7') THEN 'official' WHEN event_type = 'acquisition' THEN 'type' END AS why
        FROM (SELECT *, list_filter(entities, lambda x: list_contains({_TOP}, x))[1] AS top FROM events_v) e LEFT JOIN {counts} c USING ({cols}top)) WHERE why IS NOT NULL)"""


@query("q_breaking_signals", f"WITH {EVENTS}, {_brk('category')} SELECT id AS event_id, why AS reason, CASE WHEN why = 'entity' THEN top END AS entity FROM brk")
def breaking_signals(spark, sf):
    return signals.breaking(events_of(spark, sf), NEWS, ["category"]).select("event_id", "reason", "entity")


_RECENT = f"days AS (SELECT entity, count(DISTINCT date) AS days FROM (SELECT date, unnest(entities) AS entity FROM snaps) WHERE date BETWEEN DATE '{DAY}' - 7 AND DATE '{DAY}' GROUP BY entity)"


@query("q_memory_recency", f"WITH {SNAPSHOTS}, {_RECENT} SELECT entity, days FROM days")
def memory_recency(spark, sf):
    return signals.recent_entities(snapshots(spark, sf), day(), NEWS)


_MEMORY = f"""{_RECENT}, x AS (SELECT id, e AS entity, pos, days FROM (SELECT id, unnest(entities) AS e, generate_subscripts(entities, 1) AS pos FROM events_v) JOIN days ON e = entity),
    best AS (SELECT id, arg_max(entity, (days, -pos)) AS entity, max(days) AS days FROM x GROUP BY id), held AS (SELECT DISTINCT id FROM snaps WHERE date BETWEEN DATE '{DAY}' - 7 AND DATE '{DAY}'),
    mem AS (SELECT e.id, best.entity, CAST(coalesce(best.days, 1) AS INTEGER) AS recent_days FROM events_v e LEFT JOIN best USING (id) LEFT JOIN held ON e.id = held.id WHERE best.id IS NOT NULL OR held.id IS NOT NULL AND cluster_id IS NOT NULL)"""


@query("q_memory_notes", f"WITH {SNAPSHOTS}, {_MEMORY} SELECT id AS event_id, entity, recent_days FROM mem")
def memory_notes(spark, sf):
    e = staged(events_of(spark, sf).select(*NOTED), "events")
    return signals.memory(e, snapshots(spark, sf, e), day(), NEWS).select("event_id", "entity", "recent_days")


@query("q_coverage_count", f"WITH {SNAPSHOTS} SELECT e.id, count(DISTINCT s.date) AS snapshots FROM events_v e LEFT JOIN snaps s USING (id) GROUP BY e.id")
def coverage_count(spark, sf):
    return signals.coverage(events_of(spark, sf), snapshots(spark, sf))


_FOLLOW = f"""fol AS (SELECT e.id, e.ord, story_key, CASE WHEN state = 'stale' THEN 'STALE' WHEN last_seen >= DATE '{DAY}' - 3 THEN 'FOLLOW_UP' END AS subtype FROM events_v e JOIN stories ON cluster_id = story_key)"""


@query("q_followup", f"WITH {STORIES}, {_FOLLOW} SELECT id AS event_id, subtype, CAST(CASE subtype WHEN 'FOLLOW_UP' THEN -10 ELSE 0 END AS INTEGER) AS weight, story_key AS reason FROM fol WHERE subtype IS NOT NULL")
def followup(spark, sf):
    s = stories(spark, sf).withColumn("entity", F.lit(None).cast("string"))
    return signals.story_dedup(events_of(spark, sf), s, day(), NEWS).select("event_id", "subtype", "weight", "reason")


_SOURCE_CAP = "div AS (SELECT id FROM events_v WHERE source_name IN (SELECT source_name FROM events_v GROUP BY 1 HAVING count(*) > 3))"
_HEAT = "greatest(" + ", ".join(f"CASE WHEN len(list_intersect(entities, {sql_list(t.entities)})) > 0 THEN {t.score} ELSE 0 END" for t in TIERS) + ")"


@query("q_signal_boost", f"WITH {STORIES}, {_FOLLOW}, {_SOURCE_CAP} SELECT e.id AS event_id, CAST(least(CASE source_tier WHEN 1 THEN 20 WHEN 2 THEN 15 ELSE 7 END + {_HEAT} + CASE WHEN div.id IS NOT NULL THEN -10 ELSE 0 END + CASE WHEN fol.subtype = 'FOLLOW_UP' THEN -10 ELSE 0 END, 30) AS BIGINT) AS boost FROM events_v e LEFT JOIN div USING (id) LEFT JOIN fol ON fol.id = e.id")
def signal_boost(spark, sf):
    e, s = staged(events_of(spark, sf), "events"), stories(spark, sf).withColumn("entity", F.lit(None).cast("string"))
    rules = [lambda d: signals.authority(d, CFG), lambda d: signals.entity_heat(d, CFG), lambda d: signals.source_diversity(d, CFG), lambda d: signals.story_dedup(d, s, day(), NEWS)]
    return signals.resolve(signals.collect(e, rules), NEWS).select("event_id", F.col("boost").cast("bigint").alias("boost"))


@query("q_freshness", f"WITH {EVENTS}, a AS (SELECT id, epoch(TIMESTAMP '2024-01-31' - effective_at) / 3600.0 AS age FROM events_v) SELECT id AS event_id, CAST(CASE WHEN age <= 1 THEN 15 WHEN age <= 3 THEN 13 WHEN age <= 6 THEN 11 WHEN age <= 12 THEN 8 WHEN age <= 24 THEN 5 ELSE 2 END AS INTEGER) AS weight FROM a")
def freshness(spark, sf):
    return signals.freshness(events_of(spark, sf), as_of(), CFG).select("event_id", "weight")


@query("q_relevance", f"""WITH {EVENTS}, t AS (SELECT id, lower(title || ' ' || summary || ' ' || event_type) AS low, lower(source_name) AS src FROM events_v)
    SELECT id, CASE WHEN contains(src, 'src12') OR regexp_matches(low, '(^|[^A-Za-z0-9_])th($|[^A-Za-z0-9_])') OR contains(low, 'eauou') OR contains(low, 'keitung') THEN NULL WHEN contains(low, 'ipo') OR contains(low, 'mentedo') THEN 'non_ai_keyword' WHEN contains(low, 'ción') THEN 'neutral_only' ELSE 'no_relevance' END AS reason FROM t""")
def relevance(spark, sf):
    e = events_of(spark, sf)
    why = filters.relevance_reason(F.col("title"), F.col("summary"), F.col("event_type"), F.col("source_name"), ["th", "eauou", "keitung"], ["ipo", "mentedo"], ["ción"], ["src12"])
    return e.select("id", why.alias("reason"))


_RANKED = _brk("category") + """, rk AS (SELECT e.*, brk.id IS NOT NULL AS breaking, rank_total AS final_rank FROM events_v e LEFT JOIN (SELECT id FROM brk) brk USING (id)),
    cp AS (SELECT *, NOT breaking AND row_number() OVER (PARTITION BY category, breaking ORDER BY final_rank DESC, ord) > 8 AS capped FROM rk)"""


@query("q_category_cap", f"WITH {EVENTS}, {_RANKED} SELECT id, breaking, capped FROM cp")
def category_cap(spark, sf):
    e = staged(events_of(spark, sf), "events")
    return candidates.rank(e, signals.collect(e, [lambda d: signals.breaking(d, NEWS, ["category"])]), NEWS).select("id", "breaking", "capped")


@query("q_candidate_pool", f"WITH {EVENTS}, {_RANKED} SELECT id, final_rank FROM cp WHERE NOT capped ORDER BY final_rank DESC, ord LIMIT 40")
def candidate_pool(spark, sf):
    e = staged(events_of(spark, sf), "events")
    return candidates.build(e, signals.collect(e, [lambda d: signals.breaking(d, NEWS, ["category"])]), NEWS).select("id", "final_rank")


_LANES = "l(lane, dom, lane_most, lane_no) AS (VALUES ('research', 'research', 20, 0), ('industry', 'industry', 20, 1), ('policy', 'policy', 10, 2), ('opensource', 'opensource', 10, 3)), disp AS (SELECT e.*, coalesce(lane, 'fallback') AS lane, coalesce(lane_most, 5) AS lane_most, coalesce(lane_no, 4) AS lane_no FROM events_v e LEFT JOIN l ON domain = dom)"


@query("q_lane_dispatch", f"WITH {EVENTS}, {_LANES} SELECT lane, count(*) AS candidates FROM disp GROUP BY lane")
def lane_dispatch(spark, sf):
    return candidates.lane_counts(candidates.dispatch(events_of(spark, sf)))


# the lane follows from the category here, so BREAKING inside categories is BREAKING inside lanes
_POOLS = f"""{_LANES}, {_brk('category')}, rk AS (SELECT d.*, b.id IS NOT NULL AS breaking FROM disp d LEFT JOIN (SELECT id FROM brk) b USING (id)),
    cp AS (SELECT *, NOT breaking AND row_number() OVER (PARTITION BY lane, category, breaking ORDER BY rank_total DESC, ord) > 8 AS capped FROM rk),
    pool AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY rank_total DESC, ord) AS place FROM cp WHERE NOT capped QUALIFY place <= lane_most)"""


def _pool(spark, sf):
    e = staged(candidates.dispatch(events_of(spark, sf)), "events")
    return candidates.run_lanes(e, signals.collect(e, [lambda d: signals.breaking(d, NEWS, ["lane"])]), NEWS)


@query("q_lane_candidates", f"WITH {EVENTS}, {_POOLS} SELECT id, lane, CAST(place AS BIGINT) AS place FROM pool")
def lane_candidates(spark, sf):
    return _pool(spark, sf).select("id", "lane", F.col("place").cast("bigint").alias("place"))


@query("q_lane_merge", f"WITH {EVENTS}, {_POOLS}, p AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY rank_total DESC, ord) = 1 AS protected FROM pool), o AS (SELECT *, row_number() OVER (ORDER BY protected DESC, breaking DESC, rank_total DESC, lane_no, ord) AS position, sum(CAST(protected AS INTEGER)) OVER () AS np FROM p) SELECT id, lane, breaking, protected, rank_total AS final_rank, CAST(position AS BIGINT) AS position FROM o WHERE position <= greatest(25, np)")
def lane_merge(spark, sf):
    return candidates.merge(_pool(spark, sf), 25).select("id", "lane", "breaking", "protected", "final_rank", F.col("position").cast("bigint").alias("position"))


@query("q_lane_share", f"WITH {EVENTS}, {_POOLS} SELECT lane, count(*) AS n, round(count(*) / (SELECT count(*) FROM pool), 6) AS share FROM pool GROUP BY lane")
def lane_share(spark, sf):
    return candidates.group_shares(_pool(spark, sf), "lane").withColumn("share", F.round("share", 6))


_JUDGED = f"""{_FOLLOW}, {_brk('category')}, jd AS (SELECT e.*, CASE WHEN e.ord % 11 = 0 THEN 'hard' WHEN b.id IS NOT NULL THEN NULL WHEN fol.subtype = 'STALE' THEN 'contextual' END AS reject_type, b.id IS NOT NULL AS is_breaking, CASE WHEN fol.subtype = 'FOLLOW_UP' THEN -10 ELSE 0 END AS pw
    FROM events_v e LEFT JOIN (SELECT id FROM brk) b USING (id) LEFT JOIN fol ON fol.id = e.id)"""


def _judged(spark, sf):
    e = staged(events_of(spark, sf), "events")
    s = stories(spark, sf).withColumn("entity", F.lit(None).cast("string"))
    got = signals.collect(e, [lambda d: signals.breaking(d, NEWS, ["category"]), lambda d: signals.story_dedup(d, s, day(), NEWS)])
    earlier = e.where("ord % 11 = 0").select(F.col("id").alias("event_id"), F.lit("hard").alias("reject_type"), F.lit("off topic").alias("reason"), as_of().alias("rejected_at"))
    return judgment.qualify(e, got, earlier)


@query("q_qualify", f"WITH {STORIES}, {_JUDGED} SELECT id, reject_type, CAST(pw AS BIGINT) AS priority_weight FROM jd")
def qualify(spark, sf):
    return _judged(spark, sf).select("id", "reject_type", F.col("priority_weight").cast("bigint").alias("priority_weight"))


@query("q_prioritize", f"WITH {STORIES}, {_JUDGED} SELECT id, pw + rank_total + CASE WHEN is_breaking THEN 50 ELSE 0 END AS final_rank FROM jd WHERE reject_type IS NULL ORDER BY final_rank DESC, ord LIMIT 30")
def prioritize(spark, sf):
    return judgment.prioritize(_judged(spark, sf).where("reject_type is null"), 30).select("id", "final_rank")


@query("q_backfill", f"WITH {STORIES}, {_JUDGED}, q AS (SELECT id, pw, ord, rank_total FROM jd WHERE reject_type IS NULL AND ord % 100 = 3), f AS (SELECT id FROM jd WHERE rank_total >= 30 AND id NOT IN (SELECT id FROM q) ORDER BY rank_total DESC, ord LIMIT 10) SELECT id, CAST(pw AS BIGINT) AS priority_weight, false AS backfilled FROM q UNION ALL SELECT id, -999, true FROM f WHERE (SELECT count(*) FROM q) < 200")
def backfill(spark, sf):
    j = _judged(spark, sf)
    cfg = Editorial(backfill_score=30, backfill_below=200)
    return judgment.backfill(j.where("reject_type is null and ord % 100 = 3"), j, cfg).select("id", F.col("priority_weight").cast("bigint").alias("priority_weight"), "backfilled")


@query("q_judgment_metrics", f"WITH {STORIES}, {_JUDGED} SELECT count(*) AS total_input, count(*) FILTER (reject_type IS NULL) AS qualified, count(*) FILTER (reject_type = 'hard') AS hard_rejected, count(*) FILTER (reject_type = 'contextual') AS contextual_rejected FROM jd")
def judgment_metrics(spark, sf):
    return judgment.metrics(_judged(spark, sf))


@query("q_production_constraints", "WITH d AS (SELECT source, quality FROM documents JOIN labels USING (doc_id)), m AS (SELECT count(*) FILTER (quality = 0) / count(*) AS r FROM d) SELECT 'non_ai_ratio' AS violation, round(r, 6) AS ratio FROM m WHERE r > 0.05 UNION ALL SELECT 'single_source_' || source, round(count(*) / (SELECT count(*) FROM d), 6) FROM d GROUP BY source HAVING count(*) / (SELECT count(*) FROM d) > 0.06")
def production_constraints(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = d.select(F.col("source").alias("source_name"), F.when(F.col("quality") == 0, "hard").alias("reject_type"))
    return judgment.production_violations(rows, Editorial(single_source_ratio=0.06)).withColumn("ratio", F.round("ratio", 6))


@query("q_story_rollup", "SELECT 's' || user_id % 100 AS story_key, arg_max(event_type, (ts, event_id)) AS entity, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen, count(DISTINCT event_id) AS n_events FROM events GROUP BY 1")
def story_rollup(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.concat(F.lit("s"), (F.col("user_id") % 100).cast("string")).alias("story_key"), F.col("event_type").alias("entity"), F.col("event_id").cast("string").alias("event_id"), F.lit("t").alias("title"), F.col("ts").alias("date"), F.col("event_id").alias("ord"))
    s = memory.rollup_stories(rows)
    return s.select("story_key", "entity", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), F.size("event_ids").cast("bigint").alias("n_events"))


@query("q_snapshot_prune", f"WITH {SNAPSHOTS} SELECT strftime(date, '%Y-%m-%d') AS date, count(DISTINCT id) AS events FROM snaps WHERE date >= DATE '2024-01-20' GROUP BY 1")
def snapshot_prune(spark, sf):
    kept = memory.prune(snapshots(spark, sf), F.lit("2024-01-20").cast("date"))
    return kept.select(F.col("date").cast("string").alias("date"), F.size("top_event_ids").cast("bigint").alias("events"))


@query("q_rejection_history", "SELECT doc_id % 30 AS event_id, count(*) AS n, max(doc_id) AS last FROM labels GROUP BY 1")
def rejection_history(spark, sf):
    r = table(spark, sf, "labels").select((F.col("doc_id") % 30).alias("event_id"), F.col("doc_id").alias("rejected_at"), F.lit("hard").alias("reject_type"), F.lit("r").alias("reason"))
    return memory.rejection_history(r).select("event_id", F.size("history").cast("bigint").alias("n"), F.element_at("history", 1)["rejected_at"].alias("last"))


_OUTCOMES = "o AS (SELECT CAST(user_id % 13 AS VARCHAR) AS instance, epoch_us(ts) / 1e6 AS moment, coalesce(value > 40, false) AS ok, row_number() OVER (PARTITION BY user_id % 13 ORDER BY epoch_us(ts), event_id) AS n FROM events)"
_STREAKS = "k AS (SELECT instance, CAST(max(n) - coalesce(max(n) FILTER (ok), 0) AS INTEGER) AS failures, max(moment) AS moment FROM o GROUP BY instance)"


@query("q_breaker_states", f"WITH {_OUTCOMES}, {_STREAKS} SELECT instance, CASE WHEN failures >= 3 THEN 'OPEN' ELSE 'CLOSED' END AS state, failures, CASE WHEN failures >= 3 THEN moment ELSE 0.0::DOUBLE END AS opened_at, CASE WHEN failures >= 3 THEN 60 * least(10 * 2.0::DOUBLE ** least(failures - 3, 60), 120) ELSE 0.0::DOUBLE END AS cooldown FROM k")
def breaker_states(spark, sf):
    e = table(spark, sf, "events")
    return breaker.fold(e.select((F.col("user_id") % 13).cast("string").alias("instance"), "ts", F.when(F.col("value") > 40, "ok").otherwise("error").alias("outcome"), F.col("event_id").alias("ord")))
