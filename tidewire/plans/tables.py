"""The test tables seen as assets, events, stories and snapshots, in Spark and in SQL, and a registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Editorial, EntityTier, EventType, Scoring
from ..functions.text import clean_summary
from ..staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


AS_OF = "2024-01-31 00:00:00"
DAY = "2024-01-30"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def day():
    return F.lit(DAY).cast("date")


#: Fragments that are frequent in the test texts stand in for names.
TIERS = (EntityTier("top_tier", ("thest", "eauou", "keitung", "ciónos"), 10), EntityTier("second_tier", ("ingth", "mentre", "schen", "osmente"), 6), EntityTier("notable", ("xAI", "Yi", "thest"), 5))
TYPES = (EventType("model_release", 10, ("release", "onthe"), r"(?i)(GPT-\d|token)"), EventType("funding", 8, ("raised", "eaupa")), EventType("policy", 7, ("ungge", "EU")), EventType("acquisition", 6, ("acquire", "mentedo")))
CFG = Scoring(entity_tiers=TIERS, event_types=TYPES, auto=40, review=30)
NEWS = Editorial(top_entities=TIERS[0].entities, official_blogs=("src7.example.com",), breaking_types=("acquisition",))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as assets: dates from doc_id, categories from the language, tiers in turn."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        i.alias("ord"), F.concat(F.lit("doc_"), i.cast("string")).alias("id"), F.substring_index(text, "\n", 1).alias("title"), clean_summary(text).alias("summary"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), (i % 300).cast("string")).alias("url"), F.col("source").alias("source_id"), F.col("lang").alias("language"),
        F.when(F.col("lang") == "en", "industry").when(F.col("lang") == "fr", "research").when(F.col("lang") == "de", "policy").otherwise("arts").alias("category"),
        (i % 3 + 1).cast("int").alias("tier"), F.when(i % 17 != 0, F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(i * 7919 % 43200).cast("int"))).alias("published_at"),
    )


ASSETS = r"""
assets AS (
    SELECT doc_id AS ord, 'doc_' || doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS title,
        left(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', '', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g'), '\s+', ' ', 'g')), 500) AS summary,
        'https://' || source || '.example.com/' || (doc_id % 300) AS url, source AS source_id, lang AS language,
        CASE lang WHEN 'en' THEN 'industry' WHEN 'fr' THEN 'research' WHEN 'de' THEN 'policy' ELSE 'arts' END AS category,
        CAST(doc_id % 3 + 1 AS INTEGER) AS tier,
        CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 7919 % 43200 AS INTEGER)) END AS published_at
    FROM documents
)"""


def sql_list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _hits(tier: EntityTier) -> str:
    return f"len(list_filter({sql_list(tier.entities)}, lambda t: contains(low, lower(t))))"


def _type(k: EventType) -> str:
    words = f"len(list_filter({sql_list(k.keywords)}, lambda t: contains(lower(raw), lower(t)))) > 0"
    return f"({words} OR regexp_matches(raw, '{k.pattern}'))" if k.pattern else f"({words})"


_BY_SCORE = sorted(TYPES, key=lambda k: -k.score)
#: Assets with entities, event type and score factors.
SCORED = (
    ASSETS
    + f""", texts AS (
    SELECT *, lower(title || ' ' || summary) AS low, title || ' ' || summary AS raw, epoch(TIMESTAMP '{AS_OF}' - published_at) / 3600.0 AS age FROM assets
), factors AS (
    SELECT *, list_distinct_in_order AS entities FROM (
        SELECT *, list_filter({sql_list(dict.fromkeys(e for t in TIERS for e in t.entities))}, lambda t: contains(low, lower(t))) AS list_distinct_in_order,
            CASE {" ".join(f"WHEN {_type(k)} THEN '{k.name}'" for k in _BY_SCORE)} ELSE 'general' END AS event_type,
            CASE tier WHEN 1 THEN 20 WHEN 2 THEN 15 WHEN 3 THEN 7 ELSE 0 END AS authority,
            CASE WHEN age IS NULL THEN 2 WHEN age <= 1 THEN 15 WHEN age <= 3 THEN 13 WHEN age <= 6 THEN 11 WHEN age <= 12 THEN 8 WHEN age <= 24 THEN 5 ELSE 2 END AS timeliness,
            greatest({", ".join(f"CASE WHEN {_hits(t)} > 0 THEN {t.score} ELSE 0 END" for t in TIERS)}) AS best, {" + ".join(_hits(t) for t in TIERS)} AS hits,
            CASE {" ".join(f"WHEN {_type(k)} THEN {k.score}" for k in _BY_SCORE)} ELSE 2 END AS type_score,
            least((CASE WHEN regexp_matches(raw, '\\$[\\d.]+\\s*[bBmM]') OR regexp_matches(raw, '[\\d.]+\\s*亿') THEN 2 ELSE 0 END)
                + (CASE WHEN regexp_matches(raw, '[\\d.]+\\s*%') OR regexp_matches(raw, '(?i)\\d+x\\s*faster') THEN 1 ELSE 0 END)
                + (CASE WHEN regexp_matches(raw, '(?i)\\d+\\s*(billion|million|百万|千万)') THEN 1 ELSE 0 END), 6) AS quantitative
        FROM texts)
), scored AS (
    SELECT *, least(best + CASE WHEN hits >= 2 AND best >= 10 THEN 2 ELSE 0 END, 12) AS entity FROM factors
), ranked AS (
    SELECT *, least(authority + timeliness + entity + type_score + quantitative, 100) AS total_score, coalesce(age > 48, false) AS age_filtered FROM scored
), labelled AS (
    SELECT *, CASE WHEN age_filtered THEN 'skip' WHEN total_score >= 40 THEN 'auto' WHEN total_score >= 30 THEN 'review' ELSE 'skip' END AS tier_label FROM ranked
)"""
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assets plus entities, event_type, factors and scores (titles of the test tables hold no academic terms that count)."""
    from ..functions.text import lower_text
    from ..operators import scoring

    rows = assets(spark, sf_dir).withColumn("source", F.struct(F.col("source_id").alias("name"), F.col("tier").alias("tier"), F.lit("").alias("url")))
    raw = F.concat_ws(" ", "title", "summary")
    rows = rows.withColumns({"entities": scoring.entities(lower_text("title", "summary"), TIERS), "event_type": scoring.event_type(raw, CFG)})
    rows = rows.withColumn("title_kept", F.col("title"))
    parts = scoring.score(rows, as_of(), CFG)
    # the academic factor has its own query; here it is left out on both sides
    total = F.least(F.col("total_score") - F.col("factors.academic"), F.lit(100))
    label = F.when(F.col("age_filtered"), "skip").when(F.col("total_score") >= CFG.auto, "auto").when(F.col("total_score") >= CFG.review, "review").otherwise("skip")
    return parts.withColumn("total_score", total).withColumn("tier_label", label).drop("title_kept")


#: Events with clusters, domains and effective times.
EVENTS = (
    SCORED
    + """, events_v AS (
    SELECT id, ord, title, summary, url, source_id AS source_name, source_id, CAST(tier AS INTEGER) AS source_tier, category, event_type, entities, CAST(total_score AS DOUBLE) AS rank_total,
        published_at AS effective_at, CASE WHEN ord % 9 <> 0 THEN 'c' || (ord % 40) END AS cluster_id, category AS domain FROM labelled
)"""
)


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select(
        "id", "ord", "title", "summary", "url", F.col("source_id").alias("source_name"), "source_id", F.col("tier").alias("source_tier"), F.lit("").alias("source_url"), "category", "event_type", "entities",
        F.col("total_score").cast("double").alias("rank_total"), F.col("published_at").alias("effective_at"), "published_at", F.when(F.col("ord") % 9 != 0, F.concat(F.lit("c"), (F.col("ord") % 40).cast("string"))).alias("cluster_id"),
        F.col("category").alias("domain"), F.lit(1).alias("cluster_size"), F.array().cast("array<string>").alias("topics"),
    )


#: What memory rules read of an event.
NOTED = ["id", "ord", "category", "entities", "rank_total", "effective_at", "cluster_id"]


def snapshots(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """A snapshot for each day of January: the day's events of score 30 or more.

    Events are staged: a filter by score, and each further read, would else clean and score the whole texts again.
    """
    events = events if events is not None else staged(events_of(spark, sf_dir).select(*NOTED), "events")
    e = events.where("effective_at is not null and rank_total >= 30").withColumn("date", F.col("effective_at").cast("date"))
    names = e.select("date", F.explode("entities").alias("name")).distinct().groupBy("date").agg(F.array_sort(F.collect_list("name")).alias("top_entities"))
    days = e.groupBy("date").agg(F.array_sort(F.collect_set("id")).alias("top_event_ids"), F.array_sort(F.collect_set("category")).alias("top_categories"))
    return days.join(names, "date", "left").select("date", "top_event_ids", F.coalesce("top_entities", F.array().cast("array<string>")).alias("top_entities"), "top_categories")


SNAPSHOTS = EVENTS + """, snaps AS (SELECT CAST(effective_at AS DATE) AS date, id, entities FROM events_v WHERE effective_at IS NOT NULL AND rank_total >= 30)"""


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One story for every second cluster: its last event's day, stale where that is over ten days before the day."""
    e = events_of(spark, sf_dir).where("cluster_id is not null and effective_at is not null and ord % 40 % 2 = 0")
    g = e.groupBy("cluster_id").agg(F.min("effective_at").cast("date").alias("first_seen"), F.max(F.when(F.col("ord") % 5 == 0, F.col("effective_at"))).cast("date").alias("last_seen"), F.min("entities").alias("names"))
    return g.where("last_seen is not null").select(F.col("cluster_id").alias("story_key"), F.try_element_at("names", F.lit(1)).alias("entity"), "first_seen", "last_seen", F.when(F.col("last_seen") < F.date_sub(day(), 3), "stale").otherwise("developing").alias("state"))


STORIES = EVENTS + f""", stories AS (
    SELECT *, CASE WHEN last_seen < DATE '{DAY}' - 3 THEN 'stale' ELSE 'developing' END AS state FROM (
        SELECT cluster_id AS story_key, CAST(max(CASE WHEN ord % 5 = 0 THEN effective_at END) AS DATE) AS last_seen FROM events_v WHERE cluster_id IS NOT NULL AND effective_at IS NOT NULL AND ord % 40 % 2 = 0 GROUP BY cluster_id)
    WHERE last_seen IS NOT NULL
)"""
