"""Editorial signals as one long table (SCO-12..-17, AGG-06..-12, AGG-15, JON-11, -12, FLT-15, -16, EDT-02, -03).

Every rule is a function from events to rows of SIGNAL; rules are joined by union and resolved by aggregates. scope
is the columns inside which a rule looks at a batch (a lane, a day); it only ever adds to partition keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Editorial, Scoring
from ..functions.text import url_host
from ..functions.time import hours_between
from .caps import past_cap
from .filters import relevance_reason, story_signal

SIGNAL = "event_id string, phase string, subtype string, weight int, source string, reason string, entity string, recent_days int, rule_no int, ord bigint"
Rule = Callable[[DataFrame], DataFrame]


def signal(rows: DataFrame, phase: str, subtype: Column | str, source: str, weight: Column | int = 0, reason: Column | str = "", entity: Column | None = None, recent_days: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        F.col("id").cast("string").alias("event_id"), F.lit(phase).alias("phase"), lit(subtype).alias("subtype"), lit(weight).cast("int").alias("weight"), F.lit(source).alias("source"),
        lit(reason).cast("string").alias("reason"), (entity if entity is not None else F.lit(None)).cast("string").alias("entity"),
        (recent_days if recent_days is not None else F.lit(None)).cast("int").alias("recent_days"), F.lit(0).alias("rule_no"), F.col("ord").cast("bigint").alias("ord"),
    ).where("event_id is not null")


def collect(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The signals of all rules. A rule that can't be built on these events raises; collect_isolated leaves it out.

    Every rule reads events: stage them first (staging.staged) where making them is dear.
    """
    out = None
    for no, rule in enumerate(rules):
        got = rule(events).withColumn("rule_no", F.lit(no))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else events.sparkSession.createDataFrame([], SIGNAL)


def collect_isolated(events: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(signals, failures): the signals of the rules that can be built, and rule_no, rule, reason of each other one."""
    built, failed = [], []
    for no, rule in enumerate(rules):
        try:
            built.append(rule(events).withColumn("rule_no", F.lit(no)))
        except Exception as e:  # noqa: BLE001  what went wrong is a row of the result
            failed.append((no, getattr(rule, "__name__", str(rule)), f"{type(e).__name__}: {e}"))
    out = events.sparkSession.createDataFrame([], SIGNAL) if not built else built[0]
    for got in built[1:]:
        out = out.unionByName(got)
    return out, events.sparkSession.createDataFrame(failed, "rule_no int, rule string, reason string")


def entity_counts(events: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope..., entity, n): how many events of the batch name an entity."""
    return events.select(*scope, F.explode("entities").alias("entity")).groupBy(*scope, "entity").agg(F.count("*").alias("n"))


def breaking(events: DataFrame, cfg: Editorial = Editorial(), scope: Sequence[str] = ()) -> DataFrame:
    """BREAKING: a rare top entity; else an official blog with a cluster of one; else an event type that always breaks.

    Only events' first top entity counts, so the join to the counts has at most one row for each event.
    """
    first_top = F.try_element_at(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: e.isin(*cfg.top_entities)), F.lit(1))
    rows = events.withColumn("entity", first_top)
    counts = entity_counts(events, scope).where(F.col("entity").isin(*cfg.top_entities))
    rows = rows.join(counts, [*scope, "entity"], "left")
    host, name = url_host(F.coalesce(F.nullif("source_url", F.lit("")), F.col("url"), F.lit(""))), F.lower(F.coalesce("source_name", F.lit("")))
    official = F.lit(False)
    for blog in cfg.official_blogs:
        official = official | F.contains(host, F.lit(blog)) | F.contains(name, F.lit(blog.split(".")[0]))
    why = F.when(F.col("entity").isNotNull() & (F.coalesce("n", F.lit(0)) <= 2), "entity").when(official & (F.coalesce("cluster_size", F.lit(1)) <= 1), "official").when(F.col("event_type").isin(*cfg.breaking_types), "type")
    rows = rows.withColumn("why", why).where("why is not null")
    return signal(rows, "FILTER", "BREAKING", "breaking", reason=F.col("why"), entity=F.when(F.col("why") == "entity", F.col("entity")))


def content_relevance(events: DataFrame, **lexicons) -> DataFrame:
    rows = events.withColumn("why", relevance_reason(F.col("title"), F.col("summary"), F.col("event_type"), F.col("source_name"), **lexicons)).where("why is not null")
    return signal(rows, "FILTER", "CONTENT_REJECTION", "relevance", reason=F.col("why"))


def match_stories(events: DataFrame, stories: DataFrame) -> DataFrame:
    """events plus story_key, state and last_seen: the story of the cluster, else of the first entity that has one, its latest."""
    own = stories.select(F.col("story_key").alias("k1"), F.col("state").alias("s1"), F.col("last_seen").alias("l1"))
    rows = events.join(own, events["cluster_id"] == F.col("k1"), "left")
    latest = stories.groupBy("entity").agg(F.max_by(F.struct("story_key", "state", "last_seen"), F.struct("last_seen", "story_key")).alias("st"))
    by_entity = events.select("id", F.posexplode("entities").alias("pos", "entity")).join(latest, "entity").groupBy("id").agg(F.min_by("st", "pos").alias("st"))
    rows = rows.join(by_entity, "id", "left")
    return rows.withColumns({"story_key": F.coalesce("k1", "st.story_key"), "state": F.when(F.col("k1").isNotNull(), F.col("s1")).otherwise(F.col("st.state")), "last_seen": F.when(F.col("k1").isNotNull(), F.col("l1")).otherwise(F.col("st.last_seen"))}).drop("k1", "s1", "l1", "st")


def story_dedup(events: DataFrame, stories: DataFrame, day: Column, cfg: Editorial = Editorial()) -> DataFrame:
    """STALE for events of stale stories, FOLLOW_UP with its negative weight for stories seen lately."""
    rows = match_stories(events, stories).withColumn("sub", story_signal(F.col("state"), F.col("last_seen"), day, cfg.follow_up_days)).where("sub is not null")
    stale = signal(rows.where("sub = 'STALE'"), "FILTER", "STALE", "story", reason=F.col("story_key"))
    return stale.unionByName(signal(rows.where("sub = 'FOLLOW_UP'"), "RANK", "FOLLOW_UP", "story", weight=cfg.follow_up_weight, reason=F.col("story_key")))


def recent_entities(snapshots: DataFrame, day: Column, cfg: Editorial = Editorial()) -> DataFrame:
    """(entity, days): distinct days before day, within the look-back, on which a snapshot names the entity."""
    seen = snapshots.where((F.col("date") >= F.date_sub(day, cfg.memory_days)) & (F.col("date") <= day))
    return seen.select("date", F.explode("top_entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("days"))


def memory(events: DataFrame, snapshots: DataFrame, day: Column, cfg: Editorial = Editorial()) -> DataFrame:
    """MEMORY notes: the entity seen on most days lately (the first on ties), else a clustered event that a snapshot holds."""
    days = recent_entities(snapshots, day, cfg)
    best = events.select("id", F.posexplode("entities").alias("pos", "entity")).join(days, "entity").groupBy("id").agg(F.max_by(F.struct("entity", "days"), F.struct("days", -F.col("pos"))).alias("hit"))
    held = snapshots.where((F.col("date") >= F.date_sub(day, cfg.memory_days)) & (F.col("date") <= day)).select(F.explode("top_event_ids").alias("id")).distinct().withColumn("held", F.lit(True))
    rows = events.join(best, "id", "left").join(held, "id", "left")
    rows = rows.where("hit is not null or (held and cluster_id is not null)")
    reason = F.when(F.col("hit").isNotNull(), F.format_string('entity "%s" on %d of the last days', F.col("hit.entity"), F.col("hit.days"))).otherwise(F.format_string('cluster "%s" covered lately', F.col("cluster_id")))
    return signal(rows, "ANNOTATION", "MEMORY", "memory", reason=reason, entity=F.col("hit.entity"), recent_days=F.coalesce("hit.days", F.lit(1)))


def coverage(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(id, snapshots): in how many snapshots' lists an event stands."""
    seen = snapshots.select("date", F.explode("top_event_ids").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("snapshots"))
    return events.select("id").join(seen, "id", "left").select("id", F.coalesce("snapshots", F.lit(0)).alias("snapshots"))


def verification(events: DataFrame, dim: DataFrame, edges: DataFrame) -> DataFrame:
    """VERIFICATION from three pieces of evidence on: the publisher's kind and duplicate edges."""
    from .lineage import edge_degrees, evidence_count, with_publisher

    rows = with_publisher(events, dim).where("publisher_type is not null").join(edge_degrees(edges), "id", "left")
    rows = rows.withColumn("evidence", evidence_count(F.col("publisher_type"), F.col("edges"))).where("evidence >= 3")
    return signal(rows, "FILTER", "VERIFICATION", "verification", reason=F.col("canonical"))


def authority(events: DataFrame, cfg: Scoring = Scoring()) -> DataFrame:
    weight = F.lit(cfg.tier_scores[3])
    for t, s in cfg.tier_scores.items():
        weight = F.when(F.coalesce("source_tier", F.lit(3)) == t, s).otherwise(weight)
    return signal(events, "RANK", "AUTHORITY", "authority", weight=weight)


def freshness(events: DataFrame, as_of: Column, cfg: Scoring = Scoring()) -> DataFrame:
    weight, age = F.lit(cfg.oldest), hours_between(as_of, F.col("published_at"))
    for most, s in reversed(cfg.freshness):
        weight = F.when(age <= most, s).otherwise(weight)
    return signal(events, "RANK", "FRESHNESS", "freshness", weight=weight)


def entity_heat(events: DataFrame, cfg: Scoring = Scoring()) -> DataFrame:
    """The best tier among an event's entities, by exact name."""
    weight = F.greatest(F.lit(0), *[F.when(F.arrays_overlap("entities", F.array(*[F.lit(e) for e in t.entities])), t.score).otherwise(0) for t in cfg.entity_tiers])
    return signal(events.withColumn("_w", weight).where("_w > 0"), "RANK", "ENTITY_HEAT", "entity_heat", weight=F.col("_w"))


def source_diversity(events: DataFrame, cfg: Scoring = Scoring(), scope: Sequence[str] = ()) -> DataFrame:
    """-10 for every event of a source beyond its cap in the batch."""
    name = F.coalesce(F.nullif("source_name", F.lit("")), F.nullif("source_id", F.lit("")), F.lit("unknown"))
    rows = events.withColumn("_s", name)
    cap = F.lit(cfg.default_cap)
    for s, n in cfg.source_caps.items():
        cap = F.when(F.col("_s") == s, n).otherwise(cap)
    many = rows.groupBy(*scope, "_s").agg(F.count("*").alias("_n")).where(F.col("_n") > cap)
    return signal(rows.join(many, [*scope, "_s"]), "RANK", "SOURCE_DIVERSITY", "source_diversity", weight=-10, reason=F.col("_s"))


def origin_tier(events: DataFrame, dim: DataFrame) -> DataFrame:
    from .lineage import origin_weight, with_publisher

    rows = with_publisher(events, dim).withColumn("_w", origin_weight(F.col("publisher_type"), F.col("trust_score"))).where("publisher_type is not null and _w <> 0")
    return signal(rows, "RANK", "ORIGIN_TIER", "origin_tier", weight=F.col("_w"), reason=F.col("canonical"))


def evidence_edges(events: DataFrame, edges: DataFrame) -> DataFrame:
    from .lineage import edge_degrees, edge_weight

    rows = events.where("source_id is not null").join(edge_degrees(edges), "id")
    return signal(rows, "RANK", "EVIDENCE_COUNT", "evidence_edges", weight=edge_weight(F.col("edges")))


def resolve(signals: DataFrame, cfg: Editorial = Editorial()) -> DataFrame:
    """(event_id, breaking, held, boost, hints, signals): what an event's signals add up to."""
    is_ = lambda s: F.coalesce(F.bool_or((F.col("phase") == "FILTER") & (F.col("subtype") == s)), F.lit(False))
    note = F.when(F.col("recent_days") >= 2, F.array("reason", F.format_string("%s: reported on %d recent days", F.coalesce("entity", F.lit("unknown")), F.col("recent_days")))).otherwise(F.array("reason"))
    hints = F.collect_list(F.when(F.col("phase") == "ANNOTATION", F.struct("rule_no", "subtype", note.alias("notes"))))
    return signals.groupBy("event_id").agg(
        is_("BREAKING").alias("breaking"), (is_("DIVERSITY_CAP") & ~is_("BREAKING")).alias("held"),
        F.least(F.coalesce(F.sum(F.when(F.col("phase") == "RANK", F.col("weight"))), F.lit(0)), F.lit(cfg.boost_cap)).alias("boost"),
        F.flatten(F.transform(F.array_sort(hints), lambda h: h["notes"])).alias("hints"),
        F.array_sort(F.collect_list(F.struct("rule_no", "phase", "subtype", "weight", "reason"))).alias("signals"),
    )


def by_phase(signals: DataFrame, phase: str) -> DataFrame:
    return signals.where(F.col("phase") == phase)


def summary(signals: DataFrame) -> DataFrame:
    return signals.groupBy("phase", "subtype").agg(F.count("*").alias("signals"))


def _category(scope: Sequence[str]) -> list:
    return [*scope, F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized"))]


def category_cap(ranked: DataFrame, cfg: Editorial = Editorial(), scope: Sequence[str] = ()) -> DataFrame:
    """ranked plus capped: beyond the first per_category rows of a category by final_rank that aren't breaking. All rows stay; for pools see uncapped."""
    keys = {str(i): F.col(c) if isinstance(c, str) else c for i, c in enumerate(_category(scope))}
    return past_cap(ranked, keys, "final_rank", "ord", F.lit(cfg.per_category), cfg.per_category, ~F.col("breaking")).withColumnRenamed("past_cap", "capped")


def uncapped(ranked: DataFrame, cfg: Editorial = Editorial(), scope: Sequence[str] = ()) -> DataFrame:
    """The rows that category_cap leaves: breaking ones, and the first per_category others of each category.

    The limit is a literal, so every task ranks and keeps its own first rows before the shuffle, and a hot category is no large task.
    """
    place = F.row_number().over(Window.partitionBy(*_category(scope)).orderBy(F.desc("final_rank"), "ord"))
    first = ranked.where(~F.col("breaking")).withColumn("_place", place).where(F.col("_place") <= cfg.per_category).drop("_place")
    return ranked.where("breaking").unionByName(first).withColumn("capped", F.lit(False))
