"""Rendering and validation of reports (REN-02..-04, VAL-01..-03, AGG-22..-27, JON-16, PRJ-17, -20, -22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_cjk, urls, with_scheme

ITEM = "struct<title:string,summary:string,url:string,source:string,entities:array<string>>"
ARTICLE = f"id string, hook string, summary_items array<string>, deep_items array<{ITEM}>, important_items array<{ITEM}>, brief_items array<{ITEM}>, editorial struct<observation:string,evidence:string,judgment:string>"
SCRIPT = "id string, hook array<struct<speaker:string,text:string,duration_s:double>>, overview array<struct<speaker:string,text:string,duration_s:double>>, deep_items array<struct<title:string,dialogue:array<struct<speaker:string,text:string,duration_s:double>>>>, quick_items array<struct<title:string,dialogue:array<struct<speaker:string,text:string,duration_s:double>>>>, closing array<struct<speaker:string,text:string,duration_s:double>>"
#: Phrases that say nothing (fixed values).
EMPTY_PHRASES = ["值得关注", "引发热议", "备受瞩目", "意义重大", "影响深远", "拭目以待"]


def _items(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(f"array<{ITEM}>"))


def all_items() -> Column:
    return F.concat(_items("deep_items"), _items("important_items"), _items("brief_items"))


def render_article(articles: DataFrame) -> DataFrame:
    """(id, markdown) of ARTICLE rows."""
    block = lambda i: F.concat(F.lit("### "), F.coalesce(i["title"], F.lit("")), F.lit("\n\n"), F.coalesce(i["summary"], F.lit("")), F.lit("\n\n"), F.coalesce(i["source"], F.lit("")), F.lit(" "), with_scheme(i["url"]))
    brief = lambda i: F.concat(F.lit("- "), F.coalesce(i["title"], F.lit("")), F.lit(" "), with_scheme(i["url"]))
    part = lambda name, head, f, sep: F.when(F.size(_items(name)) > 0, F.concat(F.lit(f"## {head}\n\n"), F.array_join(F.transform(_items(name), f), sep)))
    opinion = F.when(F.col("editorial").isNotNull(), F.concat_ws("\n\n", F.lit("## Editorial"), "editorial.observation", "editorial.evidence", "editorial.judgment"))
    sources = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(all_items(), lambda i: i["source"]), lambda s: F.coalesce(s, F.lit("")) != ""))), ", ")
    text = F.concat_ws("\n\n", "hook", part("deep_items", "In depth", block, "\n\n"), part("important_items", "Important", block, "\n\n"), part("brief_items", "In brief", brief, "\n"), opinion, F.concat(F.lit("Sources: "), sources))
    return articles.select("id", text.alias("markdown"))


def dialogue(scripts: DataFrame) -> DataFrame:
    """(id, at, section, speaker, text, duration_s): a script's lines in speaking order."""
    line = "struct<section:string,speaker:string,text:string,duration_s:double>"
    tag = lambda name, rows: F.transform(F.coalesce(rows, F.array().cast("array<struct<speaker:string,text:string,duration_s:double>>")), lambda s: F.struct(F.lit(name).alias("section"), s["speaker"].alias("speaker"), s["text"].alias("text"), s["duration_s"].alias("duration_s")).cast(line))
    inner = lambda name: F.flatten(F.transform(F.col(name), lambda i: i["dialogue"]))
    rows = F.concat(tag("hook", F.col("hook")), tag("overview", F.col("overview")), tag("deep", inner("deep_items")), tag("quick", inner("quick_items")), tag("closing", F.col("closing")))
    return scripts.select("id", F.posexplode(rows).alias("at", "line")).select("id", "at", "line.*")


def script_duration(scripts: DataFrame, least: float = 180, most: float = 300) -> DataFrame:
    """(id, seconds, in_range)."""
    total = dialogue(scripts).groupBy("id").agg(F.sum("duration_s").alias("seconds"))
    return scripts.select("id").join(total, "id", "left").select("id", F.coalesce("seconds", F.lit(0.0)).alias("seconds")).withColumn("in_range", F.col("seconds").between(least, most))


def empty_phrases(text: Column, phrases: list[str] = EMPTY_PHRASES) -> Column:
    """How often phrases that say nothing occur."""
    return reduce(lambda a, p: a + F.regexp_count(text, F.lit(p)), phrases, F.lit(0))


def checks(articles: DataFrame) -> DataFrame:
    """(id, check, passed): structural and acceptance checks of ARTICLE rows."""
    n = lambda name: F.size(_items(name))
    every = all_items()
    text_of = lambda c: F.coalesce(F.col(c), F.lit(""))
    sources = F.array_distinct(F.filter(F.transform(every, lambda i: F.coalesce(i["source"], F.lit(""))), lambda s: s != ""))
    tests = {
        "hook_present": text_of("hook") != "", "hook_over_20": F.char_length(text_of("hook")) > 20, "summary_items": F.size(F.coalesce("summary_items", F.array().cast("array<string>"))) > 0,
        "deep_items": n("deep_items") > 0, "important_items": n("important_items") > 0, "brief_items": n("brief_items") > 0,
        "titles": ~F.exists(every, lambda i: F.coalesce(i["title"], F.lit("")) == ""), "urls": ~F.exists(every, lambda i: F.coalesce(i["url"], F.lit("")) == ""),
        "url_scheme": ~F.exists(every, lambda i: (F.coalesce(i["url"], F.lit("")) != "") & ~F.coalesce(i["url"], F.lit("")).rlike("^https?://")),
        "sources_named": ~F.exists(every, lambda i: F.coalesce(i["source"], F.lit("")) == ""), "three_sources": F.size(sources) >= 3,
        "deep_content": ~F.exists(_items("deep_items"), lambda i: F.char_length(F.coalesce(i["summary"], F.lit(""))) == 0),
        "deep_digits": ~F.exists(_items("deep_items"), lambda i: ~F.coalesce(i["summary"], F.lit("")).rlike(r"\d")),
        "editorial_triple": (text_of("editorial.observation") != "") & (text_of("editorial.evidence") != "") & (text_of("editorial.judgment") != ""),
        "editorial_30": F.char_length(F.concat(text_of("editorial.observation"), text_of("editorial.evidence"), text_of("editorial.judgment"))) >= 30,
        "few_empty_phrases": empty_phrases(F.concat_ws(" ", "hook", F.array_join(F.transform(every, lambda i: F.coalesce(i["summary"], F.lit(""))), " "))) <= 3,
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in tests.items()])
    return articles.select("id", F.explode(rows).alias("c")).select("id", "c.*")


CRITICAL = ("hook_present", "deep_items", "urls", "editorial_triple", "three_sources")


def accepted(checked: DataFrame, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """(id, accepted, failed): whether all critical checks passed, and the names of those that failed."""
    return checked.groupBy("id").agg(F.coalesce(F.bool_and(F.when(F.col("check").isin(*critical), F.col("passed"))), F.lit(True)).alias("accepted"), F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("check")))).alias("failed"))


def unknown_urls(articles: DataFrame, events: DataFrame, text: str = "markdown") -> DataFrame:
    """(id, url): urls in a text that no event has."""
    found = articles.select("id", F.explode(urls(F.col(text))).alias("url")).distinct()
    return found.join(events.select("url").distinct(), "url", "left_anti").select("id", "url")


def title_consistency(a: DataFrame, b: DataFrame, key: str, title: str, warn_below: float = 0.5) -> DataFrame:
    """(key, similarity, warn): Jaccard similarity of two tables' title sets."""
    sets = lambda df, name: df.groupBy(key).agg(F.collect_set(title).alias(name))
    both = sets(a, "x").join(sets(b, "y"), key, "full_outer")
    none = F.array().cast("array<string>")
    x, y = F.coalesce("x", none), F.coalesce("y", none)
    sim = F.when(F.size(F.array_union(x, y)) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    return both.select(key, sim.alias("similarity")).withColumn("warn", F.col("similarity") < warn_below)


def output_stats(items: DataFrame) -> DataFrame:
    """(date, section counts..., n_sources, latin_sources_pct, chars): statistics of a day's items (date, section, source, text)."""
    return items.groupBy("date").agg(
        F.count_if(F.col("section") == "deep").alias("deep"), F.count_if(F.col("section") == "important").alias("important"), F.count_if(F.col("section") == "brief").alias("brief"),
        F.count_distinct("source").alias("n_sources"), F.round(100 * F.avg((~has_cjk(F.col("source"))).cast("int")), 1).alias("latin_sources_pct"), F.sum(F.char_length("text")).alias("chars"),
    )


def against_baseline(stats: DataFrame, measure: str, date: str = "date") -> DataFrame:
    """stats plus baseline (mean of all days, one decimal) and diff."""
    mean = stats.agg(F.round(F.avg(measure), 1).alias("baseline"))
    return stats.crossJoin(F.broadcast(mean)).withColumn("diff", F.round(F.col(measure) - F.col("baseline"), 1))


def substitute(template: Column, values: dict[str, Column]) -> Column:
    """{{key}} replaced by each value."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)
