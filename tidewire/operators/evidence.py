"""Evidence from pages: eligible paragraphs, keyword scores, paywalls (STR-F9, SCO-10, -11, FLT-21..-24, JON-14, SRT-09, -10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import evidence_id

#: Elements whose content never counts.
DROPPED = ["script", "style", "nav", "header", "footer", "aside", "form", "iframe", "noscript"]
PAYWALL = r"(?i)(class|id)\s*=\s*[\"'][^\"']*(paywall|subscribe-wall|premium-content|meter-wall|regwall)"


def _alone(pattern: str) -> str:
    """pattern between ASCII word boundaries; Java's own boundary counts other letters."""
    return rf"(?<![A-Za-z0-9_]){pattern}(?![A-Za-z0-9_])"


def keywords(title: Column, summary: Column, names: Column, most: int = 15) -> Column:
    """Capitalised words, acronyms, entities, and non-ASCII phrases that hold an entity; distinct, longest first."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))
    find = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    names = F.coalesce(names, F.array().cast("array<string>"))
    phrases = F.filter(find(r"[^\x00-\x7F]{2,10}"), lambda p: F.exists(names, lambda n: F.contains(p, n)))
    every = F.array_distinct(F.concat(find(_alone("[A-Z][a-z]{2,}")), find(_alone("[A-Z]{2,5}")), names, phrases))
    keyed = F.array_sort(F.transform(every, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(keyed, lambda x: x["w"]), 1, most)


def main_part(html: Column) -> Column:
    """The first article, else main, else body element, without elements whose content never counts."""
    html = F.coalesce(html, F.lit(""))
    take = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    part = F.coalesce(take("article"), take("main"), take("body"), html)
    for tag in DROPPED:
        part = F.regexp_replace(part, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return part


def paragraphs(pages: DataFrame, least: int = 20) -> DataFrame:
    """(page_id, url, at, paragraph): texts of p elements with at least so many characters, in page order."""
    found = F.regexp_extract_all(main_part(F.col("html")), F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]*>", " "), r"\s+", " "))
    return pages.select("page_id", "url", F.posexplode(found).alias("at", "raw")).select("page_id", "url", "at", text.alias("paragraph")).where(F.char_length("paragraph") >= least)


def paragraph_score(paragraph: Column, words: Column) -> Column:
    """2 for each keyword of over four characters that occurs, 1 for a shorter one."""
    low = F.lower(paragraph)
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.when(F.contains(low, F.lower(w)), F.when(F.length(w) > 4, 2).otherwise(1)).otherwise(0))


def best_paragraph(scored: DataFrame) -> DataFrame:
    """The paragraph of highest positive score on each page, the first on ties."""
    return scored.where("score > 0").groupBy("page_id").agg(F.max_by("paragraph", F.struct("score", -F.col("at"))).alias("paragraph"), F.max("score").alias("score"))


def is_paywalled(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).rlike(PAYWALL)


def evidence_rows(events: DataFrame, pages: DataFrame) -> DataFrame:
    """(evidence_id, event_id, url, claim, confidence): the best paragraph of the page of each event; 0 behind a paywall."""
    words = events.select("id", "url", keywords(F.col("title"), F.col("summary"), F.col("entities")).alias("words"))
    scored = words.join(paragraphs(pages), "url").withColumn("score", paragraph_score(F.col("paragraph"), F.col("words"))).where("score > 0")
    best = scored.groupBy("id", "url").agg(F.max_by("paragraph", F.struct("score", -F.col("at"))).alias("claim"), F.max("score").alias("score"))
    walls = pages.groupBy("url").agg(F.bool_or(is_paywalled(F.col("html"))).alias("walled"))
    rows = words.join(walls, "url").join(best, ["id", "url"], "left").where("walled or claim is not null")
    return rows.select(evidence_id(F.col("id").cast("string"), F.col("url")).alias("evidence_id"), F.col("id").alias("event_id"), "url", F.when(~F.col("walled"), F.col("claim")).alias("claim"), F.when(F.col("walled"), 0).otherwise(F.col("score")).alias("confidence"))


def inject(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """items plus claim: evidence of the item's id, else the first of its url."""
    by_id = evidence.groupBy(F.col("event_id").alias("id")).agg(F.min_by("claim", "evidence_id").alias("c1"))
    by_url = evidence.groupBy("url").agg(F.min_by("claim", "evidence_id").alias("c2"))
    return items.join(by_id, "id", "left").join(by_url, "url", "left").withColumn("claim", F.coalesce("c1", "c2")).drop("c1", "c2")


def rank_paragraphs(scored: DataFrame, most: int = 3) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "at"))
    return scored.where("score > 0").withColumn("place", place).where(F.col("place") <= most)
