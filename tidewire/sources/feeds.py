"""RSS and Atom documents to items, page dates, images (SRC-01..-05, -12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import item_hash
from ..functions.text import clean_summary, first_of, strip_tags
from ..functions.time import parse_date

REGISTRY = "id string, name string, url string, tier int, language string, category string, time_window_hours double, date_reliability string, require_keyword_filter boolean, status string, enabled boolean, proxy boolean"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The source registry, a JSON file with one source on each line."""
    return spark.read.schema(REGISTRY).json(path)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): landed feed documents, one for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def split_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """feeds plus at and item: all RSS items in order, then all Atom entries."""
    pick = lambda tag: F.regexp_extract_all(F.coalesce(F.col(xml), F.lit("")), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    rest = [c for c in feeds.columns if c != xml]
    return feeds.select(*rest, F.posexplode(F.concat(pick("item"), pick("entry"))).alias("at", "item"))


def tag_text(item: Column, tag: str) -> Column:
    """An element's CDATA, else its text without tags; empty if it isn't there."""
    cdata = F.regexp_extract(item, rf"(?is)<{tag}[^>]*>\s*<!\[CDATA\[(.*?)\]\]>\s*</{tag}>", 1)
    plain = strip_tags(F.regexp_extract(item, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return F.trim(F.coalesce(F.nullif(cdata, F.lit("")), plain))


def attribute(item: Column, tag: str, name: str, also: str = "") -> Column:
    """An attribute of the first such element whose other attributes match also."""
    return F.regexp_extract(item, rf"(?is)<{tag}\b(?=[^>]*{also})[^>]*\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1)


def image(item: Column) -> Column:
    """Enclosure, then media content, then media thumbnail, then the first img."""
    return first_of(attribute(item, "enclosure", "url", r"type\s*=\s*[\"']image"), attribute(item, "media:content", "url", r"(?:medium|type)\s*=\s*[\"']image"), attribute(item, "media:thumbnail", "url"), attribute(item, "img", "src"))


def parse_items(items: DataFrame) -> DataFrame:
    """The fields of each item: title, link, guid, description, raw date, author, categories, image."""
    i = F.col("item")
    cats = F.transform(F.regexp_extract_all(i, F.lit(r"(?is)<category[^>]*>(.*?)</category>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<!\[CDATA\[|\]\]>", ""), "<[^>]*>", "")))
    return items.withColumns({
        "title": tag_text(i, "title"), "link": F.coalesce(first_of(tag_text(i, "link"), attribute(i, "link", "href")), F.lit("")), "guid": F.coalesce(first_of(tag_text(i, "guid"), tag_text(i, "id")), F.lit("")),
        "description": F.coalesce(first_of(tag_text(i, "description"), tag_text(i, "summary"), tag_text(i, "content")), F.lit("")),
        "raw_date": first_of(tag_text(i, "pubDate"), tag_text(i, "updated"), tag_text(i, "published")),
        "author": first_of(tag_text(i, "dc:creator"), tag_text(i, "author")), "categories": F.filter(cats, lambda c: c != ""), "image": image(i),
    }).drop("item")


def collect(feeds: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """Items of all sources in one table. feeds: source_id, xml. Unknown sources fall out; a bad feed just gives no items."""
    rows = parse_items(split_items(feeds)).join(registry.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "tier", "language", "category", "date_reliability", "time_window_hours", "require_keyword_filter"), "source_id")
    return rows.select(
        F.concat("source_id", F.lit("_"), item_hash(F.coalesce(F.nullif("link", F.lit("")), "guid"))).alias("id"), "source_id", "source_name", "tier", "language", "category",
        F.coalesce("date_reliability", F.lit("normal")).alias("date_reliability"), "title", F.col("link").alias("url"), "guid", F.substring("description", 1, 1000).alias("description"),
        clean_summary(F.col("description")).alias("summary"), parse_date(F.col("raw_date")).alias("published_at"), as_of.alias("collected_at"), "image", "author", "categories",
        F.when(F.char_length("description") > 500, "raw_content").otherwise("rss_metadata").alias("attribution_type"), F.coalesce("time_window_hours", F.lit(24.0)).alias("time_window_hours"),
        F.coalesce("require_keyword_filter", F.lit(False)).alias("require_keyword_filter"), F.col("at").cast("bigint").alias("at"),
    )


def collect_landed(landed: DataFrame, registry: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(items, results) of rows that the landed data source read: results has each source's status, error, and n_raw, as health.collection_summary takes them.

    A source that failed is an error with what it said, one that is switched off disabled; the others are collected.
    """
    items = collect(landed.where("status = 'ok'").select("source_id", "xml"), registry, as_of)
    off = ~F.coalesce("enabled", F.lit(True)) | (F.coalesce("status", F.lit("active")) == "disabled")
    said = landed.groupBy("source_id").agg(F.max(F.when(F.col("status") == "error", F.coalesce("error", F.lit("")))).alias("error"))
    counts = items.groupBy("source_id").agg(F.count("*").alias("n_raw"))
    every = registry.select(F.col("id").alias("source_id"), off.alias("off")).join(said, "source_id", "left").join(counts, "source_id", "left")
    status = F.when(F.col("off"), "disabled").when(F.col("error").isNotNull(), "error").otherwise("ok")
    return items, every.select("source_id", status.alias("status"), "error", F.coalesce("n_raw", F.lit(0)).alias("n_raw"))


def page_date(html: Column) -> Column:
    """The date a page gives itself: structured data, then its meta elements."""
    ld = F.regexp_extract(html, r"(?is)\"(?:datePublished|dateCreated)\"\s*:\s*\"([^\"]+)\"", 1)
    meta = lambda key: first_of(F.regexp_extract(html, rf"(?is)<meta[^>]*(?:property|name|itemprop)\s*=\s*[\"']{key}[\"'][^>]*content\s*=\s*[\"']([^\"']+)", 1), F.regexp_extract(html, rf"(?is)<meta[^>]*content\s*=\s*[\"']([^\"']+)[\"'][^>]*(?:property|name|itemprop)\s*=\s*[\"']{key}[\"']", 1))
    return parse_date(first_of(ld, meta("article:published_time"), meta("datePublished"), meta("date")))
