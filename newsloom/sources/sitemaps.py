"""Sitemap and feed files, read with Spark's XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import dates, text as X, urls as U
from newsloom.sources import scratch

_URL = "loc string, lastmod string"


def sitemap_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(url, lastmod) of every ``<url>``; a missing or unreadable time is null."""
    rows = spark.read.format("xml").option("rowTag", "url").schema(_URL).load(paths)
    return rows.where(X.is_nonempty("loc")).select(
        X.strip("loc").alias("url"), dates.last_modified(X.strip("lastmod")).alias("lastmod")
    )


def sitemap_children(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sitemaps listed by index files, each once."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(paths)
    return rows.where(X.is_nonempty("loc")).select(X.strip("loc").alias("url")).distinct()


def index_entries(stored: DataFrame, roots: DataFrame) -> DataFrame:
    """(url, lastmod) reached from root sitemaps through index files.

    ``stored``: (url, xml) of every sitemap document at hand; ``roots``: (url).
    Indexes are followed level by level, each sitemap once; a level is one join on
    the address, and the walk ends when no index names a sitemap not yet seen.
    """
    children = stored.select(
        "url", F.explode(F.from_xml("xml", "sitemap array<struct<loc:string>>")["sitemap"]).alias("s")
    ).select(F.col("url").alias("parent"), X.strip(F.col("s")["loc"]).alias("url")).where(X.is_nonempty("url")).distinct()
    level = seen = roots.select("url").distinct()
    while True:
        level = scratch.stored(
            children.join(level.select(F.col("url").alias("parent")), "parent", "left_semi").select("url").distinct()
            .join(seen, "url", "left_anti"),
            "sitemap-level",
        )
        if level.isEmpty():
            break
        seen = scratch.stored(seen.union(level), "sitemaps-seen")
    return entries_from_xml(stored.join(seen, "url", "left_semi"), "xml")


def feed_links(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cleaned links of feed items that may be crawled, each once."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("link string").load(paths)
    link = X.strip("link")
    return (
        rows.where(X.is_nonempty("link") & U.is_crawlable(link))
        .select(U.normalize_url(link).alias("url"))
        .distinct()
    )


def entries_from_xml(df: DataFrame, xml_col: str) -> DataFrame:
    """(url, lastmod) of sitemap documents stored in a column.

    The document is one ``<urlset>`` per row.
    """
    parsed = F.from_xml(F.col(xml_col), "url array<struct<loc:string,lastmod:string>>")
    u = F.col("u")
    return (
        df.select(F.explode(parsed["url"]).alias("u"))
        .where(X.is_nonempty(u["loc"]))
        .select(X.strip(u["loc"]).alias("url"), dates.last_modified(X.strip(u["lastmod"])).alias("lastmod"))
    )
