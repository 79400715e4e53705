"""Queries on URLs, link sets, order and dates."""

from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import dates, urls as U
from newsloom.operators import ranking
from newsloom.plans import sql as Q
from newsloom.plans.registry import query
from newsloom.plans.tables import outlet_of, outlet_sql, table

_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(
    "url_slug",
    f"SELECT page_id, regexp_extract(rtrim({_PATH}, '/'), '([^/]*)$', 1) AS slug, translate(regexp_extract(rtrim({_PATH}, '/'), '([^/]*)$', 1), '-', '_') AS slug_underscored FROM pages",
)
def url_slug(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", U.slug("url").alias("slug"), U.slug_underscored("url").alias("slug_underscored")
    )


@query("slug_sha256", f"SELECT page_id, sha256(regexp_extract(trim({_PATH}, '/'), '([^/]*)$', 1)) AS id FROM pages")
def slug_sha256(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.slug_sha256("url").alias("id"))


# the given addresses, moved to the outlets' sites in turn; all paths kept
_MOVED = f"""CASE page_id % 6
 WHEN 0 THEN 'https://theamericanconservative.com' || {_PATH} || '?p=1#top'
 WHEN 1 THEN 'https://www.theamericanconservative.com/category' || {_PATH}
 WHEN 2 THEN 'https://spectator.org' || {_PATH} || '-ep-' || page_id
 WHEN 3 THEN 'https://freebeacon.com' || {_PATH}
 WHEN 4 THEN 'https://www.salon.com/2026/03/' || (10 + page_id % 20) || {_PATH} || '?utm=x'
 ELSE url END"""
_MOVED_SPARK = _MOVED.replace(_PATH, "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)")


def _moved(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.expr(_MOVED_SPARK).alias("url"))


_FLAT = f"rtrim(regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || {_PATH}, '/')"
_NORMAL = (
    f"CASE WHEN starts_with({_FLAT}, '{K.CONSERVATIVE_BARE_ORIGIN}') THEN replace({_FLAT}, '{K.CONSERVATIVE_BARE_ORIGIN}', '{K.CONSERVATIVE_ORIGIN}') ELSE {_FLAT} END"
)
_M = f"(SELECT page_id, {_MOVED} AS url FROM pages)"


@query("normalize_url", f"SELECT page_id, {_NORMAL} AS url FROM {_M}")
def normalize_url(spark, sf):
    return _moved(spark, sf).select("page_id", U.normalize_url("url").alias("url"))


@query("drop_query", f"SELECT page_id, split_part(url, '?', 1) AS url FROM {_M}")
def drop_query(spark, sf):
    return _moved(spark, sf).select("page_id", U.drop_query("url").alias("url"))


_CRAWL = f"""(starts_with(url, '{K.CONSERVATIVE_ORIGIN}') AND ends_with({_HOST}, '{K.CONSERVATIVE_DOMAIN}') AND {_PATH} NOT IN ('', '/')
 AND NOT {Q.any_of('contains(url, {v})', K.EXCLUDED_URL_PARTS)}
 AND ({Q.any_of('contains(url, {v})', K.LISTING_URL_PARTS)} OR NOT {Q.any_of('ends_with(lower(' + _PATH + '), {v})', K.FILE_EXTENSIONS)})
 AND NOT {Q.any_of('ends_with(lower(url), {v})', K.FILE_EXTENSIONS)})"""
_BLOCKED = f"""({Q.any_of(f'(lower({_HOST}) = {{v}} OR ends_with(lower({_HOST}), concat(chr(46), {{v}})))', K.BLOCKED_DOMAINS)}
 OR {Q.any_of(f'starts_with(lower({_PATH}), {{v}})', K.BLOCKED_PATHS)} OR regexp_matches(lower(url), '{K.BLOCKED_URL_PATTERN}'))"""
_SEGMENTS = f"list_filter(string_split({_PATH}, '/'), lambda s: s <> '')"
_SECTION = f"""({_HOST} = '{K.BEACON_DOMAIN}' AND len({_SEGMENTS}) >= 2 AND {_SEGMENTS}[1] NOT IN ({Q.strings(K.BEACON_SECTIONS_DENIED)})
 AND NOT {Q.any_of('contains(url, {v})', K.BEACON_EXCLUDED)})"""


@query(
    "url_admission",
    f"""SELECT m.page_id, c.ok AS crawlable, {_BLOCKED} AS blocked, {_SECTION} AS section_article,
 (starts_with(url, '{K.SALON_ORIGIN}') AND regexp_matches(url, '{K.SALON_DATED_PATH}')) AS dated_article
 FROM {_M} m JOIN (SELECT page_id, {_CRAWL} AS ok FROM (SELECT page_id, {_NORMAL} AS url FROM {_M})) c ON m.page_id = c.page_id""",
)
def url_admission(spark, sf):
    return _moved(spark, sf).select(
        "page_id",
        U.is_crawlable("url").alias("crawlable"),
        U.is_blocked("url").alias("blocked"),
        U.is_section_article("url").alias("section_article"),
        U.is_dated_article("url", K.SALON_DATED_PATH, K.SALON_ORIGIN).alias("dated_article"),
    )


# visits: every event is a visit to a page, so addresses repeat heavily
_VISITS = """(SELECT 'https://news.example.org/' || event_type || '/' || (user_id % 97) AS url,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS lastmod, event_id FROM events)"""


def _visits(spark, sf):
    lastmod = F.when(F.expr("event_id % 11") != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return table(spark, sf, "events").select(
        F.expr("'https://news.example.org/' || event_type || '/' || (user_id % 97)").alias("url"),
        lastmod.alias("lastmod"),
        "event_id",
    )


@query("freshest_urls", f"SELECT url, coalesce(lastmod, '') AS lastmod, event_id FROM {_VISITS} ORDER BY lastmod DESC NULLS LAST, url")
def freshest_urls(spark, sf):
    return ranking.freshest_first(_visits(spark, sf), "lastmod", "url").na.fill({"lastmod": ""})


@query(
    "dedupe_first_seen",
    f"SELECT url, coalesce(lastmod, '') AS lastmod, event_id FROM {_VISITS} QUALIFY row_number() OVER (PARTITION BY url ORDER BY lastmod DESC NULLS LAST, event_id DESC) = 1",
)
def dedupe_first_seen(spark, sf):
    return ranking.first_seen(_visits(spark, sf), "url", "lastmod", "event_id").na.fill({"lastmod": ""})


@query(
    "cap_per_source",
    f"""SELECT o_orderkey, outlet_name FROM (SELECT o_orderkey, o_orderdate, {outlet_sql('o_custkey')} AS outlet_name FROM orders)
 QUALIFY row_number() OVER (PARTITION BY outlet_name ORDER BY o_orderdate, o_orderkey) <= 200""",
)
def cap_per_source(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", outlet_of("o_custkey").alias("outlet_name"))
    return ranking.cap_per_source(rows, "outlet_name", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("url_union", f"SELECT DISTINCT url FROM (SELECT url FROM pages UNION SELECT url FROM {_M} UNION SELECT url FROM {_VISITS})")
def url_union(spark, sf):
    return ranking.union_links(table(spark, sf, "pages"), _moved(spark, sf), _visits(spark, sf))


@query("new_urls", f"SELECT page_id, url FROM {_M} WHERE url NOT IN (SELECT url FROM pages)")
def new_urls(spark, sf):
    return ranking.unseen(_moved(spark, sf), table(spark, sf, "pages")).select("page_id", "url")


# order dates written the way bylines write them


@query("parse_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso_date FROM orders")
def parse_dates(spark, sf):
    d, kind = F.col("o_orderdate"), F.expr("o_orderkey % 5")
    written = (
        F.when(kind == 0, F.date_format(d, "MMMM d, yyyy"))
        .when(kind == 1, F.date_format(d, "MMM d, yyyy"))
        .when(kind == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(kind == 3, F.date_format(d, "MM/dd/yyyy"))
        .otherwise("yesterday")
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", F.coalesce(dates.byline_date(written), F.lit("")).alias("iso_date")
    )


@query(
    "meta_dates",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS meta_date, CASE WHEN o_orderkey % 3 = 2 THEN 'c. ' || year(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso_or_text FROM orders",
)
def meta_dates(spark, sf):
    d, kind = F.col("o_orderdate"), F.expr("o_orderkey % 3")
    full = F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    meta = F.when(kind == 0, full).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm"))
    text = F.when(kind == 2, F.concat(F.lit(" c. "), F.year(d).cast("string"), F.lit(" "))).otherwise(full)
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.meta_date(meta).alias("meta_date"), dates.iso_or_text_date(text).alias("iso_or_text")
    )


@query(
    "published_utc",
    """WITH e AS (SELECT event_id, date_trunc('minute', ts) AS t, event_id % 5 AS k FROM events)
 SELECT event_id, strftime(timezone('UTC', timezone('US/Eastern', t)), '%Y-%m-%dT%H:%M:%S+00:00') AS eastern,
 strftime(timezone('UTC', timezone(CASE k WHEN 1 THEN 'US/Eastern' WHEN 2 THEN 'US/Pacific' WHEN 3 THEN 'US/Central' WHEN 4 THEN 'US/Mountain' ELSE 'US/Eastern' END, t)),
 '%Y-%m-%dT%H:%M:%S+00:00') AS suffixed FROM e""",
)
def published_utc(spark, sf):
    minute = F.date_trunc("minute", F.col("ts"))
    kind = F.expr("event_id % 5")
    suffix = F.when(kind == 1, " EST").when(kind == 2, " PDT").when(kind == 3, " CST").when(kind == 4, " MDT").otherwise("")
    gap = F.when(F.expr("event_id % 2") == 0, " ").otherwise("")
    eastern = F.concat(F.date_format(minute, "MMMM d, yyyy h:mm a"), F.lit(" ET"))
    short = F.concat(F.date_format(minute, "MMM. d yyyy"), gap, F.date_format(minute, "h:mma"), suffix)
    return table(spark, sf, "events").select(
        "event_id", dates.eastern_to_utc(eastern).alias("eastern"), dates.suffixed_to_utc(short).alias("suffixed")
    )
