"""Queries on stored pages, feeds and article files."""

from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import urls as U
from newsloom.operators import pages as P
from newsloom.plans import sql as Q
from newsloom.plans.registry import query
from newsloom.plans.tables import (
    OUTLET_MARKUP, RAW_ARTICLES_SQL, corpus, outlet_pages, outlet_sql, raw_articles, split_input, table,
)
from newsloom.sources import articles as A, html_nodes, sitemaps
from newsloom.sources.scratch import scratch_folder


def _pages(spark, sf):
    return split_input(table(spark, sf, "pages"))


# --- files in and out ------------------------------------------------------------------


@query("json_articles_scan", RAW_ARTICLES_SQL)
def json_articles_scan(spark, sf):
    rows = raw_articles(spark, sf)
    folder = scratch_folder(spark, "articles")
    rows.write.option("ignoreNullFields", False).json(folder)
    return A.read_articles(spark, folder, schema=rows.schema, json_lines=True)


_OUTLET = outlet_sql("CAST(substr(source, 4) AS INT)")


@query("registry_scan", f"SELECT doc_id, {_OUTLET} AS registered_outlet, text FROM documents")
def registry_scan(spark, sf):
    """Documents written to the registered files of their outlets, read back."""
    from newsloom.plans.tables import SOURCE_NUMBER, outlet_of

    docs = table(spark, sf, "documents").select("doc_id", "text", outlet_of(SOURCE_NUMBER).alias("o"))
    folder = scratch_folder(spark, "registry")
    docs.write.partitionBy("o").json(folder)
    files = {outlet: f"o={outlet}" for outlet in K.DATASET_FILES}
    return A.read_registry(
        spark, folder, files, schema="doc_id bigint, text string", json_lines=True
    ).select("doc_id", "registered_outlet", "text")


@query(
    "fulltext_load",
    f"SELECT {Q.strip('text')} AS text, CAST(label AS BIGINT) AS label, source AS outlet_name, CAST(doc_id AS VARCHAR) AS article_id FROM {Q.CORPUS}",
)
def fulltext_load(spark, sf):
    folder = scratch_folder(spark, "corpus")
    corpus(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), "label", "source"
    ).write.json(folder)
    return A.load_fulltext(
        spark, folder, json_lines=True, schema="id string, body string, label bigint, source string"
    )


@query("results_export", f"SELECT source, CAST(label AS INT) AS label, count(*) AS n FROM {Q.CORPUS} GROUP BY ALL")
def results_export(spark, sf):
    """A result table written as CSV and read back."""
    folder = scratch_folder(spark, "results")
    A.write_results(corpus(spark, sf).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n")), folder)
    return spark.read.option("header", True).schema("source string, label int, n bigint").csv(folder)


@query(
    "sitemap_entries",
    "SELECT url, strftime(TIMESTAMP '2026-01-01' + to_days(CAST(page_id % 90 AS INT)), '%Y-%m-%d') AS lastmod FROM pages",
)
def sitemap_entries(spark, sf):
    """All page addresses written as sitemaps and read back."""
    folder = scratch_folder(spark, "sitemap")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 90).cast("int"))
    table(spark, sf, "pages").select(
        F.col("url").alias("loc"), F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'").alias("lastmod")
    ).write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(folder)
    found = sitemaps.sitemap_entries(spark, folder)
    return found.withColumn("lastmod", F.date_format("lastmod", "yyyy-MM-dd"))


@query(
    "rss_links",
    "SELECT DISTINCT 'https://www.theamericanconservative.com' || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS url FROM pages WHERE page_id % 3 <> 0",
)
def rss_links(spark, sf):
    """Feed items on the outlet's site, an about page, or elsewhere."""
    folder = scratch_folder(spark, "feed")
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1)
    site = F.when(F.expr("page_id % 3") == 1, "https://theamericanconservative.com").when(
        F.expr("page_id % 3") == 2, "https://www.theamericanconservative.com"
    ).otherwise("https://www.theamericanconservative.com/about/")
    table(spark, sf, "pages").select(F.concat(site, path).alias("link")).write.format("xml").option(
        "rootTag", "channel"
    ).option("rowTag", "item").save(folder)
    return sitemaps.feed_links(spark, folder)


# --- page trees -----------------------------------------------------------------------------


@query("page_blocks")
def page_blocks(spark, sf):
    return html_nodes.page_blocks(_pages(spark, sf), "page_id")


@query(
    "page_element_counts",
    """SELECT page_id, len(regexp_extract_all(body, '<p>')) AS n_p, len(regexp_extract_all(body, '<a ')) AS n_a, len(regexp_extract_all(body, '<br>')) AS n_br,
 len(regexp_extract_all(body, '<li>')) AS n_li, len(regexp_extract_all(body, '<h1>')) AS n_h1
 FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<style>.*?</style>', '', 'gs') AS body FROM pages)""",
)
def page_element_counts(spark, sf):
    """Elements per page by tag, counted in the page's own row."""
    def n(tag):
        return F.size(F.filter("nodes", lambda x: x["tag"] == tag)).cast("long").alias(f"n_{tag}")

    return html_nodes.with_nodes(_pages(spark, sf)).select("page_id", *[n(t) for t in ("p", "a", "br", "li", "h1")])


@query(
    "page_links",
    "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages)",
)
def page_links(spark, sf):
    return P.page_links(_pages(spark, sf))


def unescape(x):
    """The entities the pages use, decoded; some titles are cut before the semicolon."""
    for entity, char in (("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#x27", "''"), ("&amp", "&")):
        x = f"regexp_replace({x}, '{entity};?', '{char}', 'g')"
    return x


_H1 = unescape(Q.strip(chr(114) + 'egexp_extract(html, ' + chr(39) + '<h1>([^<]*)</h1>' + chr(39) + ', 1)'))


@query(
    "page_headline",
    f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'A headline of some length, ' || page_id WHEN length({_H1}) > 10 THEN {_H1} END AS headline FROM pages""",
)
def page_headline(spark, sf):
    """First element of the outlet's list that is there and long enough: a hero
    title too short to count, or long enough, is put before each page's own."""
    title = F.when(F.expr("page_id % 3") == 0, F.concat(F.lit("A headline of some length, "), F.col("page_id"))).when(
        F.expr("page_id % 3") == 1, F.lit("Ten chars.")
    )
    hero = F.concat(F.lit('<h2 class="c-hero-article__title">'), title, F.lit("</h2><article>"))
    pages = _pages(spark, sf).withColumn(
        "html", F.when(title.isNotNull(), F.replace("html", F.lit("<article>"), hero)).otherwise(F.col("html"))
    )
    found = P.headline(P.RULES["American_Conservative"])
    return html_nodes.with_nodes(pages).select("page_id", found.alias("headline"))


_ARTICLE_OUTLETS = [k for k, (o, _, h) in OUTLET_MARKUP.items() if "<article" in o or "o-content" in o]


@query(
    "page_type",
    f"SELECT page_id, CASE WHEN {outlet_sql('page_id')} IN ({Q.strings(_ARTICLE_OUTLETS)}) THEN 'article' ELSE 'listing' END AS page_type FROM pages",
)
def page_type(spark, sf):
    return html_nodes.with_nodes(outlet_pages(spark, sf)).select("page_id", P.page_type().alias("page_type"))


@query(
    "drop_walled_pages",
    "SELECT page_id FROM pages WHERE page_id % 8 NOT IN (1, 2, 3, 4, 5)",
)
def drop_walled_pages(spark, sf):
    """Pages with a wall of each kind put before their footer."""
    wall = (
        F.when(F.expr("page_id % 8") == 1, '<div id="paywallFluent"></div>')
        .when(F.expr("page_id % 8") == 2, '<div id="paywall" style="display: block"></div>')
        .when(F.expr("page_id % 8") == 3, '<div id="paywall"><p>Already have an <b>account</b>?</p></div>')
        .when(F.expr("page_id % 8") == 4, '<div class="x zephr-registration-form"></div>')
        .when(F.expr("page_id % 8") == 5, '<div class="regwall-main">Register below to read</div>')
        .when(F.expr("page_id % 8") == 6, '<div id="paywall" style="display: none"></div>')
        .otherwise('<div class="regwall-main">Welcome</div>')
    )
    walled = _pages(spark, sf).withColumn("html", F.replace("html", F.lit("<footer>"), F.concat(wall, F.lit("<footer>"))))
    return P.drop_walled(html_nodes.with_nodes(walled)).select("page_id")


# --- articles from pages ----------------------------------------------------------------------

# the body as SQL sees it: paragraphs of the article element, tags taken out
_INNER = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"
_CLOSED = f"regexp_replace({_INNER}, '<p><b>([^<]*)<br>', '<p>\\1</p>', 'g')"
_PARS = f"list_transform(regexp_extract_all({_CLOSED}, '<p>([^<]*)</p>', 1), lambda x: {unescape(Q.strip('x'))})"
_BROAD = Q.replaced("x", K.CHARS_BROADSHEET)
_DC_KEEP = f"lambda p: p <> '' AND NOT {Q.any_of('contains(lower(p), {v})', K.DAILYCALLER_PHRASES)}"
_DC = f"list_filter(list_transform({_PARS}, lambda x: {_BROAD}), {_DC_KEEP})"


@query(
    "pages_article_text",
    f"""SELECT page_id, body_text, CAST({Q.n_words('body_text')} AS INT) AS word_count
 FROM (SELECT page_id, array_to_string({_DC}, chr(10) || chr(10)) AS body_text FROM pages)""",
)
def pages_article_text(spark, sf):
    """Every page as one outlet's page: body text and its words."""
    from newsloom.plans.tables import dressed_as

    parsed = P.parsed_pages(dressed_as(spark, sf, "DailyCaller"), ("DailyCaller",))
    return parsed.select("page_id", "body_text", "word_count")


@query("pages_parsed")
def pages_parsed(spark, sf):
    """Every page under its outlet's rules, with the verdict."""
    return P.parsed_pages(outlet_pages(spark, sf))


@query("pages_articles")
def pages_articles(spark, sf):
    """Accepted articles of all outlets, as article files hold them."""
    return P.articles(outlet_pages(spark, sf), F.lit("2026-04-10T00:00:00Z"))


@query(
    "listing_links",
    """SELECT DISTINCT unnest(regexp_extract_all(nav, '<a href="([^"]*)"', 1)) AS url FROM
 (SELECT unnest(regexp_extract_all(html, '<nav>(.*?)</nav>', 1, 's')) AS nav FROM pages)""",
)
def listing_links(spark, sf):
    """Links inside the navigation lists of all pages."""
    return P.listing_links(_pages(spark, sf), P.El("nav"))



# --- links found on listing pages ---------------------------------------------------------------

_SLUG = "regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1)"
_LISTED_PAGES = f"(SELECT page_id, {_SLUG} || '-' || (page_id % 50) AS slug, page_id % 5 AS kind FROM pages)"


def _listing_pages(spark, sf):
    """Every page as a listing of one of the outlets, with links to keep and not to."""
    slug = F.concat(U.slug("url"), F.lit("-"), F.expr("page_id % 50").cast("string"))
    kind = F.expr("page_id % 5")
    a = lambda *href: F.concat(F.lit('<a href="'), *href, F.lit('">x</a>'))
    lit = F.lit
    html = (
        F.when(kind == 0, F.concat(
            lit('<ul class="articles-list"><li>'), a(lit("https://www.motherjones.com/politics/2026/03/"), slug, lit("/?s=1")),
            a(lit("https://www.motherjones.com/food/2026/03/"), slug), a(lit("/politics/2026/03/"), slug), lit("</li></ul>"),
            a(lit("https://www.motherjones.com/politics/2026/04/"), slug)))
        .when(kind == 1, F.concat(
            lit('<div id="post-1" class="big post_box"><h1 class="headline">'), a(lit("https://www.counterpunch.org/2026/03/09/"), slug, lit("/")),
            lit("</h1>"), a(lit("https://www.counterpunch.org/2026/03/10/"), slug), lit('</div><h1 class="headline">'),
            a(lit("https://www.counterpunch.org/2026/03/11/"), slug), lit("</h1>")))
        .when(kind == 2, F.concat(
            lit('<div class="grid-article">'), a(lit("https://www.salon.com/2026/03/09/"), slug, lit("?u=2")),
            a(lit("https://www.salon.com/2026/03/10/"), slug), lit('</div><div class="grid-article">'), a(lit("/2026/03/11/"), slug), lit("</div>")))
        .when(kind == 3, F.concat(
            a(lit("../../2026/./"), slug, lit("/?p=1#top")), a(lit("mailto:x@y.org")), a(lit("/about/")), a(lit("https://elsewhere.org/2026/"), slug)))
        .otherwise(F.concat(lit("<ul>"), a(lit("https://www.foxnews.com/"), slug), lit("</ul>")))
    )
    outlets = F.array(*[lit(o) for o in (*P.DISCOVERING, "FoxNews")])
    return _pages(spark, sf).select(
        lit("https://www.theamericanconservative.com/category/a/b").alias("url"),
        F.get(outlets, kind.cast("int")).alias("outlet"), F.concat(lit("<html><body>"), html, lit("</body></html>")).alias("html"),
    )


@query(
    "discovered_links",
    f"""SELECT DISTINCT * FROM (SELECT CASE kind WHEN 0 THEN 'MotherJones' WHEN 1 THEN 'CounterPunch' WHEN 2 THEN 'Salon' ELSE 'American_Conservative' END AS outlet,
 CASE kind WHEN 0 THEN 'https://www.motherjones.com/politics/2026/03/' || slug || '/' WHEN 1 THEN 'https://www.counterpunch.org/2026/03/09/' || slug || '/'
 WHEN 2 THEN 'https://www.salon.com/2026/03/09/' || slug ELSE 'https://www.theamericanconservative.com/2026/' || slug END AS url
 FROM {_LISTED_PAGES} WHERE kind < 4) WHERE url NOT IN (SELECT 'https://www.salon.com/2026/03/09/' || slug FROM {_LISTED_PAGES} WHERE page_id % 10 = 7)
 UNION SELECT 'American_Conservative', 'https://www.theamericanconservative.com/about' FROM pages WHERE page_id % 5 = 3""",
)
def discovered_links(spark, sf):
    """New article links of all listing pages, under each outlet's own rules."""
    seen = table(spark, sf, "pages").where("page_id % 10 = 7").select(
        F.concat(F.lit("https://www.salon.com/2026/03/09/"), U.slug("url"), F.lit("-"), F.expr("page_id % 50").cast("string")).alias("url")
    )
    return P.discovered_links(_listing_pages(spark, sf), seen)


@query(
    "sitemap_index",
    """SELECT url, strftime(TIMESTAMP '2026-01-01' + to_days(CAST(page_id % 90 AS INT)), '%Y-%m-%d') AS lastmod FROM pages WHERE page_id % 7 < 5""",
)
def sitemap_index(spark, sf):
    """All pages in seven stored sitemaps; a root index names two indexes, which name
    five of the sitemaps, some of them twice, and the root again."""
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 90).cast("int"))
    entry = F.concat(
        F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc><lastmod>"),
        F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'"), F.lit("</lastmod></url>"),
    )
    # a stored sitemap document holds a bounded stretch of the pages
    number = F.concat(F.expr("page_id % 7").cast("string"), F.lit("/"), F.floor(F.col("page_id") / 700).cast("string"))
    maps = table(spark, sf, "pages").groupBy(F.concat(F.lit("https://x.org/map/"), number).alias("url")).agg(
        F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml")
    )
    named = maps.select("url", F.substring("url", 19, 1).cast("int").alias("k"))
    loc = F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))
    indexes = named.where("k < 5").select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("i"), "k", "url").where(
        "i = 'a' AND k < 3 OR i = 'b' AND k > 1"
    ).groupBy(F.concat(F.lit("https://x.org/index/"), F.col("i")).alias("url")).agg(F.array_join(F.collect_list(loc), "").alias("locs")).select(
        "url", F.concat(F.lit("<sitemapindex><sitemap><loc>https://x.org/root</loc></sitemap>"), F.col("locs"), F.lit("</sitemapindex>")).alias("xml")
    )
    root = spark.createDataFrame(
        [("https://x.org/root", "<sitemapindex><sitemap><loc>https://x.org/index/a</loc></sitemap><sitemap><loc>https://x.org/index/b</loc></sitemap></sitemapindex>")],
        "url string, xml string",
    )
    from newsloom.sources.scratch import stored

    documents = stored(maps.union(indexes).union(root), "sitemap-documents")
    found = sitemaps.index_entries(documents, root.select("url"))
    return found.withColumn("lastmod", F.date_format("lastmod", "yyyy-MM-dd"))
