"""The given tables, and article-shaped tables derived from all their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import constants as K


#: Pieces of a table for heavy work, for each core of the session.
PIECES_PER_CORE = 3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split_input(df: DataFrame) -> DataFrame:
    """Rows in as many pieces as the setting ``newsloom.input.partitions`` says; unset,
    three for each core.

    Tables may be stored as a few large blocks, which no reader can split: then a few
    tasks would do all the work, whatever the number of machines.
    """
    pieces = df.sparkSession.conf.get("newsloom.input.partitions", None)
    return df.repartition(int(pieces or PIECES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism))


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents for heavy per-row work, only the columns asked for."""
    return split_input(table(spark, folder, "documents").select(*(columns or ("doc_id", "text"))))


def labelled_keys(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Labelled documents without their text: doc_id, label and the columns asked for."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, folder, "documents").select("doc_id", *columns).join(labels, "doc_id")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: doc_id, text, label, source."""
    docs = documents(spark, folder, "doc_id", "text", "source")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


# Text with the blemishes the given documents lack, chosen by the id.
# The same text is both Spark and ANSI SQL.
MESSY_SQL = """CASE doc_id % 9
  WHEN 0 THEN '\u00a0 \t' || chr(10)
  WHEN 1 THEN '\u00a0\u2003' || text || ' \u3000' || chr(10)
  WHEN 2 THEN replace(replace(replace(text, ' the ', ' “the” '), ' of ', ' ‘of’ '), ' and ', ' – ')
  WHEN 3 THEN replace(replace(replace(text, ' the ', ' [the] '), ' of ', ' [...] '), ' and ', ' (Laughter) ')
  WHEN 4 THEN replace(replace(replace(text, 'en', 'e\u200bn'), '. ', '.'), ', ', ' , ')
  WHEN 5 THEN replace(replace(replace(text, ' the ', ' donâ\u0080\u0099t '), ' of ', ' â€™ '), ' and ', ' … ')
  WHEN 6 THEN replace(replace(replace(text, ' the ', ' [BLOCK] '), ' of ', ' [/quote]'), ' and ', ' [A-1] ')
  WHEN 7 THEN NULL
  ELSE 'A ' || replace(replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), ' of ', ' ( of ) '), ' and ', ' — ')
END"""


def messy(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, lang, messy text (null at times)."""
    docs = documents(spark, folder, "doc_id", "source", "lang", "text")
    return docs.select("doc_id", "source", "lang", F.expr(MESSY_SQL).alias("text"))


OUTLET_LIST = tuple(K.OUTLETS)


def outlet_of(number: str):
    """Outlet key by number modulo ten, in the order of the outlet list."""
    names = F.array(*[F.lit(o) for o in OUTLET_LIST])
    return F.get(names, F.pmod(F.expr(number), F.lit(len(OUTLET_LIST))).cast("int"))


def outlet_sql(number: str) -> str:
    listed = ", ".join(f"'{o}'" for o in OUTLET_LIST)
    return f"list_extract([{listed}], CAST(({number}) % {len(OUTLET_LIST)} AS INT) + 1)"


SOURCE_NUMBER = "CAST(substring(source, 4) AS INT)"


def raw_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Article records under aliases instead of standard names."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("https://news.example.org/"), "source", F.lit("/"), F.col("doc_id")).alias("link"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN ' \u00a0' WHEN 1 THEN NULL ELSE ' Story ' || doc_id || ' ' END").alias("title"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN source || ' ' ELSE source END").alias("publisher"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'n/a' ELSE CAST(n_chars AS STRING) END").alias("wc"),
        F.col("quality").cast("string").alias("category"),
        F.col("text").alias("body"),
        "lang",
    )


RAW_ARTICLES_SQL = """
  SELECT CAST(d.doc_id AS VARCHAR) AS id,
         'https://news.example.org/' || source || '/' || d.doc_id AS link,
         CASE d.doc_id % 5 WHEN 0 THEN ' \u00a0' WHEN 1 THEN NULL ELSE ' Story ' || d.doc_id || ' ' END AS title,
         CASE d.doc_id % 3 WHEN 0 THEN source || ' ' ELSE source END AS publisher,
         CASE d.doc_id % 4 WHEN 0 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) END AS wc,
         CAST(quality AS VARCHAR) AS category,
         text AS body, lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


# page markup of each outlet put around the given pages' article
OUTLET_MARKUP = {
    "AlterNet": ('<div class="body-description">', "</div>", '<h1 class="headline">'),
    "CounterPunch": ('<div class="post_content">', "</div>", '<h1 class="headline">'),
    "DailyBeast": ('<div class="b-article-body"><article>', "</article></div>", '<h1 class="b-headline">'),
    "MotherJones": ('<article class="entry-content">', "</article>", '<h1 class="entry-title">'),
    "Salon": ('<section class="article__content">', "</section>", "<h1>"),
    "FoxNews": ("<article>", "</article>", "<h1>"),
    "American_Conservative": ('<div class="o-content">', "</div>", '<h1 class="entry-title">'),
    "American_Spectator": (
        '<div class="post-body"><div class="paywall">', "</div></div>", '<h1 class="entry-title">',
    ),
    "The_Free_Beacon": ('<div class="article-content">', "</div>", "<h1>"),
    "DailyCaller": (
        '<div id="articleContent" dc_data="7">', "</div>",
        '<h1 class="mb-6 xl:mb-10 leading-tight font-oswald font-medium text-3xl md:text-5xl">',
    ),
}


def _dressed(key: str):
    """The given page in one outlet's markup: container, heading, paragraph
    class, a date, and the unclosed first paragraph closed."""
    opening, closing, h1 = OUTLET_MARKUP[key]
    par = '<p class="c-paragraph">' if key == "DailyBeast" else "<p>"
    html = F.regexp_replace("html", "<p><b>([^<]*)<br>", "<p><b>$1</b><br></p>")
    for old, new in (("<article>", opening), ("</article>", closing), ("<h1>", h1), ("<p>", par)):
        html = F.replace(html, F.lit(old), F.lit(new))
    day = F.date_add(F.lit("2024-10-01").cast("date"), (F.col("page_id") % 400).cast("int"))
    meta = F.concat(
        F.lit('<meta property="article:published_time" content="'),
        F.date_format(day, "yyyy-MM-dd"),
        F.lit('T08:00:00Z"></head>'),
    )
    return F.replace(html, F.lit("</head>"), meta)


def dressed_as(spark: SparkSession, folder: str, outlet: str) -> DataFrame:
    """All given pages in the markup of one outlet."""
    pages = split_input(table(spark, folder, "pages"))
    return pages.select("page_id", "url", F.lit(outlet).alias("outlet"), _dressed(outlet).alias("html"))


def outlet_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All given pages, the outlets taken in turn."""
    pages = split_input(table(spark, folder, "pages")).withColumn("outlet", outlet_of("page_id"))
    html = None
    for key in OUTLET_MARKUP:
        branch = F.col("outlet") == key
        html = F.when(branch, _dressed(key)) if html is None else html.when(branch, _dressed(key))
    return pages.select("page_id", "url", "outlet", html.alias("html"))
