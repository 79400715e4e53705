"""Queries on schema operators, sources and row filters."""

from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import dates, text as X
from newsloom.functions.wrappers import drop_wrappers
from newsloom.operators import filters, schema as S
from newsloom.plans import sql as Q
from newsloom.plans.registry import query
from newsloom.plans.tables import (
    RAW_ARTICLES_SQL, SOURCE_NUMBER, corpus, documents, messy, outlet_of, outlet_sql, raw_articles, table,
)
from newsloom.sources import articles as A

_RENAMED = "id AS article_id, link AS url, title AS headline, publisher AS outlet_name, wc AS word_count, category AS label, body AS text"


@query(
    "standardize_columns",
    f"SELECT {_RENAMED}, id, link, title, publisher, wc, category, body, lang FROM ({RAW_ARTICLES_SQL})",
)
def standardize_columns(spark, sf):
    return S.standardize_columns(raw_articles(spark, sf))


_FOUND = {
    "article_id": "id", "url": "link", "headline": "title", "publication_date": "", "outlet_name": "publisher",
    "word_count": "wc", "label": "category", "crawl_timestamp": "", "text": "body",
}


@query(
    "detected_columns",
    f"WITH r AS ({RAW_ARTICLES_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{std}' AS standard_column, '{col}' AS matched_column, "
        f"count({col or 'NULL'}) AS filled_values FROM r"
        for std, col in _FOUND.items()
    ),
)
def detected_columns(spark, sf):
    return S.detection_report(raw_articles(spark, sf))


@query(
    "keep_standard",
    f"SELECT {_RENAMED} FROM ({RAW_ARTICLES_SQL})",
)
def keep_standard(spark, sf):
    return S.keep_standard_columns(S.standardize_columns(raw_articles(spark, sf)), ["text", "label", "outlet_name"])


@query("ensure_source", "SELECT doc_id, n_chars, 'external' AS outlet_name FROM documents")
def ensure_source(spark, sf):
    return S.ensure_source(table(spark, sf, "documents").select("doc_id", "n_chars"))


def _outlet_documents(spark, sf):
    return documents(spark, sf, "doc_id", "source", "text").select(
        "doc_id", F.concat(F.lit(" "), outlet_of(SOURCE_NUMBER), F.lit("\t")).alias("outlet_name"), "text"
    )


_OUTLET = outlet_sql("CAST(substr(source, 4) AS INT)")


@query(
    "encode_labels",
    f"SELECT doc_id, outlet_name, CAST(CASE WHEN outlet_name IN ({Q.strings(K.LEFT_SOURCES)}) THEN 0 ELSE 1 END AS INT) AS label "
    f"FROM (SELECT doc_id, {_OUTLET} AS outlet_name FROM documents)",
)
def encode_labels(spark, sf):
    return S.encode_labels(_outlet_documents(spark, sf).drop("text"))


def _half_known(spark, sf):
    known = F.expr(f"{SOURCE_NUMBER} < 10")
    return table(spark, sf, "documents").select(
        "doc_id", F.when(known, outlet_of(SOURCE_NUMBER)).otherwise(F.col("source")).alias("outlet_name")
    )


_HALF_KNOWN = (
    f"(SELECT doc_id, CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN {_OUTLET} ELSE source END AS outlet_name FROM documents)"
)


@query(
    "unknown_sources",
    f"SELECT outlet_name, count(*) AS n_rows FROM {_HALF_KNOWN} WHERE outlet_name NOT IN ({Q.strings(K.KNOWN_SOURCES)}) GROUP BY 1",
)
def unknown_sources(spark, sf):
    return S.unknown_sources(_half_known(spark, sf))


@query(
    "known_sources",
    f"SELECT k.outlet_name, side, count(h.doc_id) AS n_rows FROM (SELECT unnest([{Q.strings(K.LEFT_SOURCES)}]) AS outlet_name, 'left' AS side "
    f"UNION SELECT unnest([{Q.strings(K.RIGHT_SOURCES)}]), 'right') k LEFT JOIN {_HALF_KNOWN} h USING (outlet_name) GROUP BY 1, 2",
)
def known_sources(spark, sf):
    return S.known_sources(_half_known(spark, sf))


@query("binary_label", "SELECT vec_id, label, CAST(CASE WHEN label < 2 THEN 0 ELSE 1 END AS INT) AS label_binary FROM embeddings")
def binary_label(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", S.binary_label("label").alias("label_binary"))


@query("numeric_coerce", f"SELECT id, try_cast(wc AS DOUBLE) AS word_count, try_cast(category AS DOUBLE) AS label FROM ({RAW_ARTICLES_SQL})")
def numeric_coerce(spark, sf):
    return raw_articles(spark, sf).select(
        "id", X.to_number("wc").alias("word_count"), X.to_number("category").alias("label")
    )


def _text(col):
    return Q.strip(f"coalesce({col}, '')")


@query(
    "clean_metadata",
    f"""SELECT {_text('id')} AS article_id, {_text('link')} AS url, {_text('title')} AS headline, {_text('publisher')} AS outlet_name,
 try_cast(wc AS DOUBLE) AS word_count, try_cast(category AS DOUBLE) AS label, {_text('body')} AS text FROM ({RAW_ARTICLES_SQL})""",
)
def clean_metadata(spark, sf):
    return S.clean_metadata(raw_articles(spark, sf))


@query(
    "external_standardized",
    f"""SELECT lower({Q.strip('text')}) AS text, label, {Q.strip("source || ' '")} AS outlet_name, CAST(doc_id AS VARCHAR) AS article_id
 FROM {Q.CORPUS} WHERE {Q.strip('text')} <> ''""",
)
def external_standardized(spark, sf):
    raw = corpus(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("body"),
        F.col("label").alias("quality_class"),
        F.concat("source", F.lit(" ")).alias("site"),
    )
    return A.standardize_external(raw, "body", "quality_class", "site", lowercase=True)


@query(
    "labeled_corpus",
    "SELECT d.doc_id, text, CAST(CASE WHEN quality * 2 + toxic < 2 THEN 0 ELSE 1 END AS INT) AS label, 'Documents' AS source "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def labeled_corpus(spark, sf):
    classes = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("class"))
    return A.labeled_corpus(table(spark, sf, "documents"), classes, "doc_id", "class", "Documents")


@query(
    "events_props_flatten",
    'SELECT event_id, event_type, CAST(json_extract(props, \'$.k\') AS BIGINT) AS "props.k" FROM events',
)
def events_props_flatten(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "props")
    return A.flatten_json_column(events, "props", "struct<k:bigint>")


@query(
    "null_profile",
    "SELECT unnest(['doc_id','text','lang','source','n_chars','quality','toxic']) AS column_name, "
    "unnest(['bigint','string','string','string','bigint','int','int']) AS data_type, "
    "unnest([count(d.doc_id), count(text), count(lang), count(source), count(n_chars), count(quality), count(toxic)]) AS non_null, "
    "unnest([count(*), count(*), count(*), count(*), count(*), count(*), count(*)]) AS n_rows "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def null_profile(spark, sf):
    from newsloom.operators import profiling

    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return profiling.null_profile(joined)


# --- filters -------------------------------------------------------------------------


@query("nonempty_mask", f"SELECT doc_id, {_text('text')} <> '' AS nonempty FROM {Q.MESSY}")
def nonempty_mask(spark, sf):
    m = messy(spark, sf)
    return m.select("doc_id", filters.nonempty_mask(m).alias("nonempty"))


@query("remove_empty_text", f"SELECT doc_id, text FROM {Q.MESSY} WHERE {_text('text')} <> ''")
def remove_empty_text(spark, sf):
    return filters.remove_empty_text(messy(spark, sf).select("doc_id", "text"))


@query(
    "removed_text_counts",
    f"SELECT count(*) AS n_rows, count(*) FILTER ({_text('text')} <> '') AS n_kept, count(*) FILTER ({_text('text')} = '') AS n_removed FROM {Q.MESSY}",
)
def removed_text_counts(spark, sf):
    return filters.removed_counts(messy(spark, sf))


_HOLES = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE source END AS headline,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS url, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'a' || doc_id END AS article_id FROM {t}"""


@query(
    "drop_blank_metadata",
    f"SELECT * FROM ({_HOLES.format(t='documents')}) WHERE {_text('headline')} <> '' OR {_text('url')} <> '' OR {_text('article_id')} <> ''",
)
def drop_blank_metadata(spark, sf):
    docs = table(spark, sf, "documents")
    return S.drop_blank_metadata(
        docs.select(
            "doc_id",
            F.expr("CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE source END").alias("headline"),
            F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END").alias("url"),
            F.expr("CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'a' || doc_id END").alias("article_id"),
        )
    )


_MIN_WORDS = "CASE outlet_name " + " ".join(f"WHEN '{k}' THEN {v[2]}" for k, v in K.OUTLETS.items()) + " END"


@query(
    "min_words_by_source",
    f"SELECT doc_id, outlet_name, CAST({Q.n_words('text')} AS INT) AS word_count FROM (SELECT doc_id, {_OUTLET} AS outlet_name, text FROM documents) "
    f"WHERE {Q.n_words('text')} >= {_MIN_WORDS}",
)
def min_words_by_source(spark, sf):
    docs = S.normalize_source(_outlet_documents(spark, sf))
    return filters.min_words_by_source(docs).drop("text")


@query(
    "recent_articles",
    """SELECT o_orderkey, date_text FROM (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN ''
 ELSE strftime(o_orderdate + INTERVAL 28 YEAR, '%Y-%m-%dT%H:%M') END AS date_text FROM orders)
 WHERE coalesce(try_cast(substr(date_text, 1, 10) AS DATE) >= DATE '2025-01-20', FALSE)""",
)
def recent_articles(spark, sf):
    later = F.date_format(F.expr("o_orderdate + INTERVAL 28 YEAR"), "yyyy-MM-dd'T'HH:mm")
    text = F.expr("o_orderkey % 7")
    return (
        table(spark, sf, "orders")
        .select("o_orderkey", F.when(text == 0, "unknown").when(text == 1, "").otherwise(later).alias("date_text"))
        .where(dates.is_recent("date_text"))
    )


@query(
    "validation_report",
    f"""SELECT count(*) AS n_rows, count(*) FILTER (u) AS n_usable, count(*) FILTER (u AND quality IS NULL) AS n_null_labels,
 count(DISTINCT quality) FILTER (u) AS n_classes, count(*) FILTER (u AND o = '') AS n_blank_outlet, count(*) FILTER (NOT u) AS n_removed
 FROM (SELECT quality, {_text('text')} <> '' AS u, CASE WHEN m.doc_id % 4 = 0 THEN '' ELSE source END AS o
 FROM {Q.MESSY} m LEFT JOIN labels l ON m.doc_id = l.doc_id)""",
)
def validation_report(spark, sf):
    outlet = F.expr("CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END")
    df = messy(spark, sf).withColumn("outlet_name", outlet)
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return filters.validation_report(df.join(labels, "doc_id", "left"))


# --- paragraph filters -----------------------------------------------------------------

_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> '')"


@query(
    "paragraph_length_filter",
    f"SELECT doc_id, array_to_string(list_filter({_LINES}, lambda p: {Q.n_words('p')} >= 6 AND length(p) > 50), chr(10)) AS kept FROM documents",
)
def paragraph_length_filter(spark, sf):
    kept = filters.keep_paragraphs(X.lines("text"), min_words=6, min_chars=50)
    return table(spark, sf, "documents").select("doc_id", F.array_join(kept, "\n").alias("kept"))


_LACED = (
    "replace(replace(replace(replace(text, chr(10) || 'T', chr(10) || 'Read more T'), chr(10) || 'A', chr(10) || 'Photo by Getty A'), "
    "chr(10) || 'O', chr(10) || 'Originally published O'), chr(10) || 'R', chr(10) || 'Subscribe R')"
)
_BOILER = " OR ".join(
    [
        Q.any_of(f"starts_with({Q.strip('lower(p)')}, {{v}})", K.DISCLAIMER_PREFIXES),
        Q.any_of("contains(lower(p), {v})", K.SALON_PHRASES),
        Q.any_of("starts_with(lower(p), {v})", K.MOTHERJONES_PREFIXES),
        Q.any_of("contains(lower(p), {v})", K.MOTHERJONES_PHRASES),
        f"regexp_matches(lower(p), '{K.SPECTATOR_PROMO_PATTERN}')",
        Q.any_of("starts_with(lower(p), {v})", K.SPECTATOR_PREFIXES),
        "len(regexp_extract_all(p, '\\p{Lu}')) / greatest(length(p), 1) > 0.6",
        Q.any_of("contains(p, {v})", K.FOX_MARKS),
        Q.any_of("starts_with(p, {v})", K.FOX_PREFIXES),
        Q.any_of("contains(lower(p), {v})", K.FOX_CAPTION_WORDS + K.FOX_JUNK_PHRASES + K.DAILYCALLER_PHRASES),
    ]
)


@query(
    "boilerplate_filter",
    f"SELECT doc_id, array_to_string(list_filter({_LINES}, lambda p: NOT ({_BOILER})), chr(10)) AS kept FROM (SELECT doc_id, {_LACED} AS text FROM documents)",
)
def boilerplate_filter(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.expr(_LACED).alias("text"))
    return docs.select("doc_id", F.array_join(filters.drop_boilerplate(X.lines("text")), "\n").alias("kept"))


_SHOUTED = "CASE doc_id % 3 WHEN 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END"


@query(
    "uppercase_junk_filter",
    f"SELECT doc_id, CAST(len({_LINES}) AS INT) AS n_lines, CAST(len(list_filter({_LINES}, lambda p: len(regexp_extract_all(p, '\\p{{Lu}}')) / greatest(length(p), 1) <= 0.6)) AS INT) AS n_kept "
    f"FROM (SELECT doc_id, {_SHOUTED} AS text FROM documents)",
)
def uppercase_junk_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.lines(F.expr(_SHOUTED)).alias("lines"))
    kept = F.filter("lines", lambda p: X.uppercase_ratio(p) <= K.FOX_UPPERCASE_LIMIT)
    return docs.select("doc_id", F.size("lines").alias("n_lines"), F.size(kept).alias("n_kept"))


# sentences stand in for paragraphs: they are short enough to look like signatures
_SENTENCES = f"list_filter(list_transform(string_split(replace(text, '.', chr(10)), chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> '')"
_W, _CAPS = Q.words("x"), f"len(list_filter({Q.words('x')}, lambda w: regexp_matches(w, '\\A\\p{{Lu}}')))"


@query(
    "signature_filter",
    f"""SELECT doc_id, array_to_string(list_filter(b, lambda x, i: NOT (i > len(b) - 3 AND len({_W}) <= 10 AND (
 ({_CAPS} >= 2 AND contains(x, ',')) OR (len({_W}) BETWEEN 2 AND 4 AND {_CAPS} = len({_W}))))), chr(10)) AS kept
 FROM (SELECT doc_id, {_SENTENCES} AS b FROM (SELECT doc_id, replace(text, ' th', ' Th') AS text FROM documents))""",
)
def signature_filter(spark, sf):
    blocks = X.lines(F.replace(F.replace("text", F.lit(" th"), F.lit(" Th")), F.lit("."), F.lit("\n")))
    return documents(spark, sf).select(
        "doc_id", F.array_join(X.drop_signatures(blocks), "\n").alias("kept")
    )



@query(
    "wrapper_dedup",
    f"""SELECT doc_id, array_to_string(list_filter(b, lambda x: len(list_filter(b, lambda y: length(x) > length(y) AND contains(x, y))) = 0), chr(10)) AS kept
 FROM (SELECT doc_id, {_LINES} AS b FROM documents)""",
)
def wrapper_dedup(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.array_join(drop_wrappers(X.lines("text")), "\n").alias("kept")
    )


@query(
    "dedupe_paragraphs",
    f"""SELECT doc_id, array_to_string(list_filter(b, lambda x, i: list_position(b, x) = i), chr(10)) AS kept
 FROM (SELECT doc_id, {_LINES} AS b FROM (SELECT doc_id, text || chr(10) || text AS text FROM documents))""",
)
def dedupe_paragraphs(spark, sf):
    twice = X.lines(F.concat("text", F.lit("\n"), "text"))
    return documents(spark, sf).select(
        "doc_id", F.array_join(X.distinct_blocks(twice), "\n").alias("kept")
    )


@query(
    "clean_article_export",
    f"""SELECT CAST(doc_id AS VARCHAR) AS article_id, text AS body_text, source AS outlet_name, CAST({Q.n_words('text')} AS BIGINT) AS word_count
 FROM {Q.MESSY} WHERE text IS NOT NULL AND {Q.n_words('text')} > 0""",
)
def clean_article_export(spark, sf):
    rows = messy(spark, sf).select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.col("text").alias("body_text"),
        F.col("source").alias("outlet_name"),
        X.word_count("text").cast("long").alias("word_count"),
    )
    return A.exportable(rows)
