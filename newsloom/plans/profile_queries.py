"""Queries on corpus profiles."""

from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import text as X
from newsloom.operators import filters, profiling, ranking, schema as S
from newsloom.plans import sql as Q
from newsloom.plans.registry import query
from newsloom.plans.tables import RAW_ARTICLES_SQL, SOURCE_NUMBER, corpus, documents, messy, outlet_of, outlet_sql, raw_articles, table

_FILLED = f"{Q.strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} <> ''"


@query("count_nonempty", f"SELECT count(*) FILTER ({_FILLED}) AS n_nonempty FROM {Q.MESSY}")
def count_nonempty(spark, sf):
    return profiling.count_nonempty(messy(spark, sf))


@query("dataset_has_text", f"SELECT count(*) FILTER ({_FILLED}) / count(*) >= 0.1 AS has_text FROM {Q.MESSY}")
def dataset_has_text(spark, sf):
    return profiling.has_text(messy(spark, sf))


@query(
    "profile_report",
    f"""SELECT 'full_text' AS dataset_mode, count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns, TRUE AS has_text_column,
 count(*) FILTER (body <> '') > 0 AS has_usable_text, count(*) FILTER (body <> '') AS non_empty_text_rows,
 '' AS missing_metadata_columns, '' AS missing_fulltext_columns, count(DISTINCT publisher) AS n_sources,
 min(try_cast(wc AS DOUBLE)) AS min_words, max(try_cast(wc AS DOUBLE)) AS max_words, round(avg(try_cast(wc AS DOUBLE)), 6) AS mean_words
 FROM ({RAW_ARTICLES_SQL})""",
)
def profile_report(spark, sf):
    return profiling.profile_report(raw_articles(spark, sf)).withColumn("mean_words", F.round("mean_words", 6))


_LABELLED = "(SELECT d.doc_id, text, source, quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _labelled(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf, "documents").select("doc_id", "text", "source").join(labels, "doc_id", "left")


@query(
    "label_distribution",
    f"SELECT coalesce(CAST(label AS VARCHAR), 'missing') AS label, count(*) AS n FROM {_LABELLED} GROUP BY 1",
)
def label_distribution(spark, sf):
    counts = profiling.label_distribution(_labelled(spark, sf))
    return counts.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("missing")))


@query("label_share", f"SELECT label, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM {Q.CORPUS} GROUP BY 1")
def label_share(spark, sf):
    return profiling.label_share(_labelled(spark, sf)).withColumn("share", F.round("share", 9))


@query(
    "word_count_stats",
    f"SELECT min(try_cast(wc AS DOUBLE)) AS min_words, max(try_cast(wc AS DOUBLE)) AS max_words, round(avg(try_cast(wc AS DOUBLE)), 6) AS mean_words FROM ({RAW_ARTICLES_SQL})",
)
def word_count_stats(spark, sf):
    return profiling.word_count_stats(raw_articles(spark, sf), "wc").withColumn("mean_words", F.round("mean_words", 6))


@query("source_summary", f"SELECT publisher AS source, count(*) AS n_rows FROM ({RAW_ARTICLES_SQL}) WHERE publisher IS NOT NULL GROUP BY 1")
def source_summary(spark, sf):
    return profiling.source_summary(raw_articles(spark, sf), "publisher")


_LENGTHS = f"(SELECT doc_id, source, label, {Q.n_words('text')} AS n_words FROM {Q.CORPUS})"
_ALL_LENGTHS = f"(SELECT {Q.n_words('text')} AS n_words FROM documents)"


@query(
    "text_length_describe",
    f"""SELECT count(*) AS count, round(avg(n_words), 6) AS mean, round(stddev_samp(n_words), 6) AS std, CAST(min(n_words) AS INT) AS min,
 quantile_cont(n_words, 0.25) AS q25, quantile_cont(n_words, 0.5) AS q50, quantile_cont(n_words, 0.75) AS q75, CAST(max(n_words) AS INT) AS max FROM {_ALL_LENGTHS}""",
)
def text_length_describe(spark, sf):
    out = profiling.length_describe(profiling.length_counts(documents(spark, sf)))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "text_length_hist",
    f"""WITH x AS (SELECT n_words, min(n_words) OVER () AS lo, max(n_words) OVER () AS hi FROM {_ALL_LENGTHS})
 SELECT CAST(least(floor((n_words - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n, CAST(min(n_words) AS INT) AS min_words, CAST(max(n_words) AS INT) AS max_words FROM x GROUP BY 1""",
)
def text_length_hist(spark, sf):
    return profiling.length_histogram(profiling.length_counts(documents(spark, sf)))


@query(
    "text_length_box",
    f"""WITH b AS (SELECT label, quantile_cont(n_words, 0.25) AS q25, quantile_cont(n_words, 0.5) AS q50, quantile_cont(n_words, 0.75) AS q75 FROM {_LENGTHS} GROUP BY 1)
 SELECT label, q25, q50, q75,
  CAST(min(n_words) FILTER (n_words BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS INT) AS whisker_low,
  CAST(max(n_words) FILTER (n_words BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS INT) AS whisker_high,
  count(*) FILTER (n_words NOT BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS n_outliers
 FROM {_LENGTHS} JOIN b USING (label) GROUP BY label, q25, q50, q75""",
)
def text_length_box(spark, sf):
    return profiling.length_box(profiling.length_counts(corpus(spark, sf), by="label"), "label")


@query(
    "top_terms",
    f"SELECT term, count(*) AS n FROM (SELECT unnest({Q.tokens('text')}) AS term FROM documents) WHERE term NOT IN ({Q.strings(K.STOP_WORDS)}) GROUP BY 1 ORDER BY n DESC, term LIMIT 20",
)
def top_terms(spark, sf):
    return profiling.top_terms(table(spark, sf, "documents"))


_OUTLET = outlet_sql("CAST(substr(source, 4) AS INT)")
_LEAST = "CASE outlet_name " + " ".join(f"WHEN '{k}' THEN {v[2]}" for k, v in K.OUTLETS.items()) + " END"


@query(
    "collection_stats",
    f"""WITH p AS (SELECT outlet_name, n, n >= {_LEAST} AS kept FROM (SELECT {_OUTLET} AS outlet_name, {Q.n_words('text')} AS n FROM documents))
 SELECT coalesce(outlet_name, 'all') AS outlet_name, count(*) AS n_pages, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_skipped,
 CAST(sum(CASE WHEN kept THEN n ELSE 0 END) AS BIGINT) AS total_words, round(coalesce(avg(CASE WHEN kept THEN n END), 0), 6) AS mean_words,
 round(count(*) FILTER (kept) / count(*), 9) AS success_rate FROM p GROUP BY ROLLUP (outlet_name)""",
)
def collection_stats(spark, sf):
    docs = table(spark, sf, "documents").select(
        outlet_of(SOURCE_NUMBER).alias("outlet"), X.word_count("text").alias("n")
    )
    kept = F.col("n") >= filters.min_words_for(F.col("outlet"))
    return profiling.collection_stats(docs, "outlet", kept, "n").withColumns(
        {
            "outlet_name": F.coalesce("outlet_name", F.lit("all")),
            "mean_words": F.round("mean_words", 6),
            "success_rate": F.round("success_rate", 9),
        }
    )


@query(
    "first_example_per_class",
    f"SELECT label, doc_id, left(text, 500) AS example FROM {Q.CORPUS} QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) = 1",
)
def first_example_per_class(spark, sf):
    return ranking.first_per_class(corpus(spark, sf), "label", "doc_id", "text")
