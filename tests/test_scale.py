import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.features import linguistic, sentiment
from newsloom.functions import text as X
from newsloom.operators import filters
from newsloom.plans.tables import split_input
from newsloom.sources import html_nodes
from newsloom.sources.scratch import BATCH_BYTES


def _odd_texts(n=300):
    some = X.WS_CHARS + "aB,'_-9é.​\x00\x7f\x84\x86\U0001d400"
    draw = random.Random(5)
    return ["".join(draw.choice(some) for _ in range(draw.randrange(30))) for _ in range(n)] + ["", " ", None]


def test_words_and_bare_words_match_their_patterns(spark):
    df = spark.createDataFrame([(t,) for t in _odd_texts()], "text string")
    ws = F.regexp_extract_all(X.as_text("text"), F.lit(f"({X.NOT_WS}+)"), F.lit(1))
    stripped = F.transform(ws, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    bare = F.filter(stripped, lambda w: F.length(w) > 1)
    found = df.select(
        ws.alias("w"), X.words("text").alias("words"), X.word_count("text").alias("n"),
        bare.alias("b"), sentiment._bare_words(X.as_text("text")).alias("bare"),
    ).collect()
    assert all(r["w"] == r["words"] and len(r["w"]) == r["n"] and r["b"] == r["bare"] for r in found)


def test_word_class_by_ending(spark):
    tokens = ["sadly", "ly", "edify", "baked", "useful", "al", "l", "", "éal", "9ly", "can", "dog", "-", "12", "٣"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    pos = [r[0] for r in df.select(linguistic.coarse_pos(F.col("t"))).collect()]
    assert pos == ["ADV", "ADV", "VERB", "VERB", "ADJ", "ADJ", "NOUN", "NOUN", "ADJ", "NUM", "AUX", "NOUN", "PUNCT", "NUM", "NUM"]


def test_sentiment_of_a_lexicon_in_the_row_equals_the_table(spark):
    lexicon = {"good": 2.0, "bad": -1.5, "Fine": 1.0}
    texts = ["very GOOD day, but not bad!", "isn't bad bad", "", None, "GOOD BAD", "so so good"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    table = spark.createDataFrame(list(lexicon.items()), "token string, valence double")
    rounded = [F.round(c, 9).alias(c) for c in sentiment.SENTIMENT_COLUMNS]
    inside = sentiment.with_sentiment(df, lexicon=lexicon).select("doc_id", *rounded)
    joined = sentiment.lexicon_sentiment(df, "doc_id", lexicon=table).select("doc_id", *rounded)
    assert sorted(inside.collect()) == sorted(joined.collect())


def test_input_is_split_without_a_setting(spark, tmp_path):
    """One file of one block must not leave one task with all the work."""
    spark.createDataFrame([(k, "a b c") for k in range(200)], "doc_id int, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("newsloom.input.partitions")
    spark.conf.unset("newsloom.input.partitions")
    try:
        split = split_input(spark.read.parquet(str(tmp_path / "d")))
        rows = split.withColumn("outlet_name", F.lit("Salon"))
        per = rows.groupBy(F.spark_partition_id()).count().collect()
        plan = filters.min_words_by_source(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("newsloom.input.partitions", before)
    assert len(per) >= spark.sparkContext.defaultParallelism
    # words are counted after the rows were dealt out
    assert re.search(r"(?s)size\(array_remove.*Exchange", plan) and not re.search(r"(?s)Exchange.*array_remove", plan)


def test_batches_to_python_are_bounded(spark):
    """Whatever a page's size: a worker gets a few megabytes at a time."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    html = F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 20_000), F.lit("</p>"))
    pages = spark.range(200).coalesce(1).select(F.col("id").alias("page_id"), html.alias("html"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"page_id": pa.array([batch.nbytes], pa.int64())})

    assert html_nodes.with_nodes(pages).where(F.size("strings") == 1).count() == 200
    largest = pages.mapInArrow(sizes, "page_id long").agg(F.max("page_id")).first()[0]
    assert largest <= BATCH_BYTES + 300_000


def test_unicode_form_goes_row_by_row(spark):
    df = spark.createDataFrame([("é", "NFC"), ("ﬁ", "NFKC"), ("ﬁ", None), (None, "NFC"), ("a", "NFC")], "t string, f string")
    formed = df.select(X.unicode_form("t", F.col("f")).alias("x"))
    assert [r["x"] for r in formed.collect()] == ["é", "fi", "ﬁ", None, "a"]
    assert "BatchEvalPython" in formed._jdf.queryExecution().executedPlan().toString()
