import json

import pytest
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.operators import filters, profiling, schema as S
from newsloom.sources import articles as A, sitemaps


def test_first_alias_wins_and_order(spark):
    df = spark.createDataFrame([("t", "b", 1)], "title string, body string, extra int")
    out = S.standardize_columns(df)
    assert out.columns == ["headline", "text", "title", "body", "extra"]
    assert S.detect_standard_columns(df)["headline"] == "title"
    assert S.keep_standard_columns(out, ["text"]).columns == ["text", "headline"]


def test_extra_aliases_are_opt_in(spark):
    df = spark.createDataFrame([("x", "2026", "CounterPunch")], "headline string, date_published string, `outlet name` string")
    assert "publication_date" not in S.standardize_columns(df).columns
    wide = S.standardize_columns(df, K.EXTRA_ALIASES)
    assert {"publication_date", "outlet_name"} <= set(wide.columns)


def test_label_words_become_null(spark):
    df = spark.createDataFrame([("h", "o", "left", "12")], "title string, outlet string, label string, wc string")
    row = S.clean_metadata(df).first()
    assert row["label"] is None and row["word_count"] == 12.0
    with pytest.raises(ValueError, match="metadata"):
        S.clean_metadata(df.drop("title"))


def test_encode_labels(spark):
    df = spark.createDataFrame([("Salon ",), ("FoxNews",)], "outlet_name string")
    assert [r["label"] for r in S.encode_labels(df).orderBy("label").collect()] == [0, 1]
    written = spark.createDataFrame([("Fox News",)], "outlet_name string")
    with pytest.raises(ValueError, match="Fox News"):
        S.encode_labels(written)
    assert S.encode_labels(written, synonyms=K.OUTLET_SYNONYMS).first()["label"] == 1
    with pytest.raises(Exception, match="Unknown source"):
        S.encode_labels(written, check=False).collect()


def test_explicit_column_wins(spark):
    rows = [(f"s{i}", f"b{i}", i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "text string, body string, y int")
    out = A.standardize_external(df, text_col="body", label_col="y")
    assert out.columns[:3] == ["text", "label", "outlet_name"] and out.columns.count("text") == 1
    assert {r["text"] for r in out.collect()} == {f"b{i}" for i in range(12)}


@pytest.mark.parametrize(
    "rows, message",
    [
        ([], "empty"),
        ([(" ", 0)] * 20, "have text"),
        ([("a", 0)] * 5, "fewer than"),
        ([("a", None)] * 12, "no label"),
        ([("a", 0)] * 12, "only one class"),
        ([("a", i % 3) for i in range(12)], "Two classes"),
    ],
)
def test_validation_errors(spark, rows, message):
    df = spark.createDataFrame(rows, "text string, label int")
    with pytest.raises(ValueError, match=message):
        filters.validate_text_dataset(df)


def test_blank_rows_and_missing_column(spark):
    df = spark.createDataFrame([("a",), ("  ",), (None,)], "text string")
    assert filters.remove_empty_text(df).count() == 1
    with pytest.raises(ValueError, match="empty"):
        filters.remove_empty_text(df.where("text is null"))
    assert profiling.has_text(df, "nothing").first()["has_text"] is False
    assert profiling.count_nonempty(df, "nothing").first()["n_nonempty"] == 0


def test_json_sources(spark, tmp_path):
    good = tmp_path / "a.json"
    good.write_text(json.dumps([{"id": 1, "meta": {"a": 1}, "tags": ["x"]}]))
    assert A.read_articles(spark, str(good)).columns == ["id", "meta.a", "tags"]
    for name, content, error in (("b.json", "{oops", ValueError), ("c.json", "[]", ValueError), ("d.txt", "[]", ValueError)):
        bad = tmp_path / name
        bad.write_text(content)
        with pytest.raises(error):
            A.read_articles(spark, str(bad))
    with pytest.raises(FileNotFoundError):
        A.read_articles(spark, str(tmp_path / "none.json"))


def test_article_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", "u", "b c", "AlterNet", 2), ("2", "u", None, "Salon", 0)],
        "article_id string, url string, body_text string, outlet_name string, word_count int",
    )
    A.write_articles(A.exportable(df), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert [r["article_id"] for r in back.collect()] == ["1"]


def test_sitemaps(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    (tmp_path / "a.xml").write_text(
        f"<?xml version='1.0'?><urlset {ns}><url><loc> https://a.org/1 </loc><lastmod>2026-01-02T03:04:05Z</lastmod></url>"
        "<url><loc>https://a.org/2</loc><lastmod>soon</lastmod></url><url><loc>https://a.org/3</loc></url></urlset>"
    )
    got = {r["url"]: r["lastmod"] for r in sitemaps.sitemap_entries(spark, str(tmp_path / "a.xml")).collect()}
    assert set(got) == {"https://a.org/1", "https://a.org/2", "https://a.org/3"}
    assert got["https://a.org/1"].isoformat() == "2026-01-02T03:04:05" and got["https://a.org/2"] is None
    (tmp_path / "i.xml").write_text(f"<sitemapindex {ns}><sitemap><loc>https://a.org/s.xml</loc></sitemap></sitemapindex>")
    assert [r["url"] for r in sitemaps.sitemap_children(spark, str(tmp_path / "i.xml")).collect()] == ["https://a.org/s.xml"]
