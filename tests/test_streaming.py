from newsloom.streaming import articles


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(" h ", "Salon ", "12", "x"), (" ", "Salon", "1", "x"), ("b", None, "n/a", "y")]
    df = spark.createDataFrame(rows, "title string, outlet string, wc string, other string")
    df.repartition(2).write.json(source)
    stream = articles.read_article_stream(spark, source, df.schema, files_per_batch=1)
    articles.write_clean_metadata(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["headline"], r["outlet_name"], r["word_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("h", "Salon", 12.0), ("b", "", None)}
