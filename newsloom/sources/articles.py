"""Article files in, article and result files out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from newsloom import constants as K
from newsloom.functions import text as X
from newsloom.operators import filters, schema as S


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested objects become dotted columns; arrays stay as they are."""

    def leaves(fields: Iterable[T.StructField], path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType.fields, here)
            else:
                ref = ".".join("`" + p.replace("`", "``") + "`" for p in here)
                out.append(F.col(ref).alias(".".join(here)))
        return out

    return df.select(*leaves(df.schema.fields, ()))


def flatten_json_column(df: DataFrame, column: str, json_schema: str, prefix: str | None = None) -> DataFrame:
    """A column of JSON text becomes dotted columns beside the others."""
    parsed = df.withColumn(prefix or column, F.from_json(S._q(column), json_schema))
    return flatten_structs(parsed)


def read_articles(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType | str | None = None,
    normalize: bool = True,
    json_lines: bool = False,
) -> DataFrame:
    """JSON arrays of articles.

    ``multiLine`` files are read one per task; give a schema and
    ``json_lines=True`` for large collections, which are then split.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    for p in listed:
        if not p.rstrip("/*").lower().endswith((".json", ".jsonl")) and "." in p.rsplit("/", 1)[-1]:
            raise ValueError(f"Not named like a JSON file: {p}")
    reader = spark.read.option("multiLine", not json_lines).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.json(listed)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"No such file: {paths}") from e
        raise ValueError(f"Not readable as JSON: {paths}") from e
    except Exception as e:
        if "malformed" in str(e).lower() or "MALFORMED" in str(e) or "FAILFAST" in str(e):
            raise ValueError(f"Not readable as JSON: {paths}") from e
        raise
    if not df.columns or df.isEmpty():
        raise ValueError(f"No records in {paths}")
    return flatten_structs(df) if normalize else df


def read_registry(
    spark: SparkSession,
    root: str,
    files: Mapping[str, str] = K.DATASET_FILES,
    schema: T.StructType | str | None = None,
    json_lines: bool = False,
) -> DataFrame:
    """All registered files (or folders of files) in one scan.

    The outlet is found by the path below ``root``, as an equal key: the path of a
    registered file itself, or of the registered folder the file is in.
    """
    root = root.rstrip("/")
    paths = [f"{root}/{p.strip('/')}" for p in files.values()]
    by_place = [(p.strip("/"), outlet) for outlet, p in files.items()]
    reader = spark.read.option("multiLine", not json_lines)
    if schema is not None:
        reader = reader.schema(schema)
    read = reader.json(paths).withColumn("_path", F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")))
    below = F.substring_index(F.col("_path"), f"{root.rsplit('/', 1)[-1]}/", -1)
    dim = spark.createDataFrame(by_place, "_place string, registered_outlet string")
    exact = read.withColumn("_below", below).join(dim, F.col("_below") == F.col("_place"), "left").drop("_place")
    folder = F.regexp_replace("_below", "/[^/]*$", "")
    folders = dim.toDF("_place", "_of_folder")
    both = exact.join(folders, folder == F.col("_place"), "left")
    return both.withColumn("registered_outlet", F.coalesce("registered_outlet", "_of_folder")).drop(
        "_path", "_below", "_place", "_of_folder"
    )


def standardize_external(
    df: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    source_col: str | None = None,
    source_name: str = "external",
    lowercase: bool = False,
    strip_whitespace: bool = True,
    drop_empty_text: bool = True,
    validate: bool = True,
) -> DataFrame:
    """Any labelled table to text, label, outlet_name and other standard columns.

    One lazy plan; validation is a single aggregate over it.
    """
    out = S.standardize_columns(df)
    S.require_columns(out, [text_col, label_col])
    out = S.rename_core_columns(out, text_col, label_col, source_col)
    out = S.ensure_source(out, "outlet_name", source_name)
    out = S.normalize_text(out, "text", lowercase, strip_whitespace)
    if drop_empty_text:
        # the validation below sees an empty result by itself
        out = filters.remove_empty_text(out, "text", check=False)
    out = S.keep_standard_columns(out, ["text", "label", "outlet_name"])
    return filters.validate_text_dataset(out) if validate else out


def load_fulltext(
    spark: SparkSession,
    paths: str | list[str],
    text_column: str = "text",
    label_column: str = "label",
    source_name: str | None = None,
    json_lines: bool = False,
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """Article files to a validated labelled corpus; with a schema they are read once."""
    raw = S.standardize_columns(read_articles(spark, paths, schema=schema, json_lines=json_lines))
    return standardize_external(
        raw, text_column, label_column, "outlet_name", source_name or "external", **options
    )


def labeled_corpus(
    texts: DataFrame, labels: DataFrame, key: str, class_col: str, source_name: str
) -> DataFrame:
    """Labelled texts with a binary label and a constant source."""
    return texts.join(labels, key).select(
        key, "text", S.binary_label(S._q(class_col)).alias("label"), F.lit(source_name).alias("source")
    )


EXPORT_COLUMNS = (
    "article_id", "url", "headline", "body_text", "publication_date",
    "outlet_name", "word_count", "label", "crawl_timestamp",
)


def exportable(df: DataFrame, columns: Iterable[str] = EXPORT_COLUMNS) -> DataFrame:
    """Rows with a body and words, in the column order of article files."""
    names = [c for c in columns if c in df.columns]
    return df.where(F.col("body_text").isNotNull() & (F.col("word_count") > 0)).select(*names)


def write_articles(
    df: DataFrame, path: str, fmt: str = "json", by_outlet: bool = True, mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode)
    if by_outlet:
        writer = writer.partitionBy("outlet_name")
    writer.format(fmt).save(path)


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result tables as CSV with a header, a file per task."""
    df.write.mode(mode).option("header", True).csv(path)


def article_word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("word_count", X.word_count(text_col))
