"""Schema operators: every differing article table onto one set of columns.

All decisions are taken from ``df.columns`` while the plan is built, so none of
these functions starts a job, except where the docstring says so.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import text as X


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def alias_lists(extra_aliases: Mapping[str, Iterable[str]] | None = None) -> dict[str, list[str]]:
    out = {std: list(names) for std, names in K.COLUMN_ALIASES.items()}
    for std, names in (extra_aliases or {}).items():
        out[std] += [n for n in names if n not in out[std]]
    return out


def detect_standard_columns(
    df: DataFrame, extra_aliases: Mapping[str, Iterable[str]] | None = None
) -> dict[str, str | None]:
    """Standard name -> the column that plays its part, or None."""
    have = set(df.columns)
    return {
        std: next((n for n in names if n in have), None)
        for std, names in alias_lists(extra_aliases).items()
    }


def detection_report(df: DataFrame) -> DataFrame:
    """Detected columns with the number of filled values of each, one scan."""
    found = detect_standard_columns(df)
    filled = df.agg(
        *[
            (F.count(_q(col)) if col else F.lit(0).cast("long")).alias(std)
            for std, col in found.items()
        ]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(std).alias("standard_column"),
                F.lit(col or "").alias("matched_column"),
                _q(std).alias("filled_values"),
            )
            for std, col in found.items()
        ]
    )
    return filled.select(F.inline(entries))


def existing_standard_columns(df: DataFrame) -> list[str]:
    have = set(df.columns)
    return [c for c in K.STANDARD_COLUMNS if c in have]


def standardize_columns(
    df: DataFrame, extra_aliases: Mapping[str, Iterable[str]] | None = None
) -> DataFrame:
    """Copy the first alias found to its standard name; standard columns first."""
    found = detect_standard_columns(df, extra_aliases)
    standard = [_q(col).alias(std) for std, col in found.items() if col]
    names = {std for std, col in found.items() if col}
    return df.select(*standard, *[_q(c) for c in df.columns if c not in names])


def keep_standard_columns(df: DataFrame, prioritize: Iterable[str] = ()) -> DataFrame:
    """Only standard columns; those named come first, in the order given."""
    first = [c for c in prioritize if c in df.columns]
    rest = [c for c in existing_standard_columns(df) if c not in first]
    return df.select(*[_q(c) for c in first + rest])


def require_columns(df: DataFrame, names: Iterable[str], what: str = "columns") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing required {what}: {missing}")
    return df


def rename_core_columns(
    df: DataFrame, text_col: str, label_col: str, source_col: str | None = None
) -> DataFrame:
    """Caller's columns become text / label / outlet_name.

    A column named by the caller wins over one of the same standard name.
    """
    wanted = {text_col: "text", label_col: "label"}
    if source_col and source_col in df.columns:
        wanted[source_col] = "outlet_name"
    renames = {old: new for old, new in wanted.items() if old != new}
    return df.drop(*renames.values()).withColumnsRenamed(renames)


def normalize_source(df: DataFrame, source_col: str = "outlet_name") -> DataFrame:
    if source_col not in df.columns:
        return df
    return df.withColumn(source_col, X.normalize_string(_q(source_col)))


def ensure_source(
    df: DataFrame, source_col: str = "outlet_name", default_source: str = "external"
) -> DataFrame:
    """Add a constant source where the column is missing, then normalise it."""
    if source_col not in df.columns:
        df = df.withColumn(source_col, F.lit(default_source))
    return normalize_source(df, source_col)


def normalize_text(
    df: DataFrame, text_col: str = "text", lowercase: bool = False, strip_whitespace: bool = True
) -> DataFrame:
    if text_col not in df.columns:
        raise ValueError(f"Missing text column: '{text_col}'")
    t = X.normalize_string(_q(text_col)) if strip_whitespace else X.as_text(_q(text_col))
    return df.withColumn(text_col, F.lower(t) if lowercase else t)


def binary_label(c: Column | str, threshold: int = 2) -> Column:
    """Classes below the threshold become 0, the others 1."""
    return F.when(X._col(c) < threshold, 0).otherwise(1)


def outlet_dimension(spark: SparkSession) -> DataFrame:
    """Ten rows: outlet key, class, written name and minimum words."""
    rows = [
        (key, 0 if key in K.LEFT_SOURCES else 1, name, side, min_words)
        for key, (name, side, min_words) in K.OUTLETS.items()
    ]
    return spark.createDataFrame(
        rows, "outlet_name string, outlet_label int, written_name string, side string, min_words int"
    )


def _is_known(c: Column) -> Column:
    return c.isin(list(K.KNOWN_SOURCES))


def known_outlet(c: Column, synonyms: Mapping[str, str] | None = None) -> Column:
    """Normalised outlet, written names mapped to keys where asked."""
    out = X.normalize_string(c)
    if synonyms:
        pairs = [F.lit(x) for kv in synonyms.items() for x in kv]
        out = F.coalesce(F.element_at(F.create_map(*pairs), out), out)
    return out


def unknown_sources(df: DataFrame, source_col: str = "outlet_name") -> DataFrame:
    """Outlets outside the known set, with how many rows carry each."""
    return (
        df.groupBy(X.normalize_string(_q(source_col)).alias(source_col))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(~_is_known(_q(source_col)))
    )


def known_sources(df: DataFrame, source_col: str = "outlet_name") -> DataFrame:
    """Union of the two outlet sets with the rows each has in the data."""
    sets = [
        F.array(*[F.struct(F.lit(n).alias("outlet_name"), F.lit(side).alias("side")) for n in names])
        for side, names in (("left", K.LEFT_SOURCES), ("right", K.RIGHT_SOURCES))
    ]
    known = df.sparkSession.range(1).select(F.inline(F.array_union(*sets)))
    seen = df.groupBy(X.normalize_string(_q(source_col)).alias("outlet_name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return known.join(seen, "outlet_name", "left").select(
        "outlet_name", "side", F.coalesce("n", F.lit(0)).alias("n_rows")
    )


def encode_labels(
    df: DataFrame,
    source_col: str = "outlet_name",
    label_col: str = "label",
    synonyms: Mapping[str, str] | None = None,
    check: bool = True,
) -> DataFrame:
    """0 for left outlets, 1 for right ones.

    ``check=True`` runs one job that looks for unknown outlets and raises.
    ``check=False`` stays lazy: the plan itself fails on the first unknown row.
    """
    require_columns(df, [source_col], "source column")
    named = df.withColumn(source_col, known_outlet(_q(source_col), synonyms))
    if check:
        found = unknown_sources(named, source_col).agg(
            F.count(F.lit(1)).alias("n"), F.min(_q(source_col)).alias("first")
        ).first()
        if found["n"]:
            raise ValueError(
                f"{found['n']} outlets have no label, the first is {found['first']!r}; unknown_sources() lists them all."
            )
    source = _q(source_col)
    label = (
        F.when(source.isin(list(K.LEFT_SOURCES)), F.lit(0))
        .when(source.isin(list(K.RIGHT_SOURCES)), F.lit(1))
        .otherwise(F.raise_error(F.concat(F.lit("Unknown source: "), source)).cast("int"))
    )
    return named.withColumn(label_col, label)


def drop_blank_metadata(df: DataFrame) -> DataFrame:
    """Drop rows whose headline, url and id (those that exist) are all blank."""
    essential = [c for c in ("headline", "url", "article_id") if c in df.columns]
    if not essential:
        return df
    keep = F.lit(False)
    for c in essential:
        keep = keep | X.is_nonempty(_q(c))
    return df.where(keep)


def clean_metadata(
    df: DataFrame, extra_aliases: Mapping[str, Iterable[str]] | None = None
) -> DataFrame:
    """Standard columns, stripped strings, numbers or null, no blank rows."""
    out = keep_standard_columns(standardize_columns(df, extra_aliases))
    require_columns(out, K.METADATA_REQUIRED, "metadata columns")
    cleaned = {
        c: X.normalize_string(_q(c)) for c in K.METADATA_STRING_COLUMNS if c in out.columns
    }
    cleaned |= {c: X.to_number(_q(c)) for c in ("word_count", "label") if c in out.columns}
    return drop_blank_metadata(out.withColumns(cleaned))
