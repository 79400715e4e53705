"""Small SQL pieces the twins share."""

from __future__ import annotations

from newsloom.functions.text import NOT_WS, TOKEN, WS
from newsloom.plans.tables import MESSY_SQL


def strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NOT_WS}+'))"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NOT_WS}+')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def replaced(x: str, mapping) -> str:
    for bad, good in mapping.items():
        good_sql = "chr(10) || chr(10)" if good == "\n\n" else "'" + good.replace("'", "''") + "'"
        x = f"replace({x}, '{bad}', {good_sql})"
    return x


def any_of(template: str, values) -> str:
    """OR of a condition over values; ``{v}`` stands for the quoted value."""
    return "(" + " OR ".join(template.replace("{v}", "'" + v.replace("'", "''") + "'") for v in values) + ")"


MESSY = f"(SELECT doc_id, source, lang, {MESSY_SQL} AS text FROM documents)"
CORPUS = (
    "(SELECT d.doc_id, d.text, d.source, l.quality AS label FROM documents d "
    "JOIN labels l ON d.doc_id = l.doc_id)"
)


def ranked(rows: str, key: str = "doc_id", label: str = "label") -> str:
    """Rows with their seeded place inside their class and the class offset."""
    return f"""(SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || {key}), {key}) - 1 AS rank_in_class,
       count(*) OVER (PARTITION BY {label}) AS class_size,
       count(*) OVER (ORDER BY {label} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - count(*) OVER (PARTITION BY {label}) AS before
  FROM {rows} r)"""


FOLDS = f"(SELECT doc_id, label, source, text, CAST((before + rank_in_class) % 5 AS INT) AS fold FROM {ranked(CORPUS)} k)"
