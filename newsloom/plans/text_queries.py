"""Queries on text functions."""

from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import profiles, text as X
from newsloom.functions.text import CLOSING, WORD, WS
from newsloom.operators import schema as S
from newsloom.plans import sql as Q
from newsloom.plans.registry import query
from newsloom.plans.tables import documents, messy, table

_M = f"(SELECT doc_id, coalesce(text, '') AS text FROM {Q.MESSY})"


def _messy(spark, sf):
    return messy(spark, sf).select("doc_id", X.as_text("text").alias("text"))


def _over(build):
    """Apply one text expression to every messy document."""

    def run(spark, sf):
        return _messy(spark, sf).select("doc_id", build(F.col("text")).alias("result"))

    return run


def _twin(expr: str) -> str:
    return f"SELECT doc_id, {expr} AS result FROM {_M}"


query("string_normalize", _twin(Q.strip("text")))(_over(X.normalize_string))
query("collapse_ws", _twin(Q.collapse("text")))(_over(X.collapse_ws))
query(
    "collapse_lines",
    _twin(Q.sub(Q.sub(Q.sub("text", "[ \\t]+", " "), f"\\n{WS}+", "\n"), "\\n{3,}", "\n\n")),
)(_over(lambda t: X.squeeze_newlines(X.outdent_lines(X.collapse_blanks(t)))))
query("punct_map", _twin(Q.replaced("text", K.CHARS_COUNTERPUNCH)))(
    _over(lambda t: X.map_characters(t, K.CHARS_COUNTERPUNCH))
)
query(
    "mojibake_fix",
    _twin(Q.sub(Q.replaced("text", K.MOJIBAKE_SALON), r"[\x{80}-\x{9F}]", "")),
)(_over(lambda t: X.remove_pattern(X.map_characters(t, K.MOJIBAKE_SALON), r"[\x{80}-\x{9F}]")))
query(
    "mojibake_fix_single_byte",
    _twin(Q.replaced("text", K.MOJIBAKE_BEACON)),
)(_over(lambda t: X.map_characters(t, K.MOJIBAKE_BEACON)))
query(
    "zero_width_removal",
    _twin(Q.sub("text", K.ZERO_WIDTH_PATTERN, "")),
)(_over(lambda t: X.remove_pattern(t, K.ZERO_WIDTH_PATTERN)))


def tidy_sql(x: str, openers: str, closers: str) -> str:
    x = Q.sub(x, f"{WS}+([.,!?;:])", "\\1")
    x = Q.sub(Q.sub(x, f"([{openers}]){WS}+", "\\1"), f"{WS}+([{closers}])", "\\1")
    return Q.collapse(x)


query("punct_spacing", _twin(tidy_sql("text", profiles.QUOTES_OPEN, profiles.QUOTES_CLOSE)))(
    _over(lambda t: profiles.tidy_punctuation(t, curly=False))
)
query("punct_spacing_curly", _twin(tidy_sql("text", profiles.CURLY_OPEN, profiles.CURLY_CLOSE)))(
    _over(lambda t: profiles.tidy_punctuation(t, curly=True))
)
query("sentence_spacing", _twin(Q.sub("text", f"([.!?])({WORD})", "\\1 \\2")))(_over(X.space_after_sentence))
query("dash_spacing", _twin(Q.sub("replace(text, '–', '—')", f"{WS}*—{WS}*", " — ")))(_over(X.spaced_dash))


def _unbracket_sql(x: str) -> str:
    x = Q.sub(x, rf"\[{WS}*\.\.\.{WS}*\]", " ")
    return Q.sub(Q.sub(x, r"\[([^\]]+)\]", "\\1"), K.STAGE_DIRECTIONS, " ")


query("bracket_cleanup", _twin(_unbracket_sql("text")))(_over(lambda t: X.unbracket(t, K.STAGE_DIRECTIONS)))
query(
    "editorial_tags",
    _twin(Q.sub(Q.sub("text", K.EDITORIAL_TAGS, ""), r"\[[A-Z0-9_\-]+\]", "")),
)(_over(lambda t: X.drop_editorial_tags(t, K.EDITORIAL_TAGS)))
query("dropcap_join", _twin(Q.sub("text", rf"\A([A-Z]){WS}+([a-z])", "\\1\\2")))(_over(X.join_drop_cap))


@query("text_normalize", f"SELECT doc_id, lower({Q.strip('text')}) AS text FROM {_M}")
def text_normalize(spark, sf):
    return S.normalize_text(messy(spark, sf).select("doc_id", "text"), "text", lowercase=True)


@query("source_normalize", f"SELECT doc_id, {Q.strip(chr(39) + chr(9) + chr(39) + ' || source || chr(160)')} AS outlet_name FROM documents")
def source_normalize(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("\t"), "source", F.lit(" ")).alias("outlet_name")
    )
    return S.normalize_source(docs)


_SPLIT_ACCENTS = "replace(replace(replace(replace(text, 'é', 'é'), 'ü', 'ü'), 'ñ', 'ñ'), 'è', 'è')"


@query("nfc_normalize", f"SELECT doc_id, nfc_normalize({_SPLIT_ACCENTS}) AS text FROM documents")
def nfc_normalize(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.expr(_SPLIT_ACCENTS).alias("t"))
    return docs.select("doc_id", X.unicode_form("t", "NFC").alias("text"))


_WIDE = "replace(replace(replace(text, 'fi', 'ﬁ'), 'A', 'Ａ'), ', ', ', ')"


@query("nfkc_normalize", "SELECT doc_id, text FROM documents")
def nfkc_normalize(spark, sf):
    """Compatibility forms written over the plain text fold back to it."""
    docs = documents(spark, sf).select("doc_id", F.expr(_WIDE).alias("t"))
    return docs.select("doc_id", X.unicode_form("t", "NFKC").alias("text"))


@query("word_count", f"SELECT doc_id, CAST({Q.n_words('text')} AS INT) AS n_words FROM {_M}")
def word_count(spark, sf):
    return messy(spark, sf).select("doc_id", X.word_count("text").alias("n_words"))


_LINE_SPLIT = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_ONE_LINE = (
    f"array_to_string(list_filter(list_transform(string_split_regex(b, '{_LINE_SPLIT}'), lambda x: {Q.strip('x')}), lambda x: x <> ''), ' ')"
)
_BLOCKS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda b: {_ONE_LINE}), lambda b: b <> '')"


@query(
    "paragraphs",
    f"SELECT doc_id, CAST(i AS INT) AS position, p[i + 1] AS paragraph FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, {_BLOCKS} AS p FROM {_M}))",
)
def paragraphs(spark, sf):
    return _messy(spark, sf).select(
        "doc_id", F.posexplode(X.paragraphs("text")).alias("position", "paragraph")
    )


@query(
    "rebuild_body",
    f"SELECT doc_id, array_to_string(list_filter({_BLOCKS}, lambda p: {Q.n_words('p')} >= 6), chr(10) || chr(10)) AS body FROM {_M}",
)
def rebuild_body(spark, sf):
    kept = F.filter(X.paragraphs("text"), lambda p: X.word_count(p) >= 6)
    return _messy(spark, sf).select("doc_id", F.array_join(kept, "\n\n").alias("body"))


_CHUNKS = (
    f"SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 200) AS INT))) AS i FROM (SELECT doc_id, {Q.words('text')} AS w FROM {_M})"
)


@query(
    "chunk_text",
    f"SELECT doc_id, CAST(i AS INT) AS position, array_to_string(w[i * 200 + 1 : i * 200 + 200], ' ') AS chunk FROM ({_CHUNKS})",
)
def chunk_text(spark, sf):
    return _messy(spark, sf).select(
        "doc_id", F.posexplode(X.chunk_words("text", K.CHUNK_WORDS)).alias("position", "chunk")
    )


# --- outlet profiles -----------------------------------------------------------------


# what compatibility folding changes in the derived texts; SQL has the canonical form only
_FOLDED = {"\u00a0": " ", "\u2003": " ", "\u3000": " ", "…": "...", "™": "TM"}


def profile_sql(outlet: str, x: str) -> str:
    """The outlet's text profile over an SQL expression."""
    nfc = f"nfc_normalize({x})"
    nfkc = lambda y: f"nfc_normalize({Q.replaced(y, _FOLDED)})"
    zero = lambda y: Q.sub(y, K.ZERO_WIDTH_PATTERN, "")
    nbsp = lambda y: f"replace({y}, chr(160), ' ')"
    blanks = lambda y: Q.sub(y, "[ \\t]+", " ")
    closing = lambda y: Q.sub(y, f"{WS}+({CLOSING})", "\\1")
    if outlet == "AlterNet":
        return Q.strip(blanks(Q.replaced(zero(nbsp(nfc)), K.CHARS_ALTERNET)))
    if outlet == "CounterPunch":
        return Q.sub(Q.replaced(nfc, K.CHARS_COUNTERPUNCH), "\\n{3,}", "\n\n")
    if outlet == "MotherJones":
        return Q.collapse(zero(Q.replaced(_unbracket_sql(nfkc(x)), K.CHARS_MOTHERJONES)))
    if outlet == "Salon":
        y = Q.replaced(Q.sub(Q.replaced(x, K.MOJIBAKE_SALON), r"[\x{80}-\x{9F}]", ""), K.CHARS_SALON)
        y = f"replace({_unbracket_sql(nfkc(y))}, '…', '...')"
        y = Q.sub(f"replace({y}, '–', '—')", f"{WS}*—{WS}*", " — ")
        return Q.collapse(zero(closing(Q.sub(y, f"([.!?])({WORD})", "\\1 \\2"))))
    if outlet == "American_Conservative":
        tags = Q.sub(Q.sub(x, K.EDITORIAL_TAGS, ""), r"\[[A-Z0-9_\-]+\]", "")
        y = f"replace(replace({nbsp(f'nfc_normalize({tags})')}, chr(8233), chr(10) || chr(10)), chr(8232), chr(10))"
        return Q.strip(Q.sub(blanks(Q.replaced(zero(y), K.CHARS_CONSERVATIVE)), f"\\n{WS}+", "\n"))
    if outlet == "American_Spectator":
        return Q.collapse(zero(Q.replaced(nfc, K.CHARS_SPECTATOR)))
    if outlet == "The_Free_Beacon":
        y = Q.replaced(zero(nbsp(nfkc(x))), K.MOJIBAKE_BEACON)
        y = Q.sub(Q.sub(y, r"[\x{0}-\x{1F}\x{7F}]", " "), r"[\x{80}-\x{9F}]", "")
        return Q.strip(closing(blanks(Q.replaced(y, K.CHARS_BEACON))))
    return Q.replaced(x, K.CHARS_BROADSHEET)


for _outlet in K.OUTLETS:
    query(f"text_profile_{_outlet.lower()}", _twin(profile_sql(_outlet, "text")))(
        _over(lambda t, o=_outlet: profiles.clean_for(o, t))
    )
