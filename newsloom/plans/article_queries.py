"""All given pages as pages of each outlet, through its extraction rules.

The twins read the page source with patterns: the given articles hold a heading and
paragraphs, the first of them with a line break in it.
"""

from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import profiles
from newsloom.functions.text import WS
from newsloom.operators import pages as P
from newsloom.plans import sql as Q
from newsloom.plans.page_queries import unescape
from newsloom.plans.registry import query
from newsloom.plans.tables import dressed_as
from newsloom.plans.text_queries import profile_sql, tidy_sql

_PIECE = "<p><b>[^<]*<br>|<p>[^<]*</p>"
_NO_TAGS = "regexp_replace(x, '<[^>]*>', '', 'g')"
_W = Q.words("x.text")
_CAPS = f"len(list_filter({_W}, lambda w: regexp_matches(w, '^\\p{{Lu}}')))"


def _pieces(outlet: str) -> str:
    """Texts of the article's paragraphs, as the outlet's rules read them."""
    pattern = f"{_PIECE}|<h1>[^<]*</h1>" if outlet == "American_Spectator" else _PIECE
    found = f"regexp_extract_all(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '{pattern}')"
    text = unescape(Q.strip(_NO_TAGS))
    if outlet == "CounterPunch":
        return f"list_transform({found}, lambda x: {{'text': {profile_sql(outlet, text)}, 'br': contains(x, '<br>')}})"
    return f"list_transform({found}, lambda x: {text})"


def _boilerplate(outlet: str, x: str) -> str:
    low = f"lower({x})"
    begins = lambda values, of: Q.any_of(f"starts_with({of}, {{v}})", values)
    holds = lambda values, of: Q.any_of(f"contains({of}, {{v}})", values)
    if outlet == "CounterPunch":
        return begins(K.DISCLAIMER_PREFIXES, Q.strip(low))
    if outlet == "Salon":
        return holds(K.SALON_PHRASES, low)
    if outlet == "MotherJones":
        return f"({begins(K.MOTHERJONES_PREFIXES, low)} OR {holds(K.MOTHERJONES_PHRASES, low)})"
    if outlet == "American_Spectator":
        bio = f"{holds(K.SPECTATOR_BIO_PHRASES, low)} OR (contains({low}, 'is a') AND contains({low}, 'director'))"
        return f"(regexp_matches({low}, '{K.SPECTATOR_PROMO_PATTERN}') OR {begins(K.SPECTATOR_PREFIXES, low)} OR {bio})"
    if outlet == "FoxNews":
        upper = f"len(regexp_extract_all({x}, '\\p{{Lu}}')) / greatest(length({x}), 1) > {K.FOX_UPPERCASE_LIMIT}"
        marks = f"{holds(K.FOX_MARKS, x)} OR {begins(K.FOX_PREFIXES, x)}"
        return f"({marks} OR {holds(K.FOX_CAPTION_WORDS, low)} OR {holds(K.FOX_JUNK_PHRASES, low)} OR {upper})"
    if outlet == "DailyCaller":
        return holds(K.DAILYCALLER_PHRASES, low)
    return "false"


def _body(outlet: str) -> str:
    rules, texts = P.RULES[outlet], _pieces(outlet)
    if outlet == "CounterPunch":
        signature = f"""(i > len(b) - 3 AND len({_W}) <= 10 AND ((x.br AND {_CAPS} >= 2) OR ({_CAPS} >= 2 AND contains(x.text, ','))
 OR (len({_W}) BETWEEN 2 AND 4 AND {_CAPS} = len({_W}))))"""
        kept = f"list_filter(b, lambda x, i: x.text <> '' AND NOT {signature} AND NOT {_boilerplate(outlet, 'x.text')})"
        kept = f"(SELECT list_transform({kept}, lambda x: {Q.strip('x.text')}) AS k FROM (SELECT {texts} AS b))"
        apart = "list_filter(k, lambda x, i: list_position(k, x) = i AND len(list_filter(k, lambda y: length(x) > length(y) AND contains(x, y))) = 0)"
        return f"(SELECT array_to_string({apart}, chr(10) || chr(10)) FROM {kept})"
    if outlet in ("FoxNews", "DailyCaller"):
        texts = f"list_transform({texts}, lambda x: {profile_sql(outlet, 'x')})"
    elif outlet in ("American_Spectator", "The_Free_Beacon", "DailyBeast"):
        texts = f"list_transform({texts}, lambda x: {Q.collapse('x')})"
    enough = f"{Q.n_words('x')} >= {rules.min_words} AND length(x) > {rules.min_chars}"
    texts = f"list_filter({texts}, lambda x: {enough} AND NOT {_boilerplate(outlet, 'x')})"
    if outlet == "American_Spectator":
        joined_cap = Q.sub("x", rf"\A([A-Z]){WS}+([a-z])", "\\1\\2")
        texts = f"list_filter(list_transform({texts}, lambda x: {joined_cap}), lambda x: {Q.n_words('x')} >= {rules.min_words})"
    curly = (profiles.CURLY_OPEN, profiles.CURLY_CLOSE)
    if outlet == "FoxNews":
        tidy = f"list_transform({texts}, lambda x: {tidy_sql('x', *curly)})"
        return profile_sql(outlet, tidy_sql(f"array_to_string({tidy}, ' ')", *curly))
    if outlet == "AlterNet":
        parts = tidy_sql(profile_sql(outlet, "x"), profiles.QUOTES_OPEN, profiles.QUOTES_CLOSE)
        return f"array_to_string(list_transform({texts}, lambda x: {parts}), chr(10) || chr(10))"
    body = profile_sql(outlet, f"array_to_string({texts}, chr(10) || chr(10))")
    return f"nullif({body}, '')" if rules.first_filled_body else body  # no container with text: no body


def _headline(outlet: str) -> str:
    raw = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
    rules = P.RULES[outlet]
    text = profile_sql(outlet, unescape(raw if rules.headline_text == "raw" else Q.strip(raw)))
    return f"CASE WHEN length({text}) > {rules.headline_min_chars} THEN {text} END" if rules.headline_min_chars else text


_DAY = "strftime(TIMESTAMP '2024-10-01' + to_days(CAST(page_id % 400 AS INT)), '%Y-%m-%d')"


def _sql(outlet: str) -> str:
    dated = {"American_Conservative": _DAY, "The_Free_Beacon": _DAY, "AlterNet": "''"}
    accepted = f"word_count >= {K.OUTLETS[outlet][2]}"
    if P.RULES[outlet].needs_headline:
        accepted += " AND coalesce(headline, '') <> ''"
    if outlet == "American_Conservative":
        accepted += f" AND publication_date >= '{K.CUTOFF_DATE}' AND length(body_text) > 300"
    return f"""SELECT *, {accepted} AS accepted FROM (SELECT *, coalesce(CAST({Q.n_words('body_text')} AS INT), 0) AS word_count FROM (
 SELECT page_id, {_headline(outlet)} AS headline, {dated.get(outlet, 'CAST(NULL AS VARCHAR)')} AS publication_date, {_body(outlet)} AS body_text FROM pages))"""


def _articles_of(outlet: str):
    def run(spark, sf):
        parsed = P.parsed_pages(dressed_as(spark, sf, outlet), (outlet,))
        return parsed.select("page_id", "headline", "publication_date", "body_text", "word_count", "accepted")

    return run


for _outlet in K.OUTLETS:
    query(f"pages_as_{_outlet.lower()}", _sql(_outlet))(_articles_of(_outlet))
