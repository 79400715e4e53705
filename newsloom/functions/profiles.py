"""Per-outlet text cleaning, as ordered column expressions.

The order of steps inside a profile is part of its result, quirks included:
one profile normalises compatibility characters before it repairs mis-decoded
punctuation, so some repairs never apply; another collapses paragraph breaks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import text as X

# Unicode form wanted before the first step; "" where none is applied first
UNICODE_FORM = {
    "AlterNet": "NFC",
    "CounterPunch": "NFC",
    "DailyBeast": "",
    "MotherJones": "NFKC",
    "Salon": "NFKC",
    "FoxNews": "",
    "American_Conservative": "NFC",
    "American_Spectator": "NFC",
    "The_Free_Beacon": "NFKC",
    "DailyCaller": "",
}

QUOTES_OPEN, QUOTES_CLOSE = r"\(\[\{'\"", r"\)\]\}'\""
CURLY_OPEN, CURLY_CLOSE = r"\(\[\{“‘", r"\)\]\}”’"


def before_form(outlet: str, t: Column) -> Column:
    """Steps that come ahead of the Unicode form."""
    if outlet == "Salon":
        t = X.map_characters(t, K.MOJIBAKE_SALON)
        t = X.remove_pattern(t, r"[\x{80}-\x{9F}]")
        t = X.map_characters(t, K.CHARS_SALON)
    elif outlet == "American_Conservative":
        t = X.drop_editorial_tags(t, K.EDITORIAL_TAGS)
    return t


def _alternet(t: Column) -> Column:
    t = X.remove_pattern(F.translate(t, K.NBSP, " "), K.ZERO_WIDTH_PATTERN)
    return X.strip(X.collapse_blanks(X.map_characters(t, K.CHARS_ALTERNET)))


def _counterpunch(t: Column) -> Column:
    return X.squeeze_newlines(X.map_characters(t, K.CHARS_COUNTERPUNCH))


def _broadsheet(t: Column) -> Column:
    return X.map_characters(t, K.CHARS_BROADSHEET)


def _motherjones(t: Column) -> Column:
    t = X.map_characters(X.unbracket(t, K.STAGE_DIRECTIONS), K.CHARS_MOTHERJONES)
    return X.collapse_ws(X.remove_pattern(t, K.ZERO_WIDTH_PATTERN))


def _salon(t: Column) -> Column:
    t = X.unbracket(t, K.STAGE_DIRECTIONS)
    t = X.spaced_dash(F.replace(t, F.lit("…"), F.lit("...")))
    t = X.space_before_closing(X.space_after_sentence(t))
    return X.collapse_ws(X.remove_pattern(t, K.ZERO_WIDTH_PATTERN))


def _conservative(t: Column) -> Column:
    t = F.translate(t, K.NBSP, " ")
    t = X.map_characters(t, {"\u2029": "\n\n"})
    t = X.remove_pattern(F.translate(t, "\u2028", "\n"), K.ZERO_WIDTH_PATTERN)
    t = X.map_characters(t, K.CHARS_CONSERVATIVE)
    return X.strip(X.outdent_lines(X.collapse_blanks(t)))


def _spectator(t: Column) -> Column:
    t = X.remove_pattern(X.map_characters(t, K.CHARS_SPECTATOR), K.ZERO_WIDTH_PATTERN)
    return X.collapse_ws(t)


def _beacon(t: Column) -> Column:
    t = X.remove_pattern(F.translate(t, K.NBSP, " "), K.ZERO_WIDTH_PATTERN)
    t = X.map_characters(t, K.MOJIBAKE_BEACON)
    t = X.remove_pattern(t, r"[\x{0}-\x{1F}\x{7F}]", " ")
    t = X.remove_pattern(t, r"[\x{80}-\x{9F}]")
    t = X.map_characters(t, K.CHARS_BEACON)
    return X.strip(X.space_before_closing(X.collapse_blanks(t)))


_AFTER = {
    "AlterNet": _alternet,
    "CounterPunch": _counterpunch,
    "DailyBeast": _broadsheet,
    "MotherJones": _motherjones,
    "Salon": _salon,
    "FoxNews": _broadsheet,
    "American_Conservative": _conservative,
    "American_Spectator": _spectator,
    "The_Free_Beacon": _beacon,
    "DailyCaller": _broadsheet,
}


def after_form(outlet: str, t: Column) -> Column:
    """Steps that follow the Unicode form."""
    return _AFTER[outlet](t)


def tidy_punctuation(t: Column, curly: bool) -> Column:
    """Punctuation spacing of a paragraph, straight or curly quotes."""
    openers, closers = (CURLY_OPEN, CURLY_CLOSE) if curly else (QUOTES_OPEN, QUOTES_CLOSE)
    return X.collapse_ws(X.tight_brackets(X.space_before_closing(t), openers, closers))


def clean_for(outlet: str, t: Column) -> Column:
    """The whole profile of one outlet."""
    t = before_form(outlet, t)
    if UNICODE_FORM[outlet]:
        t = X.unicode_form(t, UNICODE_FORM[outlet])
    return after_form(outlet, t)


def _per_outlet(outlet: Column, build) -> Column:
    out = None
    for key in K.OUTLETS:
        branch = build(key)
        out = F.when(outlet == key, branch) if out is None else out.when(outlet == key, branch)
    return out


def clean_by_outlet(outlet: Column, t: Column) -> Column:
    """Profile chosen per row; one pass and one Unicode call for all rows."""
    first = _per_outlet(outlet, lambda key: before_form(key, t))
    form = _per_outlet(outlet, lambda key: F.lit(UNICODE_FORM[key]))
    formed = X.unicode_form(first, form)
    return _per_outlet(outlet, lambda key: after_form(key, formed))
