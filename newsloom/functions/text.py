"""Text functions as column expressions.

All patterns spell their character classes out, so that results follow
Unicode rules whatever the regex engine's defaults are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the white space a Python ``str.strip`` / ``split`` knows
_WS_BODY = (
    r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = f"[{_WS_BODY}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NOT_WS = f"[^{_WS_BODY}]"
WORD = r"[\p{L}\p{N}_]"
# the same classes for Spark, commonest characters first: the first range that holds a character ends the test
_NOT_WS_RANGES = (
    r"~\x{A1}-\x{167F}\x{0}-\x{8}\x{E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}"
    r"\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}"
)
NOT_WS_FAST = f"[!-{_NOT_WS_RANGES}]"
WS_BUT_BLANK = rf"[^\x{{20}}-{_NOT_WS_RANGES}]"
WORD_FAST = r"[a-zA-Z0-9\p{L}\p{N}_]"
TOKEN = WORD + WORD + "+"
LINE_BREAK = r"(?:\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}])"
CLOSING = "[.,!?;:]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a name inside an expression.

    A column used inside a lambda is computed again for every element; a
    lambda's own argument is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends; only the ends are looked at."""
    return F.trim(_col(c), F.lit(WS_CHARS))


def as_text(c: Column | str) -> Column:
    """Any column as a non-null string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def normalize_string(c: Column | str) -> Column:
    """Null becomes the empty string; everything else is a stripped string."""
    return strip(as_text(c))


def is_nonempty(c: Column | str) -> Column:
    """True where the value holds anything besides white space."""
    return F.coalesce(_col(c).cast("string").rlike(NOT_WS), F.lit(False))


def to_number(c: Column | str) -> Column:
    """Numeric value or null."""
    return _col(c).try_cast("double")


def word_count(c: Column | str) -> Column:
    """Number of white-space separated words."""
    return F.size(words(c))


def words(c: Column | str) -> Column:
    """Array of white-space separated words.

    White space other than blanks is rare: it becomes blanks, and cutting at a blank
    needs no pattern.
    """
    return F.array_remove(F.split(F.regexp_replace(as_text(c), f"{WS_BUT_BLANK}+", " "), " "), "")


def collapse_ws(c: Column | str) -> Column:
    """Every run of white space becomes one space; ends are stripped."""
    return F.trim(F.regexp_replace(_col(c), f"{WS}+", " "))


def collapse_blanks(c: Column | str) -> Column:
    """Runs of spaces and tabs only; line breaks stay."""
    return F.regexp_replace(_col(c), r"[ \t]+", " ")


def squeeze_newlines(c: Column | str) -> Column:
    """Three or more line breaks become a paragraph break."""
    return F.regexp_replace(_col(c), r"\n{3,}", "\n\n")


def outdent_lines(c: Column | str) -> Column:
    """White space after a line break goes, further breaks included."""
    return F.regexp_replace(_col(c), rf"\n{WS}+", "\n")


@F.udf(T.StringType(), useArrow=False)
def _unicode_form(text: str | None, form: str | None) -> str | None:
    # row by row: a worker never holds more than the hundred texts on their way to and from it
    return text if text is None or text.isascii() or not form else unicodedata.normalize(form, text)


def unicode_form(c: Column | str, form: Column | str) -> Column:
    """Unicode normal form; the form may be a literal name or a column."""
    return _unicode_form(_col(c), F.lit(form) if isinstance(form, str) else form)


def map_characters(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace characters (or short strings) by others.

    One-to-one and one-to-nothing pairs go through a single ``translate``;
    longer targets or sources are replaced one after the other.
    """
    out = _col(c)
    for bad, good in mapping.items():
        if len(bad) > 1 or len(good) > 1:
            out = F.replace(out, F.lit(bad), F.lit(good))
    kept = {b: g for b, g in mapping.items() if len(b) == 1 and len(g) == 1}
    gone = [b for b, g in mapping.items() if len(b) == 1 and g == ""]
    if kept or gone:
        out = F.translate(out, "".join(kept) + "".join(gone), "".join(kept.values()))
    return out


def remove_pattern(c: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(_col(c), pattern, by)


def space_before_closing(c: Column | str) -> Column:
    """No white space before closing punctuation."""
    return F.regexp_replace(_col(c), f"{WS}+({CLOSING})", "$1")


def tight_brackets(c: Column | str, openers: str, closers: str) -> Column:
    """No white space just inside brackets and quotes."""
    inner = F.regexp_replace(_col(c), f"([{openers}]){WS}+", "$1")
    return F.regexp_replace(inner, f"{WS}+([{closers}])", "$1")


def space_after_sentence(c: Column | str) -> Column:
    """A word character right after ``.``, ``!`` or ``?`` gets a space."""
    return F.regexp_replace(_col(c), f"([.!?])({WORD})", "$1 $2")


def spaced_dash(c: Column | str) -> Column:
    """En dashes become em dashes, each with one space at both sides."""
    return F.regexp_replace(F.replace(_col(c), F.lit("–"), F.lit("—")), f"{WS}*—{WS}*", " — ")


def unbracket(c: Column | str, stage_pattern: str) -> Column:
    """Bracketed ellipses and stage directions go; other brackets open up."""
    out = F.regexp_replace(_col(c), rf"\[{WS}*\.\.\.{WS}*\]", " ")
    out = F.regexp_replace(out, r"\[([^\]]+)\]", "$1")
    return F.regexp_replace(out, stage_pattern, " ")


def drop_editorial_tags(c: Column | str, tag_pattern: str) -> Column:
    """Named editorial tags and any bracketed upper-case marker go."""
    return F.regexp_replace(F.regexp_replace(_col(c), tag_pattern, ""), r"\[[A-Z0-9_\-]+\]", "")


def join_drop_cap(c: Column | str) -> Column:
    """A single capital split from its lower-case word is joined to it."""
    return F.regexp_replace(_col(c), rf"\A([A-Z]){WS}+([a-z])", "$1$2")


def paragraphs(c: Column | str) -> Column:
    """Blocks between blank lines, each on one line, blank ones dropped."""

    def one_line(block: Column) -> Column:
        lines = F.transform(F.split(block, LINE_BREAK), strip)
        return F.array_join(F.filter(lines, lambda x: x != ""), " ")

    blocks = F.transform(F.split(_col(c), "\n\n"), one_line)
    return F.filter(blocks, lambda x: x != "")


def lines(c: Column | str) -> Column:
    """Non-blank stripped lines."""
    return F.filter(F.transform(F.split(_col(c), "\n"), strip), lambda x: x != "")


def distinct_blocks(blocks: Column | str) -> Column:
    """First occurrence of each stripped, non-blank block, in order."""
    return F.filter(F.array_distinct(F.transform(_col(blocks), strip)), lambda x: x != "")


def uppercase_ratio(c: Column | str) -> Column:
    """Share of upper-case letters among all characters."""
    t = _col(c)
    return F.regexp_count(t, F.lit(r"\p{Lu}")) / F.greatest(F.length(t), F.lit(1))


def contains_any(c: Column | str, phrases: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(_col(c), F.lit(p))
    return out


def starts_with_any(c: Column | str, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(_col(c), F.lit(p))
    return out


def title_case_words(word_array: Column) -> Column:
    """How many words begin with an upper-case letter."""
    return F.size(F.filter(word_array, lambda w: w.rlike(r"\A\p{Lu}")))


def is_signature(text: Column, from_end: Column, has_break: Column) -> Column:
    """Author line: short, title case, among the last three paragraphs.

    ``from_end`` is 0 for the last paragraph.
    """
    w = words(text)
    n, caps = F.size(w), title_case_words(w)
    looks_like = (
        (has_break & (caps >= 2))
        | ((caps >= 2) & F.contains(text, F.lit(",")))
        | (n.between(2, 4) & (caps == n))
    )
    return (from_end < 3) & (n <= 10) & looks_like


def drop_signatures(blocks: Column | str) -> Column:
    """Remove author lines from an ordered paragraph array."""

    def kept(b: Column) -> Column:
        n = F.size(b)
        return F.filter(b, lambda x, i: ~is_signature(x, n - 1 - i, F.lit(False)))

    return let(_col(blocks), kept)


def chunk_words(c: Column | str, size: int) -> Column:
    """Array of chunks of ``size`` words; blank text gives an empty array."""

    def chunks(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size))
        joined = F.transform(starts, lambda s: F.array_join(F.slice(w, s, F.lit(size)), " "))
        return F.filter(joined, lambda x: x != "")

    return let(words(c), chunks)


def tokens(c: Column | str, stop_words: Iterable[str] = ()) -> Column:
    """Lower-case tokens of two or more word characters, stop words out."""
    toks = F.regexp_extract_all(F.lower(as_text(c)), F.lit(f"({TOKEN})"), F.lit(1))
    stop = list(stop_words)
    return F.filter(toks, lambda t: ~t.isin(stop)) if stop else toks


def with_bigrams(toks: Column | str) -> Column:
    """Tokens followed by the pairs of neighbouring tokens."""

    def both(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        left, right = F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n)
        return F.concat(t, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b)))

    return let(_col(toks), both)


def term_counts(terms: Column | str) -> Column:
    """Array of (term, n) of a term array, in term order.

    Sorted terms are cut where they change, so the work is linear after the
    sort and nothing leaves the row.
    """

    def counted(s: Column) -> Column:
        n = F.size(s)
        places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        starts = F.filter(
            places, lambda i: (i < n) & ((i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, k: F.struct(
                    F.get(s, p).alias("term"), (F.coalesce(F.get(st, k + 1), n) - p).alias("n")
                ),
            ),
        )

    return let(F.sort_array(_col(terms)), counted)
