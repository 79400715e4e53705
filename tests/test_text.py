import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions.wrappers import drop_wrappers, wrapping
from newsloom.functions import dates, profiles, text as X, urls as U


def one(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, build, expected",
    [
        (" \ta\n", X.normalize_string, "a"),
        (None, X.normalize_string, ""),
        (" a  b ", X.word_count, 2),
        ("", X.word_count, 0),
        (None, X.word_count, 0),
        ("a​b", lambda c: X.remove_pattern(c, K.ZERO_WIDTH_PATTERN), "ab"),
        ("x [...] [y] (laughter)", lambda c: X.collapse_ws(X.unbracket(c, K.STAGE_DIRECTIONS)), "x y"),
        ("A man", X.join_drop_cap, "Aman"),
        ("3.5", X.space_after_sentence, "3. 5"),
        ("a–b", X.spaced_dash, "a — b"),
        ("hi , you", X.space_before_closing, "hi, you"),
        ("“a” – ‘b’ …", lambda c: X.map_characters(c, K.CHARS_ALTERNET), "\"a\" - 'b' ..."),
        ("a b", lambda c: X.map_characters(c, K.CHARS_COUNTERPUNCH), "a\n\nb"),
        ("[BLOCK]x[/ quote] [A-1]", lambda c: X.drop_editorial_tags(c, K.EDITORIAL_TAGS), "x "),
        ("a\n b\n\n\n\nc", X.paragraphs, ["a b", "c"]),
        ("AbC d", X.uppercase_ratio, 0.4),
        ("Being a cat", lambda c: X.with_bigrams(X.tokens(c, ["being"])), ["cat"]),
        ("red fox red fox", lambda c: X.with_bigrams(X.tokens(c)), ["red", "fox", "red", "fox", "red fox", "fox red", "red fox"]),
    ],
)
def test_text_function(spark, value, build, expected):
    assert one(spark, value, build) == expected


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (200, 1), (201, 2), (400, 2)])
def test_chunks(spark, n, chunks):
    got = one(spark, " ".join(["w"] * n), lambda c: X.chunk_words(c, 200))
    assert len(got) == chunks
    assert sum(len(c.split()) for c in got) == n


def test_paragraph_rules(spark):
    assert one(spark, ["aa", "aab", "zz"], drop_wrappers, "array<string>") == ["aa", "zz"]
    assert one(spark, ["aa", " aa", "", "b"], X.distinct_blocks, "array<string>") == ["aa", "b"]
    blocks = ["Jane Doe", "some text that stays here", "More Text", "Jane Doe", "John Smith, London", "Ann Lee"]
    assert one(spark, blocks, X.drop_signatures, "array<string>") == blocks[:3]
    signed = F.lit("Written By\nJane")
    assert one(spark, "x", lambda c: X.is_signature(F.lit("by Jane Doe x y"), F.lit(0), F.lit(True)))
    assert not one(spark, "x", lambda c: X.is_signature(signed, F.lit(3), F.lit(True)))


def test_term_counts(spark):
    got = one(spark, ["b", "a", "b"], X.term_counts, "array<string>")
    assert [(r["term"], r["n"]) for r in got] == [("a", 1), ("b", 2)]
    assert one(spark, [], X.term_counts, "array<string>") == []


def test_let_is_computed_once(spark):
    assert one(spark, "a b", lambda c: X.let(X.words(c), lambda w: F.concat(w, w))) == ["a", "b", "a", "b"]


@pytest.mark.parametrize(
    "outlet, value, expected",
    [
        ("The_Free_Beacon", "donâ€™t\n\nstop", "donâ€TMt  stop".replace("  ", " ")),
        ("Salon", "â\u0080\u0099 costs 3.5 – yes", "' costs 3. 5 — yes"),
        ("AlterNet", "a  b​ \t‘c’ ", "a b 'c'"),
        ("CounterPunch", "«a»\n\n\n\n\nb", '"a"\n\nb'),
        ("American_Spectator", "a\n\n b…", "a b..."),
        ("American_Conservative", "a   b [PULLQUOTE]c", "a\nb c"),
        ("MotherJones", "a – b [sic] (Applause)", "a — b sic"),
        ("FoxNews", "‛a―", "'a-"),
    ],
)
def test_profiles(spark, outlet, value, expected):
    assert one(spark, value, lambda c: profiles.clean_for(outlet, c)) == expected


@pytest.mark.parametrize(
    "value, build, expected",
    [
        ("January 14, 2026 4:47 PM ET", dates.eastern_to_utc, "2026-01-14T21:47:00+00:00"),
        ("Feb. 9 20265:37PM EST", dates.suffixed_to_utc, "2026-02-09T22:37:00+00:00"),
        ("Feb. 9 2026 5:37:10PM PST", dates.suffixed_to_utc, "2026-02-10T01:37:10+00:00"),
        ("soon", dates.suffixed_to_utc, None),
        ("Feb 3, 2026", dates.byline_date, "2026-02-03"),
        ("02/03/2026", dates.byline_date, "2026-02-03"),
        ("2025-01-20T00:00", dates.is_recent, True),
        ("2025-01-19", dates.is_recent, False),
        (None, dates.is_recent, False),
        ("not a date", dates.is_recent, False),
        ("https://a.org/x/y-z/", U.slug, "y-z"),
        ("https://a.org/x/y-z/", U.slug_underscored, "y_z"),
        ("https://theamericanconservative.com/a/?q=1#f", U.normalize_url, "https://www.theamericanconservative.com/a"),
        ("https://www.theamericanconservative.com/author/x", U.is_crawlable, False),
        ("https://www.theamericanconservative.com/a.PDF", U.is_crawlable, False),
        ("https://theamericanconservative.com/a-b/", U.is_crawlable, True),
        ("https://m.youtube.com/x", U.is_blocked, True),
        ("https://notyoutube.com/x", U.is_blocked, False),
        ("https://spectator.org/show-ep-12", U.is_blocked, True),
        ("https://freebeacon.com/tag/x", U.is_section_article, False),
        ("https://freebeacon.com/media/x", U.is_section_article, True),
        ("https://www.counterpunch.org/2026/04/01/a-b/", lambda c: U.is_dated_article(c, K.COUNTERPUNCH_URL_PATTERN), True),
        ("//cdn.org/a", lambda c: U.resolve(c, F.lit("https://a.org/x/y")), "https://cdn.org/a"),
        ("b.html", lambda c: U.resolve(c, F.lit("https://a.org/x/y")), "https://a.org/x/b.html"),
        ("mailto:a@b.c", U.is_followable, False),
    ],
)
def test_dates_and_urls(spark, value, build, expected):
    assert one(spark, value, build) == expected


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert sorted(K.STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_wrappers_against_all_pairs():
    random = np.random.default_rng(3)

    def slow(blocks):
        return {x for x in blocks if any(len(x) > len(y) and y in x for y in blocks)}

    for _ in range(300):
        alphabet = "ab" if random.random() < 0.5 else "abcdé😀\n "
        blocks = ["".join(random.choice(list(alphabet), random.integers(0, 24))) for _ in range(random.integers(0, 14))]
        assert wrapping(blocks) == slow(blocks), blocks
    assert wrapping(["", "a"]) == {"a"} and wrapping([""]) == set() and wrapping(["same", "same"]) == set()


def test_wrappers_of_a_long_document():
    blocks = [f"Paragraph {k} of many, with the same beginning and {'a longer ' * (k % 60)}end." for k in range(5000)]
    held = [f"So it says: {b} - and more" for b in blocks[:50]]
    begun = time.perf_counter()
    assert wrapping(blocks + held) == set(held)
    assert time.perf_counter() - begun < 10  # all pairs: 12 million searches
