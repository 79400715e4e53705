"""From stored pages to articles.

Input rows carry ``nodes`` and ``strings`` (see ``sources.html_nodes``).  All
rules are expressions over these two arrays, so the work of a page stays in its
row: no shuffle, no join, no regrouping, whatever the number of pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import dates, profiles, text as X, urls as U
from newsloom.functions.text import let
from newsloom.functions.wrappers import drop_wrappers
from newsloom.operators.filters import is_author_bio, is_boilerplate
from newsloom.sources.html_nodes import with_nodes


@dataclass(frozen=True)
class El:
    """An element to look for: tag, class or id; empty means any."""

    tag: str = ""
    cls: str = ""
    id: str = ""
    inside: "El | None" = None


@dataclass(frozen=True)
class PageRules:
    """What an outlet's pages look like and what is thrown away."""

    headline: tuple[El, ...]
    body: tuple[El, ...]
    headline_text: str = "tight"  # tight | spaced | raw
    headline_min_chars: int = 0
    first_filled_body: bool = False
    paragraphs: tuple[str, ...] = ("p",)
    paragraph_class: str = ""
    drop_tags: tuple[str, ...] = ()
    drop_elements: tuple[El, ...] = ()
    drop_class_parts: tuple[str, ...] = ()
    drop_class_parts_cased: tuple[str, ...] = ()
    drop_class_tags: tuple[str, ...] = ()
    drop_paragraph_ids: tuple[str, ...] = ()
    drop_marked: tuple[str, str] | None = None
    drop_bios: bool = False
    skip_classes: tuple[str, ...] = ()
    skip_under_classes: tuple[str, ...] = ()
    skip_under_ids: tuple[str, ...] = ()
    skip_under_tags: tuple[str, ...] = ()
    skip_with_tags: tuple[str, ...] = ()
    skip_with: tuple[El, ...] = ()
    long_link_words: int = 0
    min_words: int = 0
    min_chars: int = 0
    joiner: str = "\n\n"
    needs_headline: bool = False


# --- fixed values: the page layout of each outlet --------------------------------
RULES: dict[str, PageRules] = {
    "AlterNet": PageRules(
        headline=(El("h1", "headline"),),
        body=(El("div", "body-description"),),
        skip_classes=(
            "postContent4", "postContent10", "postContent14", "bigcrunch-unit-injected",
            "bigcrunch-unit", "shortcode-media", "shortcode-media-youtube",
        ),
        skip_under_classes=(
            "postContent4", "postContent10", "postContent14", "bigcrunch-unit-injected",
            "bigcrunch-unit", "shortcode-media", "shortcode-media-youtube",
        ),
        skip_under_ids=(
            "pianoFloatingEmailFormContainer", "story_page_desktop_incontent_p2_target",
            "story_page_desktop_incontent_p4_target", "story_page_desktop_incontent_p10_target",
            "story_page_desktop_incontent_p14_target", "alternet_dt_incontent",
        ),
        skip_with_tags=("iframe", "script", "ins"),
        skip_with=(
            El("span", "rm-shortcode"), El("small", "image-media"), El("small", "media-caption"),
            El("small", "media-photo-credit"),
        ),
        min_words=6,
    ),
    "CounterPunch": PageRules(
        headline=(El("h1", "headline"),),
        body=(El("div", "post_content"),),
        drop_elements=(El("div", "wp-caption"),),
    ),
    "DailyBeast": PageRules(
        headline=(El("h1", "b-headline"),),
        body=(El("article", inside=El("div", "b-article-body")), El("article", id="main-article")),
        first_filled_body=True,
        paragraph_class="c-paragraph",
    ),
    "MotherJones": PageRules(
        headline=(El("h1", "entry-title"),),
        headline_text="raw",
        body=(El("div", id="fullwidth-body"), El("article", "entry-content")),
        drop_tags=("figcaption",),
        drop_elements=(El("div", "hero"),),
        drop_class_parts=("ad", "promo", "widget", "sidebar", "freestar", "membership"),
        drop_class_tags=("div", "aside", "section"),
        needs_headline=True,
    ),
    "Salon": PageRules(
        headline=(El("h1"),),
        headline_text="raw",
        body=(El("section", "article__content"),),
        drop_tags=("aside", "nav", "figcaption"),
        drop_elements=(El("div", "layout_template_wrapper"),),
        drop_class_parts=("template", "promo", "ad", "sponsor"),
        drop_class_tags=("div",),
        needs_headline=True,
    ),
    "FoxNews": PageRules(
        headline=(El("h1"),),
        body=(El("article"),),
        skip_under_classes=("article-meta", "image-ct", "inline", "info", "beyondwords-wrapper"),
        skip_under_tags=("figure", "figcaption"),
        skip_with_tags=("strong",),
        long_link_words=6,
        min_words=6,
        joiner=" ",
    ),
    "American_Conservative": PageRules(
        headline=(
            El("h2", "c-hero-article__title"), El("h1", "c-blog-post__title"),
            El("h1", "entry-title"), El("h1"),
        ),
        headline_min_chars=10,
        body=(
            El("div", "c-blog-post__content"), El("div", "o-content"), El("div", "entry-content"),
            El("article"), El("main"),
        ),
        first_filled_body=True,
        drop_tags=("script", "iframe", "style", "nav", "aside", "header", "footer", "form"),
        drop_class_parts=("ad", "promo", "sponsor", "newsletter", "subscription", "popular", "trending"),
        min_chars=50,
        needs_headline=True,
    ),
    "American_Spectator": PageRules(
        headline=(El("div", "title pf-title"), El("h1", "entry-title")),
        headline_text="spaced",
        body=(
            El("div", "paywall", inside=El("div", "post-body print-only")),
            El("div", "paywall", inside=El("div", "post-body")),
        ),
        paragraphs=("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li"),
        drop_tags=("script", "style", "ins", "iframe"),
        drop_elements=(El("p", "wp-caption-text"),),
        drop_class_parts=("ad",),
        drop_class_parts_cased=("spect-", "disclaimer"),
        drop_class_tags=("div",),
        drop_paragraph_ids=("caption-attachment-",),
        drop_marked=("strong", "(related:"),
        drop_bios=True,
        min_words=6,
    ),
    "The_Free_Beacon": PageRules(
        headline=(El("h1"), El("h2")),
        body=(El("div", "article-content"),),
        drop_tags=("script", "style"),
        drop_elements=(El("div", "in-article-ad-wrapper"), El("div", "tag-list")),
        min_words=4,
        needs_headline=True,
    ),
    "DailyCaller": PageRules(
        headline=(
            El("h1", "mb-6 xl:mb-10 leading-tight font-oswald font-medium text-3xl md:text-5xl"),
        ),
        body=(El("div", id="articleContent"),),
        drop_elements=(El("blockquote", "twitter-tweet"),),
    ),
}
ARTICLE_MARKS = (
    El("div", "c-blog-post__content"), El("div", "o-content"), El("div", "entry-content"),
    El("article"), El("span", "o-byline__date-item"), El("h1", "c-blog-post__title"),
    El("h2", "c-hero-article__title"),
)
META_DATES = (
    ("property", "article:published_time"), ("name", "pubdate"), ("name", "publish_date"), ("name", "date"),
)

def _nodes() -> Column:
    return F.col("nodes")


def _strings() -> Column:
    return F.col("strings")


# --- finding elements ---------------------------------------------------------------


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def has_class(n: Column, cls: str) -> Column:
    if " " in cls:
        return F.array_join(n["cls"], " ") == cls
    return F.array_contains(n["cls"], cls)


def class_contains(n: Column, parts: tuple[str, ...], cased: tuple[str, ...] = ()) -> Column:
    """Substring test on the class names: ``ad`` also hits ``header``.

    ``parts`` are found in any case, ``cased`` only as they are written.
    """
    names = F.array_join(n["cls"], " ")
    return X.contains_any(F.lower(names), parts) | X.contains_any(names, cased)


def is_el(n: Column, el: El) -> Column:
    out = F.lit(True)
    if el.tag:
        out = out & (n["tag"] == el.tag)
    if el.cls:
        out = out & has_class(n, el.cls)
    if el.id:
        out = out & (F.coalesce(n["id"], F.lit("")) == el.id)
    return out


def inside(outer: Column) -> Column:
    """All elements within one: a slice of ``nodes``, no test of the others."""
    return F.slice(_nodes(), outer["pos"] + 2, outer["last"] - outer["pos"])


def has_inside(outer: Column, rule) -> Column:
    return F.exists(inside(outer), rule)


def outermost(spans: Column) -> Column:
    """Those of ``spans`` (pos, last; in document order) that lie in no other one.

    Elements nest or are apart, so only the last one kept needs a look."""
    def add(kept: Column, d: Column) -> Column:
        last = F.coalesce(F.get(kept, F.size(kept) - 1)["last"], F.lit(-1))
        return F.when(d["pos"] > last, F.concat(kept, F.array(d))).otherwise(kept)

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def _around(values: Column, holes: Column, first, after, start: Column, stop: Column, filled=None) -> Column:
    """``values`` from ``start`` to ``stop`` without the stretches ``holes`` cover.

    ``first`` and ``after`` give a hole's bounds; ``filled`` what stands in its place.
    Slices are copied whole, so the work is linear in the values."""
    def piece(d: Column, i: Column) -> Column:
        begin = F.coalesce(after(F.get(holes, i - 1)), start)
        kept = F.slice(values, begin + 1, F.greatest(first(d) - begin, F.lit(0)))
        return kept if filled is None else F.concat(kept, filled(d))

    begin = F.coalesce(after(F.get(holes, F.size(holes) - 1)), start)
    tail = F.slice(values, begin + 1, F.greatest(stop - begin, F.lit(0)))
    return F.flatten(F.concat(F.transform(holes, piece), F.array(tail)))


def find(el: El) -> Column:
    """First such element, or null."""
    if el.inside is None:
        return F.get(F.filter(_nodes(), lambda n: is_el(n, el)), F.lit(0))
    return let(
        find(el.inside),
        lambda o: F.get(F.filter(inside(o), lambda n: is_el(n, el)), F.lit(0)),
    )


def exists_el(el: El) -> Column:
    return F.exists(_nodes(), lambda n: is_el(n, el))


def text_of(n: Column, sep: str) -> Column:
    return F.array_join(F.slice(_strings(), n["t0"] + 1, n["t1"] - n["t0"]), sep)


def first_of(values: list[Column]) -> Column:
    return F.coalesce(*values)


# --- page kinds ------------------------------------------------------------------------


def page_type() -> Column:
    """``article`` where any article mark is present, else ``listing``."""
    return F.when(_any([exists_el(el) for el in ARTICLE_MARKS]), "article").otherwise("listing")


def is_paywalled() -> Column:
    """Paywall container that is active, shown, old style, or says so."""
    wall = find(El("div", id="paywall"))

    def closed(w: Column) -> Column:
        style = F.coalesce(w["style"], F.lit(""))
        card = has_inside(w, lambda n: is_el(n, El("fluent-card", "old-paywall")))
        return (
            X.contains_any(style, ("display: inherit", "display: block"))
            | card
            | X.contains_any(F.lower(text_of(w, " ")), K.PAYWALL_PHRASES)
        )

    return exists_el(El(id="paywallFluent")) | F.coalesce(
        let(wall, lambda w: w.isNotNull() & closed(w)), F.lit(False)
    )


def is_registration_walled() -> Column:
    form_id = F.exists(
        _nodes(),
        lambda n: (n["tag"] == "div") & F.startswith(F.coalesce(n["id"], F.lit("")), F.lit("zephr-form-")),
    )
    wall = let(
        find(El("div", "regwall-main")),
        lambda w: X.contains_any(F.lower(text_of(w, " ")), K.REGWALL_PHRASES),
    )
    return exists_el(El("div", "zephr-registration-form")) | form_id | F.coalesce(wall, F.lit(False))


def is_walled(outlet: str) -> Column:
    if outlet == "DailyCaller":
        return is_paywalled()
    if outlet == "DailyBeast":
        return is_registration_walled()
    return F.lit(False)


def drop_walled(pages: DataFrame) -> DataFrame:
    """Pages behind no wall of either kind."""
    return pages.where(~(is_paywalled() | is_registration_walled()))


# --- headline and date -------------------------------------------------------------------


def headline(rules: PageRules) -> Column:
    """Text of the first headline element that is there (and long enough)."""

    def words_of(n: Column) -> Column:
        if rules.headline_text == "raw":
            return n["raw"]
        return text_of(n, " " if rules.headline_text == "spaced" else "")

    found = []
    for el in rules.headline:
        t = let(find(el), lambda n: F.when(n.isNotNull(), words_of(n)))
        if rules.headline_min_chars:
            t = let(t, lambda x: F.when(F.length(x) > rules.headline_min_chars, x))
        found.append(t)
    return first_of(found)


def _text_at(el: El, sep: str = "") -> Column:
    return let(find(el), lambda n: F.when(n.isNotNull(), text_of(n, sep)))


def _attr_at(el: El, attribute: str) -> Column:
    return let(find(el), lambda n: n[attribute])


def _meta(kind: str, name: str) -> Column:
    m = F.get(F.filter(_nodes(), lambda n: (n["tag"] == "meta") & (n[kind] == name)), F.lit(0))
    return let(m, lambda n: F.when(n["content"] != "", n["content"]))


def _nth_inside(el: El, tag: str, i: int) -> Column:
    inner = let(
        find(el), lambda o: F.get(F.filter(inside(o), lambda n: n["tag"] == tag), F.lit(i))
    )
    return let(inner, lambda n: F.when(n.isNotNull(), text_of(n, "")))


def published(outlet: str) -> Column:
    """Publication date as the outlet's records hold it."""
    if outlet == "AlterNet":
        return F.coalesce(_text_at(El("span", "post-date")), F.lit(""))
    if outlet == "CounterPunch":
        return profiles.after_form(outlet, _text_at(El("span", "post_date")))
    if outlet == "DailyBeast":
        return _attr_at(El("time", "PublicationTime__pub-time"), "datetime")
    if outlet == "MotherJones":
        return X.collapse_ws(_text_at(El("span", "dateline", inside=El("div", "mj-top-flag")), " "))
    if outlet == "Salon":
        dated = F.get(F.filter(_nodes(), lambda n: (n["tag"] == "time") & n["datetime"].isNotNull()), F.lit(0))
        return let(dated, lambda n: n["datetime"])
    if outlet == "FoxNews":
        return _text_at(El("time", inside=El("span", "article-date")))
    if outlet == "American_Conservative":
        byline = let(_text_at(El("span", "o-byline__date-item")), lambda t: dates.byline_date(t))
        metas = [_meta(kind, name) for kind, name in META_DATES]
        return first_of([byline, *[let(m, dates.meta_date) for m in metas]])
    if outlet == "American_Spectator":
        return first_of(
            [_text_at(El("div", "date print-only")), _attr_at(El("time", "entry-date"), "datetime")]
        )
    if outlet == "The_Free_Beacon":
        block = let(
            _nth_inside(El("div", "author-date"), "div", 1),
            lambda d: let(
                profiles.after_form(outlet, d),
                lambda t: F.coalesce(dates.byline_date(t, ("MMMM d, yyyy",)), t),
            ),
        )
        return first_of([let(_meta("property", "article:published_time"), dates.iso_or_text_date), block])
    spans = F.concat_ws(" ", _nth_inside(El("time"), "span", 0), _nth_inside(El("time"), "span", 1))
    return let(spans, dates.eastern_to_utc)


# --- paragraphs ----------------------------------------------------------------------------


def _spans(nodes: Column) -> Column:
    return F.transform(
        nodes,
        lambda n: F.struct(
            n["pos"].alias("pos"), n["last"].alias("last"), n["t0"].alias("t0"), n["t1"].alias("t1")
        ),
    )


def _dropped(rules: PageRules) -> Column | None:
    """Elements whose whole content is thrown away; None without such rules."""

    def is_mail(n: Column) -> Column:
        return (n["tag"] == "a") & F.startswith(F.lower(F.coalesce(n["href"], F.lit(""))), F.lit("mailto:"))

    def rule(n: Column) -> Column:
        conditions = []
        if rules.drop_tags:
            conditions.append(n["tag"].isin(list(rules.drop_tags)))
        conditions += [is_el(n, el) for el in rules.drop_elements]
        if rules.drop_class_parts:
            hit = class_contains(n, rules.drop_class_parts, rules.drop_class_parts_cased)
            if rules.drop_class_tags:
                hit = n["tag"].isin(list(rules.drop_class_tags)) & hit
            conditions.append(hit)
        for part in rules.drop_paragraph_ids:
            conditions.append((n["tag"] == "p") & F.contains(F.coalesce(n["id"], F.lit("")), F.lit(part)))
        if rules.drop_marked:
            tag, mark = rules.drop_marked
            conditions.append((n["tag"] == tag) & F.contains(F.lower(text_of(n, " ")), F.lit(mark)))
        if rules.drop_bios:
            conditions.append(
                (n["tag"] == "p") & (has_inside(n, is_mail) | is_author_bio(text_of(n, " ")))
            )
        return _any(conditions)

    if not (rules.drop_tags or rules.drop_elements or rules.drop_class_parts):
        return None
    return _spans(F.filter(_nodes(), rule))


def _bad_parents(rules: PageRules) -> Column | None:
    """What lies in elements whose paragraphs are skipped; None without such rules."""
    if not (rules.skip_under_classes or rules.skip_under_ids or rules.skip_under_tags):
        return None

    def rule(n: Column) -> Column:
        conditions = []
        if rules.skip_under_classes:
            names = F.array(*[F.lit(c) for c in rules.skip_under_classes])
            conditions.append((n["tag"] == "div") & F.arrays_overlap(n["cls"], names))
        if rules.skip_under_ids:
            conditions.append(F.coalesce(n["id"], F.lit("")).isin(list(rules.skip_under_ids)))
        if rules.skip_under_tags:
            conditions.append(n["tag"].isin(list(rules.skip_under_tags)))
        return _any(conditions) & (n["last"] > n["pos"])

    found = _spans(F.filter(_nodes(), rule))
    # the element itself may be a paragraph: only what it holds is skipped
    return F.transform(found, lambda d: d.withField("pos", d["pos"] + 1))


def _is_bad_child(rules: PageRules):
    """Rule for elements that disqualify the paragraph around them; None without."""
    if not (rules.skip_with or rules.skip_with_tags or rules.long_link_words):
        return None

    def rule(n: Column) -> Column:
        conditions = [is_el(n, el) for el in rules.skip_with]
        if rules.skip_with_tags:
            conditions.append(n["tag"].isin(list(rules.skip_with_tags)))
        if rules.long_link_words:
            conditions.append((n["tag"] == "a") & (X.word_count(text_of(n, "")) > rules.long_link_words))
        return _any(conditions)

    return rule


def paragraphs(rules: PageRules, with_breaks: bool = False) -> Column:
    """Array of (text, has_break) of the body's paragraphs, in page order.

    The body is a slice of the elements; what is thrown away is cut out of it, and
    blanked among the strings, once. A paragraph then looks at its own elements and
    strings only, whatever else the page holds.
    """
    bad_child = _is_bad_child(rules)

    def wanted(n: Column) -> Column:
        keep = n["tag"].isin(list(rules.paragraphs))
        if rules.paragraph_class:
            keep = keep & has_class(n, rules.paragraph_class)
        if rules.skip_classes:
            names = F.array(*[F.lit(c) for c in rules.skip_classes])
            keep = keep & ~F.arrays_overlap(n["cls"], names)
        return keep if bad_child is None else keep & ~has_inside(n, bad_child)

    def entries(nodes: Column, strings: Column) -> Column:
        def entry(n: Column) -> Column:
            parts = F.slice(strings, n["t0"] + 1, n["t1"] - n["t0"])
            has_break = has_inside(n, lambda d: d["tag"] == "br") if with_breaks else F.lit(False)
            return F.struct(F.array_join(parts, " ").alias("text"), has_break.alias("has_break"))

        return F.transform(F.filter(nodes, wanted), entry)

    def without(holes: Column, body: Column) -> Column:
        return _around(
            _nodes(), holes, lambda d: d["pos"], lambda d: d["last"] + 1, body["pos"] + 1, body["last"] + 1
        )

    def blanked(holes: Column) -> Column:
        nothing = lambda d: F.array_repeat(F.lit(None).cast("string"), d["t1"] - d["t0"])
        return _around(
            _strings(), holes, lambda d: d["t0"], lambda d: d["t1"], F.lit(0), F.size(_strings()), nothing
        )

    gone, skipped = _dropped(rules), _bad_parents(rules)

    def of_body(body: Column) -> Column:
        def held(spans: Column) -> Column:
            return outermost(F.filter(spans, lambda d: (d["pos"] > body["pos"]) & (d["pos"] <= body["last"])))

        if gone is None and skipped is None:
            return entries(inside(body), _strings())
        cut = skipped
        if skipped is not None and gone is not None:  # in order, the wider first where two begin together
            cut = F.array_sort(
                F.concat(held(gone), skipped),
                lambda a, b: F.when(a["pos"] != b["pos"], a["pos"] - b["pos"]).otherwise(b["last"] - a["last"]),
            )

        def reaching() -> Column:  # one that holds the body itself leaves nothing of it
            return F.filter(outermost(cut), lambda d: (d["last"] > body["pos"]) & (d["pos"] <= body["last"]))

        if gone is None:
            return let(reaching(), lambda h: entries(without(h, body), _strings()))
        return let(held(gone), lambda g: let(
            g if skipped is None else reaching(), lambda h: let(blanked(g), lambda s: entries(without(h, body), s))
        ))

    bodies = F.filter(F.array(*[find(el) for el in rules.body]), lambda n: n.isNotNull())
    if not rules.first_filled_body:
        bodies = F.slice(bodies, 1, 1)
    options = F.transform(bodies, of_body)
    if rules.first_filled_body:
        options = F.filter(options, lambda o: F.exists(o, lambda p: F.length(p["text"]) > rules.min_chars))
    return F.get(options, F.lit(0))


_MARK = "\u0001"  # stands between paragraphs while they are one string


def joined_paragraphs(outlet: str, paras: Column) -> Column:
    """Paragraph texts that survive the outlet's wording rules, as one string."""
    rules = RULES[outlet]
    texts = F.transform(paras, lambda p: p["text"])
    if outlet == "CounterPunch":
        return F.array_join(F.transform(texts, lambda t: F.replace(t, F.lit('\\"'), F.lit('"'))), _MARK)
    if outlet in ("FoxNews", "DailyCaller"):
        texts = F.transform(texts, lambda t: profiles.after_form(outlet, t))
    elif outlet in ("American_Spectator", "The_Free_Beacon", "DailyBeast"):
        texts = F.transform(texts, X.collapse_ws)
    texts = F.filter(
        texts,
        lambda t: (X.word_count(t) >= rules.min_words)
        & (F.length(t) > rules.min_chars)
        & ~is_boilerplate(outlet, t),
    )
    if outlet == "American_Spectator":
        texts = F.filter(F.transform(texts, X.join_drop_cap), lambda t: X.word_count(t) >= rules.min_words)
    if outlet == "FoxNews":
        texts = F.transform(texts, lambda t: profiles.tidy_punctuation(t, curly=True))
    return F.array_join(texts, _MARK if outlet == "AlterNet" else rules.joiner)


def _counterpunch_blocks(formed: Column, paras: Column) -> Column:
    """Cleaned paragraphs without author lines and disclaimers."""
    def kept(cleaned: Column) -> Column:
        n = F.size(cleaned)
        entries = F.zip_with(
            cleaned, paras, lambda t, p: F.struct(t.alias("text"), p["has_break"].alias("has_break"))
        )
        signed = F.filter(
            entries,
            lambda e, i: (e["text"] != "")
            & ~X.is_signature(e["text"], n - 1 - i, e["has_break"])
            & ~is_boilerplate("CounterPunch", e["text"]),
        )
        return F.transform(signed, lambda e: e["text"])

    cleaned = F.transform(F.split(formed, _MARK), lambda t: profiles.after_form("CounterPunch", t))
    return let(cleaned, kept)


def finished_body(outlet: str, formed: Column, blocks: Column) -> Column:
    """Body text after the Unicode form was applied to the joined paragraphs;
    ``blocks`` are CounterPunch's, none of which contains another."""
    if outlet == "CounterPunch":
        return F.array_join(X.paragraphs(F.array_join(X.distinct_blocks(blocks), "\n\n")), "\n\n")
    if outlet == "AlterNet":
        parts = F.transform(
            F.split(formed, _MARK),
            lambda t: profiles.tidy_punctuation(profiles.after_form(outlet, t), curly=False),
        )
        return F.array_join(parts, "\n\n")
    if outlet == "FoxNews":
        return profiles.after_form(outlet, profiles.tidy_punctuation(formed, curly=True))
    return profiles.after_form(outlet, formed)


def _accepted(outlet: str) -> Column:
    _, _, least = K.OUTLETS[outlet]
    ok = (F.col("body_text").isNotNull()) & (F.col("word_count") >= least)
    if RULES[outlet].needs_headline:
        ok = ok & (F.coalesce(F.col("headline"), F.lit("")) != "")
    if outlet == "American_Conservative":
        ok = ok & dates.is_recent("publication_date") & (F.length("body_text") > 300)
    return ok & ~F.col("walled")


def _article_id(outlet: str) -> Column:
    if outlet in ("MotherJones", "Salon"):
        return U.slug_underscored("url")
    if outlet == "DailyBeast":
        return U.slug_sha256("url")
    if outlet in ("CounterPunch", "American_Spectator", "The_Free_Beacon"):
        return U.slug("url")
    if outlet == "DailyCaller":
        return _attr_at(El("div", id="articleContent"), "dc_data")
    return U.url_hash("url").cast("string")


def computed(df: DataFrame, keep: tuple[str, ...], **columns: Column) -> DataFrame:
    """Columns worked out once per row.

    Goes through a one-element ``inline``, which the optimizer does not see
    through: large expressions are neither copied into later filters nor
    repeated where they are used more than once.
    """
    entry = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(entry)))


def parsed_pages(pages: DataFrame, outlets: tuple[str, ...] = tuple(K.OUTLETS)) -> DataFrame:
    """Every page with headline, date, body, word count and verdict.

    ``pages`` holds ``page_id, url, html, outlet``.  One pass for all outlets:
    each row evaluates its own outlet's branch only, and the Python stages are
    the page parser and the Unicode form.
    """

    def per_outlet(build) -> Column:
        out = None
        for key in outlets:
            branch = F.col("outlet") == key
            out = F.when(branch, build(key)) if out is None else out.when(branch, build(key))
        return out

    parsed = with_nodes(pages)
    found = computed(
        parsed,
        keep=("page_id", "url", "outlet"),
        form=per_outlet(lambda k: F.lit(profiles.UNICODE_FORM[k])),
        paras=per_outlet(lambda k: paragraphs(RULES[k], with_breaks=k == "CounterPunch")),
        article_id=per_outlet(_article_id),
        walled=per_outlet(is_walled),
        page_type=page_type(),
        publication_date=per_outlet(published),
        found_headline=per_outlet(lambda k: headline(RULES[k])),
    )
    known = ("page_id", "url", "outlet", "article_id", "walled", "page_type", "publication_date", "paras")
    raw = computed(
        found,
        keep=(*known, "form"),
        raw_headline=per_outlet(lambda k: profiles.before_form(k, F.col("found_headline"))),
        raw_body=per_outlet(lambda k: profiles.before_form(k, joined_paragraphs(k, F.col("paras")))),
    )
    formed = raw.select(
        *known,
        X.unicode_form("raw_headline", F.col("form")).alias("formed_headline"),
        X.unicode_form("raw_body", F.col("form")).alias("formed_body"),
    )
    blocks = F.lit(None).cast("array<string>")
    if "CounterPunch" in outlets:
        own = F.when(F.col("outlet") == "CounterPunch", _counterpunch_blocks(F.col("formed_body"), F.col("paras")))
        staged = computed(formed, keep=(*known[:-1], "formed_headline", "formed_body"), blocks=own)
        formed, blocks = staged.withColumn("blocks", drop_wrappers("blocks")), F.col("blocks")
    finished = computed(
        formed,
        keep=known[:-1],
        headline=per_outlet(lambda k: profiles.after_form(k, F.col("formed_headline"))),
        body_text=per_outlet(lambda k: finished_body(k, F.col("formed_body"), blocks)),
    )
    return (
        finished.withColumn("word_count", X.word_count("body_text"))
        .withColumn("accepted", per_outlet(_accepted))
        .select(
            "page_id", "url", "outlet", "article_id", "page_type", "headline", "publication_date",
            "body_text", "word_count", "walled", "accepted",
        )
    )


def articles(pages: DataFrame, crawl_timestamp: Column, outlets: tuple[str, ...] = tuple(K.OUTLETS)) -> DataFrame:
    """Accepted articles in the column order of article files."""

    def per_outlet(i: int) -> Column:
        pairs = [F.lit(x) for k in outlets for x in (k, K.OUTLETS[k][i])]
        return F.element_at(F.create_map(*pairs), F.col("outlet"))

    return (
        parsed_pages(pages, outlets)
        .where("accepted")
        .select(
            "article_id", "url", "headline", "body_text", "publication_date",
            per_outlet(0).alias("outlet_name"),
            F.col("word_count").cast("long").alias("word_count"),
            per_outlet(1).alias("label"),
            crawl_timestamp.alias("crawl_timestamp"),
        )
    )


# --- links ----------------------------------------------------------------------------------


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Absolute URL of every followable anchor of each page."""
    anchors = F.filter(_nodes(), lambda n: (n["tag"] == "a") & (F.coalesce(n["href"], F.lit("")) != ""))
    href = F.col("a")["href"]
    return (
        with_nodes(pages)
        .select(id_col, url_col, F.explode(anchors).alias("a"))
        .where(U.is_followable(href))
        .select(id_col, U.resolve(href, url_col).alias("link"))
    )


def _within_any(boxes: Column, rule) -> Column:
    """Elements that lie in one of the boxes and meet a rule, each once, in order."""
    return F.flatten(F.transform(outermost(boxes), lambda o: F.filter(inside(o), rule)))


def _hrefs(outlet: str) -> Column:
    """Addresses of the anchors in an outlet's listing containers, as written."""
    href = lambda n: n["href"]
    is_link = lambda n: (n["tag"] == "a") & (F.coalesce(n["href"], F.lit("")) != "")

    def boxes_of(el: El) -> Column:
        return F.filter(_nodes(), lambda n: is_el(n, el))

    if outlet == "MotherJones":
        return F.transform(_within_any(boxes_of(El("ul", "articles-list")), is_link), href)
    if outlet == "CounterPunch":
        posts = F.filter(
            _nodes(),
            lambda n: (n["tag"] == "div") & F.startswith(F.coalesce(n["id"], F.lit("")), F.lit("post-"))
            & F.contains(F.array_join(n["cls"], " "), F.lit("post_box")),
        )
        headlines = _within_any(posts, lambda n: is_el(n, El("h1", "headline")))
        return F.transform(_within_any(headlines, is_link), href)
    if outlet == "Salon":  # the first link of each card
        cards = boxes_of(El("div", "grid-article"))
        return F.transform(cards, lambda o: F.get(F.filter(inside(o), is_link), F.lit(0))["href"])
    return F.transform(F.filter(_nodes(), is_link), href)


def _admitted(outlet: str, href: Column, base: Column) -> Column:
    """The cleaned address of an article of the outlet, or null."""
    if outlet == "MotherJones":
        fits = U.is_dated_article(href, K.MOTHERJONES_DATED_PATH, K.MOTHERJONES_ORIGIN, K.MOTHERJONES_SECTION)
        return F.when(fits, U.drop_query(href))
    if outlet == "CounterPunch":
        return F.when(href.rlike(K.COUNTERPUNCH_URL_PATTERN), href)
    if outlet == "Salon":
        return F.when(U.is_dated_article(href, K.SALON_DATED_PATH, K.SALON_ORIGIN), U.drop_query(href))
    full = let(U.resolve(href, base), lambda u: U.normalize_url(u))
    return F.when(U.is_followable(href), let(full, lambda u: F.when(U.is_crawlable(u), u)))


DISCOVERING = ("MotherJones", "CounterPunch", "Salon", "American_Conservative")


def discovered_links(pages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(outlet, url): articles linked from listing pages (url, outlet, html), each once.

    Links come from the outlet's listing container, are admitted by its rule and
    cleaned; addresses in ``seen`` (url) are left out.
    """
    hrefs = link = None
    for outlet in DISCOVERING:
        here, own = F.col("outlet") == outlet, _admitted(outlet, F.col("href"), F.col("url"))
        hrefs = F.when(here, _hrefs(outlet)) if hrefs is None else hrefs.when(here, _hrefs(outlet))
        link = F.when(here, own) if link is None else link.when(here, own)
    kept = pages.where(F.col("outlet").isin(*DISCOVERING))
    found = with_nodes(kept).select("outlet", "url", F.explode(hrefs).alias("href")).where("href IS NOT NULL")
    links = found.select("outlet", link.alias("link")).where("link IS NOT NULL")
    links = links.select("outlet", F.col("link").alias("url")).distinct()
    return links if seen is None else links.join(seen.select("url"), "url", "left_anti").select("outlet", "url")


def listing_links(pages: DataFrame, block: El, link: El = El("a")) -> DataFrame:
    """Hrefs of links inside the blocks of a listing page, each once."""
    blocks = F.filter(_nodes(), lambda n: is_el(n, block))
    links = _within_any(blocks, lambda n: is_el(n, link) & n["href"].isNotNull())
    hrefs = F.transform(links, lambda n: n["href"])
    return with_nodes(pages).select(F.explode(F.array_distinct(hrefs)).alias("url")).distinct()


