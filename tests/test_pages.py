import pytest
from pyspark.sql import functions as F

from newsloom.operators import pages as P
from newsloom.sources import html_nodes


def nodes(spark, html):
    return html_nodes.with_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))


def parse(spark, outlet, html, url="https://a.org/x/my-slug/"):
    df = spark.createDataFrame([(1, url, html, outlet)], "page_id long, url string, html string, outlet string")
    return P.parsed_pages(df, (outlet,)).first()


LONG = "This paragraph is long enough to be kept as a part of the article body text. "


def test_tree_follows_tag_soup():
    found, strings = html_nodes.shred("<p><b>a<br><p>b</p></article><script>var t='</p>';</script>&amp;c<!-- x -->d")
    tags = [(n["tag"], n["pos"], n["last"], n["t0"], n["t1"]) for n in found]
    assert tags[0] == ("p", 0, 4, 0, 4) and tags[3][0] == "p"
    assert strings == ["a", "b", "&c", "d"]
    assert html_nodes.shred(None) == ([], [])


def test_substring_class_rule_also_hits_header(spark):
    df = nodes(spark, '<div class="Header big">x</div><div class="body">y</div>')
    hit = F.transform("nodes", lambda n: P.class_contains(n, ("ad",)))
    assert df.select(hit.alias("h")).first()["h"] == [True, False]


@pytest.mark.parametrize(
    "html, walled",
    [
        ('<div id="paywallFluent"></div>', True),
        ('<div id="paywall" style="display: block"></div>', True),
        ('<div id="paywall" style="display: none"><p>Hello</p></div>', False),
        ('<div id="paywall"><fluent-card class="old-paywall"></fluent-card></div>', True),
        ('<div id="paywall"><p>Continue <b>reading</b></p></div>', True),
        ("<p>x</p>", False),
    ],
)
def test_paywall(spark, html, walled):
    assert nodes(spark, html).select(P.is_paywalled().alias("w")).first()["w"] is walled


def test_headline_choice(spark):
    html = "<h1>Short</h1><h2 class='c-hero-article__title'>A headline that is long</h2>"
    rules = P.RULES["American_Conservative"]
    assert nodes(spark, html).select(P.headline(rules).alias("h")).first()["h"] == "A headline that is long"
    assert nodes(spark, "<h1>Short</h1>").select(P.headline(rules).alias("h")).first()["h"] is None


def test_alternet_skips(spark):
    body = (
        f"<p>{LONG}</p><p class='postContent4'>{LONG}1</p><div class='bigcrunch-unit'><p>{LONG}2</p></div>"
        f"<p>{LONG}3<iframe></iframe></p><div id='alternet_dt_incontent'><p>{LONG}4</p></div><p>too short</p>"
        f"<p>‘Quote’ , that is kept in the text here</p>"
    )
    row = parse(spark, "AlterNet", f"<h1 class='headline'>T</h1><div class='body-description'>{body}</div>")
    # the opening-quote rule also takes the space after a closing quote
    assert row["body_text"] == f"{LONG.strip()}\n\n'Quote', that is kept in the text here"
    assert row["accepted"] is False and row["headline"] == "T"


def test_counterpunch_signature_wrapper_and_disclaimer(spark):
    ps = "".join(f"<p>{LONG}{i}</p>" for i in range(20))
    html = (
        f"<h1 class='headline'>T</h1><span class='post_date'>April 1, 2026</span><div class='post_content'><div class='wp-caption'><p>cap</p></div>"
        f"{ps}<p>{LONG}1</p><p>This piece first appeared on X.</p><p>Jane<br>Doe</p></div>"
    )
    row = parse(spark, "CounterPunch", html)
    blocks = row["body_text"].split("\n\n")
    # "...10" to "...19" contain "...1" and count as wrappers of it
    assert blocks == [f"{LONG}{i}" for i in range(10)]
    assert row["publication_date"] == "April 1, 2026" and row["article_id"] == "my-slug"


def test_daily_beast_fallback_container(spark):
    html = f"<div class='b-article-body'><article><p>no class</p></article></div><article id='main-article'><p class='c-paragraph'>{LONG}</p></article>"
    assert parse(spark, "DailyBeast", html)["body_text"] == LONG.strip()


def test_spectator_bio_related_and_nested_text(spark):
    html = (
        "<h1 class='entry-title'>T</h1><div class='post-body'><div class='paywall'>"
        f"<p>I <span class='first-char'></span>left the house early in the morning today</p><p>{LONG}<strong>(RELATED: more)</strong></p>"
        f"<blockquote><p>{LONG}quoted</p></blockquote><p>Jane is a director of something at some place</p>"
        f"<p>{LONG}<a href='mailto:x@y.z'>mail</a></p><p>Read more about this and that and those things</p><div class='read'><p>{LONG}ad</p></div></div></div>"
    )
    row = parse(spark, "American_Spectator", html)
    assert row["body_text"] == " ".join(
        ["Ileft the house early in the morning today", LONG.strip(), LONG + "quoted", LONG + "quoted"]
    )


def test_fox_rules(spark):
    html = (
        f"<h1>T</h1><span class='article-date'>x <time>March 28, 2026 6:49pm EDT</time></span><article><p>{LONG}</p><p><strong>{LONG}</strong></p>"
        f"<figure><p>{LONG}f</p></figure><p>{LONG}<a>one two three four five six seven</a></p><p>THIS IS ALL UPPER CASE JUNK TEXT HERE</p>"
        f"<p>Watch {LONG}</p><p>{LONG}“ end ”</p></article>"
    )
    row = parse(spark, "FoxNews", html)
    assert row["body_text"] == f'{LONG.strip()} {LONG}" end "'
    assert row["publication_date"] == "March 28, 2026 6:49pm EDT"


def test_conservative_dates_and_filters(spark):
    body = "".join(f"<p>{LONG}{i}</p>" for i in range(12))
    page = "<h1>A headline that is long</h1><span class='o-byline__date-item'>{d}</span><div class='o-content'>{b}<div class='header'><p>{b}</p></div></div>"
    row = parse(spark, "American_Conservative", page.format(d="February 3, 2026", b=body))
    assert row["accepted"] and row["publication_date"] == "2026-02-03" and row["page_type"] == "article"
    assert row["body_text"].count("\n") == 11
    old = parse(spark, "American_Conservative", page.format(d="February 3, 2024", b=body))
    assert old["accepted"] is False


def test_free_beacon_and_daily_caller_dates(spark):
    html = "<h1>T</h1><div class='author-date'><div>By</div><div>February 3, 2026</div></div><div class='article-content'><p>one two three</p><p>a b c d</p></div>"
    row = parse(spark, "The_Free_Beacon", html)
    assert (row["publication_date"], row["body_text"]) == ("2026-02-03", "a b c d")
    html = "<time><span>January 14, 2026</span> <span>4:47 PM ET</span></time><div id='articleContent' dc_data='9'><p>Related: x</p><p>y</p></div>"
    row = parse(spark, "DailyCaller", html)
    assert (row["publication_date"], row["body_text"], row["article_id"]) == ("2026-01-14T21:47:00+00:00", "y", "9")


def test_pages_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa

    from newsloom.sources import html_nodes

    monkeypatch.setattr(html_nodes, "SHREDDED_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 6, None, "b" * 4, "c" * 30, "", "d"])], ["html"])
    cuts = [c.column(0).to_pylist() for c in html_nodes._cuts([batch, batch.slice(0, 0)], "html")]
    assert [x for c in cuts for x in c] == batch.column(0).to_pylist() and [len(c) for c in cuts] == [3, 1, 2]


def test_cased_class_parts(spark):
    from newsloom.operators import pages as P

    rows = [(0, "spect-box"), (1, "SPECT-box"), (2, "Disclaimer"), (3, "disclaimer x"), (4, "MyAds")]
    df = spark.createDataFrame(rows, "id int, c string").selectExpr("id", "struct(split(c, ' ') AS cls) AS n")
    rules = P.RULES["American_Spectator"]
    hit = P.class_contains(df["n"], rules.drop_class_parts, rules.drop_class_parts_cased)
    assert [r.id for r in df.where(hit).orderBy("id").collect()] == [0, 3, 4]
