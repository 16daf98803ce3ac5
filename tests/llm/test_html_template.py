import random

from crosstally.llm import html_template as H

from .conftest import FOLDER

PAGE = """<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body>
<header><a href="/">Site</a></header><ul class="main-menu"><li><a href="/a">Menu {i}</a></li></ul>
<div class="cookie-notice">We use cookies {i}</div><div id="content"><h1>Head &amp; line {i}</h1>
<p class="label">Share this</p><p>First  <b>bold</b>
para {w}.</p><script>var a = "<p>no</p>";</script><p>Second {i}<br>para {w}</p><form><p>Your mail {i}</p></form>
<ul><li>One {i}<li>Two {i}</ul></div><div class="sidebar"><p>Side {w}</p></div><div class="comments"><p>Nice! {w}</p></div>
<footer>&copy; {i}</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_slots_of_a_template(spark):
    rng = random.Random(1)
    word = lambda i: " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(20 + i % 7)) + str(i)
    kept = {i: word(i) for i in range(30)}
    rows = [(i, f"https://Host.example/{i}", PAGE.format(i=i, w=w)) for i, w in kept.items()]
    rows += [(100 + i, f"http://other.example/{i}", f"<html><body><nav>menu</nav><article><h1>A {i}</h1><p>Text {w}</article></body>")
             for i, w in kept.items()]
    got = {r.page_id: r.text for r in H.main_texts(pages(spark, rows)).collect()}
    for i, w in kept.items():
        lines = got[i].split("\n")
        assert lines[:2] == [f"Head & line {i}", f"First bold para {w}."]
        assert lines[2:] == [f"Second {i}", f"para {w}", f"One {i}", f"Two {i}"]  # the label stands on every page of the host
        assert got[100 + i] == f"A {i}\nText {w}"


def test_whole_article_of_every_page(spark):
    import html
    import re

    table = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r for r in H.main_texts(table).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = r.html[r.html.find("<article>") + 9 : r.html.find("</article>")]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("<h1>|</h1>|<p>|</p>|<br>", article))
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_odd_rows(spark):
    long = "<html><body><article>" + "<p>" + "word " * 200_000 + "</article></body></html>"
    rows = [(1, None, None), (2, "", ""), (3, "no url", "just text &lt;here"), (None, "http://a.b/", "<p>x</p>"), (4, "http://a.b/", "<p>x</p>"),
            (4, "http://a.b/", "<p>x</p>"), (5, "http://c.d", long), (6, "http://c.d", "<div"), (7, "http://c.d", "<p a='>b</p>" + "<" * 500),
            (8, "http://c.d", "<nav>only menu</nav>"), (9, "http://e.f", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    frame = pages(spark, rows).selectExpr("*", "1 AS host", "'x' AS text", "2 AS salt", "3 AS main")
    got = H.main_texts(frame).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[8] == "" and by[3] == "just text <here" and by[4] == by[None] == "x" and by[9] == "deep"
    assert by[5] == ("word " * 200_000).strip()
    assert H.main_texts(frame.where("false")).collect() == []


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, f"http://same.host/{i}", "<html><body><div class='nav'>m</div><article><h1>Short</h1><p>Same text here again and again, long enough to be one.</p></article></body></html>")
            for i in range(20)]
    assert {r.text for r in H.main_texts(pages(spark, rows)).collect()} == {
        "Short\nSame text here again and again, long enough to be one."}


def test_header_of_an_article_is_its_own(spark):
    page = "<body><header>Site</header><article><header class='entry-header'><h1>Title</h1></header><p>Text of it.</p><footer>By me</footer></article>"
    assert [r.text for r in H.main_texts(pages(spark, [(1, "http://a.b/", page)])).collect()] == ["Title\nText of it."]


def one(spark, html, n=12, host="http://h.example", **fields):
    """The text of page 0 of a host with ``n`` such pages; {i} and {w} differ from page to page."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        w = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(999)}" for _ in range(40))
        rows.append((i, f"{host}/{i}", html.replace("{i}", f"{i}x").replace("{w}", w)))
    got = {r.page_id: r.text for r in H.main_texts(pages(spark, rows)).collect()}
    return got[0].replace(rows[0][2].split("W:")[1].split("<")[0] if "W:" in rows[0][2] else "\0", "{w}").split("\n")


def test_an_article_is_whole_around_its_body(spark):
    nested = ("<body><div class='teasers'><p>Teaser {i}</p></div><article><h1>Head {i}</h1><p class='lead'>Lead {i}</p>"
              "<section class='intro'><p>Intro {i}</p></section><div class='body'><p>W:{w}</p><p>more {w} {w}</p></div></article></body>")
    got = one(spark, nested)
    assert got[:4] == ["Head 0x", "Lead 0x", "Intro 0x", "W:{w}"] and len(got) == 5
    plain = nested.replace("<article>", "<div id='story'>").replace("</article>", "</div>")
    got = one(spark, plain)
    assert got[:4] == ["Head 0x", "Lead 0x", "Intro 0x", "W:{w}"] and len(got) == 5


def test_names_inside_an_article_are_whole_roles(spark):
    page = ("<body><article><h1>H {i}</h1><p class='share-price'>Price {i}</p><div class='search-history'>History {i}</div><p class='related'>Para {i}</p>"
            "<div class='share-buttons'>Share {i}</div><div class='comments-area'><p>Comment {i}</p></div><aside>Aside {i}</aside>"
            "<div class='cookie-notice'>Cookies {i}</div><ul class='related-posts'><li>Other {i}</li></ul><p>W:{w}</p></article></body>")
    assert one(spark, page) == ["H 0x", "Price 0x", "History 0x", "Para 0x", "W:{w}"]


def test_columns_of_a_grid_are_places_of_their_own(spark):
    page = "<body><div class='row'><div class='col-md-8'><h1>H {i}</h1><p>W:{w}</p><p>{w} {w} {w}</p></div><div class='col-md-4'><p>Weather {i}</p></div></div></body>"
    got = one(spark, page)
    assert got[:2] == ["H 0x", "W:{w}"] and len(got) == 3
    numbered = page.replace("<body>", "<body class='post-1234{i}' id='p{i}'>")
    assert len(one(spark, numbered.replace("{i}x", ""))) == 3


def test_long_strings_of_the_template_go(spark):
    notice = "This long sentence of far more than eight words stands on every single page of this whole site."
    page = f"<body><div id='c'><h1>H {{i}}</h1><p>W:{{w}}</p><p>{notice}</p></div></body>"
    assert one(spark, page) == ["H 0x", "W:{w}"]
    # Inside an article nothing is dropped, and a host of copies keeps its text.
    assert one(spark, page.replace("div id='c'", "article").replace("/div", "/article"))[-1] == notice
    copies = [(i, f"http://c.example/{i}", f"<body><div><h1>Same</h1><p>{notice}</p></div></body>") for i in range(9)]
    assert {r.text for r in H.main_texts(pages(spark, copies)).collect()} == {f"Same\n{notice}"}


def test_reading_takes_time_in_proportion(spark):
    import time

    for source in ("<a " * 350_000, "<a \"" * 260_000, "<a '\">" * 180_000, "<!a" * 350_000, "<" * 1_000_000, "<p>&" * 60_000, "<!--" * 260_000,
                   "<b>x" * 5_000, "<div>x" * 5_000, "<b><p>" * 5_000, "<div>x" * 5_000 + "</div>" * 5_000, "<p>x<b>" * 20_000, "</b>" * 250_000,
                   "<dt>x<i>" * 20_000):
        started = time.process_time()
        H._text(source, 0, set(), set())
        assert time.process_time() - started < 4, source[:20]
    levels = "<div>" * 5_000 + "deep" + "</div>" * 5_000
    assert H._text(levels, 0, set(), set()) == "deep"


def test_brackets_that_close_nothing():
    for source, text in (("a < b <a", "a < b <a"), ("x <p>y <b", "x\ny <b"), ("<p a='>one</p><p>two</p>", None), ("1 <!-- 2 <p> 3", "1"),
                         ("<p>a</p><!-- open", "a"), ("a <3 b", "a <3 b"), ("<p>a<br/>b", "a\nb")):
        got = H._text(source, 0, set(), set())
        assert text is None or got == text, (source, got)
