import html
import re

from logframe.llm.html import extract_main_text, main_text


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for page in extract_main_text(pages).collect():
        article = re.search("<article>(.*)</article>", page.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p|br)>", article)]
        assert page.main_text == "\n".join(b for b in blocks if b)


def test_without_an_article_element():
    long = "Sentence after sentence of the main text, long enough to rise above the rest of the page. "
    page = f"""<html><head><title>t</title></head><body><div id="top-menu"><a href=x>Home</a> <a href=y>About us and more</a></div>
    <div class='cookie-notice'>{long * 3}</div><p>Short</p><br><hr><hr><hr><hr><div class=content><h2>Head</h2><p>{long}<p>Second&nbsp;&eacute;
    <b>para</b>graph<ul><li>one<li>two</ul><script>if (a < b) document.write("<p>no</p>")</script></div>
    <section id="comments"><p>{long * 2}</p></section><footer>{long}</footer></body></html>"""
    assert main_text(page) == f"Head\n{long.strip()}\nSecond é paragraph\none\ntwo"


def test_article_with_other_things_inside():
    page = """<article><header><h1>Title &lt;1&gt;</h1></header><div class="ad">buy</div><p>One</p><aside>see also</aside>
    <form><p>search</p></form><p>Two<br>lines</p><!-- <p>note</p> --><div class="comments"><p>nice</p></div></article><p>outside</p>"""
    assert main_text(page) == "Title <1>\nOne\nTwo lines"
    assert main_text("<div class=ad>buy<article><p>text</p></article>") == "text"


def test_odd_pages(spark):
    for page, text in (("", ""), ("<p", ""), ("plain & text", "plain & text"), ("<", "<"), ("a < b", "a < b"), ("<a b='", ""), ("</p></div>", "")):
        assert main_text(page) == text, page
    assert main_text("<p>" + "x y " * 200_000) == ("x y " * 200_000).strip()
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    rows = spark.createDataFrame([(1, None, "u", "own"), (2, "<p>a</p>", None, "own"), (2, "<p>a</p>", None, "own")], "page_id long, html string, url string, MAIN_TEXT string")
    got = extract_main_text(rows)
    assert sorted((r.page_id, r.main_text) for r in got.collect()) == [(1, ""), (2, "a"), (2, "a")]
    assert extract_main_text(rows.limit(0)).count() == 0


def test_blocks_of_links_and_short_blocks_stay():
    long = "Sentence after sentence of the main text, long enough to rise above the rest of the page. "
    links = "<p>Long text</p><p><a href=x>Read the full report</a></p><ul><li><a href=y>Source one</a><li><a href=z>Source two</a></ul>"
    assert main_text(f"<a href=m>Menu</a><article>{links}</article>") == "Long text\nRead the full report\nSource one\nSource two"
    apart = "<hr>" * 5
    page = f"""<ul><li><a href=m>Menu of the page</a></ul><p>Before</p>{apart}<h1>Headline</h1>{apart}<p>{long}</p><p><a href=x>Read the full report</a></p>
    {apart}<p>Short</p>{apart}<div class=related><p>{long}</p></div><p><a href=y>Source</a></p>{apart}<p>{long}</p>{apart}<p><a href=q>Imprint</a></p>"""
    text = long.strip()
    assert main_text(page) == f"Headline\n{text}\nRead the full report\nShort\nSource\n{text}"
    assert main_text(f"<p>{long}<p><a href=x>Read the full report</a><p>{long}") == f"{text}\nRead the full report\n{text}"
