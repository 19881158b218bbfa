from retailoom.llm import html_text
from retailoom.llm.common import read

PAGE = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">The home of the news</a></li></ul></nav><!-- <p>x</p> -->
<div class="ad banner">Buy the best of the best and be happy with it in the end of all this and that for you</div>
<article class="post"><header><h1>A head&shy;line</h1></header><p>This is the   first paragraph of the text,&nbsp;and it is long enough to be sure of it.
<p>Short.<p>%%% *** $$$ symbols only without any known word but quite long so that it would be odd &lt;b&gt;</p>
<p><b>Bold &eacute;t&eacute;<br>line</b></p><ul><li>One<li>Two</ul><aside>The aside is not part of the article and that is that</aside>
<div class="comments"><p>I was the first of all to say that this is the best of the texts</p></div></article>
<form><label>Name of the user</label></form><footer>&copy; of the site</footer>"""


def test_page():
    text = html_text.main_text(PAGE)
    assert text.split("\n") == [
        "A head­line", "This is the first paragraph of the text, and it is long enough to be sure of it.", "Short.",
        "%%% *** $$$ symbols only without any known word but quite long so that it would be odd <b>", "Bold été line", "One", "Two"]


def test_pages_without_an_article():
    long = "This is the story of a man who was in the house with all of his books and that is it."
    page = f"<body><p>Menu</p><div><a href=x>The first of the links and all that is in it</a></div><h2>Head</h2><p>{long}</p><p>Short</p><p>{long}</p><p>Impressum</p></body>"
    assert [long in html_text.main_text(page), "first of the links" in html_text.main_text(page)] == [True, False]
    labels = html_text.second_pass(["bad", "ambiguous", "good", "ambiguous", "good", "ambiguous", "ambiguous", "bad"], [False] * 8)
    assert labels == ["bad", "bad", "good", "good", "good", "good", "bad", "bad"]


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<p", 1), (3, "u", "<article>" + "<p>word</p>" * 20000, 1), (3, "u", "plain < text", 1), (3, "u", "<article><p>a</b></p></i>b", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = html_text.query(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got][:2] == ["", ""] and got[3].n_chars == 20000 * 5 - 1 and got[5].text == "a\nb"
    assert html_text.query(pages.limit(0)).count() == 0


def test_article_text_of_the_tables(spark):
    import html
    import re
    table = read(spark, "/root/testdata/sf0.01", "pages")
    for r in html_text.query(table).join(table.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert r.text == "\n".join(p for p in parts if p)
