"""Main text of pages: named boilerplate, density without names, broken markup, and the given pages by a plain rule."""

import html
import re

import duckdb
import pytest

from echofold.llm.extraction import extract, main_text, op12_extraction

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
%s<aside>Side</aside><form><label>Name</label><input value="x"></form><div id="comments"><p>First!</p></div><footer>&copy; 2024</footer></body></html>"""
LONG = "Some words that make up a paragraph of an ordinary length, with a comma or two, and an end. "


def page(body):
    return PAGE % body


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Head &lt;1&gt;</h1><p>A  b\n c<br>d<p>e &eacute;&#x1D4B3;&nbsp;f</article>", "Head <1>\nA b c d\ne é𝒳 f"),
        # a short article beside much boilerplate
        ("<article><h1>Hi.</h1></article>", "Hi."),
        # sections, lists and tables of an article stay whole, its advert and comments go
        ("<main><section><p>%s</section><section><ul><li>one<li>two</ul><div class='ad'>Buy</div><table><tr><td>1<td>2</table></section><div class='reader-comments'>no</div></main>" % LONG, LONG.strip() + "\none\ntwo\n1\n2"),
        ("<article><header><h2>Title</h2></header><p>x</p><footer>f</footer></article>", "Title\nx"),
        # words that only contain a name, and a named block around the article, are none
        ("<div class='adventure header'><article class='comment-free'><p class='shadow'>kept</p></article></div>", "kept"),
        # inline markup, comments and scripts join; blocks part
        ("<article>a<b>b</b><!-- no -->c<script>x</script>d<div>e</div>f</article>", "abcd\ne\nf"),
        # broken: unclosed, crossed, stray ends, bare < and &
        ("<article><p><b>one<p>two</i></b> 1 < 2 & 3 &am</p></div></article>", "one\ntwo 1 < 2 & 3 &am"),
        ("<article><p title='a > b'>q</p><p class=\"x>y</p>z</article>", "q\ny\nz"),
    ],
)
def test_pages(body, text):
    assert main_text(page(body)) == text


def test_density_without_names():
    links = "<div>" + "".join(f"<a href=/{k}>link number {k}</a> " for k in range(30)) + "</div>"
    core = "".join(f"<p>{LONG * (1 + k % 3)}</p>" for k in range(8))
    text = main_text(f"<html><body>{links}<div><div>{core}</div><div><p>{LONG}</p><p>{LONG * 2}</p></div></div>{links}</body></html>")
    want = [" ".join((LONG * (1 + k % 3)).split()) for k in range(8)] + [LONG.strip(), " ".join((LONG * 2).split())]
    assert text == "\n".join(want)


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "   ", "<", "<p", "<!-- x", "<script>x", "</p>", "<nav>x</nav>")] == ["", "", "", "<", "", "", "", "", ""]
    assert main_text("just text\n&amp; more") == "just text & more"
    assert main_text("<p>a<p>b") == "a\nb"
    assert len(main_text("<article>" + "<p>word</p>" * 50_000)) == 5 * 50_000 - 1
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert main_text("<article>" + "<p>%s</p>" % ("w " * 300_000) + "</article>").count("w") == 300_000


def test_rows(spark):
    rows = [(1, "u", page("<article>x</article>"), 1, "t"), (1, "u", page("<article>x</article>"), 1, "t"), (None, None, None, 2, "t"), (3, None, "", 2, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    assert sorted(map(tuple, extract(df).collect()), key=repr) == sorted([(1, "u", "x"), (1, "u", "x"), (None, None, ""), (3, None, "")], key=repr)
    assert extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    """On pages of one known form a plain rule gives the same: all of the article, block by block."""
    data = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op12_extraction(spark, data).collect()}
    pages = duckdb.connect().execute(f"SELECT page_id, url, html FROM '{data}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page_id, url, source in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert (got[page_id].url, got[page_id].text, got[page_id].n_chars) == (url, want, len(want))
