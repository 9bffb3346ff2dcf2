import html
import random
import re
import time

import pytest

from marginalia.llm import extraction
from marginalia.llm.extraction import extract_pages, main_text, smoothed, threshold
from marginalia.llm.queries import op4_html_extraction

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1><ul class="menu"><li><a href=x>A</a><li><a>B</a></ul></header>
<div id="page"><div class="notice">We use cookies to make this site better for you and others please accept them all now.</div>
<div class="content"><h2>Title here</h2><p>First paragraph with a good   deal of text &amp; more, so it counts&nbsp;as text.<p>Second <i>para</i>graph unclosed, again long enough to count as a content line.<ul><li>one<li>two</ul>
<div class="ad-box">Buy now! Cheap!</div><form><input><label>Your mail</label></form><script>var t="</p>";</script><p>End.</p></div>
<div class="sidebar"><p>Other stories that may be of interest to many readers of this long page.</p></div>
<div class="comments"><p>Great post, I liked reading it very much and will come again soon!</p></div></div><footer>&copy; me</footer></body></html>"""


def test_page_without_article():
    assert main_text(PAGE) == "Title here\nFirst paragraph with a good deal of text & more, so it counts as text.\nSecond paragraph unclosed, again long enough to count as a content line.\none\ntwo\nEnd."


def test_article_keeps_short_blocks_and_its_header():
    page = "<body><nav>long navigation text that says a lot of things about the site</nav><article><header><h1>H</h1></header><p>short</p><aside>zz</aside><p>c<br>d</p><footer>f</footer></article><div class='comment'>hello there</div></body>"
    assert main_text(page) == "H\nshort\nc d"


def test_edges():
    assert [main_text(x) for x in ("", "<article></article>", "plain", "<p>a</p", "<script>x", "&lt;b&gt; &#233;")] == ["", "", "plain", "a", "", "<b> é"]
    assert main_text("<article>" + "<p>x y</p>" * 20_000 + "</article>").count("\n") == 19_999
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_smoothing_and_threshold():
    assert max(abs(x - 3) for x in smoothed([3.0] * 5)) < 1e-9 and 2 < threshold([1, 1, 2, 90, 80, 100]) < 80 and threshold([5, 5]) == 0


def test_pages_against_their_articles(spark, sf):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op4_html_extraction(spark, sf).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted((r["text"] for r in extract_pages(df).collect())) == ["", "", "x"] and extract_pages(df.limit(0)).count() == 0


BODY = "<h1>T</h1><p>First paragraph with a good deal of text and more, so it counts as content here.</p><p>Second one that is about as long as the first one, and says more of it.</p><p>End.</p>"
TEXT = "T\nFirst paragraph with a good deal of text and more, so it counts as content here.\nSecond one that is about as long as the first one, and says more of it.\nEnd."


@pytest.mark.parametrize("wrapper", ['class="site"', 'class="site has-sidebar"', 'id="page" class="no-comments"', 'class="header-fixed"', 'class="left-sidebar"', 'class="comments"', 'role="search"', "hidden"])
def test_a_wrapper_stays_whatever_it_is_called(wrapper):
    assert main_text(f"<body><div {wrapper}>{BODY}</div></body>") == TEXT
    assert main_text(f"<body><nav><a>Home</a></nav><div {wrapper}>{BODY}<div class='ad'>Buy it now</div></div></body>") == TEXT
    assert main_text(f"<body><form id=f><div {wrapper}>{BODY}</div></form></body>") == TEXT


def test_long_comments_go():
    said = "<div class='comment'><p>I think that this is the best thing I have ever read about any of these, thank you very much.</p></div>" * 40
    assert main_text(f"<body><div class='post'>{BODY}</div><div id='comments'>{said}</div></body>") == TEXT
    assert main_text(f"<body><article>{BODY}</article><section class='comment-list'>{said.replace('div', 'article')}</section></body>") == TEXT


def test_an_empty_article_has_no_text():
    assert main_text("<body><div class='ad'>Nothing but this advert is here for you.</div><article></article><footer>me</footer></body>") == ""


def test_runs_of_links_are_left_out():
    links = "<ul>" + "<li><a>Some other page of this site</a></li>" * 5 + "</ul>"
    assert main_text(f"<body><div>{BODY}{links}</div></body>") == TEXT
    assert main_text(f"<body><div>{BODY}<p><a>one link alone</a></p></div></body>") == TEXT + "\none link alone"


def test_pages_of_several_templates():
    """Pages made of known blocks; the text is what they were made of."""
    rng = random.Random(3)
    words = "river stone lantern of the and copper window gentle where morning 1984 é über <b>bold</b> &amp;".split()

    def paragraph(least=14):
        return " ".join(rng.choice(words) for _ in range(rng.randint(least, 60))) + "."

    def plain(markup):
        return html.unescape(re.sub("<[^>]*>", "", markup))

    menu = "<ul>" + "".join(f"<li><a href=/{k}>{k}</a>" for k in ("Home", "News", "About us", "Contact")) + "</ul>"
    templates = [
        '<body class="single"><header id="masthead"><a>Site</a>{menu}</header><div id="content" class="site-content no-sidebar">{body}</div><div class="sidebar"><h3>More</h3>{menu}</div><div id="footer">All rights reserved</div></body>',
        '<body><div class="page-wrap with-menu"><div role="navigation">{menu}</div><main><div class="cookie-notice">We use cookies, please accept them.</div>{body}<div class="share">Share this with friends</div></main><section id="comments"><p>A reader wrote that this was quite a good one to read again.</p></section></div></body>',
        '<body><table><tr><td class="nav">{menu}</td><td>{body}</td></tr></table><div class="copyright footer">me</div></body>',
    ]
    for k in range(60):
        blocks = [("h1", "Title of the page"), *(("p", paragraph()) for _ in range(rng.randint(3, 9)))]
        body = "".join(f"<{tag}>{text}</{tag}>" for tag, text in blocks)
        assert main_text(templates[k % 3].format(menu=menu, body=body)) == "\n".join(plain(text) for _, text in blocks), k


def test_time_is_linear():
    for page in ("<body>" + "<p>some words here</p>" * 200_000, "<div>" * 50_000 + "<p>deep</p>" * 50_000, "<li><div>" + "<b>" * 5000 + "<li>x</li></i>" * 20_000):
        start = time.time()
        assert main_text(page)
        assert time.time() - start < 10


def test_unclosed_tags_are_settled():
    whole = '<p class="a>b" id=\'<\'>text <b>bold</b> 1 < 2 & 3 > 2</p><!-- <p> --><script>if (a<b) "</p>"</script><br/>'
    assert extraction.settled(whole) == whole
    assert extraction.settled("<p>one <a href=x <b>two</b>") == "<p>one <a><b>two</b>"
    assert extraction.settled('<p>one <a b="x> two <i>three</i>') == "<p>one <a> two <i>three</i>"
    for cut in ("<p>text<a", "<p>text<a b=", "<p>text<!-- never ends", "<p>text<!doc", "<p>text</"):
        assert extraction.settled(cut) == "<p>text"
    assert extraction.settled("<script>a <b 'c") == "<script>a <b 'c"
    assert main_text("<p>A first line of text.<p>Another <a href=/x <b>line</b> of it.</p><div <p>The last one.") == "A first line of text.\nAnother line of it.\nThe last one."


@pytest.mark.parametrize("shape", ["<a ", '<a b="', "<a b='", "</a ", "<!--", "<!", "<?", "<", "</", '<a b="x" ', "<p <!-- ", "<script>", "<script>'<a \"", "<a b=<", "<a =\"'"])
def test_time_is_linear_whatever_is_left_open(shape):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        main_text("<p>Some text before it.</p>" + shape * n + "<p>Some text behind it.</p>")
        main_text("<p>Some text before it.</p>" + shape * n)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5 and took[1] < 15
