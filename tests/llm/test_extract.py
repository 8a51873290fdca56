import re

from common_rows import sample

from citadex.llm import extract
from citadex.llm.registry import QUERIES


def test_generated_pages(spark, sf):
    """Their article element holds the text; paragraphs and headings are blocks."""
    import html

    pages = {r.page_id: r for r in sample(spark, sf, "pages").collect()}
    rows = QUERIES["op2_html_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[r.page_id].html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert r.text == want and r.n_chars == len(want) and r.url == pages[r.page_id].url


PAGE = """<!doctype html><html><head><title>Site &amp; more</title><style>p{}</style></head><body class="home">
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="wrap-7"><div class="post-content" id="p1">
<h1>Title of it</h1><p>One &lt;two&gt; th<b>re</b>e.<p>Fo\n ur &copy; &#128512; &#x1F600; &am x<br>five
<div class="ad-box">Buy!</div><script>var x = "<p>no</p>";</script><!-- <p>nor this</p> --><table><tr><td>c1<td>c2</table>
<form><input><button>Send</button></form><section id="comments"><p>Reader says hi</p></section></div>
<aside class="sidebar"><p>Most read</p></aside></div><footer>(c)</footer></body></html>"""
TEXT = "Title of it One <two> three. Fo ur © \U0001f600 \U0001f600 &am x five c1 c2"


def test_boilerplate_goes_and_references_are_decoded():
    assert extract.extract(PAGE, None) == TEXT
    page = extract.Page(PAGE)
    assert page.path_name(page.best().path) in ("body>div.wrap-#>div.post-content", "body>div.wrap-#") and page.path_number("body>div.wrap-#") > 0


def test_hosts_agree_on_a_path(spark):
    """The winning path also leads to what a page's own best container leaves out: here the part after a long post."""
    page = lambda post, tail: f'<body><div class="col"><div class="post"><p>{post}</p></div><p>{tail}</p></div></body>'
    post, tail = "a long post about something " * 40, "what follows the post " * 40
    rows = [(i, f"http://H.org:80/{i}", page(post, tail), 1, "p") for i in range(8)]
    rows += [(9, "https://h.org/x", page(post, "only a short end"), 1, "p"), (10, None, None, None, None), (11, "junk", "", 1, "x"), (12, "http://solo.net", "plain text", 1, "x")]
    rows += [(13, "https://solo.org/x", page(post, "only a short end"), 1, "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int, path string")
    out = {r.page_id: r for r in extract.main_text(df).collect()}
    assert out[9].text == post + "only a short end" and out[13].text == post.strip()
    assert out[10].text == out[11].text == "" and out[12].text == "plain text" and len(out) == 13
    repeated = extract.main_text(df.union(df)).count()
    assert repeated == 26 and extract.main_text(df.where("false")).count() == 0


def test_a_path_that_leads_to_less_is_not_followed():
    page = f'<body><div class="teaser">a teaser of some other page</div><div class="story"><p>{"the article itself, in full. " * 5}</p></div></body>'
    whole = ("the article itself, in full. " * 5).strip()
    assert extract.extract(page, None) == extract.extract(page, "body>div.teaser") == extract.extract(page, "body>div.story") == whole
    assert extract.extract(page, "body") == f"a teaser of some other page {whole}" and extract.extract(page, "body>div.none") == whole


def test_words_in_slugs_and_text_elements_drop_nothing():
    kept = [
        '<h2 id="discussion">x1</h2>', '<section id="search-algorithms">x2</section>', '<p id="related-work">x3</p>', '<div class="ad-hoc">x4</div>',
        '<b class="share">x5</b>', '<h2 class="related">x6</h2>', '<div id="social-history">x7</div>', f'<div class="discussion">{"long and without links " * 20}</div>',
        '<p class="notice">x8</p>', '<section class="comment-free">x9</section>',
    ]
    text = extract.extract(f"<body><article>{''.join(kept)}</article></body>", None)
    assert [f"x{i}" for i in range(1, 10)] == [w for w in text.split() if w.startswith("x")] and text.count("long and") == 20
    dropped = [
        '<div class="ad">y</div>', '<div class="ad-box2">y</div>', '<div class="comments">' + "<p>a reader writes y</p>" * 40 + "</div>", '<ul class="related-posts"><li><a href="/">y</a></ul>',
        '<div class="share">y</div>', f'<div class="related">{"<a href=/>some other page y</a> " * 40}</div>', '<div role="navigation">y</div>', '<div id="sidebar">y</div>', '<div class="cookieBanner">y</div>', '<div hidden>y</div>',
    ]
    assert extract.extract(f"<body><article>kept{''.join(dropped)}</article></body>", None) == "kept"


def test_work_is_linear_in_depth():
    import time

    def seconds(n):
        pages = ["<div>" * n + "word", "<div class=c>text" * n, "<b>" * n + "<div>x" * n, "<p>" * n + "</i>" * n, "<li><b>" * n + "</ul>" * n + "<li>" * n]
        start = time.process_time()
        for page in pages:
            extract.extract(page, "body>div.c")
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.05)


def test_odd_markup():
    e = lambda s: extract.extract(s, None)
    assert e("1 < 2 and 3 > 2 <p") == "1 < 2 and 3 > 2"
    assert e("<p>a</p></div></p>b<script>x") == "a b" and e("<p title='>'>q</p>") == "q"
    assert e("<article>a<article>b</article>c</article>") == "a b c" and e("<nav>only a menu</nav>") == ""
    assert e("<p>" * 3000 + "deep") == "deep" and e("x&nbsp;y　z") == "x y z"
    assert len(e("<div>" * 2000 + "word " * 50_000)) == 249_999
