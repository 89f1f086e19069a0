import html as h
import re

from tasteframe.llm import html


def text(source):
    blocks = html.Page(source).blocks
    return "\n".join(t for _, t, m in blocks if m or not any(x[2] for x in blocks))


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- ad --><div class="ad">Buy</div>
    <article><header><h1>Head  line &eacute;</h1></header><p><b>bold&amp;&amp; text.<br><p>Second
    para <script>x()</script>with <a href="#">link</a>.</p><ul><li>one<li>two</ul><aside>side</aside><form><input>f</form>
    <div class="share-box">share</div><section id="comments"><article class="comment"><p>troll</p></article></section>
    <table><tr><td>a<td>b</table><p></p></article><footer>&copy; me</footer>"""
    assert text(page) == "Head line é\nbold&& text.\nSecond para with link.\none\ntwo\na\nb"


def test_odd_pages():
    assert text("") == "" and text("plain  text") == "plain text" and text("<p>a<p>b</div>c") == "a\nb\nc"
    assert text("<article><p>cut off in the mid") == "cut off in the mid"
    assert text("<div hidden>x</div><p>y &lt;b&gt;</p>") == "y <b>"
    assert text("<main><p>1</p></main><p>2</p>") == "1"


def test_style_tree_drops_what_pages_share(spark):
    rows = [(i, f"http://A.example/{i}", f"<body><div><p>Same slogan on all</p></div><div class='t'><p>own text {i}</p></div></body>", "x") for i in range(12)]
    rows += [(100, None, "<p>lonely</p>", "x"), (101, "http://b.example/", None, "x"), (102, "not a url", "<p>z</p>", "x"), (100, None, "<p>lonely</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in html.extract(df).collect())
    assert got == sorted([(i, f"own text {i}") for i in range(12)] + [(100, "lonely"), (101, ""), (102, "z"), (100, "lonely")])
    assert html.extract(df.limit(0)).count() == 0


def test_query_equals_plain_cut(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = html.op9_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(h.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|div)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_style_tree_decides_inside_articles_too(spark):
    page = "<body><div class='ad'>Ad {0}</div><article><h1>Head {0}</h1><p>own text {0}</p><p>Read our other stories</p><div>Our desk</div></article></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(12)]
    # a class word rules out all of a page's text, which the tree knows to be its own
    rows += [(100 + i, f"http://b.example/{i}", f"<body><div class='widget'><p>story {i}</p></div><nav>menu</nav></body>") for i in range(12)]
    rows += [(200 + i, f"http://c.example/{i}", f"<body><article><p>notice</p></article><div>{i}</div></body>") for i in range(12)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Head {i}\nown text {i}" for i in range(12)} | {100 + i: f"story {i}" for i in range(12)} | {200 + i: "notice" for i in range(12)}
    assert got == want


def test_copies_of_a_page_count_once(spark):
    page = "<body><script>track({0})</script><div><p>the only story</p></div><div class='t'><p>its end</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(10)]
    # a host of mostly copies: neither they nor the other pages lose text
    article = "<body><article><h1>{0}</h1><p>story {0}</p></article></body>"
    rows += [(100 + i, f"http://b.example/{i}", article.format(max(i, 40))) for i in range(50)]
    # furniture still goes from a host with copies
    slogan = "<body><div><p>Same slogan</p></div><div class='t'><p>own {0}</p></div></body>"
    rows += [(200 + i, f"http://c.example/{i}", slogan.format(max(i, 40))) for i in range(50)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: "the only story\nits end" for i in range(10)} | {100 + i: f"{max(i, 40)}\nstory {max(i, 40)}" for i in range(50)} | {200 + i: f"own {max(i, 40)}" for i in range(50)}
    assert got == want


def test_words_do_not_rule_out_the_article():
    story = "<p>A story of some length.</p><p>It goes on.</p>"
    want = "A story of some length.\nIt goes on."
    assert text(f"<body><p>Welcome</p><div class='layout has-sidebar'><article>{story}</article></div></body>") == want
    assert text(f"<body><div class='layout has-sidebar'><article>{story}</article></div></body>") == want
    assert text(f"<body><div class='sidebar-left'><article>{story}</article><div class='sidebar'>{story}</div></div></body>") == want
    assert text(f"<body><p>Hi</p><article class='post no-comments'>{story}</article></body>") == want
    assert text(f"<body><p>Hi</p><article class='post comments-open'>{story}</article></body>") == want
    assert text("<article><p>a</p><p class='market-share'>b</p><p class='share'>Share</p></article>") == "a\nb"
    assert text(f"<article>{story}</article><article class='teaser'>Another</article>") == want
    assert text(f"<body><div class='widget'>{story}</div><div>Hi</div></body>") == want + "\nHi"
    # what is no layout goes, however long
    more = story * 9
    assert text(f"<article>{story}</article><section id='comments'><article>{more}</article></section>") == want
    assert text(f"<article>{story}</article><div class='ad'>{more}</div>") == want
    assert text(f"<article>{story}<div class='related'><article>{more}</article></div></article>") == want
    assert text("<article></article><div class='ad'>Buy</div>") == "" and text("<div class='cookie'>We bake</div>") == ""


def test_few_pages_of_a_host_are_judged_too(spark):
    page = "<body><p>We use cookies</p><div><p>own text {0} of {1}</p></div></body>"
    rows = [(10 * n + i, f"http://h{n}.example/{i}", page.format(i, n)) for n in range(1, 10) for i in range(n)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {10 * n + i: ("" if n >= 5 else "We use cookies\n") + f"own text {i} of {n}" for n in range(1, 10) for i in range(n)}


def test_long_and_deep_pages(spark):
    words = "word " * 400_000
    deep = "<div class='x'>" * 8000 + "<p>deep</p>"
    rows = [(1, "http://a.example/", f"<article><p>{words}</p></article>"), (2, "http://a.example/", deep), (3, None, f"<div class='ad'>{words}</div><p>x</p>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: words.strip(), 2: "deep", 3: "x"}
