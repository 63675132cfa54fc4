from shelflot.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><a href=/a>Home, a, b, c</a></nav><div class="ad">Buy, buy, buy</div><div id="cookie-notice">We use, cookies</div>
<article><h1>Big &amp; small</h1><p><b>One,  two
three.<br><p>Four&nbsp;five, six &lt;x&gt;.</p><form>no</form><div class="comments"><p>First, comment, here, now</p></div></article>
<aside><p>Side, bar, with, commas, and more and more text</p></aside><footer>&copy; me</footer>"""


def test_article_alone():
    assert extract(PAGE) == "Big & small\nOne, two three.\nFour five, six <x>."


def test_containers_without_an_article_element():
    page = '<div id=x><div><p>Alpha, beta, gamma delta.</p><p>More, of the same kind.</p></div><div class=links><a href=1>a, b, c, d, e</a></div></div>'
    assert extract(page) == "Alpha, beta, gamma delta.\nMore, of the same kind."


def test_faults_and_long_pages():
    assert extract(None) == extract("") == extract("<p></p>") == ""
    assert extract("plain &lt;text&gt; 3 < 4 <") == "plain <text> 3 < 4 <"
    assert extract('<p>a<p>b <a href="x') == "a\nb"
    assert extract("<ul><li>a<li>b</ul>") == "a\nb"
    assert len(extract("<p>x, y" * 50_000).split("\n")) == 50_000
    assert extract("<div>" * 20_000 + "deep") == "deep"
    extract('<a "' * 100_000 + ">")  # ends


def test_names_do_not_lose_the_article():
    text = "<p>Alpha, beta, gamma delta.</p><p>More, of the same kind.</p>"
    lines = "Alpha, beta, gamma delta.\nMore, of the same kind."
    for name in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "post-header-visible", "entry-share-enabled", "widget"):
        assert extract(f'<div class="{name}"><main>{text}</main></div>') == lines
        assert extract(f'<body class=x><div id="page {name}"><article>{text}</article></div></body>') == lines
        assert extract(f'<div class="{name}">{text}</div>') == lines
        assert extract(f'<main><div class="post {name}">{text}</div></main>') == lines
    assert extract(f'<form action="/"><main>{text}</main></form>') == lines
    assert extract(f'<article>{text}<div class="sidebar">x, y</div><div class="share-links"><a href=1>Tell</a></div></article>') == lines
    assert extract(f'<article>{text}<p hidden>no</p></article><div class="related"><article><p>Other, one</p></article></div>') == lines


def test_everyday_names_are_left_out():
    text = "<p>Alpha, beta, gamma delta.</p><p>More, of the same kind.</p>"
    lines = "Alpha, beta, gamma delta.\nMore, of the same kind."
    names = """comments-area comment-list user-comments comments-section reader-comments ad-container ad-slot advert-wrapper sticky-ad
    cookie-bar notice-box promo-box popup-content sidebar-left left-sidebar site-footer site-nav related-posts""".split()
    for name in names:
        assert extract(f'<article>{text}<div class="{name}"><p>Not, this.</p></div></article>') == lines
        assert extract(f'<article>{text}</article><div id="{name}"><p>Not, this.</p></div>') == lines
        assert extract(f'<div class="{name}"><article>{text}</article></div>') == lines


def test_raw_elements_that_close_themselves_or_never():
    for icon in ('<svg class="icon"/>', "<math />", '<object data="x"/>', "<iframe src=x />", "<canvas>", "<noscript>"):
        assert extract(f"{icon}<article><h1>A</h1><p>One, two.</p></article>") == "A\nOne, two."
    assert extract('<svg class="a"/><article><p>One, two.</p><svg><text>no</text></svg></article>') == "One, two."
    assert extract("<article><p>One, two.</p></article><script>a, b, c <p>d, e, f, g") == "One, two."
    assert extract("<p>One, two." + "<svg>" * 100_000) == "One, two."


def test_what_is_beside_the_best_container_stays():
    long = "<p>" + "A long, plain sentence, with commas. " * 9 + "</p>"
    whole = ("A long, plain sentence, with commas. " * 9).strip()
    short = "<p>Short end.</p>"
    assert extract(f"<div><h1>Title</h1><div>{long}</div>{short}</div>") == f"Title\n{whole}\nShort end."
    assert extract(f"<body><h1>Title</h1><div><div>{long}</div></div>{short}</body>") == f"Title\n{whole}\nShort end."
    rest = "<ul><li>one<li>two</ul><table><tr><td>3</table><blockquote>four</blockquote><section><h2>five</h2><p>six</section>seven"
    assert extract(f"<div><div>{long}</div>{rest}</div>") == "\n".join([whole, "one", "two", "3", "four", "five", "six", "seven"])
    out = '<ul><li><a href=1>one</a><li><a href=2>two</a></ul><div class="sidebar">x</div><nav>y</nav><div class="left-sidebar">z</div><a href=3>more</a>'
    assert extract(f"<div><div>{long}</div>{out}</div>") == whole


def test_rows(spark):
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, "old"), (None, "u", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text(df).select("page_id", "text").collect()
    assert sorted(got, key=str) == sorted([(1, extract(PAGE)), (1, extract(PAGE)), (2, ""), (None, "")], key=str)
    assert main_text(df.limit(0)).count() == 0
