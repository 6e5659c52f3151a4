"""Main-text extraction on small pages."""

import re

from siftwood.llm import html_text as h


def test_article_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now and here.</div>
    <article><h1>Title &amp; more</h1><p><b>First &eacute;&#233; line.<br><p>Tiny.</p><p>A  second
    one with <a href="/x">a link</a>, 1 &lt; 2.</p><div class="comment-list"><p>Nice text, I like it very much indeed.</p></div></article>
    <aside>Side text</aside><form>Your mail <input name="a > b"> please</form><footer>&copy; me</footer></body></html>"""
    assert h.main_text(page) == "Title & more\n\nFirst éé line.\n\nTiny.\n\nA second one with a link, 1 < 2."


def test_page_without_article():
    text = "This is a paragraph of plain running text that goes on for quite a while and says something."
    page = f"<body><div><a href='/1'>One</a> <a href='/2'>Two</a></div><div><h1>Head of the story</h1><p>{text}</p><p>{text} {text}</p></div><div id='sidebar'><p>{text}</p></div>"
    assert h.main_text(page) == "\n\n".join(["Head of the story", text, f"{text} {text}"])


def test_odd_input():
    assert h.main_text(None) == h.main_text("") == h.main_text("<") == h.main_text("<p") == h.main_text("<!-- a") == ""
    assert h.main_text("<article><p>cut in the mid") == "cut in the mid"
    assert h.main_text("<article><p>a < b and <3</p></article>") == "a < b and <3"
    assert len(h.main_text("<article>" + "<p>word <b title='>'>x</b></p>" * 20000)) == 20000 * 8 - 2
    assert h.main_text("<article><p>" + "<div " * 3000 + '"' * 3001) is not None


def test_equals_plain_rule_on_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in h.extract(pages.withColumnRenamed("x", "text")).collect():
        body = html[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(h.html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_tables(spark):
    df = spark.createDataFrame([(1, "u", "<article>a</article>", "old"), (1, "u", None, "old"), (None, None, "", "old")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in h.extract(df).collect()) == ["", "", "a"]
    assert h.extract(df.filter("false")).collect() == []


def test_elements_without_end_tags():
    body = "<article><p>One.</p>{}<p>Two.</p></article>"
    for head in ("<head><title>T</title><meta charset=u><script>a('<p>')</script>", "<head><title>T</title></head>", "<HEAD lang='>'><!-- x --><link href=a><noscript>n</noscript>", "<head>"):
        for start in ("<body class=x>", ""):
            assert h.main_text(f"<!DOCTYPE html><html>{head}\n{start}{body.format('')}") == "One.\n\nTwo.", (head, start)
    assert h.main_text("<head><title>T</title>" + body.format("<head>")) == "One.\n\nTwo."
    for inside in ("<svg width='1'/>", "<math />", "<svg/><svg><text>no</text></svg>", "<svg><svg/><text>no</text></svg>", "<svg><svg></svg>no</svg>", "<button>", "<canvas>", "<object data=a>", "<noscript>", "<template>", "<select>", "<svg>", "<button>no</button>", "<script>no</script>", "<script>x = \"<script y\"; '</script>", "<svg-icon></svg-icon>"):
        assert h.main_text(body.format(inside)) == "One.\n\nTwo.", inside
    assert h.main_text(body.format("<button>")[:-10] + "<button>no</button></article>") == "One.\n\nTwo."
    assert h.main_text(body.format("<script>")) == h.main_text(body.format("<style>")) == "One."
    assert h.main_text("<article><p>One.</p>" + "<button><svg><title>" * 20000 + "<p>Two.</p>") == "One.\n\nTwo."
    assert h.main_text("<head>" + "<title><noscript>" * 20000 + "<article><p>Two.</p>") == "Two."


LONG = "This is a paragraph of plain running text that goes on for quite a while and says something about the matter at hand, as articles do."


def test_names_and_short_blocks():
    for open_tag, end in (('<div class="content ad-free">', "</div>"), ('<article class="related-post">', "</article>"), ('<div class="has-sidebar">', "</div>"), ('<main id="social">', "</main>"), ('<div class="postContent">', "</div>"), ("<div>", "</div>"), ('<div class="teaser">', "</div>")):
        page = f"<body>{open_tag}<p>Yes.</p><p>{LONG}</p><p>{LONG}</p>{end}<footer>Imprint</footer>"
        assert h.main_text(page) == f"Yes.\n\n{LONG}\n\n{LONG}", open_tag
    assert h.main_text(f"<body><p>Yes.</p><p>{LONG}</p><p>{LONG}</p>") == f"Yes.\n\n{LONG}\n\n{LONG}"
    teaser = "<div><p><a href=x>Another story that you may want to read</a> today</p></div>"
    for where in (f"<body>{teaser}<div><p>{LONG}</p><p>{LONG}</p></div>", f"<body><div><p>{LONG}</p><p>{LONG}</p></div>{teaser}"):
        assert h.main_text(where) == f"{LONG}\n\n{LONG}"
    for bad in ('<div class="comments">', '<section id="comment-list">', '<div class="sidebar-left">', '<div role="complementary">', "<aside>", "<form>", '<div class="cookieNotice">', '<ul class="nav">'):
        tag = bad[1:].split()[0].strip(">")
        assert h.main_text(f"<body><article><p>{LONG}</p></article>{bad}<p>{LONG}</p><p>{LONG}</p></{tag}>") == LONG, bad
        assert h.main_text(f"<body><article><p>{LONG}</p>{bad}<p>{LONG}</p></{tag}></article>") == LONG, bad


def test_inline_markup_stays():
    assert h.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p></article>") == "So x=1 holds."
    assert h.main_text("<article><p>A <em>b</em><sup>2</sup> <code>c</code></p></article>") == "A b2 c"


def test_tree_uses_words_and_links_and_holds_on_other_pages():
    used = set()

    def walk(tree):
        if tree.feature is not None:
            used.add(h.FEATURES[tree.feature])
            walk(tree.low)
            walk(tree.high)

    walk(h.trained())
    assert {"words", "links", "around_words", "around_links"} <= used and used & {"words_before", "words_after", "links_before", "links_after"}
    x, y = h.labelled(seed=99, pages=300)
    assert ((h.trained().predict(x) >= 0.5) == y).mean() >= 0.97


def test_features_and_tree_equal_brute_force():
    make = h._Pages(5)
    for _ in range(20):
        blocks = h.text_blocks(make.page())
        x = h.features(blocks)
        for i, b in enumerate(blocks):
            near = lambda j: (min(blocks[j].words, h.MANY), blocks[j].linked / blocks[j].words) if 0 <= j < len(blocks) else (0, 0)  # noqa: E731, B023
            own = [c for c in blocks if c.around == b.around]
            total = sum(c.words for c in own)
            want = [*near(i), *near(i - 1), *near(i + 1), min(total, 4 * h.MANY), sum(c.linked for c in own) / total, b.in_main, b.in_aside, b.hint, b.heading, b.item]
            assert x[i].tolist() == [float(v) for v in want]
            tree = h.trained()
            while tree.feature is not None:
                tree = tree.low if want[tree.feature] <= tree.cut else tree.high
            assert h.trained().predict(x[i : i + 1])[0] == tree.share
