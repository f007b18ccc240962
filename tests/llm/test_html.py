import pytest

from rootscope.llm.html import extract_main_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a>b">menu</a></li></ul></nav><!-- <article>no</article> -->
<div class="cookie-notice">We use cookies</div><div class="content"><article><h1>Title&nbsp;one</h1>
<p>First  <b>bold</b>ly<br>second &lt;x&gt; line.<p>No end &copy; 5 &#8364; &amp;amp; <div class="ad">Buy</div><p>Third.</p>
<form><input><button>Send</button></form><aside>Side</aside><ul><li>one</li><li>two</li></ul></article></div>
<section id="comments"><p>A very long comment by a reader, longer than the article itself. A very long comment by a reader.</p></section>
<footer>&copy; Site</footer></body></html>"""


def test_a_page_with_everything():
    assert main_text(PAGE) == "Title one First boldly second <x> line. No end © 5 € &amp; Third. one two"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("   \n ", ""),
        ("plain words", "plain words"),
        ("<p>a<p>b", "a b"),
        ("<article><p>cut off", "cut off"),
        ("<article>x</article><article>much longer text</article>", "much longer text"),
        ("<nav>only a menu</nav>", ""),
        ("<article></article><p>text outside</p>", "text outside"),
        ("<div><a href=x>link</a></div><div>" + "body text " * 9 + "</div>", ("body text " * 9).strip()),
        ("<article>1 < 2 <p>a &lt b</p></article>", "1 < 2 a < b"),
        ("<article><script>if (a<b) {}</script>ok<script>never closed", "ok"),
        ("<main><p>in main</p></main><footer>f</footer>", "in main"),
        ("<article><p>a</p><!-- open comment", "a"),
        ("<article><p title='a>b' class=\"x\">q</p></article>", "q"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("name", ["content has-sidebar", "with-sidebar content", "has-nav", "no-ads", "has-comments"])
def test_names_are_whole(name):
    assert main_text(f'<div class="{name}"><article><p>The text</p></article></div>') == "The text"
    assert main_text(f'<div class="{name}"><p>The text</p></div>') == "The text"


@pytest.mark.parametrize("own", ['id="search"', 'id="consent"', 'id="related-work"', 'aria-label="Social history"', 'aria-label="How to share a file"', 'aria-hidden="false"', 'title="hidden"'])
def test_sections_of_an_article_stay(own):
    assert main_text(f'<article><p>One</p><section {own}><p>two</p></section><div class="ad">Buy</div></article>') == "One two"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="sidebar"><p>side</p><article>The text</article></div>', "The text"),
        ("<form><main>The text</main><input></form>", "The text"),
        ("<article>The text</article><ol class=comments><article>A much longer comment</article></ol>", "The text"),
        ("<div class=promo><article>Ad</article></div><p>The text</p>", "The text"),
        ("<aside><article>A much longer teaser</article></aside><p>The text</p>", "The text"),
        ("<div hidden><article>A much longer text</article></div><p>The text</p>", "The text"),
        ("<article><figure><img><figcaption>A caption</figcaption></figure>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</article>", "A caption Let x = 1 be"),
    ],
)
def test_articles_in_marked_parts(page, text):
    assert main_text(page) == text


ARTICLE = "<article><p>The text</p></article>"


@pytest.mark.parametrize("name", ["select", "datalist", "object", "svg", "canvas", "iframe", "noscript", "template"])
def test_elements_without_an_end(name):
    whole = f"<{name}><b>no</b></{name}>"
    assert main_text(whole + ARTICLE + whole) == "The text"
    assert main_text(f"<div><{name} class=x></div>" + ARTICLE) == "The text"
    assert main_text(f"<div><{name}></div>" + ARTICLE + whole) == "The text"
    assert main_text(f"<article><{name}>one {whole} two {whole} three</article>") == "one two three"
    assert main_text(f"<article>one<{name}>no{whole}no</{name}>two</article>") == "one two"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<form><input list=a><datalist id=a><option value=a><option value=b></datalist></form>" + ARTICLE, "The text"),
        ("<select><option>A<option>B</select>" + ARTICLE + "<select><option>C</option></select>", "The text"),
        ("<div><select><option>A 1 < 2<option>B</div>" + ARTICLE, "The text"),
        ("<article>a<!-- <svg> -->b<svg><path/></svg><script>'<svg>'</script>c</article>", "ab c"),
        ("<head><meta charset=utf-8><title>T</title><body>" + ARTICLE, "The text"),
        (ARTICLE + "<textarea>never closed", "The text"),
    ],
)
def test_end_tags_left_out(page, text):
    assert main_text(page) == text


def test_many_elements_without_an_end_end_soon():
    for name in ("select", "svg", "option", "template"):
        assert main_text("<article>x" + f"<{name}><script>" * 20_000) == "x"
        assert main_text("<article>x" + f"<{name}>" * 50_000 + "</article>") == "x"


LONG = "A sentence of the text, and it is rather long. " * 9


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article>{LONG}</article><article>A second article that has one sentence.</article>", LONG + "A second article that has one sentence."),
        ("<article>First of two.</article><hr><article>Second.</article>", "First of two. Second."),
        (f"<article>{LONG}</article><article><a href=x>A teaser of another page, all of it a link</a></article>", LONG.strip()),
        (f"<main><article>One</article><article>{LONG}</article></main>", "One " + LONG.strip()),
    ],
)
def test_several_articles(page, text):
    assert main_text(page) == text


def test_between_surges():
    menu = "<ul>" + "<li><a href=x>A link</a>" * 5 + "</ul>"
    assert main_text(f"<p>{LONG}</p>{menu}<p>Short.</p>{menu}<p>{LONG}</p>") == f"{LONG}Short. {LONG}".strip()
    assert main_text(f"<p>{LONG}</p>{menu}<p>Short.</p>") == LONG.strip()
    assert main_text(f"{menu}<p>{LONG}</p><p><a href=x>See this page</a></p><p>{LONG}</p>{menu}") == f"{LONG}See this page {LONG}".strip()
    assert main_text(f"<p>{LONG}</p><nav><p>menu</p></nav><p>{LONG}</p>") == f"{LONG}{LONG}".strip()


def test_very_long_and_broken_pages_end_soon():
    assert main_text("<article>" + "<p>word</p>" * 50_000 + "</article>").count("word") == 50_000
    assert isinstance(main_text('<a "' * 3_000), str)
    assert isinstance(main_text("<" * 50_000), str)
    assert isinstance(main_text("<div>" * 5_000 + "x"), str)


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "<p>é😀</p>")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id bigint, url string, html string, text string, main string")
    got = sorted(map(tuple, extract_main_text(pages).collect()), key=str)
    text = main_text(PAGE)
    want = [(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "é😀", 2)]
    assert got == sorted(want, key=str)
    assert extract_main_text(pages.limit(0)).count() == 0
