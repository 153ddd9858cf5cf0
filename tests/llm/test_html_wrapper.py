import html
import re

import pytest

from labtables.llm import html_wrapper as w

SF = "/root/testdata/sf0.001"


def page(title, paragraphs, more=""):
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- x --><div class="ad">Buy &amp; sell</div>
<article><h1>{title}</h1>{"".join(f"<p>{p}</p>" for p in paragraphs)}{more}</article>
<aside><p>Side text that is long enough to matter</p></aside><section id="comments"><p>First!</p></section>
<form><p>Search</p><button>Go</button></form><footer>&copy; me</footer></body></html>"""


def test_article_only():
    text = w.main_text(page("T &amp; U", ["one\n  <b>two</b>", "a &lt; b &eacute;", " "], '<div class="share">Share</div><ul><li>x<li>y</ul>'), None)
    assert text == "T & U\none two\na < b é\nx\ny"


def test_headers_and_classes():
    assert w.main_text('<header class="site"><h1>S</h1></header><article class="post tag-x"><header class="entry-header"><h1>T</h1></header><header>by me</header><div class="post tag-news"><p>b</p></div><footer>f</footer></article>', None) == "T\nb"


def test_sloppy_markup():
    assert w.main_text("<article><h1>H</h1><p><b>B<br><p>one<p>two</article><footer>f", None) == "H\nB\none\ntwo"
    assert w.main_text("<main>a<div>b <span>c</span>d</div>e</main>", None) == "a\nb cd\ne"
    assert w.main_text("", None) == "" and w.main_text("<p", None) == "" and w.main_text("<nav>x</nav>", None) == ""
    assert w.main_text("<article>a < b && c <!-- <p>no --> d</article", None) == "a < b && c d"


def plain(host_pages):
    """Without article elements, the host's wrapper finds where the varying text stands."""
    nodes = None
    for p in host_pages:
        new = w.page_shape(w.parse(p))
        nodes = new if nodes is None else w.aligned(nodes, new)
    return nodes


def test_wrapper_without_article():
    make = lambda i: f'<body><div class="a"><p>Welcome to this large site with a long greeting that all pages share</p></div><div class="b"><h2>Title {i}</h2>{"".join(f"<p>Story {i} {k}</p>" for k in range(i))}</div></body>'
    pages = [make(i) for i in range(1, 6)]
    import json

    wrapper = json.dumps(plain(pages))
    assert w.main_text(pages[0], wrapper) == "Title 1\nStory 1 0"
    assert w.main_text(pages[2], wrapper) == "Title 3\nStory 3 0\nStory 3 1\nStory 3 2"


def test_wrapper_of_plain_containers():
    """No article element: headings, bodies in several parts, a list of links and a fixed greeting."""
    import json

    def make(i):
        body = "".join(f"<div class='para'>Paragraph {i} {k} with quite some words in it</div>" for k in range(1, i + 2))
        menu = "".join(f"<li><a href='/{k}'>Link {i} {k}</a></li>" for k in range(8))
        return f"<body><div id='top'>Example site, a fixed greeting</div><div class='links'><ul>{menu}</ul></div><div id='story'><h1>Title {i}</h1><div class='text'>{body}</div><div class='comment-list'><p>Nice story {i}</p></div></div><div id='end'>The end, always</div></body>"

    pages = [make(i) for i in range(1, 6)]
    wrapper = json.dumps(plain(pages))
    for i, p in enumerate(pages, 1):
        assert w.main_text(p, wrapper) == "\n".join([f"Title {i}", *(f"Paragraph {i} {k} with quite some words in it" for k in range(1, i + 2))])


def test_links_and_fixed_texts_beside_the_article():
    """Text that shares its labels with links or with fixed texts stays."""
    import json

    body = lambda i: "".join(f"<p>Paragraph {i} {k} with quite some words in it</p>" for k in range(3))
    lines = lambda i: [f"Paragraph {i} {k} with quite some words in it" for k in range(3)]
    home = [f'<body><div class="content"><p><a href="/">Home</a></p><h1>T {i}</h1>{body(i)}</div></body>' for i in range(4)]
    assert w.main_text(home[1], None) == "\n".join(["Home", "T 1", *lines(1)])
    assert w.main_text(home[1], json.dumps(plain(home))) == "\n".join(["T 1", *lines(1)])
    fixed = [f'<body><div class="content"><h1>T {i}</h1>{body(i)}<hr><p>All rights of this page are ours</p></div></body>' for i in range(4)]
    assert w.main_text(fixed[2], json.dumps(plain(fixed))) == "\n".join(["T 2", *lines(2)])
    menu = "".join(f'<li><a href="/{k}">Menu {k}</a></li>' for k in range(4))
    listed = lambda i: "".join(f'<li><a href="/r{k}">Reference {i} {k}</a></li>' for k in range(3))
    cited = [f'<body><div class="content"><ul>{menu}</ul><h1>T {i}</h1>{body(i)}<ol>{listed(i)}</ol></div></body>' for i in range(4)]
    assert w.main_text(cited[3], json.dumps(plain(cited))) == "\n".join(["T 3", *lines(3), *(f"Reference 3 {k}" for k in range(3))])


def test_lists_on_one_page_are_not_fixed():
    """What one page has three times isn't what three pages have."""
    import json

    pages = [f'<body><div class="content"><h1>T {i}</h1><p>Some words of story {i}</p>{"<blockquote>Hear</blockquote>" * 3 if i == 1 else ""}</div></body>' for i in range(3)]
    assert w.main_text(pages[1], json.dumps(plain(pages))) == "T 1\nSome words of story 1\nHear\nHear\nHear"


def test_groups():
    a = w.shape(w.parse("<ul><li>1</li><li>2</li></ul><h2>x</h2><p>y</p><h2>x</h2><p>y</p>"))
    kinds = [n[0] for n in a]
    assert kinds == ["e", "+"] and a[0][2][0][0] == "+" and w.heads(a[1][1]) == ["h2", "p"]
    b = w.aligned(a, w.shape(w.parse("<ul><li>1</li></ul><div>new</div>")))
    assert ["?" in n[0] for n in b] == [False, True, True]


def test_as_written_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in w.extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in lines if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (2, "http://h/x", "", 1), (None, "http://h/y", page("T", ["p"]), 1), (3, "HTTP://H/z", page("T", ["p"]), 1), (3, "HTTP://H/z", page("T", ["p"]), 1), (4, "nohost", "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id or -1, r.text) for r in w.extract_main_text(df).collect())
    assert got == [(-1, "T\np"), (1, ""), (2, ""), (3, "T\np"), (3, "T\np"), (4, "x" * 100_000)]
    assert w.extract_main_text(df.limit(0)).count() == 0


def wrapped(pages):
    import json

    return json.dumps(plain(pages))


def test_names_alone_drop_nothing():
    """Article text whose class or id only looks like something else's stays."""
    inner = '<h2 id="discussion">Discussion</h2><section id="related-work"><p>Others did this</p></section><div class="legal">Of law</div><p class="alert">Beware of it</p><table class="social stats"><tr><td>1</td></tr></table><p>x <math><mi>y</mi></math> z</p>'
    text = "T\nThe story begins with words\nDiscussion\nOthers did this\nOf law\nBeware of it\n1\nx y z"
    pages = [f"<article><h1>T</h1><p>The story begins with words</p>{inner}</article>"] + [f"<article><h1>T {i}</h1><p>Another story {i} begins here</p></article>" for i in range(4)]
    assert w.main_text(pages[0], None) == text and w.main_text(pages[0], wrapped(pages)) == text
    # what holds the article isn't a comment, whatever its name
    named = '<article><div class="comments"><p>A long text that is all there is of the article</p></div><p>x</p></article>'
    assert w.main_text(named, None) == "A long text that is all there is of the article\nx"


def test_wrapper_decides_in_articles():
    """What all pages of a host have in their articles goes by the wrapper only; named lists of links,
    repeated comments and articles in articles go by any."""

    def make(i):
        told = "".join(f"<p>Paragraph {i} {k} with quite some words in it</p>" for k in range(i + 1))
        said = "".join(f'<div class="comment"><time>day {k}</time><p>Reader {i} {k} thinks so</p></div>' for k in range(3))
        return f'<body><article><h1>Title {i}</h1><p>Follow us for more</p>{told}<ul class="related"><li><a href="/{i}">Other story {i}</a></li></ul><div>{said}</div><article>An answer {i}</article><div class="ad">Buy thing {i}</div></article></body>'

    pages = [make(i) for i in range(5)]
    text = lambda i, more=(): "\n".join([f"Title {i}", *more, *(f"Paragraph {i} {k} with quite some words in it" for k in range(i + 1))])
    for i in (2, 4):
        assert w.main_text(pages[i], None) == text(i, ["Follow us for more"])
        assert w.main_text(pages[i], wrapped(pages)) == text(i)
    # copies of one page are no evidence, nor are pages that differ in a word
    assert w.main_text(pages[3], wrapped([pages[3]] * 6)) == text(3, ["Follow us for more"])
    near = [f"<article><h1>Same title</h1><p>One and the same paragraph of the article</p><p>Number {i}</p></article>" for i in range(5)]
    assert w.main_text(near[0], wrapped(near)) == "Same title\nOne and the same paragraph of the article\nNumber 0"


def test_cards_are_not_the_article():
    page_ = '<div class="list"><article class="teaser"><a href="/1">One other story to read</a></article><article class="teaser"><a href="/2">Two</a></article></div><article><h1>T</h1><p>Words of it</p></article>'
    assert w.main_text(page_, None) == "T\nWords of it"


def test_deep_and_wide_pages():
    import time

    deep = "<body>" + "<div>a" * 10_000 + "<p>end</p>" + "</div>b" * 10_000 + "<article>c<div>d</div></article></body>"
    text = w.main_text(deep, wrapped([deep, deep]))
    assert text == "c\nd"
    alone = w.main_text(deep.replace("article", "div"), None).split("\n")
    at = alone.index("end")
    assert at > 9_890 and alone == [*["a"] * at, "end", *["b"] * (len(alone) - at - 1)] and len(alone) > 19_790
    begin = time.time()
    wide = ["<body><article><h1>T</h1>" + "".join(f'<div class="{chr(97 + k % 26)}{"xyz"[s]}{"q" * (k % 97)} {chr(97 + k // 26 % 26)}{"w" * (k // 676)}">text {k}</div>' for k in range(10_000)) + "</article></body>" for s in range(3)]
    assert w.main_text(wide[1], wrapped(wide)).count("\n") == 10_000
    assert time.time() - begin < 60 and len(wrapped(wide)) <= 4 * w.WRAPPER_BYTES


def test_common_subsequences():
    import random

    draw = random.Random(4)
    for _ in range(200):
        x, y = (["abcdef"[draw.randrange(6)] for _ in range(draw.randint(0, 12))] for _ in range(2))
        pairs = w.common(x, y)
        assert pairs == sorted(pairs) and all(x[i] == y[k] for i, k in pairs) and len({i for i, _ in pairs}) == len({k for _, k in pairs}) == len(pairs)
    x, y = [str(i) for i in range(900)], [str(i) for i in range(0, 1800, 2)]
    assert len(w.common(x, y)) == 450


def test_short_words_on_few_pages_are_no_evidence():
    pages = [f"<article><h1>T {i}</h1><p>A longer paragraph {i}</p><p>The.</p><p>Another of the paragraphs {i}</p></article>" for i in range(4)]
    assert w.main_text(pages[1], wrapped(pages)) == "T 1\nA longer paragraph 1\nThe.\nAnother of the paragraphs 1"


def test_parts_of_an_article_stay():
    """An article in an article that has a heading is a part; one without is a reader's comment."""
    def page(i):
        words = lambda tag, n: " ".join(f"{tag}{i}w{k}" for k in range(n))
        return (
            f"<html><body><nav>menu</nav><article><h1>Title {i}</h1><p>{words('a', 40)}</p><article class='part'><h2>Part {i}</h2><p>{words('b', 60)}</p></article>"
            f"<article><p>{words('c', 9)}</p></article><article><p>{words('d', 7)}</p></article></article></body></html>"
        )

    shapes = None
    for i in range(10):
        nodes = w.page_shape(w.parse(page(i)))
        shapes = nodes if shapes is None else w.bounded(w.aligned(shapes, nodes))
    import json

    text = w.main_text(page(3), json.dumps(shapes))
    assert "Part 3" in text and "b3w59" in text and "c3w0" not in text and "d3w0" not in text and text.startswith("Title 3")


def test_columns_of_any_name(spark):
    page = "<html><body><article><h1>T</h1><p>some words here</p></article></body></html>"
    rows = [(1, "http://a.b/x", page, "w", "c"), (2, None, None, "w", "c")]
    for id_col, url_col, html_col in (("k", "host", "wrapper"), ("html", "u", "text"), ("page", "url", "html")):
        df = spark.createDataFrame(rows, f"`{id_col}` long, `{url_col}` string, `{html_col}` string, extra string, more string")
        out = w.extract_main_text(df, id_col, url_col, html_col)
        assert out.columns == [id_col, url_col, "text", "n_chars"]
        assert sorted((r[0], r[2]) for r in out.collect()) == [(1, "T\nsome words here"), (2, "")]
    clash = spark.createDataFrame([(1, "http://a.b/x", page)], "text long, url string, html string")
    assert w.extract_main_text(clash, "text").columns == ["url", "text", "n_chars"]
