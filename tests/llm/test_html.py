import html as entities
import re

import pytest

from quillgraph.llm.html import main_text
from quillgraph.llm.registry import op1_tag_path_ratios

BODY = ["The first paragraph says a good deal, and it says it slowly; it goes on for a while.", "A second one follows, with <b>bold</b> words, <a href='x'>a link</a> and an &eacute;clair &amp; more.", "The third ends it all, at last, in a few plain words."]
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>if (a<b) document.write("<p>no</p>")</script></head>
<body class="page"><header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies, as everybody does, and you may accept them all.</div>
<div id="content"><h2>Title here</h2><p>%s<p>%s<ul><li>one</li><li>two</li></ul><p>%s</p></div>
<div class="sidebar"><p>Popular: this, that and the other story, which are all very good.</p></div>
<section id="comments"><p>I disagree, said a reader, at length, with many words and commas.</p></section>
<form><label>Name</label><input name=q><button>Send</button></form><footer>&copy; Somebody, 2020. All rights reserved, as ever.</footer></body></html>"""


def test_article_without_its_surroundings():
    plain = [entities.unescape(re.sub("<[^>]+>", "", p)) for p in BODY]
    assert main_text(PAGE % tuple(BODY)) == f"Title here {plain[0]} {plain[1]} one two {plain[2]}"


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<script>x", "<!-- open", "<p", "</p></div>", "<nav>a</nav>"])
def test_pages_without_content(page):
    assert main_text(page) == ("<p" if page == "<p" else "")  # a tag that never ends is text


ARTICLE = "<article><h1>Heading</h1><p>%s</p><p>%s</p></article>" % ("A first, long sentence; it goes on, and on. " * 3, "A second one, as long as that, or longer. " * 3)


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="page has-sidebar">{ARTICLE}<div class="sidebar"><p>Not this, never this.</p></div></div></body>',
        f'<div class="layout with-sidebar no-nav">{ARTICLE}</div>',
        f'<div id="content-share">{ARTICLE}</div>',
        f'<div class="widget"><div class="header">{ARTICLE}</div></div>',
        f'<div data-id="nav" data-class="comments">{ARTICLE}</div>',
        f'<main class="comments">{ARTICLE}</main>',
        f'<div class=main>{ARTICLE}</div><div class="comment-list"><article class="comment"><p>%s</p></article></div>' % ("I say, no, and no, again. " * 60),
        f'<section class="related-posts"><p>This, that, and the other. </p></section>{ARTICLE}<div class="ad-slot">Buy, buy, buy. </div>',
    ],
)
def test_marks_hide_parts_of_a_page_but_not_the_page(page):
    want = " ".join(re.sub(r"\s+", " ", x).strip() for x in re.findall(r"<(?:h1|p)>([^<]*)<", ARTICLE))
    assert main_text(page) == want


@pytest.mark.parametrize("name", ["entry-header", "article-header", "post-header"])
def test_an_article_keeps_its_own_header(name):
    page = ARTICLE.replace("<h1>Heading</h1>", f'<div class="{name}"><h1>Heading</h1></div>')
    assert main_text(page).startswith("Heading A first")


def test_quotes_in_attributes():
    body = "Some text, of a sort, with commas. " * 3
    for start in ("<p title=Bob's>", "<p title='a > b'>", '<p title="a > b" x=\'">\'>', "<p 'odd\">", '<p class = "x" hidden>', "<p a=\"un>"):
        assert main_text(f"<div>{start}{body}</p></div>") == body.strip(), start
    assert main_text("<a =\"\"" * 5000) == ("<a =\"\"" * 5000).strip()


def brute_paths(order, texts, spread=1.0, share=0.15):
    """Ratios, Gaussian smoothing, fusion and threshold, node by node."""
    import math

    at = {p: [k for k, q in enumerate(order) if q == p] for p in order}
    length = [sum(len(" ".join(texts[j].split())) for j in at[p]) / len(at[p]) for p in order]
    marks = [(sum(1 for j in at[p] for c in texts[j] if c in ".,;:!?…。、，！？؛،") + 1) / len(at[p]) for p in order]

    def smoothed(values, k):
        near = [(math.exp(-0.5 * (d / spread) ** 2), values[k + d]) for d in range(-3, 4) if 0 <= k + d < len(values)]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    long, points = ([smoothed(v, k) for k in range(len(order))] for v in (length, marks))
    fused = [a / (sum(long) / len(long)) * b / (sum(points) / len(points)) for a, b in zip(long, points)]
    bar = share * sum(f * n for f, n in zip(fused, length)) / sum(length)
    return {p for p in order if max(fused[j] for j in at[p]) >= bar}


def test_content_paths_against_brute_force(spark):
    from quillgraph.llm import html

    some = dropped = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        nodes = [(html.content_path(n.path), n.text) for n in html.text_nodes(r.html, {}, set()) if n.text.strip()]
        order, texts = [p for p, _ in nodes], [t for _, t in nodes]
        got = html.content_paths(order, texts)
        assert got == brute_paths(order, texts)
        some += 1
        dropped += len(set(order)) - len(got)
    assert some > 100 and dropped > some


def test_broken_and_long_pages():
    assert main_text("plain text,   no\n markup") == "plain text, no markup"
    assert main_text("<p>a &lt;b&gt; &#233;&#x41; &nosuch; 1 < 2") == "a <b> éA &nosuch; 1 < 2"
    long = "word, " * 200_000
    assert main_text(f"<article><p>{long}</article>") == long.strip()
    assert main_text("<div>" * 3000 + "deep, deep text") == "deep, deep text"


def test_whole_table_against_the_generated_structure(spark):
    def want(page):
        inside = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        blocks = (re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br|li|ul|div)>", inside))
        return " ".join(b for b in blocks if b)

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = op1_tag_path_ratios(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want(pages[r.page_id].html), len(r.text))


def test_nulls_repeats_and_empty_tables(spark):
    from quillgraph.llm import html

    rows = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x, y</p>", 2), (1, "u", "<p>x, y</p>", 3)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract(rows).collect()) == [(0, "", 0), (1, "x, y", 4), (1, "x, y", 4)]
    assert html.extract(rows.limit(0)).count() == 0
