"""Main text of pages: broken and huge markup in bounded time, layouts unlike those trained on, and a plain reader to compare with."""

import html
import random
import time
from html.parser import HTMLParser

from quadrille.llm import html_extraction

R = random.Random(4)
SAY = "river stone morning letter garden window table winter summer music paper silver mountain village harbour engine bridge market teacher doctor".split()


def said(page):
    return [b.text for b in html_extraction.blocks(page)]


def test_broken_markup_stays_out():
    assert said('<p>one.. <a title="x>link</a> tail.</p>') == ["one.. link tail."]
    assert said("<p>a <b>b</b> &lt;c&gt;<p>d<br>e") == ["a b <c>", "d e"]
    assert said("<p>one<a href='x") == ["one"] and said("<p>1 < 2 <3 </ p>x<!-- y") == ["1 < 2 <3 x"]
    assert said("<script>var a='<p>no</p>'</SCRIPT><p>yes") == ["yes"] and said("<style>p{}") == []
    assert said("<head><title>t</title><body><p>x") == ["x"] and said("<head><meta a=b><p>x") == ["x"] and said("<head><title>t</title>x") == ["x"]
    assert said("<div hidden><p>a</p></div><p style='display: none'>b</p><p>c") == ["c"]
    assert said(None) == [] == said("")
    assert said("<") == ["<"]


def test_long_pages_take_time_in_proportion():
    pages = ["<a " * 330_000 + '"', '<a title="x ' * 80_000, "<div>x" * 100_000, "<b>" + "<div>" * 90_000 + "</b>" * 90_000, "<" * 1_000_000, "<!--" * 250_000, "<!-- a -->" * 100_000, "".join(f"<x{k}>y" for k in range(90_000))]
    for page in pages:
        began = time.perf_counter()
        html_extraction.blocks(page)
        assert time.perf_counter() - began < 10


class Plain(HTMLParser):
    """Texts between tags of well-formed pages, a block for each block element."""

    def __init__(self):
        super().__init__()
        self.out, self.part = [], []

    def _cut(self):
        if text := " ".join("".join(self.part).split()):
            self.out.append(text)
        self.part = []

    def handle_starttag(self, tag, attrs):
        if tag in html_extraction._BLOCK:
            self._cut()

    def handle_endtag(self, tag):
        if tag in html_extraction._BLOCK:
            self._cut()

    def handle_data(self, data):
        self.part.append(data)


def test_blocks_are_those_of_a_plain_reader():
    def grow(depth):
        kind = R.random()
        if depth > 5 or kind < 0.4:
            return html.escape(" ".join(R.choice(SAY) for _ in range(R.randint(1, 5)))) + R.choice(["", " &amp; ", "\n"])
        tag = R.choice("div section span b em ul blockquote article".split())
        return f'<{tag} class="{R.choice(SAY)}">' + "".join(grow(depth + 1) for _ in range(R.randint(1, 4))) + f"</{tag}>"

    for _ in range(300):
        page = "".join(grow(0) for _ in range(4))
        reader = Plain()
        reader.feed(page), reader.close(), reader._cut()
        assert said(page) == reader.out


def test_layouts_that_it_was_not_trained_on():
    model = html_extraction.model()
    sentence = lambda a, b: " ".join(R.choice(SAY) for _ in range(R.randint(a, b))).capitalize() + "."
    right = total = 0
    for k in range(60):
        gold, parts = [], []
        link = lambda: f'<a href="/{R.choice(SAY)}">{R.choice(SAY).title()}</a>'
        parts.append(f'<div id="top-navigation" role="navigation">{"".join(f"<span>{link()}</span> " for _ in range(5))}</div>')
        parts.append(f'<section class="breadcrumbs"><p>{link()} / {link()}</p></section>')
        inner = []
        for _ in range(R.randint(3, 7)):
            text = sentence(10, 40)
            gold.append(text)
            inner.append(R.choice([f"<p class='lead'>{text}</p>", f"<section><p>{text}</p></section>", f"<div><p>{text}</p></div>"]))
        parts.append(R.choice(['<div class="story-body">{}</div>', '<article class="blog-post"><div>{}</div></article>', '<main role="main"><div>{}</div></main>']).format("".join(inner)))
        parts.append(f'<table class="related-widget"><tr><td>{link()}</td><td>{link()}</td></tr></table>')
        parts.append(f'<div class="site-footer"><div>Copyright {sentence(3, 6)}</div></div>')
        parts.append(f'<div class="user-comments"><div class="reply"><p>{sentence(4, 12)}</p></div></div>')
        got = html_extraction.extract(["<body>" + "".join(parts)], model)[0].split("\n")
        right += len(set(gold) & set(got))
        total += len(set(gold) | set(got)) - ("" in got)
    assert right / total > 0.9


def test_report(spark):
    article = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A</h1><p>One\n two <b>three</b> words here.</article>"
    rows = [(1, "u", article, "x", 1), (1, "u", article, "x", 1), (2, None, None, "y", 2), (None, "v", "", "z", 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in html_extraction.report(pages).collect()))
    want = "A\nOne two three words here."
    assert got == [(0, "v", "", 0), (1, "u", want, len(want)), (1, "u", want, len(want)), (2, "", "", 0)]
    assert html_extraction.report(pages.where("false")).collect() == []
