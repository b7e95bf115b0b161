"""Operator 1: main text of web pages by a conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text that no block element divides, in page order, each with
what its open elements say.  The reader goes forward only, and each open element sums up those around it,
so time and memory are in proportion to the page however it is nested or broken.  The field's features are
the ancestors' tags, what their ids, classes and roles mention, and the text's length, links and punctuation.  It is trained on the labelled pages that
``labelled`` builds from layouts written for it, and decoded by Viterbi.

Scripts, styles, forms' controls, comments in markup and hidden elements never make blocks.

Defined results: a null or empty page has the empty text; very long pages are read whole; markup may be
cut off or unclosed anywhere: a tag without an end is dropped with what follows it, a quote without an end
ends with its tag, and what belongs into a body closes an open head; blocks that score alike for both
labels are no main text; repeated rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.common import map_rows, table
from quadrille.llm.crf import Crf, train

REPORT = "page_id bigint, url string, text string, n_chars bigint"

_TAG_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_GAP, _NAME, _EQUALS, _BARE = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"))
_SILENT = frozenset(("head", "template", "svg", "math", "select", "button", "canvas", "object", "audio", "video", "datalist"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these closes an open element of its group up to the bound.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_LINKS_ONLY = frozenset(("base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title", "head"))
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_SCOPE = frozenset(("td", "th", "caption", "table", "html", "button", "template"))

#: What ids, classes and roles may mention, by theme.
_THEMES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs sitemap topbar skip",
    "head": "header masthead banner logo site brand hero top",
    "foot": "footer foot bottom copyright colophon contentinfo legal imprint",
    "side": "sidebar aside side widget widgets rail complementary related recommended trending popular more",
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion adsense dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert banner popup modal overlay subscribe newsletter signup paywall privacy",
    "form": "form login search signin register contact input field",
    "talk": "comment comments reply replies respond disqus discussion thread reviews feedback responses",
    "share": "share sharing social follow tweet facebook tags tag categories author byline meta",
    "main": "main content article post entry story body text page blog news maincontent articlebody prose",
}
_THEME = {word: theme for theme, words in _THEMES.items() for word in words.split()}
_PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")


@dataclass(slots=True)
class Open:
    """An open element and what it and those around it say together."""

    tag: str
    #: known tags; themes mentioned
    tags: frozenset[str] = frozenset()
    themes: frozenset[str] = frozenset()
    #: innermost block element; innermost element that says something about its purpose
    inner: str = ""
    purpose: str = "none"
    hidden: bool = False
    link: bool = False


@dataclass(slots=True)
class Block:
    text: str
    at: Open
    #: characters inside links
    linked: int = 0


_PURPOSEFUL = frozenset(("nav", "aside", "footer", "header", "form", "article", "main"))
_KNOWN = _BLOCK | _INLINE
_NOWHERE = Open("")


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[Open] = field(default_factory=list)
    #: tag -> places in the stack; places of block elements
    places: dict[str, list[int]] = field(default_factory=dict)
    block_places: list[int] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def top(self) -> Open:
        return self.stack[-1] if self.stack else _NOWHERE

    def last(self, tag: str) -> int:
        return where[-1] if (where := self.places.get(tag)) else -1

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.top(), min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def push(self, new: Open) -> None:
        self.places.setdefault(new.tag, []).append(len(self.stack))
        if new.tag in _BLOCK:
            self.block_places.append(len(self.stack))
        self.stack.append(new)

    def cut(self, at: int) -> None:
        """Closes all elements from a place of the stack on."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in _BLOCK:
                self.block_places.pop()

    def data(self, raw: str) -> None:
        if not raw:
            return
        if self.top().tag == "head" and not raw.isspace():
            self.cut(len(self.stack) - 1)
        top = self.top()
        if not top.hidden:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if top.link:
                self.linked += len(text.strip())

    def close_to(self, tags: tuple[str, ...], bounds: Iterable[str]) -> None:
        at = max(map(self.last, tags))
        if at >= 0 and at > max(map(self.last, bounds)):
            self.flush()
            self.cut(at)

    def start(self, tag: str, said: dict[str, str]) -> None:
        if tag not in _LINKS_ONLY and self.top().tag == "head":
            self.cut(len(self.stack) - 1)
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in _BLOCK:
            self.flush()
            self.close_to(("p",), _SCOPE)
        if tag in _CLOSES:
            self.close_to(*_CLOSES[tag])
        if tag in _VOID:
            return
        around, themes = self.top(), frozenset()
        if said:
            words = _PART.findall(f"{said.get('id', '')} {said.get('class', '')} {said.get('role', '')} {said.get('itemprop', '')}")
            themes = frozenset(_THEME[w.lower()] for w in words if w.lower() in _THEME)
        style = said.get("style", "").replace(" ", "").lower()
        hidden = around.hidden or tag in _SILENT or "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        self.push(
            Open(
                tag, around.tags | {tag} if tag in _KNOWN and tag not in around.tags else around.tags, around.themes if themes <= around.themes else around.themes | themes,
                tag if tag in _BLOCK else around.inner, f"{tag if tag in _KNOWN else 'x'}:{min(themes)}" if themes else tag if tag in _PURPOSEFUL else around.purpose, hidden, around.link or tag == "a",
            )
        )

    def end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        at = self.last(tag)
        if at < 0:
            return
        # A stray inline end tag doesn't close blocks opened since.
        if tag in _BLOCK or not self.block_places or self.block_places[-1] < at:
            if self.block_places and self.block_places[-1] >= at:
                self.flush()
            self.cut(at)


def _attributes(page: str, at: int, quotes: dict[str, int]) -> tuple[dict[str, str], int]:
    """A tag's attributes from behind its name, and where it ends; -1 if it doesn't.  ``quotes`` has each quote's last place."""
    said: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return said, -1
        if page[at] == ">":
            return said, at + 1
        m = _NAME.match(page, at)
        name, at, value = m[0].lower(), m.end(), ""
        if m := _EQUALS.match(page, at):
            at = m.end()
            sign = page[at : at + 1]
            if sign and sign in quotes:
                if quotes[sign] <= at:  # it has no end
                    end = page.find(">", at)
                    return said, end + 1 if end >= 0 else -1
                end = page.find(sign, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        if name not in said:
            said[name] = html.unescape(value) if "&" in value else value


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    if not page:
        return []
    reader, at, low, size = _Reader(), 0, None, len(page)
    quotes = {sign: page.rfind(sign) for sign in "\"'"}
    while at < size:
        tag_at = page.find("<", at)
        if tag_at < 0:
            reader.data(page[at:])
            break
        reader.data(page[at:tag_at])
        sign, at = page[tag_at + 1 : tag_at + 2], tag_at + 1
        if sign and sign in "!?" or sign == "/" and not page[tag_at + 2 : tag_at + 3].isalpha():
            close = "-->" if page.startswith("!--", at) else "]]>" if page.startswith("![CDATA[", at) else ">"
            end = page.find(close, at)
            at = size if end < 0 else end + len(close)
            continue
        m = _TAG_NAME.match(page, at)
        if m is None:
            reader.data("<")
            continue
        tag, closing = m[1].lower(), sign == "/"
        said, at = _attributes(page, m.end(), quotes)
        if at < 0:
            break
        if closing:
            reader.end(tag)
        elif tag in _RAW:
            low = low if low is not None else page.translate(_ASCII_LOWER)
            end = low.find("</" + tag, at)
            at = size if end < 0 else end
        else:
            reader.start(tag, said)
    reader.flush()
    return reader.blocks


#: Tags that say nothing by standing around a block.
_PLAIN = frozenset(("html", "body", "div", "span", "b", "i", "em", "strong"))
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _bucket(n: int) -> int:
    return min(n.bit_length(), 8)


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for b in page:
        at = b.at
        main = not at.tags.isdisjoint(("article", "main")) or "main" in at.themes
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        names = ["theme=" + t for t in at.themes]
        names += ["in=" + t for t in at.tags if t not in _PLAIN]
        names += [
            "own=" + at.inner, "purpose=" + at.purpose, f"main={main}", f"words={_bucket(words)}", f"words={_bucket(words)},own={at.inner}",
            f"links={0 if share < 0.05 else 1 if share < 0.5 else 2}", f"links={share >= 0.5},main={main}", f"stop={b.text[-1] in '.!?…\"»”'}", f"stop={b.text[-1] in '.!?'},words={_bucket(words)}",
        ]
        if "©" in b.text or "copyright" in b.text.lower():
            names.append("owner")
        out.append(names)
    return out


def labelled(seed: int = 11, count: int = 90) -> list[tuple[str, list[bool]]]:
    """Pages of several layouts, and whether each leaf block is main text."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeiousrtlnmdh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def sentence(a: int = 3, b: int = 40) -> str:
        return words(a, b).capitalize() + r.choice([".", ".", ".", "!", "?", "", "***"])

    out = []
    for _ in range(count):
        parts: list[str] = []
        gold: list[bool] = []

        def put(markup: str, *main: bool, parts=parts, gold=gold) -> None:
            parts.append(markup)
            gold.extend(main)

        def links(n: int) -> str:
            return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 2)}</a></li>' for _ in range(n))

        def nav() -> None:
            n = r.randint(2, 7)
            o, c = r.choice([("<nav><ul>", "</ul></nav>"), ('<div class="menu"><ul>', "</ul></div>"), ('<ul id="site-nav">', "</ul>"), ('<nav class="breadcrumb"><ol>', "</ol></nav>")])
            put(o + links(n) + c, *[False] * n)

        def head() -> None:
            put(r.choice(["<header><h1>{a}</h1><p>{b}</p></header>", '<div class="site-header"><h2>{a}</h2><p>{b}</p></div>', '<div id="masthead"><p>{a}</p><p>{b}</p></div>']).format(a=words(1, 4), b=sentence()), False, False)

        def advert() -> None:
            put(r.choice(['<div class="ad">{a}</div>', '<aside class="promo"><p>{a}</p></aside>', '<div class="sponsored"><p>{a}</p></div>', '<div id="advert-1">{a}</div>', '<ins class="adsense">{a}</ins>']).format(a=sentence()), False)

        def notice() -> None:
            put(r.choice(['<div class="cookie-notice"><p>{a}</p></div>', '<div id="consent-banner">{a}</div>', '<div class="newsletter">{a}</div>', '<section class="notice"><p>{a}</p></section>', '<div role="alert">{a}</div>']).format(a=sentence()), False)

        def side() -> None:
            n = r.randint(1, 4)
            o, c = r.choice([("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="right-rail" class="widget">', "</div>"), ('<section class="related">', "</section>")])
            if r.random() < 0.5:
                put(f"{o}<h3>{words(1, 3)}</h3><ul>{links(n)}</ul>{c}", *[False] * (n + 1))
            else:
                put(o + "".join(f"<p>{sentence()}</p>" for _ in range(n)) + c, *[False] * n)

        def form() -> None:
            put(r.choice(["<form><label>{a}</label><input name=q><button>go</button></form>", '<div class="login-form"><p>{a}</p></div>', '<form class="search"><p>{a}</p><textarea>x</textarea></form>']).format(a=words(1, 5)), False)

        def talk() -> None:
            n = r.randint(1, 5)
            o, c = r.choice([('<section id="comments">', "</section>"), ('<div class="comments">', "</div>"), ('<ol class="comment-list">', "</ol>"), ('<div id="disqus_thread">', "</div>")])
            inner = r.choice(["<p>{}</p>", '<div class="comment"><p>{}</p></div>', "<article><p>{}</p></article>", "<li>{}</li>", '<article class="comment"><p>{}</p></article>'])
            put(o + "".join(inner.format(sentence()) for _ in range(n)) + c, *[False] * n)

        def foot() -> None:
            put(r.choice(["<footer>{a}</footer>", '<div class="footer"><p>{a}</p></div>', '<footer><p>{a}</p></footer>', '<div id="colophon">{a}</div>']).format(a=r.choice(["&copy; ", "Copyright ", ""]) + sentence()), False)

        def piece() -> None:
            kind = r.random()
            if kind < 0.7:
                put(r.choice(["<p>{}</p>", "<p>{}</p>", "<p><b>{}</b></p>", "<p>{} <a href='/x'>here</a></p>", "<p>{}", "<p><b>{}<br><p>next</p>"]).format(sentence(1, 60)), True)
                if "<br><p>" in parts[-1]:
                    gold.append(True)
            elif kind < 0.8:
                put(f"<h2>{words(1, 6)}</h2>", True)
            elif kind < 0.9:
                n = r.randint(1, 4)
                put("<ul>" + "".join(f"<li>{sentence(1, 15)}</li>" for _ in range(n)) + "</ul>", *[True] * n)
            elif kind < 0.95:
                put(f"<blockquote>{sentence()}</blockquote>", True)
            else:
                put(f"<pre>{sentence()}</pre>", True)

        for f in r.sample([nav, head, advert, notice, side, form, nav], r.randint(1, 4)):
            f()
        o, c = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main" class="post">', "</div>"), ('<div class="article-body">', "</div>"), ("<article>", "</article>")])
        parts.append(o)
        if r.random() < 0.8:
            put(f"<h1>{sentence(2, 14)}</h1>", True)
        for _ in range(r.randint(1, 9)):
            piece()
            if r.random() < 0.12:
                r.choice([advert, notice, side, form, talk])()
        if r.random() < 0.2:
            talk()
        parts.append(c)
        for f in r.sample([talk, side, advert, notice, form, nav], r.randint(0, 3)):
            f()
        foot()
        out.append((f"<html><head><title>t</title><script>var a='<p>';</script></head><body>{''.join(parts)}</body></html>", gold))
    return out


@lru_cache(maxsize=1)
def model() -> Crf:
    rows = [(blocks(page), gold) for page, gold in labelled()]
    if any(len(b) != len(g) for b, g in rows):
        raise AssertionError("labelled pages and their blocks differ")
    return train([features(b) for b, _ in rows], [["main" if g else "other" for g in gold] for _, gold in rows], ["other", "main"])


def extract(pages: list[str | None], crf: Crf) -> list[str]:
    """The main text of each page: its main blocks joined by line feeds."""
    read = [blocks(p) for p in pages]
    main = crf.labels.index("main")
    return ["\n".join(b.text for b, k in zip(bs, path, strict=True) if k == main) for bs, path in zip(read, crf.decode([features(b) for b in read]), strict=True)]


def report(pages: DataFrame) -> DataFrame:
    held = pages.sparkSession.sparkContext.broadcast(model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract(batch.column("html").to_pylist(), held.value)
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_rows(pages.select("page_id", "url", "html"), "html", run, REPORT)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "pages"))
