"""Main text of web pages by the maximum-scoring run of tokens.

A page is read as a row of tokens: words and tags.  A word weighs as much as words in general do, more or less the
evidence of the elements that it lies in; tags weigh less than nothing.  The contiguous run with the greatest sum (found
in one linear scan) is the content region, whose blocks are joined in page order.  All weights are log-odds estimated from
labelled pages (``labelled_pages``).  The evidence of an element is that of its name, its role and the words of its class and
id; it is bounded, and adds up with that of the elements around it, so that a doubtful word in the class of a wrapper
costs its words a little, which good evidence within wins back.  Words joined to others (``nav-open``, ``sidebar-left``)
mostly tell of a page's state, so they count for less, and for very little beside a word such as ``content``.

Where evidence makes words weigh less than nothing, an element's words together cost no more than a few words gain, so that
an advert in the middle of an article does not part it.  Within the region, such parts are the runs of least sum of the same
weights between words of content, found by the same scan with the signs turned; they are taken out.

Defined results: a null or empty page, and a page without a run of words that gain more than their tags cost, has the empty text;
what HTML does not render as text (scripts, styles, form controls, hidden elements) never shows; unclosed and
misnested tags are closed where HTML closes them, a tag or comment without an end runs to the page's end;
equal pages get equal texts; repeated rows get one result each; columns but page_id, url and html are ignored;
an empty table gives an empty result.  The time is linear in the length of the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, to_python

# Element names of HTML.  Fixed values.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose content HTML does not render as text of the page.
UNSEEN = frozenset("head script style noscript template textarea title xmp iframe noembed noframes svg math canvas audio video object select button input datalist".split())

_OPEN = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
_STOP = re.compile(r"=\s*+([\"'])|>")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT_MARK = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_UNSHOWN = re.compile(r"display\s*+:\s*+none")
_WHITE = re.compile(r"\s+")
#: An open p is closed by these; so are open items by the next of their kind.
_CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "title", "noscript"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table td th body article main section div aside nav blockquote form figure".split())
_NAMED = ("article", "main")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip() else {}


class Page:
    """A page's tokens and elements, in page order.

    tokens: ("", text, element), (name, "", element) where a tag opens and (name, "/", element) where it closes.
    elements: (name, attributes as written, parent, lies in an article or main element); holds: those with an article or main within."""

    def __init__(self, page: str) -> None:
        self.tokens: list[tuple[str, str, int]] = []
        self.elements: list[tuple[str, str, int, bool]] = [("", "", -1, False)]
        self.holds: set[int] = set()
        self._parse(page)

    def _parse(self, page: str) -> None:
        add, elements = self.tokens.append, self.elements
        stack: list[tuple[str, int]] = []  # open elements
        places: dict[str, list[int]] = defaultdict(list)  # of each name, where it is in the stack
        scopes: list[int] = []
        unseen = named = 0
        at, size, last = 0, len(page), {q: page.rfind(q) for q in "\"'"}

        def shut(depth: int) -> None:
            nonlocal unseen, named
            while len(stack) > depth:
                name, ident = stack.pop()
                places[name].pop()
                if name in _SCOPES:
                    scopes.pop()
                if not unseen:
                    add((name, "/", ident))
                unseen -= name in UNSEEN
                named -= name in _NAMED

        def text(part: str) -> None:
            if part and not unseen:
                add(("", part, stack[-1][1] if stack else 0))

        while at < size:
            m = _OPEN.search(page, at)
            text(html.unescape(page[at : m.start() if m else size]))
            if not m:
                break
            at = m.end()
            if not m[2]:
                if m[0] == "<!--":
                    quick = page.startswith((">", "->"), at)
                    end = page.find(">", at) + 1 if quick else e.end() if (e := _COMMENT_END.search(page, at)) else size
                elif m[0] == "<![CDATA[":
                    end = page.find("]]>", at)
                    text(page[at : end if end >= 0 else size])
                    end = end + 3 if end >= 0 else size
                else:
                    end = page.find(">", at) + 1 or size
                at = end
                continue
            # the tag's end: quotes count where a value begins, if they are closed at all
            pos = at
            while (stop := _STOP.search(page, pos)) and stop[1]:
                pos = page.find(stop[1], stop.end()) + 1 if stop.end() <= last[stop[1]] else stop.end()
            raw = page[at : stop.start() if stop else size]
            at = stop.end() if stop else size
            name = m[2].lower()
            if m[1]:
                if places[name] and (name in BLOCKS or not scopes or scopes[-1] <= places[name][-1]):
                    shut(places[name][-1])
                elif name == "p" and not places[name] and not unseen:
                    here = stack[-1][1] if stack else 0
                    self.tokens += [("p", "", here), ("p", "/", here)]
                continue
            if name in _CLOSES_P or name in _SIBLINGS:
                near = max((places[n][-1] for n in (*_SIBLINGS.get(name, ()), *(("p",) if name in _CLOSES_P else ())) if places[n]), default=-1)
                if near >= 0 and near >= (scopes[-1] if scopes else 0):
                    shut(near)
            parent = stack[-1][1] if stack else 0
            ident = len(elements)
            elements.append((name, raw, parent, named > 0))
            gone = unseen > 0 or name in UNSEEN
            if not gone:
                add((name, "", ident))
            if name in VOID:
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else size
                continue
            if raw.rstrip().endswith("/") and name not in BLOCKS:
                continue
            if name in _NAMED:
                while parent > 0 and parent not in self.holds:
                    self.holds.add(parent)
                    parent = elements[parent][2]
                named += 1
            if name in _SCOPES:
                scopes.append(len(stack))
            places[name].append(len(stack))
            stack.append((name, ident))
            unseen += name in UNSEEN
        shut(0)


# -- labelled pages and what is learned from them ---------------------------------------------------

#: Parts of pages that are none of the article, as they are marked up in practice: their opening tags and what they hold.
_AROUND = """
menu: nav | nav class="main-menu" | div class="navbar" | div id="nav" | ul class="navigation" | div role="navigation" | div class="breadcrumbs" | ul class="breadcrumb" | div class="menu" role="menu" | menu | div class="topbar" | div class="toolbar" role="toolbar" | div class="pagination" | div class="pager" | div class="skip" | nav class="navi crumbs" | div class="crumbs" | div class="navi"
line: header | header class="site-header" | div id="header" | div class="masthead" role="banner" | header class="masthead" | footer | footer class="site-footer" | div id="footer" role="contentinfo" | div class="footer" | div class="copyright" | div class="legal disclaimer" | p class="copyright legal" | p class="disclaimer" | div class="siteheader" | header class="siteheader" | div class="foot" | p class="foot"
aside: aside | aside class="sidebar" | div class="sidebar" role="complementary" | div id="sidebar" | div class="widget" | div class="related" | section class="related recommended" | div class="recommendations" | div class="recommended widget" | div class="rail" | section class="recommendations rail" | div class="side" | div class="tags" | div class="side tags"
line: div class="ad" | div id="ad-1" | div class="ads" | aside class="ads advert" | div class="advert" | div class="adverts" | div class="adverts advertisements" | div class="advertisements" | div class="advertisement" | section class="advertisement" | div class="advertising adslot" | div class="adsense adbox" | div class="adbox adslot" | div class="adsense advertising" | div class="sponsor" | div class="sponsored" | p class="sponsored sponsor" | div class="promo" | div class="promotion promo" | div class="promoted" | section class="promotion promoted" | div class="banner" | div id="banner"
line: div class="cookie" | div class="cookies consent" | div id="cookie-consent" role="dialog" | div class="gdpr cookies" | dialog | div class="gdpr" role="alertdialog" | div class="notice" role="alert" | div class="notice" | div class="notices" | div class="notices notification" | div class="notification alert" | div class="alert" | div class="popup" | div class="modal popup" role="dialog" | div class="modal overlay" | div class="overlay"
form: form | form role="search" | div class="search" role="search" | div class="searchbox search" | div class="searchbox" | div class="newsletter" | div class="newsletter subscribe" | form class="subscribe subscription" | div class="subscription signup" | div class="signup register" | div class="login" | form class="login register" | div class="share sharing" | div class="share social" | div class="social sharing" | div class="form"
talk: section id="comments" | div class="comments" | div class="comment" | ol class="commentlist" | ol class="commentlist comment" | div id="disqus" | div class="disqus discussion" | section class="discussion" | div id="respond" | div class="respond reply" | div class="replies" | div class="reply replies"
"""
#: What surrounds and makes up articles, likewise.
_WITHIN = """
shape: article | div | main | section | div class="content" | article | div id="main-content" | div class="post" | main | div class="entry-content" | div class="site-content" | article class="post" | div class="story-body" | section class="site-main" | main id="content" | div class="text"
page: div | div id="page" | div class="wrapper" | div class="container" | div class="page has-sidebar" | div class="layout with-sidebar" | section
part: header | div class="header" | div class="side" | div class="legal" | div class="form" | p class="tags" | p class="foot" | blockquote | figure | section | header | div | p class="legal"
"""


#: How classes join such words to others: those of parts, and of wrappers whose words tell of a state.
_PARTS = "site-* | *-list | *-box | *-wrap | *-area | *-bar | *-container | *-item | page-* | *-inner | *-block | *-widget | *-notice | *-banner | main-*"
_WRAPPERS = "wrapper | content | entry | story | text | body | layout | container | post | article-wrap | content-area | post-container | main-inner | text-block | entry-box | story-item | content-bar | page-list | site-main"


def _spec(text: str) -> list[tuple[str, str]]:
    return [(kind, tag.strip()) for kind, tags in (x.split(":", 1) for x in text.strip().splitlines()) for tag in tags.split(" | ")]


def labelled_pages() -> list[str]:
    """Pages with the marks ``[[`` and ``]]`` where the content begins and ends, and ``{{`` and ``}}`` around what is none of it in between."""
    words = "the of and lore that in for with main text line here one more part then".split()
    text = lambda n, k: " ".join(words[(i * 7 + k) % len(words)] for i in range(n))
    links = lambda n, k: "".join(f'<li><a href="/{i}">{text(1 + (i + k) % 2, i)}</a></li>' for i in range(n))
    wrap = lambda tag, inner: f"<{tag}>{inner}</{tag.split()[0]}>"

    def around(kind: str, tag: str, k: int) -> str:
        inner = {
            "menu": links(4 + k % 4, k) if tag.startswith(("ul", "menu")) else f"<ul>{links(4 + k % 4, k)}</ul>",
            "line": f"{text(4 + k % 9, k)} <a href='/'>{text(2, k)}</a>",
            "aside": f"<h3>{text(2, k)}</h3><ul>{links(4, k + 1)}</ul>",
            "form": f"<label>{text(3, k)}</label><p>{text(5, k)}</p>",
            "talk": "".join(f"<{x}><p>{text(6 + i, k)}</p></{x}>" for i, x in enumerate(("li", "li", "li") if tag.startswith("ol") else ("div", "div"))),
        }[kind]
        return wrap(tag, inner)

    out, others = [], _spec(_AROUND)
    how, wrappers = _PARTS.split(" | "), _WRAPPERS.split(" | ")
    shapes, pages, parts = ([tag for kind, tag in _spec(_WITHIN) if kind == x] for x in ("shape", "page", "part"))
    for k in range(3 * len(others)):
        body = "".join(f"<p>{text(20 + (i * k) % 30, i)} <a href='/x'>{text(2, i)}</a> <b>{text(1, k)}</b> {text(9, k)}.</p>" for i in range(2 + k % 5))
        for tag in ("ul", "ol")[k % 2 : 2 if k % 3 else 1]:
            body += wrap(tag, "".join(f"<li>{text(8 + i, k)} <a href='/x'>{text(1, i)}</a></li>" for i in range(3)))
        if k % 5 < 3:
            body += f"<h2>{text(3, k)}</h2><div><p>{text(14, k)}</p></div><h3>{text(4, k)}</h3><p>{text(12, k + 1)}</p>"
        if k % 6 == 5:
            body += f"<table><tr><td>{text(9, k)}</td><td>{text(7, k)}</td></tr></table>"
        pick = [others[(k * 5 + i * 31) % len(others)] for i in range(4)]
        shape = shapes[k % len(shapes)]
        if shape.startswith(_NAMED):
            body += wrap(parts[k // 2 % len(parts)], f"<p>{text(11, k)}</p>") + f"<p>{text(25, k + 1)}</p>"
        if k % 3 == 0:
            body += "{{" + around(*pick[3], k) + "}}" + f"<p>{text(30, k)}</p>"
        article = wrap(shape, f"[[<h1>{text(5, k)}</h1>{body}]]")
        plain = f"<div><a href='/'>{text(2, k)}</a> | <a href='/'>{text(1, k)}</a></div>" if k % 2 else f"<div><ul>{links(5, k)}</ul></div>"
        joined = others[(k * 7 + 3) % len(others)]
        words_of = [w for w in _SPLIT_MARK.split(joined[1].split("=", 1)[-1]) if w and w not in ("class", "role", "id", "div")]
        word = words_of[k // len(others) % len(words_of)]
        part = around(joined[0], f'div class="{how[k % len(how)].replace("*", word.lower())}"', k)
        article = wrap(f'div class="{wrappers[k % len(wrappers)]}"', article)
        article = f"{part}{article}" if k % 3 else f"{article}{part}"
        out.append(f"<html><body>{around(*pick[0], k)}{wrap(pages[k % len(pages)], around(*pick[1], k + 1) + article)}{plain}{around(*pick[2], k + 2)}</body></html>")
    return out


Feature = tuple[str, str]
#: Log-odds for content count for no more than the first of these (of an element that holds an article, the second; of the names of others but article and main, the third); counts are smoothed by the last.
_MOST, _MOST_HOLDS, _MOST_NAME, _SMALL = 0.5, 2.5, 0.05, 0.1
#: Log-odds up to the first of these count for the second of them only.
_SURE, _UNSURE = 2.0, 0.15
#: Bounds of the evidence of all elements around a word, and of words that are joined to others in a class: of a token
#: without and with a word of state, and of all of them beside a word that speaks for content.
_LOW, _HIGH, _JOINED, _STATE, _BESIDE = -5.0, 1.0, -4.0, -0.3, -0.4
#: What the words of an element cost together at most, where each weighs less than nothing: outside of article and main elements, and within.
_COST, _COST_WITHIN = 6.0, 1.5
#: Words that tell of the state of a page or part rather than of what it is.  Fixed values.
STATES = frozenset("open opened closed close on off left right top bottom middle no not non has have with without is enabled disabled active inactive visible invisible hidden fixed sticky free full wide narrow collapsed expanded ready loaded accepted allowed dismissed shown after before below above first last one two three col cols column columns layout page single template type id post category topics format style theme".split())


@lru_cache(maxsize=4096)
def features(name: str, raw: str) -> tuple[tuple[Feature, ...], tuple[tuple[str, ...], ...]]:
    """What an element says of itself, and the tokens of its class and id that are several words.  The class of a whole page or article names all sorts of things and is not heeded."""
    attrs = attributes(raw) if "=" in raw else {}
    if name in ("html", "body", *_NAMED):
        return (("name", name),), ()
    tokens = {tuple(w.lower() for w in _SPLIT_MARK.split(t) if w) for t in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()}
    alone = {t[0] for t in tokens if len(t) == 1}
    return (("name", name), *(("word", w) for w in sorted(alone)), *(("role", w) for w in attrs.get("role", "").lower().split())), tuple(sorted(t for t in tokens if len(t) > 1))


@lru_cache(maxsize=4096)
def _hidden(raw: str) -> bool:
    """Whether an element's attributes keep it from being rendered."""
    attrs = attributes(raw) if "hidden" in raw or "none" in raw else {}
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_UNSHOWN.search(attrs.get("style", "")))


class Learned:
    """Log-odds of content: of an element's features, within an article or not; and of tokens."""

    def __init__(self, pages: list[str]) -> None:
        self.evidence: dict[tuple[Feature, bool], float] = {}
        self.word, self.tags = 0.0, {}
        read = [self._marked(p) for p in pages]
        self._learn_elements(read)
        self._learn_tokens(read)

    @staticmethod
    def _marked(source: str) -> tuple[Page, list[tuple[int, int]]]:
        """A page; and of each token, the words of content in it and of anything else, the marks being taken out.  A tag counts as one word of the region that it is in."""
        page, on, off, out = Page(source), False, False, []
        for i, (name, text, ident) in enumerate(page.tokens):
            if name:
                out.append((int(on), int(not on)))
                continue
            good = bad = 0
            for w in re.sub(r"(\[\[|\]\]|\{\{|\}\})", r" \1 ", text).split():
                if w in ("[[", "]]", "{{", "}}"):
                    on, off = (w == "[[", off) if w[0] in "[]" else (on, w == "{{")
                elif on and not off:
                    good += 1
                else:
                    bad += 1
            page.tokens[i] = ("", re.sub(r"\[\[|\]\]|\{\{|\}\}", " ", text), ident)
            out.append((good, bad))
        return page, out

    def _learn_elements(self, read: list[tuple[Page, list[tuple[int, int]]]]) -> None:
        """Each feature counts once a page for content, and once against it, by the elements that have it and hold words of one sort only.

        Where no labelled article has a feature within its content, all that is known of the feature counts."""
        counts: dict[tuple[Feature, bool], list[int]] = defaultdict(lambda: [0, 0])
        for page, marks in read:
            words = [[0, 0] for _ in page.elements]
            for (name, _, ident), (good, bad) in zip(page.tokens, marks, strict=True):
                if not name:
                    words[ident][0] += good
                    words[ident][1] += bad
            for k in range(len(words) - 1, 0, -1):
                for j in (0, 1):
                    words[page.elements[k][2]][j] += words[k][j]
            holds = {("holds", "article") for k in page.holds if words[k][0] > words[k][1]}
            pure = {(f, page.elements[k][3], good == 0) for k, (good, bad) in enumerate(words) if k and (good > 0) != (bad > 0) and k not in page.holds for f in self._all(page, k)}
            for f, named, against in pure | {(f, False, False) for f in holds}:
                counts[f, named][against] += 1
        for f, named in list(counts):
            if named and not counts[f, True][0]:
                counts[f, True] = [a + b for a, b in zip(counts[f, True], counts.get((f, False), [0, 0]), strict=True)]
        self.evidence = {key: math.log((a + _SMALL) / (b + _SMALL)) for key, (a, b) in counts.items()}

    @staticmethod
    def _all(page: Page, k: int) -> set[Feature]:
        """What is counted of an element."""
        own, joined = features(*page.elements[k][:2])
        return {*own, *(("joined", w) for t in joined for w in t)}

    def _odds(self, f: Feature, named: bool, most: float = _MOST) -> float:
        """What no labelled article has within counts as it does elsewhere."""
        get = self.evidence.get
        odds = get((f, named), get((f, False), 0.0))
        # what both sorts of elements have tells little, and comes again and again from one element to the next within
        return min(odds if abs(odds) > _SURE else _UNSURE * odds, most)

    def says(self, page: Page, k: int) -> float:
        """The evidence of one element; of one that holds an article, the class is not heeded."""
        name, raw, _, named = page.elements[k]
        if k in page.holds:
            return self._odds(("name", name), named) + self._odds(("holds", "article"), named, _MOST_HOLDS)
        own, joined = features(name, raw)
        each = [self._odds(f, named, _MOST_NAME if f[0] == "name" and f[1] not in _NAMED else _MOST) for f in own]
        parts = 0.0
        for t in joined:
            one = sum(self._odds(("joined", w), named) for w in t if w not in STATES)
            parts += max(one, _STATE if any(w in STATES for w in t) else _JOINED)
        if any(x > 0 for f, x in zip(own, each, strict=True) if f[0] == "word"):
            parts = max(parts, _BESIDE)
        return sum(each) + max(parts, _JOINED)

    def gains(self, page: Page) -> list[float | None]:
        """Of each element, what a word in it gains; none where it is not rendered."""
        total, gone, counts = [0.0], [False], Counter()
        for k, (_, raw, parent, _) in enumerate(page.elements[1:], 1):
            gone.append(gone[parent] or bool(raw) and _hidden(raw))
            total.append(min(max(total[parent] + self.says(page, k), _LOW), _HIGH))
        for name, text, ident in page.tokens:
            if not name:
                counts[ident] += len(text.split())
        # the outermost elements whose words weigh less than nothing, and the words in each
        top = [-1]
        for k, (_, _, parent, _) in enumerate(page.elements[1:], 1):
            top.append(top[parent] if top[parent] >= 0 else k if self.word + total[k] < 0 else -1)
        held = Counter()
        for k, n in counts.items():
            held[top[k]] += n
        return [None if gone[k] else self.word + total[k] if t < 0 else max(min(self.word + total[k], -0.01), -(_COST_WITHIN if page.elements[t][3] else _COST) / max(held[t], 1)) for k, t in enumerate(top)]

    def _learn_tokens(self, read: list[tuple[Page, list[tuple[int, int]]]]) -> None:
        inside, outside = Counter(), Counter()
        self.word = 1.0  # to tell elements apart, until it is known
        for page, marks in read:
            gains = self.gains(page)
            for (name, text, ident), (good, other) in zip(page.tokens, marks, strict=True):
                if gains[ident] is not None and gains[ident] > 0:
                    key = (name, text, page.elements[ident][3]) if name else ("", "w", False)
                    inside[key] += good
                    outside[key] += other
        a, b = sum(inside.values()), sum(outside.values())
        odds = lambda t: math.log((inside[t] + 1) / (a + 1) / ((outside[t] + 1) / (b + 1)))
        self.word = max(odds(("", "w", False)), _LEAST_WORD)
        self.tags = {t: max(min(odds(t), -0.05), _LEAST_TAG) for t in {*inside, *outside} if t[0]}

    def scores(self, page: Page) -> list[float]:
        """Weights of the tokens; a tag that no labelled page has there weighs as it does elsewhere, and tags of what costs nothing more."""
        get, gains, out = self.tags.get, self.gains(page), []
        for name, text, ident in page.tokens:
            gain = gains[ident]
            if gain is None:
                out.append(0.0)
            elif not name:
                out.append(gain * len(text.split()))
            elif gain < 0:
                out.append(0.0)
            else:
                named = page.elements[ident][3]
                known = get((name, text, named))
                if known is None:
                    known = get((name, text, not named))
                out.append(known if known is not None else _OTHER_BLOCK if name in BLOCKS else _OTHER_INLINE)
        return out


#: A word weighs so much at least, and a tag does not weigh less than this.
_LEAST_WORD, _LEAST_TAG = 1.0, -1.5
#: Of tags that no labelled page has: of blocks and of others.
_OTHER_BLOCK, _OTHER_INLINE = -0.5, -0.05


@lru_cache(maxsize=1)
def learned() -> Learned:
    return Learned(labelled_pages())


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run with the greatest positive sum; (0, 0) if there is none."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def least_runs(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal runs of negative sum that lie between positive scores: none can be made less by going on, nor by leaving out an end.

    One linear scan: of each run, the last one before it that begins at a lower sum is kept, so none is looked at twice."""
    runs: list[tuple[int, int, float, float, int]] = []  # first, last + 1, the negated sums before and after it, and that run
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total - s
        if s >= 0:
            continue
        first, low = i, before
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= low:
                j = runs[j][4]
            if j < 0 or runs[j][3] >= total:
                break
            first, low = runs[j][0], runs[j][2]
            del runs[j:]
        runs.append((first, i + 1, low, total, j))
    firm = [i for i, s in enumerate(scores) if s > 0]
    return [(a, b) for a, b, *_ in runs if firm and firm[0] < a and b <= firm[-1]]


def blocks(toks: list[tuple[str, str]]) -> list[str]:
    """The texts between block tags, with single spaces."""
    out, part = [], []
    for name, text in [*toks, ("p", "")]:
        if not name:
            part.append(text)
        elif name == "br":
            part.append(" ")
        elif name in BLOCKS:
            joined = _WHITE.sub(" ", "".join(part)).strip()
            if joined:
                out.append(joined)
            part = []
    return out


def shown(page: Page) -> list[tuple[str, str]]:
    """The tokens that count for content: ("", text), (name, "") where a tag opens and (name, "/") where it closes."""
    gains = learned().gains(page)
    return [(name, text) for name, text, ident in page.tokens if gains[ident] is not None and gains[ident] > 0]


def region(page: Page, weights: Learned) -> list[tuple[str, str]]:
    """The tokens of the content: those of the best run, without the runs that cost within it."""
    scores = weights.scores(page)
    lo, hi = best_run(scores)
    words = [s if not name else 0.0 for (name, _, _), s in zip(page.tokens[lo:hi], scores[lo:hi], strict=True)]
    gone = [False] * (hi - lo)
    for a, b in least_runs(words):
        gone[a:b] = [True] * (b - a)
    gains = weights.gains(page)
    return [(name, text) for (name, text, ident), out in zip(page.tokens[lo:hi], gone, strict=True) if name or not out and gains[ident] is not None]


def extract(page: str | None, weights: Learned | None = None) -> str:
    """The main text: its blocks, joined by empty lines."""
    # tags of what is taken out part blocks as any others do
    return "\n\n".join(blocks(region(Page(page), weights or learned()))) if page else ""


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(at, 500)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
        give_back()

    return to_python(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
