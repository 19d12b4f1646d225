"""Main text of web pages: a tree-structured graphical model over the nodes of the document tree.

Each element is a binary variable (content or not). Its potential is the product of the likelihoods of what is seen of it:
tag, role, word stems of class and id, how much text it and what is below it hold, whether that reads as sentences, the
share of links, whether the page marks an article and the element lies in it, and how many neighbours look alike. Each edge
has the potential of a child's state given its parent's. Both are counted from labelled pages. Sum-product messages run from
the leaves to the root and back; an element's own text is kept where its marginal of being content is above one half. No
feature decides alone: its weight is bounded by CLIP.

Labelled pages are of two kinds. Pages composed here from a seed carry a label at each part (composed); their parts appear
under class names of many kinds, with misleading ones among them. A bounded sample (LEARN_PAGES of at most LEARN_CHARS
characters, those with the smallest seeded hash of page_id) of the given pages is labelled by the article or main element
that they mark. Counts are kept in BUCKETS hashed features, so that the model that is broadcast has a fixed size.

Defined results: a null or empty page has an empty text; text outside any element, and in an element that is cut off, is
kept by its element's state; tags that the page leaves open end with their parent, or where HTML implies it; a page of any
length is parsed once, without recursion; repeated rows are each extracted; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.llm.common import bounded_sample

LEARN_PAGES, LEARN_CHARS = 2_000, 200_000
#: Pages composed as labelled examples, and how much more an element of theirs weighs than the sample's as a whole.
COMPOSED = 900
BUCKETS = 4096
#: Added to each count, and the largest weight (log likelihood ratio) of one feature.
SMOOTH, CLIP = 0.5, 4.0
#: Weight of what is seen of an element that is no part of its own: the texts of one part resemble each other.
TEXT_WEIGHT = 0.5
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math q s samp small span strike strong sub sup time tt u var wbr".split())
MATHS = frozenset("math mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption"},
    "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
SCOPES = frozenset("ul ol dl table article section div body html nav aside header footer main form menu select datalist".split())
PARTS = frozenset("address article aside body center details dialog dir div fieldset figure footer form head header hr html main menu nav ol section table ul".split())
#: Elements whose text a browser does not show as text of the page, or that are a part of a form.
SILENT = frozenset("head template noscript svg select datalist option optgroup button object audio video canvas".split())
#: Parts whose tag says nothing but that they are as their parent is.
LISTS = frozenset("ul ol li dl dt dd".split())
# What marks an article, and elements that HTML defines as something beside it.
CONTENT = frozenset("article main".split())
BESIDE = frozenset("nav aside footer form dialog menu fieldset".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SENTENCE = re.compile(r"[.!?\u2026\u3002][\"')\u00bb\u201d]*(?:\s|\Z)")


class Page:
    """Elements in page order: tag, parent, marks (word stems of class and id), role and label (given by a composed page);
    texts: (element, text, starts a block)."""

    __slots__ = ("tags", "parents", "marks", "roles", "given", "texts")

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.marks, self.roles, self.given = ["#root"], [-1], [()], [""], [-1]
        self.texts: list[tuple[int, str, bool]] = []
        stack, at, size, new_block = [0], 0, len(source), True
        tags, parents = self.tags, self.parents
        find = _TAG.search
        while at < size:
            m = find(source, at)
            end = m.start() if m else size
            if end > at:
                self.texts.append((stack[-1], source[at:end], new_block))
                new_block = False
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            inline = name in INLINE or name in MATHS
            if not inline:
                new_block = True
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        break
                    if inline and tags[stack[k]] not in INLINE and tags[stack[k]] not in MATHS:
                        break  # an end tag of a part of a line does not end the blocks in it
                continue
            if name in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    t = tags[stack[k]]
                    if t == "p":
                        del stack[k:]
                        break
                    if t in SCOPES:
                        break
            elif name in SIBLINGS:
                for k in range(len(stack) - 1, 0, -1):
                    t = tags[stack[k]]
                    if t in SIBLINGS[name]:
                        del stack[k:]
                        break
                    if t in SCOPES:
                        break
            marks, role, label = (), "", -1
            if m[3] and "=" in m[3]:
                words = []
                for key, *values in _ATTRIBUTE.findall(m[3]):
                    key, value = key.lower(), (values[0] or values[1] or values[2]).lower()
                    if key == "data-label":
                        label = int(value == "1")
                    elif key == "role":
                        role = value
                    else:
                        words += [w[:6] for w in _SPLIT.split(value) if w]
                marks = tuple(words)
            tags.append(name)
            parents.append(stack[-1])
            self.marks.append(marks)
            self.roles.append(role)
            self.given.append(label)
            if name in RAW and not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else size
            elif name not in VOID:
                stack.append(len(tags) - 1)

    def marked(self) -> list[int]:
        """1 in an element that the page marks as its article, 0 beside one, 2 where the page marks none, 3 above one."""
        n = len(self.tags)
        state = [0] * n
        beside = [False] * n
        for i in range(1, n):
            beside[i] = beside[self.parents[i]] or self.tags[i] in BESIDE
            mark = self.tags[i] in CONTENT or self.roles[i] == "main" or "articl" in self.marks[i] and "body" in self.marks[i] or "articlebody"[:6] in self.marks[i] and self.tags[i] in PARTS
            state[i] = int(not beside[i] and mark or state[self.parents[i]] == 1)
        if 1 not in state:
            return [2] * n
        for i in range(n - 1, 0, -1):
            if state[i] and not state[self.parents[i]]:
                state[self.parents[i]] = 3
        return state

    def features(self) -> list[list[int]]:
        """Hashed features of each element."""
        n = len(self.tags)
        tags, parents = self.tags, self.parents
        own, deep, linked, said = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text, _ in self.texts:
            own[node] += len(text.strip())
            said[node] += len(_SENTENCE.findall(text))
        for i in range(n - 1, 0, -1):
            deep[i] += own[i]
            if tags[i] == "a":
                linked[i] = deep[i]
            for total in (deep, linked, said):
                total[parents[i]] += total[i]
        alike = Counter(zip(parents, tags, self.marks, strict=True))
        marked = self.marked()
        around = [False] * n  # all its text lies in one part, which shows the same
        for i in range(1, n):
            around[parents[i]] |= tags[i] in PARTS and deep[i] == deep[parents[i]] > 0
        out = []
        for i in range(n):
            of = "list " * (tags[i] in LISTS)
            names = [f"tag {tags[i]}{' around' * around[i]}"] if not of else []
            if not around[i]:
                names.append(f"{of}links {4 * linked[i] // max(1, deep[i])} {deep[i] > 0}")
            if tags[i] in PARTS and not around[i]:
                names.append(f"{of}deep {min(4, deep[i].bit_length() // 3)} {min(3, said[i])}")
                names.append(f"{of}alike {min(3, alike[parents[i], tags[i], self.marks[i]])} {bool(self.marks[i])}")
            elif tags[i] not in PARTS:
                names.append(f"{of}own {min(4, own[i].bit_length() // 2)} {min(2, said[i])}")
            if marked[i] != marked[parents[i]]:  # below, edges pass it on
                names.append(f"marked {marked[i]}")
            if self.roles[i]:
                names.append(f"role {self.roles[i]}")
            names += [f"mark {w}" for w in dict.fromkeys(self.marks[i])]
            out.append([_bucket(x) for x in names])
        return out

    def labels(self) -> list[int]:
        """Of a composed page what it says; of another 1 in its marked article but for what HTML sets beside it; -1 all over where nothing is said."""
        n = len(self.tags)
        if 1 in self.given:
            state = list(self.given)
            state[0] = 0
            for i in range(1, n):
                state[i] = state[i] if state[i] >= 0 else state[self.parents[i]]
            return state
        marked = self.marked()
        if 1 not in marked:
            return [-1] * n
        other = [False] * n
        for i in range(1, n):
            other[i] = other[self.parents[i]] or self.tags[i] in BESIDE or self.tags[i] in SILENT or self.tags[i] in RAW
        return [int(m == 1 and not o) for m, o in zip(marked, other, strict=True)]


_buckets: dict[str, int] = {}


def _bucket(name: str) -> int:
    found = _buckets.get(name)
    if found is None:
        if len(_buckets) > 100_000:
            _buckets.clear()
        found = _buckets[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS
    return found


# Class names that the composed pages use for each kind of part.
NAMES = {
    "nav": "nav navbar navigation menu main-menu site-nav topnav breadcrumb breadcrumbs pagination pager toc-links toolbar tabs".split(),
    "header": "header site-header masthead top-bar branding logo banner".split(),
    "footer": "footer site-footer page-footer colophon copyright legal imprint".split(),
    "aside": "sidebar side-column widget widgets rail related related-posts recommended more-stories trending popular".split(),
    "advert": "ad ad ad ad ad-box ads advert advertisement ad-slot sponsor sponsored promo promotion affiliate dfp taboola".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay newsletter subscribe paywall signup".split(),
    "share": "share share-buttons sharing social social-links follow-us tools print".split(),
    "comments": "comments comment-list discussion responses replies reactions feedback user-feedback thread talkback reader-comments reader-voices voices conversation opinions disqus guestbook discussion-body".split(),
    "comment": "comment-body comment-text comment-inner reply-body reply-text message-text post-message opinion voice remark".split(),
    "content": "content content content main article-text entry-content post-body story text body-copy section chapter paragraph lead intro column block wrap row main-text".split(),
    "content misleading": "share-of-market social-policy ad-hoc notice-of-death comment-on-law menu-of-the-day sidebar-story print-edition".split(),
    "plain": "box c1 row-2 x inner container wrap group col s7 js-block".split(),
}


def composed(rng: random.Random) -> str:
    """A page of parts in random order and depth, each labelled; some pages mark their article and some don't."""
    vocabulary = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(60)]

    def words(low: int, high: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(low, high)))

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(words(4, 20).capitalize() + rng.choice(".....!?") for _ in range(rng.randrange(low, high)))

    def attributes(kind: str, label: int) -> str:
        named = rng.random() < (0.85 if kind != "content" else 0.6)
        name = f" {rng.choice(('class', 'class', 'id'))}='{rng.choice(NAMES[kind + " misleading" * (kind == "content" and rng.random() < 0.06)] if named else NAMES['plain'])}'" if named or rng.random() < 0.5 else ""
        return f"{name} data-label='{label}'"

    def links(n: int) -> str:
        rows = [f"<a href='/x'>{words(1, 4)}</a>" for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>" if rng.random() < 0.7 else " ".join(rows)

    def beside(kind: str) -> str:
        if kind == "comments":
            item = rng.choice(("div", "li", "article", "div", "section"))
            mark = rng.choice((" class='comment'", " class='item'", " class='post'", " class='reply'", ""))
            said = rng.choice(("", "", f" class='{rng.choice(NAMES['comment'])}'"))
            longer = rng.choice((3, 3, 6, 9))
            inside = (lambda x: f"<div{said}>{x}</div>") if said and rng.random() < 0.6 else (lambda x: f"<p{said}>{x}</p>")
            one = lambda: f"<{item}{mark}>{rng.choice(('<b>', '<span>', '<cite>', ''))}{words(1, 3)}</b></span></cite>{inside(prose(1, longer))}{rng.choice(('<a href=/r>reply</a>', '<button>ok</button>', ''))}</{item}>"
            if rng.random() < 0.25:  # texts alone
                one = lambda: inside(prose(1, longer))
            inner = f"<h3>{words(1, 3)}</h3>" * rng.randrange(2) + "".join(one() for _ in range(rng.randrange(1, 5))) + rng.choice(("", f"<form><textarea>x</textarea><label>{words(1, 2)}</label><button>go</button></form>"))
            return f"<{(t := rng.choice(('div', 'section', 'aside', 'div')))}{attributes(kind, 0)}>{inner}</{t}>"
        if kind == "form":
            inner = f"<label>{words(1, 3)}</label><input><select><option>{words(1, 2)}<option>{words(1, 2)}</select><datalist><option>{words(1, 2)}</datalist><textarea>{words(1, 3)}</textarea><p>{words(2, 6)}</p><button>{words(1, 2)}</button>"
            return f"<{(t := rng.choice(('form', 'form', 'fieldset')))} data-label='0'>{inner}</{t}>"
        if kind == "bare":
            return rng.choice((f"<button data-label='0'>{words(1, 3)}</button>", f"<select data-label='0'><option>{words(1, 2)}</select>", f"<noscript data-label='0'>{prose(1, 2)}</noscript>", f"<template data-label='0'><p>{prose(1, 2)}</p></template>", f"<svg data-label='0'><text>{words(1, 3)}</text></svg>"))
        tag = {"nav": ("nav", "div", "ul", "menu"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "notice": ("div", "dialog", "section"), "share": ("div", "ul")}.get(kind, ("div", "section", "aside"))
        role = f" role='{r}'" if rng.random() < 0.2 and (r := {"nav": "navigation", "header": "banner", "footer": "contentinfo", "aside": "complementary", "notice": "alert"}.get(kind)) else ""
        inner = {"nav": lambda: links(rng.randrange(3, 9)), "share": lambda: links(rng.randrange(2, 5)), "header": lambda: f"<a href='/'>{words(1, 3)}</a> {words(1, 4)}", "footer": lambda: links(rng.randrange(2, 6)) + f"<p>{words(3, 9)}</p>", "aside": lambda: f"<h3>{words(1, 4)}</h3>" + links(rng.randrange(2, 6)) + rng.choice(("", f"<p>{prose(1, 2)}</p>"))}.get(kind, lambda: rng.choice(("", "<p>", "<div>")) + prose(1, 3) + f" <a href='/y'>{words(1, 3)}</a>" * rng.randrange(2) + rng.choice(("", "</p>", f"<button>{words(1, 2)}</button>")))()
        return f"<{(t := rng.choice(tag))}{attributes(kind, 0)}{role}>{inner}</{t}>"

    kinds = ["nav", "header", "footer", "aside", "advert", "notice", "share", "comments", "form", "bare", "comments"]

    def listed() -> str:
        """A list of an article: of words, sentences, links in text, or lists."""
        kind = rng.choice(("words", "prose", "links", "links", "nested"))
        one = {"words": lambda: words(1, 9), "prose": lambda: prose(1, 3), "links": lambda: f"{words(*around)} <a href='/w'>{words(1, 4)}</a> {words(*around)}", "nested": lambda: f"{words(1, 5)}<ul><li>{words(1, 6)}<li>{words(1, 6)}</ul>"}[kind]
        around = rng.choice(((0, 5), (0, 5), (0, 1)))
        tag = rng.choice(("ul", "ul", "ol"))
        return f"<{tag}{rng.choice(('', '', attributes('plain', 1)))}>" + "".join(f"<li>{one()}{rng.choice(('', '</li>'))}" for _ in range(rng.randrange(2, 7))) + f"</{tag}>"

    def block() -> str:
        return rng.choice((
            lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}", lambda: f"<p>{prose(1, 3)} <a href='/z'>{words(1, 4)}</a> <b>{words(1, 4)}</b> {prose(1, 3)}</p>",
            lambda: f"<h2>{words(1, 6)}</h2>", lambda: listed(), lambda: listed(), lambda: f"<blockquote>{prose(1, 3)}</blockquote>",
            lambda: f"<table><tr><th>{words(1, 3)}<td>{words(1, 3)}</table>", lambda: f"<pre>{words(3, 20)}</pre>", lambda: f"<figure><img><figcaption>{words(2, 9)}</figcaption></figure>",
            lambda: f"<p>{words(2, 5)} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {words(1, 4)}.</p>", lambda: prose(), lambda: f"<dl><dt>{words(1, 3)}<dd>{prose(1, 2)}</dl>", lambda: f"<header><h1>{words(2, 8)}</h1><p>{words(1, 4)}</p></header>",
        ))()

    def body(depth: int) -> str:
        out = [f"<h1>{words(2, 9)}</h1>"] if depth == 0 else [f"<h3>{words(1, 5)}</h3>"] * rng.randrange(2)
        for _ in range(rng.randrange(2, 7)):
            chance = rng.random()
            if chance < 0.2 and depth < 3:
                out.append(f"<{(t := rng.choice(('div', 'section', 'div')))}{attributes('content', 1)}>{body(depth + 1)}</{t}>")
            elif chance < 0.3:
                out.append(beside(rng.choice(kinds[2:])))
            else:
                out.append(block())
        return "".join(out)

    text = body(0) if rng.random() < 0.75 else f"<h1>{words(1, 9)}</h1>" * rng.randrange(2) + "".join(block() for _ in range(rng.randrange(1, 4)))
    for _ in range(rng.choice((0, 0, 1, 2, 5))):
        text = f"<div{rng.choice(('', '', attributes('plain', 1)))}>{text}</div>"
    tag = rng.choice(("article", "article", "main", "div", "section", "article", "div role='main'"))
    page = f"<{tag}{attributes('content', 1) if rng.random() < 0.6 else ' data-label=1'}>{text}</{tag.split()[0]}>"
    for _ in range(rng.randrange(3)):
        page = f"<div{attributes('plain', 0)}>{''.join(beside(rng.choice(kinds)) for _ in range(rng.randrange(2)))}{page}{''.join(beside(rng.choice(kinds)) for _ in range(rng.randrange(3)))}</div>"
    before, after = ("".join(beside(rng.choice(kinds)) for _ in range(rng.randrange(1, 4))) for _ in range(2))
    return f"<html data-label='0'><head><title>t</title></head><body>{before}{page}{after}</body></html>"


def _edge(tag: str) -> int:
    """Kinds of edges: to a part of its parent's text, to a part of the page, to one that is silent or beside the rest by its
    tag, to one that marks content, to a list or its entries."""
    return 4 if tag in LISTS else 3 if tag in CONTENT else 2 if tag in SILENT or tag in BESIDE or tag in RAW else int(tag in PARTS)


def counts_of(source: str) -> Counter:
    """(kind, key, state) counts of a labelled page."""
    page = Page(source)
    state = page.labels()
    out: Counter = Counter()
    if state[0] < 0:
        return out
    made = 1 in page.given
    for i, seen in enumerate(page.features()):
        out["node", 0, state[i]] += 1
        # What a given page shows is counted apart: weighed() takes it where such pages show it in both states.
        for f in seen:
            out["feature" if made else "seen", f, state[i]] += 1
        if i:
            out["edge", 2 * _edge(page.tags[i]) + state[page.parents[i]], state[i]] += 1
    return out


class Model:
    """Log likelihood ratios of features, and edge and root potentials."""

    def __init__(self, counts: Counter) -> None:
        nodes = [counts["node", 0, s] + 1.0 for s in (0, 1)]
        self.ratio = np.zeros(BUCKETS)
        for f in range(BUCKETS):
            c = [(counts["feature", f, s] + SMOOTH) / (nodes[s] + 1.0) for s in (0, 1)]
            if counts["feature", f, 0] or counts["feature", f, 1]:
                self.ratio[f] = min(CLIP, max(-CLIP, math.log(c[1] / c[0])))
        self.ratio = self.ratio.tolist()
        edges = [[counts["edge", p, s] + SMOOTH for s in (0, 1)] for p in range(10)]
        chance = [[e / sum(row) for e in row] for row in edges]
        self.edge = [(*chance[k], *chance[k + 1]) for k in range(0, 10, 2)]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each element by sum-product: an upward and a downward pass over the tree."""
        n, parents, ratio = len(page.tags), page.parents, self.ratio
        edge = [self.edge[_edge(t)] for t in page.tags]
        up = [0.0] * n  # log odds of what an element and those below it show
        sent = [0.0] * n
        for i, seen in enumerate(page.features()):
            total = 0.0
            for f in seen:
                total += ratio[f]
            up[i] = total if page.tags[i] in PARTS else total * TEXT_WEIGHT
        for i in range(n - 1, 0, -1):
            odds = math.exp(min(60.0, max(-60.0, up[i])))
            e00, e01, e10, e11 = edge[i]
            sent[i] = math.log((e10 + e11 * odds) / (e00 + e01 * odds))
            up[parents[i]] += sent[i]
        full = [0.0] * n
        full[0] = up[0] + math.log(edge[0][1] / edge[0][0])
        for i in range(1, n):
            # What the parent believes without this child, passed through the edge.
            odds = math.exp(min(60.0, max(-60.0, full[parents[i]] - sent[i])))
            e00, e01, e10, e11 = edge[i]
            full[i] = up[i] + math.log((e01 + e11 * odds) / (e00 + e10 * odds))
        return [1 / (1 + math.exp(min(700.0, max(-700.0, -x)))) for x in full]

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        content = self.marginals(page)
        parts = []
        for node, text, starts in page.texts:
            if starts:
                parts.append(" ")
            if content[node] > 0.5:
                parts.append(text)
        return " ".join(entities.unescape("".join(parts)).split())


def train(pages: DataFrame, rows: int = LEARN_PAGES) -> Model:
    """Counts of the bounded sample, summed by key, and of the composed pages."""
    fit = pages.select("page_id", "html").where(F.length("html") <= LEARN_CHARS)
    chosen = bounded_sample(fit, "page_id", rows, "learn", pages.count()).select("html").repartition(16, F.xxhash64("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: Counter = Counter()
            for x in b.html:
                total += counts_of(x)
            yield pd.DataFrame([(*k, v) for k, v in total.items()], columns=["kind", "key", "state", "count"])

    found = chosen.mapInPandas(run, "kind string, key long, state int, count long").groupBy("kind", "key", "state").agg(F.sum("count").alias("count"))
    return Model(weighed(Counter({(r.kind, r.key, r.state): r["count"] for r in found.toLocalIterator()})))


def weighed(sample: Counter, seed: int = 1) -> Counter:
    """The sample's counts scaled to weigh as much as the composed pages, together with theirs.

    That the sample never shows a tag, say, in its articles (or never beside them) says nothing about other pages: what it
    shows in one state alone is judged by the composed pages.
    """
    made: Counter = Counter()
    rng = random.Random(seed)
    for _ in range(COMPOSED):
        made += counts_of(composed(rng))
    size = lambda c: c["node", 0, 0] + c["node", 0, 1]
    if not size(sample):
        return made
    scale = size(made) / size(sample)
    shown = {key for (kind, key, state) in sample if kind == "seen" and sample[kind, key, 1 - state]}
    wider = [1 + sample["node", 0, s] * scale / max(1, made["node", 0, s]) for s in (0, 1)]
    for kind, key, state in list(made):
        if kind == "feature" and key not in shown:  # as frequent as before among more elements
            made[kind, key, state] *= wider[state]
    for (kind, key, state), v in sample.items():
        if kind != "seen":
            made[kind, key, state] += v * scale
        elif key in shown:
            made["feature", key, state] += v * scale
    return made


def with_text(pages: DataFrame, model: Model) -> DataFrame:
    """pages with a column text: the main text of html."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extracted(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for s in sources:
            yield pd.Series([m.text(x) for x in s], dtype="object")

    return pages.withColumn("text", extracted("html"))
