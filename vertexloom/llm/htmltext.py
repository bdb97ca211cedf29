"""Main text of web pages by the maximum-scoring subsequence.

A page is read once into runs of words and tags. Words score by where they stand: in a paragraph, a
link or a list, in an article, below tags or class names that sites give to menus, adverts, forms or
comments. All of these are features with weights, fitted by logistic regression on the labelled pages
that labelled_pages() makes; no word of a list decides alone. Tags are negative. An element of the
page whose words sum up below zero is cut out and counts as its tags. Of what is left, one linear
scan finds the contiguous region with the highest sum: the article.

A class name says little of an element that holds nearly all of the page, or most of it and a
headline or an article: such an element is a wrapper, whatever it is called.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, texts, tuned

# Fixed values of the HTML standard, and the words that sites use in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
UNSEEN = frozenset("script style noscript template textarea title head iframe noembed noframes svg math object canvas audio video select option datalist xmp plaintext".split())
NOISE = frozenset("nav footer aside form dialog menu fieldset header button".split())
#: Those of NOISE that are never a wrapper.
FIXED = frozenset("nav footer aside menu button".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menus submenu sidebar sidebars sidenav footer foot header masthead topbar ad ads advert adverts advertisement advertising adsense "
    "sponsor sponsored promo promotion promos banner cookie cookies consent gdpr notice notices alert comment comments commentlist reply replies disqus respond discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget widgets popup "
    "modal overlay toolbar copyright legal disclaimer skip hidden".split()
)
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)/?>", re.S)
_MARKS = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: The share of the page's words from which a marked element is a wrapper: alone, and with a headline or an article in it.
WRAPS, WRAPS_ARTICLE = 0.8, 0.5


@functools.lru_cache(maxsize=4096)
def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """(noise, main, unseen): what class, id, role and visibility say; a name that says both says nothing."""
    noise = main = unseen = False
    for m in _MARKS.finditer(attributes):
        key, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if key in ("class", "id"):
            parts = {p.lower() for p in _PART.findall(html.unescape(value))}
            noise |= bool(parts & NOISE_WORDS)
            main |= bool(parts & MAIN_WORDS)
        elif key == "role":
            noise |= value.lower() in NOISE_ROLES
            main |= value.lower() in ("main", "article")
        elif key == "style":
            unseen |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            unseen |= key == "hidden" or value.lower() == "true"
    return noise and not main, main and not noise, unseen


def _tag_kind(name: str, close: str) -> str:
    if name in INLINE:
        return "a" if name == "a" else "inline"
    if name in ("p", "br", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption"):
        return "prose"
    if name in ("ul", "ol", "li", "dl", "dt", "dd"):
        return "list"
    return ("/" if close else "") + ("main" if name in MAIN else "noise" if name in NOISE or name in UNSEEN else "box")


@dataclass
class Element:
    name: str
    parent: int
    marks: tuple[bool, bool, bool] = (False, False, False)
    words: int = 0  # of all that it holds
    article: bool = False  # it holds a headline or an article


#: Features of words, as bits: where the weights find them.
IN_TAG, IN_CLASS, IN_MAIN, IN_LINK, IN_PROSE, IN_LIST, IN_UNSEEN = (1 << i for i in range(7))
FEATURES = 6
FEATURES_MASK = (1 << FEATURES) - 1


@dataclass
class Page:
    tokens: list[tuple[str | None, str | None, int, int]]  # kind of a tag (None: words), text ("\n": the edge of a block), element, place in the page
    elements: list[Element]

    def words(self) -> list[int]:
        """Words of each token; tags have none."""
        return [0 if kind else len(text.split()) for kind, text, _, _ in self.tokens]

    def features(self) -> list[int]:
        """Of each element, as bits: what holds for the words in it."""
        counts = self.words()
        for (_, _, e, _), n in zip(self.tokens, counts):
            self.elements[e].words += n
        for i in range(len(self.elements) - 1, 0, -1):
            x, up = self.elements[i], self.elements[self.elements[i].parent]
            if not (x.name in UNSEEN or x.marks[2]):
                up.words += x.words
                up.article |= x.article or x.name in MAIN or x.name == "h1" or x.marks[1]
        total, out = max(1, self.elements[0].words), [0]
        for x in self.elements[1:]:
            bits = out[x.parent]
            wraps = x.name in ("html", "body") or x.words >= (WRAPS_ARTICLE if x.article else WRAPS) * total
            if x.name in NOISE and not (x.name == "header" and bits & IN_MAIN) and (x.name in FIXED or not wraps):
                bits |= IN_TAG
            if x.marks[0] and x.name not in MAIN and not wraps:
                bits |= IN_CLASS
            if x.name in MAIN or (x.marks[1] and x.name not in ("html", "body")):
                bits |= IN_MAIN
            if x.name in UNSEEN or x.marks[2]:
                bits |= IN_UNSEEN
            if x.name == "a":
                bits |= IN_LINK
            elif x.name in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption"):
                bits |= IN_PROSE
            elif x.name in ("li", "dt", "dd"):
                bits |= IN_LIST
            out.append(bits)
        return out


def read(page: str) -> Page:
    """All runs of words and tags in order, and the elements that they stand in."""
    out = Page([], [Element("", 0)])
    stack: list[tuple[str, int]] = []  # name, element
    at, n = 0, len(page)

    def words(raw: str, start: int) -> None:
        if raw:
            out.tokens.append((None, html.unescape(raw) if "&" in raw else raw, stack[-1][1] if stack else 0, start))

    def pop_to(i: int) -> None:
        del stack[i:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            words(page[at:], at)
            break
        words(page[at : m.start()], at)
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                words(html.escape(m[0][9:].removesuffix("]]>")), m.start())
            continue
        name, close = m[2].lower(), m[1]
        block = name not in INLINE
        out.tokens.append((_tag_kind(name, close), "\n" if block else None, stack[-1][1] if stack else 0, m.start()))
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
                if not block and stack[i][0] not in INLINE:
                    break
            continue
        if name in VOID:
            continue
        if block:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in CLOSES:
            same, within = CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in within:
                    break
                if stack[i][0] in same:
                    pop_to(i)
                    if name != "tr":
                        break
        if name == "body" and any(x[0] == "head" for x in stack):
            pop_to(next(i for i, x in enumerate(stack) if x[0] == "head"))
        out.elements.append(Element(name, stack[-1][1] if stack else 0, _marks(m[3]) if m[3] else (False, False, False)))
        stack.append((name, len(out.elements) - 1))
        if name in RAW and not m[0].endswith("/>"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
    return out


# ---------------------------------------------------------------- weights

def labelled_pages() -> list[list[tuple[bool, str]]]:
    """Pages as parts (is content, html): the layouts that sites use, in every combination, with content from a few words to long."""
    prose = "the quiet river ran past an old mill where three of us had once hidden from the rain and told each other stories until it was dark".split()
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in prose[:8])
    menus = [f"<nav><ul>{links}</ul></nav>", f'<div class="menu"><ul>{links}</ul></div>', f"<ul>{links}</ul>", f"<header><h2>Our site</h2><ul>{links}</ul></header>"]
    adverts = ['<div class="ad">Buy two and get one free today only.</div>', "<aside><h3>Popular</h3><p>Ten things that you did not know.</p></aside>", "<div><a href='/x'>Sponsored: great offers here</a></div>"]
    ends = ["<footer>&copy; Some Site. All rights reserved.</footer>", "<div><p>Copyright Some Site</p><ul>" + links + "</ul></div>", '<div id="comments"><h3>2 comments</h3><p>I like this very much.</p><p>So do I, thank you.</p></div>']
    boxes = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>")]
    wraps = [("", ""), ('<div class="site has-sidebar">', "</div>"), ("<form>", "</form>"), ('<div class="wrap"><div class="row">', "</div></div>")]
    out = []
    for i in range(len(menus) * len(adverts) * len(ends) * len(boxes)):
        menu, i = menus[i % len(menus)], i // len(menus)
        advert, i = adverts[i % len(adverts)], i // len(adverts)
        end, i = ends[i % len(ends)], i // len(ends)
        open_box, close_box = boxes[i]
        n = len(out)
        open_wrap, close_wrap = wraps[n % len(wraps)]
        paragraphs = [" ".join((prose * 4)[: 6 + (7 * n + 31 * k) % 90]) for k in range(1 + n % 6)]
        content = "<h1>" + " ".join(prose[: 3 + n % 6]) + "</h1>" + "".join(f"<p>{p[:60]}<b>{p[60:70]}</b>{p[70:]}</p>" for p in paragraphs)
        if n % 2:
            content += '<p>It was <a href="/mill">the old mill</a> that we had seen first, long before the rain.</p>'
        if n % 3 == 0:
            content += "<ul><li>The first of them went home.</li><li>The others stayed for the night.</li></ul><h2>Later on</h2><p>Nobody came.</p>"
        if n % 5 == 0:
            content += "Some of it stands in no paragraph, as the first pages had it.<br>They were short."
        parts = [(False, f"<html><head><title>x</title></head><body>{open_wrap}{menu}{advert}{open_box}"), (True, content), (False, f"{close_box}{end}{close_wrap}</body></html>")]
        if n % 4 == 1:  # an advert within the article
            parts[2:2] = [(False, '<div class="ad-box">Get it while it lasts, only here.</div>'), (True, "<p>After that the night was quiet again.</p>")]
        out.append(parts)
    return out


@functools.cache
def weights() -> tuple[tuple[float, ...], dict[str, float]]:
    """(the score of a word for each set of features, the score of each kind of tag).

    A word's score is the log odds of content that logistic regression gives its features, a tag's the log of how much
    more often it stands in content than outside, no more than a small negative value. Each page counts the same.
    """
    rows, labels, shares = [], [], []
    inside, outside = Counter(), Counter()
    for parts in labelled_pages():
        page = read("".join(p for _, p in parts))
        edges, at = [], 0
        for content, part in parts:
            edges += [content] * len(part)
        bits, counts = page.features(), page.words()
        total = sum(counts)
        for (kind, _, e, at), n in zip(page.tokens, counts):
            if kind:
                (inside if edges[at] else outside)[kind] += 1 / len(page.tokens)
            elif n and not bits[e] & IN_UNSEEN:
                rows.append([1.0, *(float(bits[e] >> i & 1) for i in range(FEATURES))])
                labels.append(edges[at])
                shares.append(n / total)
    x, y, share = np.array(rows), np.array(labels, float), np.array(shares)
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0, *[0.05] * FEATURES])
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (share * (y - p)) - ridge @ w)
    words = tuple(float(w[0] + sum(w[1 + i] for i in range(FEATURES) if bits >> i & 1)) for bits in range(1 << FEATURES))
    total_in, total_out = sum(inside.values()), sum(outside.values())
    odds = {k: math.log((inside[k] + 0.5) / (total_in + 1)) - math.log((outside[k] + 0.5) / (total_out + 1)) for k in {*inside, *outside}}
    return words, {k: min(-0.02, v) for k, v in odds.items()}


def best_region(scores) -> tuple[int, int]:
    """The first of the shortest spans with the highest sum; empty if no sum is above zero."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str, score: tuple | None = None) -> str:
    """The article: blocks joined by one space, white space within a block turned into one space."""
    of_words, of_tags = score or weights()
    read_page = read(page)
    tokens, elements = read_page.tokens, read_page.elements
    bits, counts = read_page.features(), read_page.words()
    values = [of_tags.get(kind, -0.02) if kind else 0.0 if bits[e] & IN_UNSEEN else n * of_words[bits[e] & FEATURES_MASK] for (kind, _, e, _), n in zip(tokens, counts)]
    # an element whose words sum up below zero is cut; what holds it counts it as nothing
    sums = [0.0] * len(elements)
    for (kind, _, e, _), v in zip(tokens, values):
        if not kind:
            sums[e] += v
    cut = [False] * len(elements)
    for i in range(len(elements) - 1, 0, -1):
        cut[i] = bool(bits[i] & IN_UNSEEN) or (sums[i] < 0 and elements[i].name not in INLINE)
        if not cut[i]:
            sums[elements[i].parent] += sums[i]
    for i in range(1, len(elements)):
        cut[i] |= cut[elements[i].parent]
    values = [0.0 if not kind and cut[e] else v for (kind, _, e, _), v in zip(tokens, values)]
    start, end = best_region(values)
    return " ".join("".join(t for kind, t, e, _ in tokens[start:end] if t is not None and (kind or not cut[e])).split())


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches, score):
    for b in batches:
        found = [main_text(t, score) for t in texts(b.column(2))]
        yield batch(_OUT, b.column(0), b.column(1), found, [len(t) for t in found])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null or empty html, and pages without content, give the empty text; repeated rows each give a
    row; an empty table gives an empty result. Other columns are ignored.
    """
    tuned(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    return rows.mapInArrow(functools.partial(_extract, score=weights()), "page_id long, url string, text string, n_chars long")
