"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element is a node with features of its subtree (text, link and
punctuation density), its attribute tokens and those of its ancestors, depth,
place in the page, and its siblings. Trees give each node log-odds of holding
the article. Decoding is hierarchical: over each page's tree the best set of
nodes is chosen in which no kept node has a dropped ancestor.

The trees are fitted on ``PAGES`` laid-out pages whose parts are known by
construction; layouts, wrappers, attribute names and text lengths vary.
"""

from __future__ import annotations

import random
import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import boosting
from tidemark.llm.common import rows_per_batch, slices

PAGES = 800

#: A tag up to its end, or else up to its first quote.
_HEAD = re.compile(r"""<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s>/]*+)([^>"']*+)(>)?)""")
_MARK = re.compile(r"""["'>]""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|style|hidden|data-y)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element groups of HTML.
GROUPS = (
    "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "table thead tbody tfoot tr td th caption", "div", "section", "article main", "nav", "aside",
    "header hgroup", "footer address", "form fieldset", "blockquote pre figure figcaption", "html body", "hr details summary dialog center legend search",
)
BLOCKS = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select button head".split())
#: Without an end tag, these last to the end of the page; of the others only the tag goes.
TO_END = frozenset("script style textarea title".split())
_CLOSE = {name: re.compile(rf"</{name}(?![^\s/>])[^>]*>?", re.IGNORECASE) for name in RAW}
#: Of the raw elements, those that may hold their own kind.
NESTED = frozenset("template object svg math canvas audio video".split())
_BOTH = {name: re.compile(rf"<(/?){name}(?![^\s/>])([^>]*)>?", re.IGNORECASE) for name in NESTED}
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: A paragraph ends before a block, unless one of these stands between; a list item or cell ends at its like inside the same list or table.
HOLDS = ("td", "th", "li", "div", "section")
LISTS = ("ul", "ol", "dl", "table", "menu")
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

# Words of class, id and role attributes by what they usually mark.
WORDS = (
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc topbar toolbar tabs skip",
    "header masthead logo branding site hero head",
    "footer foot copyright legal colophon contentinfo",
    "sidebar aside widget related recommended recommend popular rail trending more side complementary links teaser",
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense doubleclick partner outbrain taboola commercial",
    "cookie cookies consent notice gdpr alert popup modal overlay warning disclaimer message announcement paywall toast",
    "form search login signin signup subscribe subscription newsletter register contact input",
    "comment comments reply replies respond disqus discussion thread feedback reviews commentlist",
    "share sharing social follow tools print tweet facebook",
    "meta byline tags tag author date timestamp category categories bio",
    "article post entry story body text main content page blog news read copy prose paragraph",
)
GROUP_OF = {w: i for i, g in enumerate(WORDS) for w in g.split()}
N_WORDS, N_TAGS = len(WORDS), len(GROUPS)


def _tag_end(html: str, at: int, lost: set[int]) -> int:
    """The place of the ``>`` that ends a tag, past closed quotes; where quotes stay open, that of the next ``>``.

    ``lost`` holds the opening quotes found to lead to no end; none is followed twice, so all tags of a page together take linear time.
    """
    followed = []
    i = at
    while m := _MARK.search(html, i):
        if m[0] == ">":
            return m.start()
        followed.append(m.start())
        if m.start() in lost or (i := html.find(m[0], m.end()) + 1) == 0:
            break
    lost.update(followed)
    return html.find(">", at)


def _nested_ends(html: str, name: str) -> dict[int, int]:
    """Where each element of this name ends, by where it starts; elements without an end tag of their own are left out."""
    ends: dict[int, int] = {}
    waiting: list[int] = []
    for m in _BOTH[name].finditer(html):
        if not m[1]:
            if not m[2].endswith("/"):
                waiting.append(m.start())
        elif waiting:
            ends[waiting.pop()] = m.end()
    return ends


class Page:
    """Block nodes in document order, with the runs of text that stand directly in each.

    Time and memory are linear in the html, whatever its markup.
    """

    __slots__ = ("parent", "tag", "words", "end", "label", "runs", "links", "hidden")

    def __init__(self, html: str):
        self.parent, self.tag, self.words, self.end, self.label, self.hidden = [-1], [14], [0], [0], [1], [0]
        self.runs: list[tuple[int, str]] = []  # node, text
        self.links: list[int] = []  # characters of each run inside links
        stack, names = [0], ["html"]
        places: dict[str, list[int]] = {t: [] for t in BLOCKS}  # where each name stands in the stack, the root aside
        text: list[str] = []
        linked = link_chars = 0
        at, last = 0, html.rfind(">")
        never_closed: set[str] = set()
        nested: dict[str, dict[int, int]] = {}
        lost: set[int] = set()

        def flush():
            nonlocal link_chars
            if text:
                s = "".join(text)
                s = " ".join((unescape(s) if "&" in s else s).split())
                if s:
                    self.runs.append((stack[-1], s))
                    self.links.append(min(link_chars, len(s)))
                text.clear()
            link_chars = 0

        def pop(to: int):
            nonlocal linked
            while len(stack) > to:
                self.end[stack.pop()] = len(self.parent)
                name = names.pop()
                if stack:
                    places[name].pop()
            linked = 0

        def top(of) -> int:
            return max((places[n][-1] for n in of if places[n]), default=0)

        while at < len(html):
            m = _HEAD.search(html, at, last + 1) if at <= last else None
            if m is None:  # no tag can end any more; a comment can still begin
                tail = html.find("<!--", at)
                text.append(html[at:] if tail < 0 else html[at:tail])
                break
            if m.start() > at:
                piece = html[at : m.start()]
                text.append(piece)
                if linked:
                    link_chars += len(piece)
            if m[1]:
                at = html.find("-->", m.end()) + 3
                if at < 3:
                    break
                continue
            if not m[3] or m[2]:
                at = m.end() if m[5] else html.find(">", m.end()) + 1
                if not m[3]:
                    continue
                name = m[3].lower()
                if name == "a":
                    linked = 0
                elif name in BLOCKS:
                    flush()
                    if places[name]:
                        pop(places[name][-1])
                continue
            name, attributes, at = m[3].lower(), m[4], m.end()
            if not m[5]:
                end = _tag_end(html, at, lost)
                attributes, at = html[m.start(4) : end], end + 1
            if name in RAW:
                if not attributes.endswith("/") and name not in never_closed:
                    if name in NESTED and name not in nested:
                        nested[name] = _nested_ends(html, name)
                    if name in NESTED and m.start() in nested[name]:
                        at = max(at, nested[name][m.start()])
                    elif close := _CLOSE[name].search(html, at):
                        at = close.end()
                    elif name in TO_END:
                        break
                    else:
                        never_closed.add(name)
                continue
            if name not in BLOCKS:
                if name == "br":
                    text.append(" ")
                elif name == "a":
                    linked = 1
                continue
            flush()
            if name in ("html", "body") and len(stack) == 1:
                self._read(0, attributes)
                continue
            if name == "hr":
                continue
            if places["p"] and top(HOLDS) < places["p"][-1]:
                pop(places["p"][-1])
            if name in CLOSES and (like := top(CLOSES[name].split())) > top(LISTS):
                pop(like)
            i = len(self.parent)
            self.parent.append(stack[-1])
            self.tag.append(BLOCKS[name])
            self.words.append(0)
            self.end.append(0)
            self.label.append(self.label[stack[-1]])
            self.hidden.append(self.hidden[stack[-1]])
            if attributes:
                self._read(i, attributes)
            places[name].append(len(stack))
            stack.append(i)
            names.append(name)
            linked = 0
        flush()
        pop(0)

    def _read(self, i: int, attributes: str) -> None:
        for key, *value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value[0] or value[1] or value[2]
            if key == "data-y":
                self.label[i] = 0
            elif key == "hidden" or key == "style":
                if key == "hidden" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    self.hidden[i] = 1
            else:
                for w in _TOKEN.findall(value):
                    g = GROUP_OF.get(w.lower())
                    if g is not None:
                        self.words[i] |= 1 << g


def features(pages: list[Page]) -> np.ndarray:
    """The features of all nodes of all pages, in order."""
    counts = np.array([len(p.parent) for p in pages])
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    base = np.repeat(first, counts)
    flat = lambda name: np.fromiter((v for p in pages for v in getattr(p, name)), np.int64, n)
    parent, tag, own, end, hidden = (flat(k) for k in ("parent", "tag", "words", "end", "hidden"))
    top = parent < 0
    up = np.where(top, 0, parent) + base
    end = end + base
    at = np.fromiter((f + r[0] for f, p in zip(first.tolist(), pages) for r in p.runs), np.int64)
    runs = [r[1] for p in pages for r in p.runs]
    link = np.fromiter((k for p in pages for k in p.links), np.float64)
    chars = np.array([len(r) for r in runs], dtype=np.float64)
    marks = np.array([r.count(".") + r.count(",") for r in runs], dtype=np.float64)
    spaces = np.array([r.count(" ") + 1 for r in runs], dtype=np.float64)
    mine = [np.bincount(at, v, minlength=n) if len(at) else np.zeros(n) for v in (chars, link, marks, spaces, np.ones(len(chars)))]

    def below(v):
        s = np.concatenate([[0.0], np.cumsum(v)])
        return s[end] - s[np.arange(n)]

    text, links, points, words, parts = (below(v) for v in mine)
    depth, over, inside = np.zeros(n), own.copy(), (1 << tag).copy()
    for i in range(n):  # parents come before their children
        if not top[i]:
            j = up[i]
            depth[i] = depth[j] + 1
            over[i] |= over[j]
            inside[i] |= inside[j]
    total = np.repeat(text[first], counts) + 1
    before = (np.concatenate([[0.0], np.cumsum(mine[0])])[np.arange(n)] - np.repeat(np.concatenate([[0.0], np.cumsum(mine[0])])[first], counts)) / total
    nodes = below(np.ones(n))
    paragraphs = below((tag == 0) * 1.0)
    kin = np.bincount(up[~top], minlength=n).astype(np.float64)
    kin_text = np.bincount(up[~top], text[~top], minlength=n)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i in np.flatnonzero(~top).tolist():
        j = int(up[i])
        seen[j] = order[i] = seen.get(j, 0) + 1
    same = np.zeros(n)
    pair = up * N_TAGS + tag
    _, inverse, tallies = np.unique(pair, return_inverse=True, return_counts=True)
    same[:] = tallies[inverse]
    columns = [
        np.log1p(mine[0]), np.log1p(text), links / (text + 1), points / (text + 1), text / (parts + 1), words / (parts + 1), text / nodes, np.log1p(nodes), np.log1p(paragraphs),
        depth, before, text / total, np.where(top, 0, kin[up]), order / (np.where(top, 0, kin[up]) + 1), same, text / (np.where(top, 0, kin_text[up]) / np.maximum(1, np.where(top, 0, kin[up])) + 1), hidden.astype(float),
    ]
    columns += [(tag == k) * 1.0 for k in range(N_TAGS)]
    columns += [(own >> k & 1) * 1.0 for k in range(N_WORDS)]
    columns += [(over >> k & 1) * 1.0 for k in range(N_WORDS)]
    columns += [(inside >> k & 1) * 1.0 for k in (7, 8, 9, 10, 11, 12)]
    return np.stack(columns, 1)


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The kept nodes of greatest total log-odds (weighted by own text) with no dropped ancestor."""
    n = len(page.parent)
    own = [0] * n
    for i, s in page.runs:
        own[i] += len(s)
    total = [float(o) * (1 + np.log1p(c)) for o, c in zip(np.clip(odds, -6, 6), own)]
    for i in range(n - 1, 0, -1):
        if total[i] > 0:
            total[page.parent[i]] += total[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and total[i] > 0
    return keep


def main_text(page: Page, odds: np.ndarray) -> str:
    keep = decode(page, odds)
    return " ".join([s for i, s in page.runs if keep[i]])


def _made_page(rng: random.Random) -> str:
    """A page whose boilerplate elements carry data-y."""
    letters = "aeioutnrsldmhc"
    no = " data-y"

    def words(lo, hi):
        n = rng.randint(lo, hi)
        out = ["".join(rng.choices(letters, k=rng.randint(1, 10))) for _ in range(n)]
        for i in range(rng.randint(4, 16), n, rng.randint(6, 18)):
            out[i] += rng.choice([".", ",", "."])
        return (" ".join(out).capitalize() + rng.choice([".", ".", ".", ""])).replace("  ", " ")

    def named(*choices):
        c = rng.choice(choices)
        return rng.choice(["", f' class="{c}"', f' class="{c}"', f' class="{c}"', f' id="{c}"', f' class="{rng.choice(["block", "col-8", "x1", "wrap"])} {c}"'])

    def sure(*choices):
        c = rng.choice(choices)
        return rng.choice([f' class="{c}"', f' id="{c}"', f' class="{rng.choice(["block", "col-4", "x1", "box"])} {c}"'])

    def link(lo=1, hi=4):
        return f'<a href="/{rng.randint(1, 999)}">{words(lo, hi)}</a>'

    def listed(n, lo=1, hi=4):
        return "<ul>" + "".join(f"<li>{link(lo, hi)}</li>" for _ in range(n)) + "</ul>"

    def menu():
        return rng.choice([f"<nav{no}{named('nav', 'menu', 'main-nav')}>{listed(rng.randint(3, 12))}</nav>", f"<div{no}{sure('nav', 'menu', 'topbar', 'breadcrumbs', 'site-navigation')}>{listed(rng.randint(2, 12))}</div>", f"<ul{no}{sure('menu', 'nav', 'pagination')}>" + "".join(f"<li>{link()}</li>" for _ in range(5)) + "</ul>"])

    def advert():
        return f"<{(t := rng.choice(['div', 'div', 'section', 'aside']))}{no}{sure('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-banner', 'advertisement')}>{rng.choice([words(2, 50), f'<p>{words(4, 40)}</p>', link(3, 12), words(3, 12) + link()])}</{t}>"

    def notice():
        return f"<div{no}{sure('cookie-notice', 'notice', 'alert', 'consent', 'cookie-banner', 'gdpr', 'popup', 'modal')}>{rng.choice([words(5, 40), f'<p>{words(5, 40)}</p>'])}{rng.choice(['', '<button>ok</button>', link()])}</div>"

    def form():
        return rng.choice([f"<form{no}>{words(1, 8)}<input name=q><p>{words(2, 20)}</p><button>go</button></form>", f"<div{no}{sure('newsletter', 'subscribe', 'signup', 'search-form', 'login')}><h3>{words(2, 6)}</h3><p>{words(5, 25)}</p><form><label>{words(1, 3)}</label><input></form></div>"])

    def share():
        return f"<div{no}{sure('share', 'social', 'sharing-tools')}>{listed(rng.randint(2, 5), 1, 1)}</div>"

    def side():
        inner = "".join(rng.choice([lambda: f"<h3>{words(1, 4)}</h3>{listed(rng.randint(3, 8), 3, 9)}", lambda: f"<div class=widget><p>{words(4, 30)}</p></div>", lambda: f"<p>{words(5, 60)}</p>"])() for _ in range(rng.randint(1, 4)))
        return rng.choice([f"<aside{no}{named('sidebar', 'related', 'rail')}>{inner}</aside>", f"<div{no}{sure('sidebar', 'related-posts', 'widget-area', 'recommended', 'right-rail')}>{inner}</div>"])

    def comments():
        one = lambda: rng.choice([f"<div class=comment><p class=author>{words(1, 2)}</p><p>{words(3, 80)}</p></div>", f"<li class='comment'><b>{words(1, 2)}</b><p>{words(3, 60)}</p></li>", f"<p>{words(3, 60)}</p>", f"<div class='reply'>{words(3, 50)}</div>"])
        inner = rng.choice([f"<h3>{words(1, 3)}</h3>", ""]) + "".join(one() for _ in range(rng.randint(1, 8)))
        t = rng.choice(["div", "section", "ol", "div"])
        return f"<{t}{no}{sure('comments', 'comment-list', 'discussion', 'replies', 'disqus_thread', 'respond')}>{inner}</{t}>"

    def foot():
        inner = rng.choice([f"&copy; {words(2, 40)}", words(3, 60), f"<p>{words(3, 60)}</p>", listed(rng.randint(2, 10)) + words(2, 8), f"<div>{words(2, 20)}</div><p>{link()}</p>"])
        return rng.choice([f"<footer{no}>{inner}</footer>", f"<footer{no}>{inner}</footer>", f"<div{no}{sure('footer', 'site-footer', 'copyright')}>{inner}</div>"])

    def head():
        inner = rng.choice([f"<h1>{words(1, 4)}</h1>", f"<div class=logo>{link()}</div>", f"<p>{words(2, 10)}</p>", words(1, 5)]) + rng.choice(["", menu()])
        return rng.choice([f"<header{no}{named('header', 'site-header')}>{inner}</header>", f"<div{no}{sure('header', 'masthead', 'site-header', 'branding')}>{inner}</div>"])

    def paragraph():
        t = words(*rng.choice([(1, 8), (8, 40), (30, 120), (60, 200)]))
        return rng.choice([f"<p>{t}</p>"] * 8 + [f"<p><b>{t}<br>", f"<p>{t}", f"<p>{t[:40]}{link()} {t[40:]}</p>", f"<div>{t}</div>", f"<p class=lead>{t}</p>"])

    def body():
        out = [paragraph() for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8, 15]))]
        for _ in range(rng.randint(0, 2)):
            out.insert(rng.randint(0, len(out)), rng.choice([lambda: f"<h2>{words(2, 8)}</h2>", lambda: f"<ul>{''.join(f'<li>{words(2, 25)}</li>' for _ in range(rng.randint(2, 7)))}</ul>", lambda: f"<blockquote><p>{words(5, 50)}</p></blockquote>", lambda: f"<figure><img src=a><figcaption>{words(3, 15)}</figcaption></figure>", lambda: f"<pre>{words(5, 40)}</pre>", lambda: f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>"])())
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            out.insert(rng.randint(0, len(out)), rng.choice([advert, notice, form, share, side])())
        return "".join(out)

    title = rng.choice([f"<h1>{words(3, 14)}</h1>", f"<h1>{words(3, 14)}</h1>", f"<header><h1>{words(3, 14)}</h1></header>", f"<h2>{words(3, 14)}</h2>", ""])
    tail = "".join(f() for f in (share, side, comments, form) if rng.random() < 0.25)
    inner = title + body() + tail
    article = rng.choice([f"<article>{inner}</article>", f"<article{named('post', 'story', 'entry')}>{inner}</article>", f"<div{sure('article', 'post', 'entry-content', 'story-body', 'content', 'main-content', 'post-body')}>{inner}</div>", f"<main>{inner}</main>", f"<section{sure('article', 'story', 'content')}>{inner}</section>", f"<div>{inner}</div>"])
    if rng.random() < 0.5:
        article = f"<{(t := rng.choice(['div', 'main', 'section']))}{named('main', 'content', 'container', 'page', 'wrapper')}>{article}{rng.choice(['', side(), comments()])}</{t}>"
    before = "".join(f() for f in (head, menu, notice, advert, side, form) if rng.random() < 0.4)
    after = "".join(f() for f in (comments, side, advert, share, menu, foot, notice) if rng.random() < (0.75 if f is foot else 0.35))
    whole = before + article + after
    if rng.random() < 0.4:
        whole = f"<div{named('container', 'page', 'wrapper', 'site')}>{whole}</div>"
    return f"<html><head><title>{words(2, 6)}</title></head><body>{whole}</body></html>"


def train(pages: int = PAGES, seed: int = 11):
    rng = random.Random(seed)
    made = [Page(_made_page(rng)) for _ in range(pages)]
    y = np.array([v for p in made for v in p.label], dtype=np.float64)
    own = np.concatenate([np.bincount([i for i, _ in p.runs], [len(s) for _, s in p.runs], minlength=len(p.parent)) if p.runs else np.zeros(len(p.parent)) for p in made])
    tag = np.array([t for p in made for t in p.tag])
    rare = np.sqrt(len(tag) / np.bincount(tag, minlength=N_TAGS)[tag])  # seldom used elements count as much
    return boosting.fit(features(made), y, (0.5 + 0.25 * np.log1p(own)) * rare)


def extract(pages: DataFrame, model=None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html; other columns are ignored):
    page_id, url, text (empty if none) and n_chars.

    A null or empty html, or one without text, gives an empty text; html without
    any element is judged as one block. Broken markup is read leniently, pages
    of any length whole and in linear time: an element that is never closed loses
    its tag only (script, style, textarea and title last to the end, as browsers
    have it), nested drawings and the like end where the outer one does.
    Repeated rows and null ids are extracted like any other; an empty table
    gives an empty one.
    """
    rows_per_batch(pages.sparkSession)
    model = model or train()

    def run(batches):
        for whole in batches:
            for b in slices(whole, 2, 1 << 20):
                read = [Page(h) if h else None for h in b.column(2).to_pylist()]
                some = [p for p in read if p is not None]
                odds = boosting.predict(model, features(some)) if some else np.zeros(0)
                texts, at = [], 0
                for p in read:
                    if p is None:
                        texts.append("")
                    else:
                        texts.append(main_text(p, odds[at : at + len(p.parent)]))
                        at += len(p.parent)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return typed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
