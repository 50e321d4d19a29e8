"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree with a binary label each (content or not). A node's
own potential is log-linear in its tag, hints in class, id and role, the form of its text, its share of the page's text and
whether the page names an article at all; a potential
of each parent-child pair couples their labels, apart for children with hints of their own and those without.
Sum-product messages, upward and then downward, give each node's exact content marginal; both passes run
level by level over all pages of a batch at once. Weights maximise the likelihood of labelled pages, whose
nodes carry data-gold="1" or "0" (inherited by what stands inside). `labelled_pages` makes such pages from
common page layouts by a rule; `train` accepts any others.

Blocks whose node is content are decoded, their white space is collapsed, and they are joined in page
order. Nothing is cut or capped. A page is handled within one row; there is no shuffle.

Defined cases: null and empty html give an empty text, as does a page all of whose blocks are judged no content; text outside any element belongs to the page's root;
unclosed, misnested and cut-off tags are read as browsers do in the common cases (a new paragraph ends the
last one, a new list item the last one, a tag cut off by the end of the page is dropped; a stray quote in a tag is
a plain character). Time is linear in a page's length, and in its number of elements whatever their depth.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names of the public HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript svg math iframe object textarea select title canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

GROUPS = ["article main", "p", "h1 h2 h3 h4 h5 h6", "div section", "ul ol menu dl", "li dt dd", "nav", "header", "footer", "aside", "form fieldset button", "table tr td th tbody thead", "blockquote pre", "figure figcaption", "html body", "head"]
_GROUP = {t: k for k, g in enumerate(GROUPS) for t in g.split()}
HINTS = [
    r"\b(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|adsense|adslot|ad[-_]\w+)\b",
    r"nav|menu|breadcrumb|\btabs?\b|toolbar|pagination|pager",
    r"foot|copyright|legal|colophon|contentinfo",
    r"side|widget|rail|complementary",
    r"comment|repl(?:y|ies)|disqus|discussion|responses",
    r"cookie|notice|consent|gdpr|alert|popup|modal|overlay|warning|disclaimer",
    r"share|social|related|recommend|newsletter|subscri|signup|login|search|tags\b|trending|popular",
    r"article|content|post(?!er)|entry|story|main|prose|body|text",
    r"header|masthead|topbar|branding|site[-_]?title",
]
_HINTS = [re.compile(h, re.I) for h in HINTS]
N_TAGS, N_HINTS, N_FORM = len(GROUPS) + 1, len(HINTS), 10
N_UNARY = N_TAGS + N_HINTS + N_FORM

# A tag ends at the first ">" outside a value; quotes that don't begin a value are plain characters.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>|<(?=[/a-zA-Z])[^>]*+\Z""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_GOLD = re.compile(r'data-gold="([01])"')


@lru_cache(50_000)
def _hints(attrs: str) -> int:
    told = " ".join(next(v for v in m.groups()[1:] + ("",) if v is not None) for m in _ATTR.finditer(attrs))
    return sum(1 << k for k, h in enumerate(_HINTS) if h.search(told)) if told else 0


class Page:
    """The block tree of a page: arrays by node in page order, and text blocks (node, text)."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.hints, self.gold = [-1], [N_TAGS - 1], [0], [0]
        self.linked = [0]
        self.blocks: list[tuple[int, str]] = []
        names, nodes, run, links, at = ["#root"], [0], [], 0, 0
        standing: Counter[str] = Counter()  # open elements by name

        def flush():
            nonlocal run
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    self.blocks.append((nodes[-1], text))
                run = []

        def close(k):
            nonlocal links
            flush()
            standing.subtract(names[k:])
            del names[k:], nodes[k:]
            links = 0

        def innermost(name):
            k = len(names) - 1
            while names[k] != name:
                k -= 1
            return k

        n = len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None or m.start() > at:
                piece = html[at : m.start() if m else n]
                run.append(piece)
                if links:
                    self.linked[nodes[-1]] += len(piece.strip())
            if m is None:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name == "a":
                    links = max(0, links - 1)
                elif name not in INLINE and standing[name]:
                    close(innermost(name))
                elif name == "p":
                    flush()
                continue
            if name in UNSEEN:
                if not m[3].endswith("/"):
                    end = _end_of(name).search(html, at)
                    at = end.end() if end else n
                run.append(" ")
                continue
            if name in INLINE:
                if name == "a":
                    links = 1
                elif name == "br":
                    run.append(" ")
                continue
            if name in CLOSES_P and standing["p"]:
                close(innermost("p"))
            elif name in SIBLINGS and any(standing[x] for x in SIBLINGS[name][0].split()):
                own, stops = SIBLINGS[name]
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in stops:
                        break
                    if names[k] in own.split():
                        close(k)
                        if name != "tr":
                            break
            flush()
            if name in VOID:
                continue
            gold = _GOLD.search(m[3]) if "data-gold" in m[3] else None
            self.parent.append(nodes[-1])
            self.tag.append(_GROUP.get(name, N_TAGS - 1))
            self.hints.append(_hints(m[3]) if "=" in m[3] else 0)
            self.gold.append(int(gold[1]) if gold else self.gold[nodes[-1]])
            self.linked.append(0)
            names.append(name)
            standing[name] += 1
            nodes.append(len(self.parent) - 1)
        flush()


@lru_cache(64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}[^>]*>?", re.I)


class Forest:
    """The trees of many pages as one, with features of all nodes."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = [len(p.parent) for p in pages]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        n = int(self.start[-1])
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, self.start, strict=False)]) if pages else np.zeros(0, int)
        self.depth = np.zeros(n, int)
        chars, ends, marks = np.zeros(n), np.zeros(n), np.zeros(n)
        for p, s in zip(pages, self.start, strict=False):
            depth = [0] * len(p.parent)
            for i, up in enumerate(p.parent):
                depth[i] = depth[up] + 1 if up >= 0 else 0
            self.depth[s : s + len(depth)] = depth
            for node, text in p.blocks:
                chars[s + node] += len(text)
                ends[s + node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
                marks[s + node] += "©" in text or "|" in text
        tag = np.array([t for p in pages for t in p.tag], int)
        hints = np.array([h for p in pages for h in p.hints], int)
        linked = np.array([x for p in pages for x in p.linked], float)
        self.gold = np.array([g for p in pages for g in p.gold], int)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 1)))[1:]
        below, below_linked = chars.copy(), linked.copy()
        for level in reversed(self.levels):
            np.add.at(below, self.parent[level], below[level])
            np.add.at(below_linked, self.parent[level], below_linked[level])
        x = np.zeros((n, N_UNARY))
        x[np.arange(n), tag] = 1
        x[:, N_TAGS : N_TAGS + N_HINTS] = hints[:, None] >> np.arange(N_HINTS) & 1
        density = np.minimum(1, below_linked / np.maximum(1, below))
        page = np.repeat(np.arange(len(pages)), np.diff(self.start))
        share = below / np.maximum(1, np.bincount(page, chars, len(pages)))[page] if n else below
        named = np.bincount(page, (tag == 0) | (hints >> 7 & 1 > 0), len(pages))[page] > 0 if n else below  # the page has an article of some name
        x[:, -N_FORM:] = np.c_[np.log1p(chars) / 4, np.log1p(below) / 6, density, density > 0.6, np.minimum(ends, 8) / 4, chars == 0, marks > 0, (chars > 0) & (chars < 25), share, ~named.astype(bool)]
        self.x = x
        self.kind = (hints & ~(1 << 7) > 0).astype(int) + (np.isin(tag, [0, 6, 7, 8, 9, 10])) * 2  # of the pair with the parent
        self.kind = np.minimum(self.kind, 2)

    def messages(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, ...]:
        """Upward beliefs, messages to parents, downward messages (all in logs)."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = self.x @ w
        to_parent, down = np.zeros((n, 2)), np.zeros((n, 2))
        for level in reversed(self.levels):
            to_parent[level] = np.logaddexp.reduce(pair[self.kind[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, self.parent[level], to_parent[level])
        for level in self.levels:
            p = self.parent[level]
            outside = up[p] - to_parent[level] + down[p]
            d = np.logaddexp.reduce(pair[self.kind[level]] + outside[:, :, None], axis=1)
            down[level] = d - d.max(1, keepdims=True)
        return up, to_parent, down

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> np.ndarray:
        up, _, down = self.messages(w, pair)
        b = up + down
        return 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -60, 60)))


def train(labelled: list[str], steps: int = 300, rate: float = 0.1, ridge: float = 5e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (unary, pairwise) that maximise the likelihood of pages with data-gold attributes."""
    f = Forest([Page(h) for h in labelled])
    w, pair = np.zeros(N_UNARY), np.zeros((3, 2, 2))
    child = np.flatnonzero(f.parent >= 0)
    up_to, kind = f.parent[child], f.kind[child]
    seen = np.zeros_like(pair)
    np.add.at(seen, (kind, f.gold[up_to], f.gold[child]), 1)
    m = [np.zeros(N_UNARY), np.zeros_like(pair)]
    v = [np.zeros(N_UNARY), np.zeros_like(pair)]
    scale = 1 / len(f.parent)
    for t in range(1, steps + 1):
        up, to_parent, down = f.messages(w, pair)
        b = up + down
        p1 = 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -60, 60)))
        joint = (up[up_to] - to_parent[child] + down[up_to])[:, :, None] + pair[kind] + up[child][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
        expected = np.zeros_like(pair)
        np.add.at(expected, kind, joint)
        for k, (value, g) in enumerate(((w, f.x.T @ (f.gold - p1) * scale - ridge * w), (pair, (seen - expected) * scale - ridge * pair))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            value += rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w, pair


def labelled_pages(n: int = 400, seed: int = 3) -> list[str]:
    """Labelled pages of common layouts: where the article stands, and what stands around and inside it."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    maybe = lambda p: rng.random() < p

    def words(a, b):
        return " ".join("".join(pick("ta", "re", "on", "mi", "sel", "dor", "an", "the", "ing", "ü", "é") for _ in range(rng.integers(1, 4))) for _ in range(rng.integers(a, b)))

    def sentence(a=5, b=18):
        return words(a, b).capitalize() + pick(".", ".", ".", "!", "?", ",")

    odd = 0.0

    def prose(a, b):
        if odd and maybe(odd):  # a text of marks, repeats or cells without sentences
            mark = pick("%%%", "!!", " |", "###")
            return " ".join(w + mark for w in words(a * 4, b * 12).split()) if maybe(0.5) else " ".join([words(1, 2)] * int(rng.integers(3, 40)))
        return " ".join(sentence() for _ in range(rng.integers(a, b)))

    def links(k, tag="li"):
        return "".join(f'<{tag}><a href="/{i}">{words(1, 3)}</a></{tag}>' for i in range(k))

    def off(tag, attrs, body):
        return f'<{tag} {attrs} data-gold="0">{body}</{tag}>'

    def advert():
        return off(pick("div", "div", "aside", "section", "p"), f'class="{pick("ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo box")}"', pick(sentence(), f"<p>{sentence()}</p>", f'<a href="/x">{words(2, 8)}</a>'))

    def notice():
        return off(pick("div", "section", "p", "aside"), f'class="{pick("notice", "cookie-notice", "consent", "alert", "disclaimer", "popup")}"', pick(sentence(), prose(1, 4), f"<p>{prose(1, 3)}</p><button>ok</button>"))

    def comments():
        one = lambda: f'<{(t := pick("div", "li", "article"))} class="comment"><p>{prose(1, 4)}</p></{t}>'
        return off(pick("div", "section", "ol"), pick('id="comments"', 'class="comments"', 'class="comment-list"', 'class="reader-comments"', 'id="disqus_thread"'), f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.integers(1, 6))))

    def nav():
        return off(pick("nav", "nav", "div"), pick("", 'class="menu"', 'id="nav"', 'role="navigation"') if maybe(0.5) else 'class="navbar"', f"<ul>{links(rng.integers(3, 9))}</ul>")

    def side():
        return off(pick("aside", "div", "section"), pick('class="sidebar"', 'id="side"', 'class="widget"'), f"<h4>{words(1, 4)}</h4>" + pick(f"<ul>{links(rng.integers(2, 7))}</ul>", f"<p>{prose(1, 3)}</p>"))

    def form():
        return off("form", pick("", 'class="newsletter"', 'id="search"'), f"<label>{words(1, 4)}</label><input type=text><p>{sentence()}</p><button>{words(1, 2)}</button>")

    def body():
        parts = [f"<h1>{words(3, 12)}</h1>"] if maybe(0.8) else []
        for _ in range(pick(1, 1, 2, 3, int(rng.integers(3, 12)), int(rng.integers(3, 12)))):
            kind = rng.random() * (0.66 if maybe(0.3) else 1)
            text = prose(1, 9)
            if kind < 0.66:
                parts.append(f"<p>{pick('', '<b>', '<em>')}{text}{pick('', '<br>')}" + pick("</p>", "</p>", ""))
            elif kind < 0.72:
                parts.append(f"<h{(k := rng.integers(2, 5))}>{words(2, 7)}</h{k}>")
            elif kind < 0.78:
                parts.append("<ul>" + "".join(f"<li>{prose(1, 3)}</li>" for _ in range(rng.integers(2, 5))) + "</ul>")
            elif kind < 0.83:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.87:
                parts.append(f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>")
            elif kind < 0.9:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                parts.append(f"<div>{text}</div>")
            else:
                parts.append(f"<p>{words(1, 4)}.</p>")
            if maybe(0.12):
                parts.append(pick(advert, notice, form, side)())
        if maybe(0.15):
            parts.append(off("div", 'class="related"', f"<ul>{links(4)}</ul>"))
        if maybe(0.15):
            parts.append(comments())
        if maybe(0.1):
            parts.append(off("footer", "", words(2, 6)))
        if maybe(0.1):
            parts.insert(0, off("header", "", words(2, 6)))
        return "".join(parts)

    def short():
        """A short article as blocks, as bare text, or as lines with breaks, at times with an advert between."""
        form, between = rng.random(), advert() if maybe(0.25) else ""
        if form < 0.4:
            return "".join(f"<p>{prose(1, 3) if maybe(0.7) else words(1, 14) + '.'}</p>" for _ in range(rng.integers(1, 3))) + between
        if form < 0.7:
            return f"{words(1, 10)}{between}{words(1, 10) if between else ''}"
        return "<br>".join(words(1, 6) for _ in range(rng.integers(1, 5))) + between

    def bare():
        """A page of little more than its article, which may stand in the body itself."""
        tag = pick("article", "main", "div", "section", "body", "body")
        inner = (f"<h1>{words(2, 9)}</h1>" if maybe(0.3) else "") + (short() if tag != "body" or maybe(0.6) else "".join(f"<p>{prose(1, 4)}</p>" for _ in range(rng.integers(1, 5))))
        around = [nav() if maybe(0.2) else "", footer() if maybe(0.4) else ""]
        if tag == "body":
            head = f'<head data-gold="0"><title>{words(2, 6)}</title></head>' if maybe(0.6) else ""
            return f'<html>{head}<body data-gold="1">{around[0]}{inner}{around[1]}</body></html>'
        whole = f'{around[0]}<{tag} data-gold="1">{inner}</{tag}>{around[1]}'
        return whole if maybe(0.3) else f'<html><body data-gold="0">{whole}</body></html>'

    def footer():
        tag, attrs = pick(("footer", ""), ("footer", 'class="footer"'), ("div", 'class="footer"'), ("div", 'id="footer"'), ("div", 'role="contentinfo"'), ("footer", 'role="contentinfo"'), ("div", 'class="site-footer"'))
        return off(tag, attrs, pick(f"&copy; {words(1, 3)} &middot; {prose(1, 4)}", f"(c) {rng.integers(1990, 2030)}", f"&copy; {words(1, 4)}", f"<p>&copy; {words(2, 6)}</p><ul>{links(3)}</ul>", f"<p>{prose(1, 3)}</p>"))

    pages = []
    for _ in range(n):
        odd = pick(0.0, 0.0, 0.0, 0.9)
        if maybe(0.4):
            odd = 0.0
            pages.append(bare())
            continue
        tag, attrs = pick(("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'id="main"'), ("div", 'class="entry-content"'), ("div", 'class="story"'), ("div", ""), ("section", 'class="article-body"'), ("td", ""))
        page = [f'<html><head data-gold="0"><title>{words(2, 6)}</title></head><body data-gold="0">']
        page += [nav()] if maybe(0.8) else []
        page += [off("header", pick("", 'class="site-header"', 'class="masthead"'), f"<p>{words(1, 5)}</p>" + nav())] if maybe(0.5) else []
        page += [pick(advert, notice)() for _ in range(rng.integers(0, 3))]
        page += [side()] if maybe(0.25) else []
        inner = f'<{tag} {attrs} data-gold="1">{body()}</{tag}>'
        page.append(pick(inner, inner, f"<div>{inner}</div>", f'<div class="wrapper">{inner}{side() if maybe(0.5) else ""}</div>'))
        page += [side()] if maybe(0.35) else []
        page += [comments()] if maybe(0.45) else []
        page += [form()] if maybe(0.3) else []
        page += [advert()] if maybe(0.3) else []
        page.append(footer())
        pages.append("".join(page) + "</body></html>")
    return pages


@lru_cache(1)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train(labelled_pages())


def main_texts(htmls: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    forest = Forest(pages)
    content = forest.marginals(*model) >= 0.5 if pages else []
    return [" ".join(t for k, t in p.blocks if content[s + k]) for p, s in zip(pages, forest.start.tolist(), strict=False)]


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text in a column in place of the html's."""
    model = model or default_model()
    kept = [c for c in pages.columns if c not in (html, into)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                b = batch.slice(low, 128)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(main_texts(b.column(b.num_columns - 1).to_pylist(), model), pa.string())], names=[*kept, into])

    source = pages.select(*[pages[f"`{c}`"] for c in kept], pages[html])
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(into, T.StringType())]))
