"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each element of a page is a row of features: its place, the density of text and links in its
subtree, tokens of its class, id and role, and how it compares with its siblings and parent.
Boosted trees give the probability that the element holds main text. Decoding picks the likeliest
labelling of the whole tree in which no element is kept below one that is dropped. A formula or a
drawing is one element with all its text.

The trees are trained here, on pages made from a seeded generator of layouts whose labels are known
by construction; no row of any table is used for training.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, other declarations and end tags without a name, and tags. A value has quotes only right
#: behind its =; another one ends at white space or >.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)|[^=>]|=)*+)(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAMING = frozenset("class id role itemprop aria-label".split())
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Element names as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template".split())
#: Searched in the page itself: its lower case may be longer.
END_OF = {t: re.compile("</" + t, re.I | re.A) for t in (*RAW, "xmp")}
FOREIGN = frozenset("svg math".split())
#: Parts of formulas and drawings that may hold elements of HTML.
INTEGRATION = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: Parts of them that don't continue the word before.
APART = frozenset("text desc foreignobject annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul caption xmp".split())
GROUPS = ["p", "h1 h2 h3 h4 h5 h6 hgroup", "a", "ul ol dl menu", "li dd dt", "div", "section", "article main", "nav", "header", "footer", "aside dialog", "form fieldset input button select option label legend textarea", "table tbody thead tr td th", "blockquote pre figure figcaption", "html body"]
GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main nav aside header footer form blockquote td th body object".split()) | INTEGRATION
#: The end of a start tag whose last slash belongs to a value without quotes.
UNQUOTED = re.compile(r"""=\s*[^\s"'>]+\Z""")

# Tokens that authors give to the parts of a page.
TOKENS = {
    "main": "article main content post entry body story text hentry maincontent articlebody",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pager pagination toc skip",
    "head": "header masthead logo brand sitehead hero",
    "foot": "footer copyright colophon legal bottom credits",
    "side": "sidebar aside side rail widget widgets related recommended popular trending more tags archive",
    "ad": "ad ads advert advertisement adsense adslot banner sponsor sponsored promo promotion promoted outbrain taboola dfp",
    "note": "cookie cookies consent notice gdpr alert popup modal overlay paywall disclaimer announcement banner notification toast",
    "talk": "comment comments commentlist reply replies disqus discussion respond responses feedback thread",
    "form": "form login signin signup subscribe newsletter search register contact captcha",
    "share": "share sharing social twitter facebook author byline meta print buttons tools",
}
TOKEN_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        TOKEN_OF.setdefault(_w, []).append(_i)
N_TOKENS = len(TOKENS)


class Node:
    __slots__ = ("tag", "parent", "children", "items", "tokens", "depth", "own", "text", "link", "tags", "punct", "para", "controls", "start", "index", "label", "foreign", "scope", "block", "held")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "") -> None:
        self.tag, self.parent, self.children, self.items = tag, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.index, self.label = None, False
        self.foreign = (parent.foreign if parent else None) or (self if tag in FOREIGN else None)  # the svg or math it is or lies in
        # the nearest of itself and what it lies in that: bounds a paragraph; is a block (its depth); bounds a drawing's parts
        self.scope = self if parent is None or tag == "p" or tag in SCOPE else parent.scope
        self.block = self.depth if tag in BLOCK else parent.block if parent else -1
        self.held = None if self.foreign is None else self if self.foreign is self or tag in INTEGRATION else parent.held
        self.tokens = 0
        for m in ATTR.finditer(attrs) if attrs else ():
            if m[1].lower() not in NAMING:
                continue
            for w in WORD.findall(CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()):
                for g in TOKEN_OF.get(w, ()):
                    self.tokens |= 1 << g


def parse(source: str, element: type = Node) -> Node:
    """A tree of elements; `items` hold text and children in page order. Bad markup is repaired as it comes.

    `element` makes an element of its tag, parent and attributes. Open elements are known by tag, so an
    end tag without a start costs nothing, however deep it stands; an element is closed once.
    """
    root = node = element("html", None)
    at, n = 0, len(source)
    opened: dict[str, list] = {}

    def down(x: Node) -> Node:
        opened.setdefault(x.tag, []).append(x)
        return x

    def up(x: Node, to: Node) -> Node:
        while x is not to:
            opened[x.tag].pop()
            x = x.parent
        return to

    while at < n:
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else n]
        if text:
            if node.tag == "head" and not text.isspace():
                node = up(node, node.parent)  # text ends the head
            node.items.append(text)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            x = opened[tag][-1] if opened.get(tag) else None
            if x is not None and (tag in BLOCK or node.block < x.depth):  # no block lies between
                node = up(node, x.parent)
            continue
        attrs = m[3]
        foreign = node.foreign is not None or tag in FOREIGN
        closed = foreign and attrs.endswith("/") and not UNQUOTED.search(attrs)
        if tag == "title" and node.foreign is not None:
            if not closed:
                node = down(element("title", node))  # as head: a drawing's name is never read
            continue
        if tag in RAW:
            if closed:
                continue
            end = END_OF[tag].search(source, at)
            if end is None:
                if tag != "template":
                    break
                continue
            end = source.find(">", end.end())
            at = end + 1 if end >= 0 else n
            continue
        if tag in ("html", "body"):
            continue
        if tag == "head":
            node = down(element("head", node))  # not linked to its parent: its text is never read
            continue
        if node.tag == "head" and tag == "noscript":
            continue
        if node.tag == "head" and tag not in VOID:
            node = up(node, node.parent)
        if tag in BLOCK:
            if node.foreign is not None and node.held is node.foreign:  # it ends the formula or drawing
                node = up(node, node.foreign.parent)
            if node.scope.tag == "p":
                node = up(node, node.scope.parent)
            closes = SELF_CLOSING.get(tag)
            if closes:
                x = node
                while x is not root and x.tag not in closes and (x.tag not in SCOPE or x.tag in ("td", "th") and tag == "tr"):
                    x = x.parent
                if x.tag in closes:
                    node = up(node, x.parent)
        if tag == "br":
            node.items.append(" ")
            continue
        child = element(tag, node, attrs)
        if child.foreign is None or child.foreign is child:
            node.children.append(child)
        else:
            child.label = True  # goes with the svg or math
            if tag in APART:
                node.items.append(" ")
        node.items.append(child)
        if tag == "xmp":  # all up to its end is text as it stands
            end = END_OF["xmp"].search(source, at)
            end = end.start() if end else n
            child.items.append(source[at:end].replace("&", "&amp;"))
            at = end
        if tag not in VOID and not closed:
            node = down(child)
    return root


def own_text(x: Node) -> str:
    """The text of x outside its children; all that lies in a formula or drawing is its own."""
    if x.foreign is None:
        return "".join([i for i in x.items if i.__class__ is str])
    out, stack = [], list(reversed(x.items))
    while stack:
        i = stack.pop()
        if i.__class__ is str:
            out.append(i)
        else:
            stack.extend(reversed(i.items))
    return "".join(out)


PUNCT = re.compile(r"[.,;:!?]")
CONTROL = frozenset("input button select textarea label".split())


def nodes_of(root: Node) -> list[Node]:
    """All elements in page order, with the sums over their subtrees."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(reversed(x.children))
    # text in page order, for offsets
    seen = 0
    for x in order:
        own = own_text(x)
        x.own = len(own.strip())
        x.punct = len(PUNCT.findall(own)) if x.own else 0
    for x in order:
        x.start = seen
        seen += x.own
    for x in reversed(order):
        kids = x.children
        x.text = x.own + sum([k.text for k in kids])
        x.link = x.text if x.tag == "a" else sum([k.link for k in kids])
        x.tags = 1 + sum([k.tags for k in kids])
        x.punct += sum([k.punct for k in kids])
        x.para = (x.text if x.tag == "p" else 0) or sum([k.para for k in kids])
        x.controls = (x.tag in CONTROL) + sum([k.controls for k in kids])
    return order


def features(order: list[Node]) -> np.ndarray:
    """One row an element."""
    rows = []
    whole = max(1, order[0].text)
    inherited: dict[int, tuple] = {}
    for x in order:
        p = x.parent
        group = GROUP_OF.get(x.tag, len(GROUPS))
        up_tokens, up_groups, near = inherited[id(p)] if p is not None else (0, 0, 0)
        inherited[id(x)] = (up_tokens | x.tokens, up_groups | 1 << group, x.tokens or near)
        if p is None:
            place, n, same, mean = 0, 1, 1, x.text
        else:
            sib = p.children
            n = len(sib)
            if p.index is None:
                p.index = {id(k): i for i, k in enumerate(sib)}, {}
                for k in sib:
                    p.index[1][k.tag] = p.index[1].get(k.tag, 0) + 1
            place, same, mean = p.index[0][id(x)], p.index[1][x.tag] / n, (p.text - p.own) / n
        text = x.text
        rows.append((x.depth, text, x.own, x.link / (text or 1), x.tags, text / x.tags, 100 * x.punct / (text or 1), len(x.children), place / n, n, same, text / ((p.text if p else text) or 1), mean, text / whole, x.start / whole, (x.start + text) / whole, x.para / (text or 1), x.controls, group, x.tokens, up_tokens, up_groups, near))
    a = np.array(rows, np.float64)
    for c in (1, 2, 4, 5, 7, 9, 12, 17):
        a[:, c] = np.log1p(a[:, c])
    group, own, up, up_groups, near = (a[:, c].astype(np.int64) for c in range(18, 23))
    bits = np.arange(N_TOKENS)
    flags = [(group[:, None] == np.arange(len(GROUPS))), (own[:, None] >> bits) & 1, (up[:, None] >> bits) & 1, (up_groups[:, None] >> np.arange(len(GROUPS))) & 1, (near[:, None] >> bits) & 1]
    return np.concatenate([a[:, :18], *flags], axis=1).astype(np.float32)


class BoostedTrees:
    """Logistic boosting of oblivious trees: one test a level, so a tree is a table of 2^depth leaves."""

    def __init__(self, trees: int = 60, depth: int = 5, rate: float = 0.3, bins: int = 24) -> None:
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])  # x > cut[i] iff bin > i
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        z = np.full(len(y), self.base)
        self.model = []
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, q * (1 - q)
            leaf, tests = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                best = (-1.0, 0, 0)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = leaf * (self.bins + 1) + binned[f]
                    size = (1 << level) * (self.bins + 1)
                    gs = np.bincount(k, g, size).reshape(-1, self.bins + 1).cumsum(axis=1)
                    hs = np.bincount(k, h, size).reshape(-1, self.bins + 1).cumsum(axis=1)
                    gain = (gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)).sum(axis=0)[: len(c)]
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], f, i)
                _, f, i = best
                tests.append((f, np.float32(cuts[f][i])))
                leaf = leaf * 2 + (binned[f] > i)
            size = 1 << self.depth
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1)
            z += value[leaf]
            self.model.append((tests, value))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        cols = np.ascontiguousarray(x.T)
        for tests, value in self.model:
            leaf = np.zeros(len(x), np.int64)
            for f, t in tests:
                leaf = leaf * 2 + (cols[f] > t)
            z += value[leaf]
        return z


def decode(order: list[Node], z: np.ndarray) -> None:
    """Sets label on each element: the likeliest labelling with no kept element below a dropped one."""
    keep = (-np.logaddexp(0, -z)).tolist()
    drop = (-np.logaddexp(0, z)).tolist()
    best_keep, best_drop, at = [0.0] * len(order), [0.0] * len(order), {id(x): i for i, x in enumerate(order)}
    for i in range(len(order) - 1, -1, -1):
        k, d = keep[i], drop[i]
        for c in order[i].children:
            j = at[id(c)]
            d += best_drop[j]
            k += max(best_keep[j], best_drop[j])
        best_keep[i], best_drop[i] = k, d
    for i, x in enumerate(order):
        x.label = best_keep[i] > best_drop[i] and (x.parent is None or x.parent.label)


def text_of(root: Node) -> str:
    """Blocks of kept elements in page order, joined by an empty line."""
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        if now:
            line = " ".join("".join(now).split())
            if line:
                blocks.append(line)
            now.clear()

    stack: list = [root] if root.label else []
    while stack:
        x = stack.pop()
        if x.__class__ is str:
            now.append(html.unescape(x))  # a reference doesn't go on behind a tag
        elif x is None:
            end()
        elif x.label:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.items))
    end()
    return "\n\n".join(blocks)


def extract(pages: list[str], model: BoostedTrees) -> list[str]:
    """The main text of each page; '' where there is none."""
    trees = [nodes_of(parse(p)) for p in pages]
    if not trees:
        return []
    z = model.logits(np.concatenate([features(t) for t in trees]))
    out, at = [], 0
    for t in trees:
        decode(t, z[at : at + len(t)])
        at += len(t)
        out.append(text_of(t[0]))
    return out


class Layouts:
    """Pages of random layouts; an element with the attribute k holds main text."""

    def __init__(self, seed: int = 8) -> None:
        self.rng = np.random.default_rng(seed)
        self.syllables = "ba ce di fo gu the er on an re ti es or la que tion ment le und ich en ado ción os ü é".split()

    def pick(self, *xs: str) -> str:
        return xs[self.rng.integers(len(xs))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        style = self.rng.integers(12)
        out = ["".join(self.rng.choice(self.syllables, self.rng.integers(1, 4))) for _ in range(n)]
        if style == 0:
            return " ".join(w.upper() + "!!" for w in out)
        if style == 1:
            return " ".join(w + self.pick("***", "###", "%%%", "&amp;&amp;", "$$$") for w in out)
        if style == 2:
            return " | ".join(out)
        out = [w + (self.pick(".", ",", ".", ";") if self.chance(0.12) else "") for w in out]
        return (" ".join(out)).capitalize() + self.pick(".", ".", "")

    def links(self, n: int, item: str = "li") -> str:
        return "".join(f"<{item}><a href='/x'>{self.words(1, 4)}</a></{item}>" for _ in range(n))

    def attr(self, *names: str) -> str:
        name = self.pick(*names)
        return f' {self.pick("class", "id")}="{name}{self.pick("", "-1", " wide", "-box")}"' if name else ""

    def menu(self) -> str:
        inner = f"<ul>{self.links(self.rng.integers(2, 12))}</ul>"
        return self.pick(f"<nav>{inner}</nav>", f"<div{self.attr('menu', 'navbar', 'navigation', 'breadcrumb')}>{inner}</div>", f"<nav{self.attr('', 'main-nav')}>{self.links(self.rng.integers(2, 9), 'span')}</nav>", f"<ul{self.attr('menu', 'nav', 'pagination')}>{self.links(self.rng.integers(2, 9))}</ul>")

    def head(self) -> str:
        inner = self.pick("", f"<h1>{self.words(1, 6)}</h1>", f"<a href=/>{self.words(1, 3)}</a>", f"<p>{self.words(2, 12)}</p>", f"<h2>{self.words(1, 5)}</h2><p>{self.words(2, 15)}</p>") + (self.menu() if self.chance(0.5) else "")
        return self.pick(f"<header>{inner}</header>", f"<div{self.attr('header', 'masthead', 'site-header', 'topbar', 'logo')}>{inner}</div>")

    def foot(self) -> str:
        inner = self.pick("&copy; ", "", "Copyright ") + self.words(2, 40) + self.pick("", f"<p>{self.words(3, 40)}</p>", f"<ul>{self.links(4)}</ul>", f" &middot; {self.words(2, 30)}")
        return self.pick(f"<footer>{inner}</footer>", f"<footer{self.attr('', 'site-footer')}>{inner}</footer>", f"<div{self.attr('footer', 'copyright', 'legal', 'page-footer')}>{inner}</div>")

    def ad(self) -> str:
        inner = self.pick(self.words(1, 60), f"<p>{self.words(3, 60)}</p>", f"<a href=x>{self.words(2, 12)}</a>", f"<a href=x><img src=y></a> {self.words(1, 8)}")
        return self.pick(f"<div{self.attr('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo', 'ad-slot', 'advertisement')}>{inner}</div>", f"<aside{self.attr('ad', 'promo')}>{inner}</aside>", f"<ins class='adsbygoogle ad'>{inner}</ins>", f"<section{self.attr('sponsored', 'advertisement')}>{inner}</section>")

    def notice(self) -> str:
        inner = self.pick(self.words(4, 50), f"<p>{self.words(4, 50)}</p>") + self.pick("", "<button>OK</button>", f"<a href=x>{self.words(1, 3)}</a>")
        return self.pick(f"<div{self.attr('cookie-notice', 'consent', 'notice', 'gdpr', 'alert', 'popup', 'modal', 'cookie-banner', 'disclaimer')}>{inner}</div>", f"<div role=alert>{inner}</div>", f"<section{self.attr('cookies', 'notice')}>{inner}</section>", f"<aside{self.attr('notice', 'cookie')}>{inner}</aside>", f"<dialog>{inner}</dialog>")

    def side(self) -> str:
        inner = "".join(self.pick(f"<h3>{self.words(1, 4)}</h3><ul>{self.links(self.rng.integers(2, 8))}</ul>", f"<p>{self.words(3, 60)}</p>", f"<div{self.attr('widget', '')}>{self.words(3, 40)}</div>", self.ad()) for _ in range(self.rng.integers(1, 4)))
        return self.pick(f"<aside>{inner}</aside>", f"<aside{self.attr('sidebar', 'related', '')}>{inner}</aside>", f"<div{self.attr('sidebar', 'side', 'related', 'widgets', 'rail')}>{inner}</div>", f"<section{self.attr('related', 'recommended', 'popular')}>{inner}</section>")

    def form(self) -> str:
        inner = self.pick("", f"<p>{self.words(2, 30)}</p>", f"<label>{self.words(1, 4)}</label>", f"<h3>{self.words(1, 5)}</h3>") + "<input name=q>" + self.pick("", f"<button>{self.words(1, 2)}</button>", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>")
        return self.pick(f"<form>{inner}</form>", f"<form{self.attr('newsletter', 'search', 'login', 'subscribe')}>{inner}</form>", f"<div{self.attr('newsletter', 'signup', 'login')}><form>{inner}</form></div>")

    def talk(self) -> str:
        one = lambda: self.pick(f"<div{self.attr('comment', 'reply')}><b>{self.words(1, 2)}</b><p>{self.words(3, 90)}</p></div>", f"<li{self.attr('comment', '')}><p>{self.words(3, 90)}</p></li>", f"<article{self.attr('comment')}><p>{self.words(3, 90)}</p></article>", f"<p>{self.words(3, 90)}</p>")
        inner = self.pick("", f"<h3>{self.words(1, 3)}</h3>") + "".join(one() for _ in range(self.rng.integers(1, 7))) + (self.form() if self.chance(0.3) else "")
        return self.pick(f"<section{self.attr('comments', 'discussion', 'responses')}>{inner}</section>", f"<div{self.attr('comments', 'comment-list', 'disqus', 'replies')}>{inner}</div>", f"<ol{self.attr('commentlist', 'comments')}>{inner}</ol>")

    def share(self) -> str:
        return f"<div{self.attr('share', 'social', 'share-buttons', 'tags')}>{self.links(self.rng.integers(1, 5), 'span')}</div>"

    def inline(self, s: str) -> str:
        words = s.split(" ")
        if len(words) > 6 and self.chance(0.35):
            i = self.rng.integers(1, len(words) - 3)
            t = self.pick("b", "i", "em", "strong", "a", "span", "code")
            words[i] = f"<{t} k>{words[i]}"
            words[i + 2] += f"</{t}>"
        return " ".join(words)

    def main(self) -> str:
        parts = [self.pick(f"<h1 k>{self.words(2, 14)}</h1>", f"<h2 k>{self.words(2, 12)}</h2>", "")]
        for _ in range(self.rng.integers(1, 14)):
            s = self.inline(self.words(1, 120))
            kind = self.rng.integers(20)
            if kind < 13:
                parts.append(self.pick(f"<p k>{s}</p>", f"<p k>{s}</p>", f"<p k>{s}", f"<p k><b k>{s}<br>", f"<div k>{s}</div>"))
            elif kind == 13:
                parts.append(f"<ul k>{''.join(f'<li k>{self.words(2, 20)}</li>' for _ in range(self.rng.integers(2, 6)))}</ul>")
            elif kind == 14:
                parts.append(f"<blockquote k><p k>{s}</p></blockquote>")
            elif kind == 15:
                parts.append(f"<h{self.pick('2', '3')} k>{self.words(1, 9)}</h3>")
            elif kind == 16:
                parts.append(f"<pre k>{s}</pre>")
            elif kind == 17:
                parts.append(f"<table k><tr k><td k>{self.words(1, 9)}</td><td k>{self.words(1, 9)}</td></tr></table>")
            elif kind == 18:
                parts.append(f"<figure k><img src=x><figcaption k>{self.words(2, 14)}</figcaption></figure>")
            else:
                parts.append(self.pick(self.ad(), self.share(), self.form(), self.side(), self.notice()))
        if self.chance(0.15):
            parts.append(self.pick(self.talk(), self.share(), self.side()))
        inner = "".join(parts)
        if self.chance(0.3):
            inner = f"<div k{self.attr('', 'content', 'entry-content', 'article-body', 'text')}>{inner}</div>"
        one = self.pick(f"<article k>{inner}</article>", f"<article k{self.attr('post', 'entry', 'story', '')}>{inner}</article>", f"<main k>{inner}</main>", f"<div k{self.attr('content', 'article', 'post', 'main', 'entry', 'story')}>{inner}</div>", f"<section k{self.attr('content', 'article', '')}>{inner}</section>", f"<div k>{inner}</div>", f"<main k><article k>{inner}</article></main>")
        return one[: one.rindex("</")] if self.chance(0.08) else one

    def page(self) -> str:
        before = [f() for f, p in ((self.notice, 0.25), (self.head, 0.5), (self.menu, 0.7), (self.ad, 0.5), (self.side, 0.15), (self.form, 0.12)) if self.chance(p)]
        after = [f() for f, p in ((self.share, 0.1), (self.talk, 0.35), (self.side, 0.35), (self.form, 0.15), (self.ad, 0.2), (self.notice, 0.1), (self.foot, 0.85)) if self.chance(p)]
        if self.chance(0.3):
            self.rng.shuffle(after)
        inner = "".join(before) + (self.main() if self.chance(0.97) else "") + "".join(after)
        if self.chance(0.3):
            inner = f"<div k{self.attr('', 'page', 'wrapper', 'container')}>{inner}</div>"
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body>{inner}</body></html>"
        return page[: int(len(page) * self.rng.uniform(0.6, 1))] if self.chance(0.06) else page


KEPT = re.compile(r"\sk(?=[\s>])")


class MarkedNode(Node):
    """An element of a made-up page, labelled by the attribute k."""

    __slots__ = ()

    def __init__(self, tag: str, parent: Node | None, attrs: str = "") -> None:
        super().__init__(tag, parent, KEPT.sub("", attrs))
        self.label = bool(KEPT.search(attrs + " "))


def train(pages: int = 450, seed: int = 8) -> BoostedTrees:
    """Trees fitted on so many made-up pages; an element above a kept one is kept."""
    layouts, xs, ys = Layouts(seed), [], []
    for _ in range(pages):
        order = nodes_of(parse(layouts.page(), MarkedNode))
        for x in reversed(order):
            x.label = x.label or any(c.label for c in x.children)
        xs.append(features(order))
        ys.append(np.array([x.label for x in order], float))
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def extract_text(pages: DataFrame, html_column: str = "html", keep: tuple = ("page_id", "url"), training_pages: int = 450) -> DataFrame:
    """`keep`, text and n_chars (code points) of every page. Null html counts as empty and gives ''.

    Whole pages are read, however long; repeated rows each get a row. Columns that aren't named are
    ignored. An empty table gives an empty one.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(training_pages))
    types = dict(pages.dtypes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 200):
                some = part.slice(i, 200)
                text = extract([h or "" for h in some.column(some.num_columns - 1).to_pylist()], model.value)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*some.schema.names[:-1], "text", "n_chars"])

    return pages.select(*keep, F.col(html_column).alias("html_")).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", text string, n_chars long")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
