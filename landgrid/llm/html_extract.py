"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down."""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from landgrid.llm.common import rows_at_a_time, small_batches

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title".split())
NO_TEXT = frozenset("head script style noscript template title svg math iframe object canvas audio video select datalist textarea".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag closes the open elements named here, up to the nearest element of the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
FENCES = frozenset("table td th article section div main aside nav header footer body html button form li".split())

# Words of class, id and role attributes, by what they tell.
SIGNS = {
    "menu": "nav navbar navigation menu submenu topnav breadcrumb breadcrumbs crumbs pagination pager toc tabs skip",
    "head": "header masthead topbar branding logo tagline",
    "foot": "footer foot bottom colophon copyright legal imprint",
    "side": "sidebar side aside rail widget widgets complementary",
    "ad": "ad ads advert adverts advertisement banner sponsor sponsored promo promotion promoted dfp adsbox",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall toast warning disclaimer",
    "talk": "comment comments commentlist reply replies respond discussion disqus reviews feedback thread",
    "share": "share sharing social related recommended recommendations trending popular more tags follow",
    "form": "form search login register contact",
    "main": "article content main post entry story body text news blog page",
}
SIGN_OF = {w: i for i, ws in enumerate(SIGNS.values()) for w in ws.split()}
KINDS = [{"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "label", "legend"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl"}, {"div"}, {"section"}, {"td", "th", "tr", "table"}, {"#text"}]
KIND_OF = {t: i for i, ts in enumerate(KINDS) for t in ts}

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
TOKEN = re.compile(r"[a-z]+")
ENDING = re.compile(r"[.!?…:;,]")
SPACE = re.compile(r"\s+")
#: Elements that lie deeper than this aren't opened; what they hold belongs to the last one that is.
DEEPEST = 512


class Node:
    """An element, or a run of text between an element's child blocks (tag #text)."""

    __slots__ = ("tag", "parent", "children", "text", "link", "signs", "depth", "links", "state", "gone")

    def __init__(self, tag: str, parent: "Node | None", signs: int = 0, gone: bool = False) -> None:
        self.tag, self.parent, self.signs, self.gone = tag, parent, signs, gone
        self.children: list[Node] = []
        self.text: list[str] = []
        self.link = self.links = self.state = 0
        self.depth = parent.depth + 1 if parent else 0


def _signs(attributes: str) -> int:
    out = 0
    for _, value in ATTRIBUTE.findall(attributes):
        spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
        for word in TOKEN.findall(spaced):
            if (i := SIGN_OF.get(word)) is not None:
                out |= 1 << i
    return out


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" of an end tag, name, attributes) of every tag; comments and declarations have no name. A tag ends with the first >
    outside quotes; a < that has none is text. In time linear in the page: where no > follows none is sought again, and a quote that led
    a tag to no end is remembered."""
    at, last, special, hopeless = 0, page.rfind(">"), -1, set()
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", "", ""
            at = end
            continue
        if at > last:
            at += 1
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
            yield at, end, "", "", ""
            at = end
            continue
        m = NAME.match(page, at)
        if not m:
            at += 1
            continue
        where, tried, end = m.end(), [], -1
        while where <= last:
            if special < where:
                special = SPECIAL.search(page, where).start()
            if page[special] == ">":
                end = special
                break
            close = -1 if special in hopeless else page.find(page[special], special + 1)
            tried.append(special)
            if close < 0:
                break
            where = close + 1
        if end < 0:
            hopeless.update(tried)
            # Later tags begin their search before the places that this one has reached.
            special = tried[0] if tried else special
            at += 1
            continue
        yield at, end + 1, m[1], m[2].lower(), page[m.end() : end]
        at = end + 1


def parse(page: str) -> Node:
    """The tree of a page. Never fails: ends that nothing opened are skipped, what is left open ends with the page, and a < that begins no
    tag is text. Elements that show no text, and hidden ones, hold none. A head without an end goes to the body's start, or to the first
    text or element that no head may hold. Elements beyond DEEPEST levels aren't opened, so that time is linear in the page."""
    root = Node("html", None)
    stack: list[tuple[str, Node]] = [("html", root)]  # inline elements stand for the block that holds them
    at, in_link = 0, 0
    held: dict[str, int] = {}  # open elements by name

    def leave_head() -> None:
        for i, (tag, _) in enumerate(stack):
            if tag == "head":
                close(i)
                break

    def put(piece: str) -> None:
        if stack[-1][0] == "head" and piece.strip(" \t\n\f\r"):
            leave_head()
        node = stack[-1][1]
        if piece and not node.gone:
            if not node.children or node.children[-1].tag != "#text":
                if piece.isspace():
                    return
                node.children.append(Node("#text", node))
            run = node.children[-1]
            run.text.append(piece)
            if in_link:
                run.link += len(piece)

    def close(i: int) -> None:
        nonlocal in_link
        for tag, _ in stack[i:]:
            in_link -= tag == "a"
            held[tag] -= 1
        del stack[i:]

    def push(tag: str, node: Node) -> None:
        nonlocal in_link
        if len(stack) < DEEPEST:
            stack.append((tag, node))
            held[tag] = held.get(tag, 0) + 1
            in_link += tag == "a"

    for start, end, closing, tag, attributes in tags(page):
        if start < at:
            continue
        if start > at:
            put(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if not held.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if held.get("head") and (stack[-1][0] == "head" and tag not in IN_HEAD or tag == "body" and not held.get("template")):
            leave_head()
        if tag in ("html", "body"):
            stack[0][1].signs |= _signs(attributes)
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1 if held.get("p") else 0, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in FENCES:
                    break
            if tag[0] == "h" and tag[1:].isdigit() and stack[-1][0] != tag and re.fullmatch("h[1-6]", stack[-1][0]):
                close(len(stack) - 1)
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in ends:
                    close(i)
                    break
        if tag in ("br", "hr", "img", "wbr"):
            put(" " if tag == "br" else "")
        if tag in INLINE:
            if tag not in VOID and not attributes.endswith("/"):
                push(tag, stack[-1][1])
                if tag == "a":
                    if stack[-1][1].children and stack[-1][1].children[-1].tag == "#text":
                        stack[-1][1].children[-1].links += 1
            continue
        holder = stack[-1][1]
        node = Node(tag, holder, _signs(attributes), holder.gone or tag in NO_TEXT or bool(HIDDEN.search(attributes)))
        holder.children.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        push(tag, node)
    put(page[at:])
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes that hold text, parents before children; a block whose only content is one run takes the run's place."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(reversed(n.children))
    for n in reversed(order):
        if n.tag == "#text":
            n.text = [SPACE.sub(" ", references.unescape("".join(n.text))).strip()]
        else:
            n.children = [c for c in n.children if not c.gone and (c.children or (c.text and c.text[0]))]
            if len(n.children) == 1 and n.children[0].tag == "#text" and n.parent is not None:
                run = n.children[0]
                n.text, n.link, n.links, n.children = run.text, run.link, run.links, []
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(reversed(n.children))
    return order


FEATURES = 20 + len(KINDS) * 2 + len(SIGNS) * 3


def node_features(order: list[Node]) -> np.ndarray:
    """Subtree density, tokens of attributes, depth, siblings, and what stands above, for each node."""
    n = len(order)
    at = {id(x): i for i, x in enumerate(order)}
    parent = np.array([at[id(x.parent)] if x.parent is not None else -1 for x in order])
    chars, links, blocks, marks, paras, words, below = (np.zeros(n) for _ in range(7))
    signs = np.array([x.signs for x in order], np.int64)
    kind = np.array([KIND_OF.get(x.tag, -1) for x in order])
    signs_below = np.zeros(n, np.int64)
    for i, x in enumerate(order):
        if not x.children:
            t = x.text[0] if x.text else ""
            chars[i], links[i], blocks[i], marks[i], words[i] = len(t), min(x.link, len(t)), 1, len(ENDING.findall(t)), t.count(" ") + 1
            paras[i] = len(t) if x.tag in ("p", "blockquote", "#text") else 0
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for v in (chars, links, blocks, marks, paras, words):
            v[p] += v[i]
        below[p] += below[i] + 1
        signs_below[p] |= signs_below[i] | signs[i]
    up_signs, up_kinds, rank, sibs, best = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.ones(n), np.ones(n)
    before, after = np.zeros(n), np.zeros(n)
    for i, x in enumerate(order):
        if i:
            p = parent[i]
            up_signs[i] = up_signs[p] | signs[p]
            up_kinds[i] = up_kinds[p] | (1 << int(kind[p]) if kind[p] >= 0 else 0)
        kids = [at[id(c)] for c in x.children]
        if kids:
            size = chars[kids]
            rank[kids] = np.arange(len(kids)) / len(kids)
            sibs[kids] = len(kids)
            best[kids] = size / max(1.0, size.max())
            before[kids[1:]], after[kids[:-1]] = size[:-1], size[1:]
    total = max(1.0, chars[0])
    share_of_parent = chars / np.maximum(1, chars[np.maximum(parent, 0)])
    doc_pos = np.arange(n) / n
    some = np.maximum(1, chars)
    numbers = [np.log1p(chars), chars / total, links / some, chars / (below + 1), np.log1p(blocks), marks / np.maximum(1, words), paras / some, np.log1p(words / blocks.clip(1)), share_of_parent, [x.depth for x in order], rank, np.log1p(sibs), best, np.log1p(before), np.log1p(after), doc_pos, words / np.maximum(1, blocks) < 4, [x.links for x in order], below, (chars == 0)]
    flags = [(kind == k) for k in range(len(KINDS))] + [(up_kinds >> k) & 1 for k in range(len(KINDS))]
    flags += [(v >> s) & 1 for v in (signs, up_signs, signs_below) for s in range(len(SIGNS))]
    return np.stack([np.asarray(v, np.float32) for v in [*numbers, *flags]], 1)


class Boosted:
    """Softmax gradient boosting of shallow trees over binned features. Trees are full: node i has the children 2i+1 and 2i+2."""

    def __init__(self, classes: int, rounds: int = 24, depth: int = 4, rate: float = 0.3, bins: int = 32) -> None:
        self.classes, self.rounds, self.depth, self.rate, self.bins = classes, rounds, depth, rate, bins
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        score = np.zeros((len(y), self.classes))
        hot = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            e = np.exp(score - score.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            row = []
            for c in range(self.classes):
                tree, out = self._tree(b, cuts, hot[:, c] - p[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6))
                row.append(tree)
                score[:, c] += out
            self.trees.append(row)
        return self

    def _tree(self, b: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray):
        size = 2 ** (self.depth + 1) - 1
        feature, limit, leaf = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
        at = np.zeros(len(g), np.int64)
        width = self.bins + 1
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            gain_best, choice = np.full(count, 1e-6), [None] * count
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * width + b[:, f]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                k = gain[:, : len(c)].argmax(1)
                v = gain[np.arange(count), k]
                for i in np.flatnonzero(v > gain_best):
                    gain_best[i], choice[i] = v[i], (f, int(k[i]))
            bins = np.full(count, width)
            for i, ch in enumerate(choice):
                if ch:
                    feature[first + i], limit[first + i], bins[i] = ch[0], cuts[ch[0]][ch[1]], ch[1]
            at = 2 * at + 1 + (b[np.arange(len(g)), feature[at]] > bins[local])
        first = 2**self.depth - 1
        gs, hs = np.bincount(at - first, g, 2**self.depth), np.bincount(at - first, h, 2**self.depth)
        leaf[first:] = self.rate * gs / (hs + 1)
        return (feature, limit, leaf), leaf[at]

    def log_chances(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for row in self.trees:
            for c, (feature, limit, leaf) in enumerate(row):
                at = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
                score[:, c] += leaf[at]
        score -= score.max(1, keepdims=True)
        return np.maximum(score - np.log(np.exp(score).sum(1, keepdims=True)), -12.0)


OUT, IN, MIX = range(3)


def decode(order: list[Node], log: np.ndarray) -> list[str]:
    """Blocks of main text, in page order. A node is wholly out, wholly in, or mixed; what is out or in decides for all below, so that no
    choice contradicts one above it; of all such labellings the likeliest is taken."""
    n = len(order)
    at = {id(x): i for i, x in enumerate(order)}
    whole = log[:, :2].copy()
    best = np.zeros(n)
    for i in range(n - 1, -1, -1):
        kids = [at[id(c)] for c in order[i].children]
        mixed = -np.inf
        if kids:
            whole[i] += whole[kids].sum(0)
            mixed = log[i, MIX] + best[kids].sum()
        order[i].state = int(np.argmax([whole[i, 0], whole[i, 1], mixed]))
        best[i] = max(whole[i, 0], whole[i, 1], mixed)
    out: list[str] = []
    todo = [(order[0], MIX)]
    while todo:
        node, above = todo.pop()
        state = node.state if above == MIX else above
        if not node.children:
            if state == IN and node.text and node.text[0]:
                out.append(node.text[0])
            continue
        todo.extend((c, state) for c in reversed(node.children))
    return out


# Training pages. Pages carry no labels, so the trees learn from generated ones of many layouts, whose main text is known.


class _Writer:
    """Random pages; MAIN marks what is main text (as an attribute that features never see)."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiouáéä") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.words(1, 22).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(low, high)))

    def named(self, kinds: str, chance: float = 0.8) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        word = r.choice(SIGNS[r.choice(kinds.split())].split())
        word = r.choice([word, f"{word}-{self.words(1, 1)}", f"site-{word}", f"{word}_1"])
        return f' {r.choice(["class", "class", "id"])}="{word}"'

    def links(self, low: int, high: int) -> str:
        r = self.r
        item = lambda: f'<a href="/x">{self.words(1, r.choice([1, 1, 3, 8]))}</a>'
        n = r.randint(low, high)
        return r.choice([lambda: "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>", lambda: " | ".join(item() for _ in range(n)), lambda: "".join(f"<div>{item()}</div>" for _ in range(n))])()

    def boiler(self, place: str) -> str:
        r = self.r
        few = lambda: r.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", self.words(1, 6), f"<p>{self.words(1, 8)}</p>" * r.randint(1, 3)])
        if place == "top":
            return r.choice([lambda: f"<nav{self.named('menu', 0.4)}>{self.links(2, 9)}</nav>", lambda: f"<header{self.named('head', 0.4)}>{r.choice(['<h1>' + self.words(1, 4) + '</h1>', '<div>' + self.words(1, 3) + '</div>', ''])}{r.choice([few(), self.links(2, 6)])}</header>", lambda: f"<div{self.named('menu head', 1)}>{self.links(2, 8)}</div>", lambda: f"<div{self.named('notice', 1)}>{few()}<button>{self.words(1, 2)}</button></div>", lambda: f"<div{self.named('ad', 1)}>{few()}</div>"])()
        if place == "side":
            return r.choice([lambda: f"<aside{self.named('side share', 0.6)}><h3>{self.words(1, 4)}</h3>{r.choice([few(), self.links(3, 8)])}</aside>", lambda: f"<div{self.named('side', 1)}><h3>{self.words(1, 4)}</h3>{r.choice([few(), self.links(3, 8)])}</div>", lambda: f"<div{self.named('ad', 1)}>{few()}</div>", lambda: f"<form{self.named('form notice', 0.5)}><label>{self.words(1, 5)}</label><input name='q'><p>{self.prose(1, 2)}</p><button>{self.words(1, 2)}</button></form>"])()
        if place == "talk":
            one = lambda: f"<{r.choice(['div', 'li', 'article'])}{self.named('talk', 0.8)}><b>{self.words(1, 2)}</b><p>{self.prose(1, 5)}</p></div>"
            return f"<{r.choice(['section', 'div'])}{self.named('talk', 1)}><h2>{self.words(1, 3)}</h2>" + "".join(re.sub("</div>$", f"</{m}>", o) for o in (one() for _ in range(r.randint(1, 6))) for m in [re.match("<([a-z]+)", o)[1]]) + "</section>"
        return r.choice([lambda: f"<footer{self.named('foot', 0.4)}>{r.choice(['&copy; ', ''])}{few()}{r.choice(['', self.links(2, 6)])}</footer>", lambda: f"<div{self.named('foot share', 1)}>{r.choice([few(), self.links(2, 6)])}</div>", lambda: f"<section{self.named('share', 1)}><h3>{self.words(1, 3)}</h3>{self.links(2, 6)}</section>", lambda: f"<div{self.named('notice ad', 1)}>{few()}</div>"])()

    def main(self) -> str:
        r = self.r
        parts = [f"<h1 MAIN>{self.words(1, 14)}</h1>"] if r.random() < 0.9 else []
        if parts and r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            parts.append(r.choice([lambda: f"<p MAIN>{self.prose(1, 9)}{r.choice(['', '', '<br>'])}</p>"] * 8 + [lambda: f"<p MAIN>{self.words(1, 6)}</p>", lambda: f"<h2 MAIN>{self.words(1, 8)}</h2>", lambda: "<ul>" + "".join(f"<li MAIN>{self.words(1, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", lambda: f"<blockquote><p MAIN>{self.prose(1, 3)}</p></blockquote>", lambda: "<table>" + "".join(f"<tr><td MAIN>{self.words(1, 4)}</td><td MAIN>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>", lambda: f"<p MAIN>{self.prose(1, 2)} <a href='/x'>{self.words(1, 4)}</a> {self.prose(1, 2)}</p>", lambda: f"<div MAIN>{self.prose(1, 5)}</div>", lambda: f"<pre MAIN>{self.words(3, 20)}</pre>"])())
        for kind in ("side", "foot"):
            if r.random() < 0.15:
                parts.insert(r.randint(0, len(parts)), self.boiler(kind) if kind == "side" else f"<div{self.named('share ad', 1)}>{r.choice([self.words(1, 8), self.prose(1, 2), self.links(2, 5)])}</div>")
        body = "".join(parts)
        return r.choice([f"<article>{body}</article>"] * 5 + [f"<main>{body}</main>", f"<main><article{self.named('main', 0.3)}>{body}</article></main>", f"<article{self.named('main')}>{body}</article>", f"<div{self.named('main', 1)}>{body}</div>", f"<div><div{self.named('main', 1)}>{body}</div></div>", f"<section{self.named('main', 1)}>{body}</section>", f"<div>{body}</div>"])

    def page(self) -> str:
        r = self.r
        some = lambda place, most: [self.boiler(place) for _ in range(r.randint(0, most))]
        main = [self.main()]
        if r.random() < 0.3:
            main.insert(r.randint(0, 1), self.boiler("side"))
        if r.random() < 0.3:
            main.append(self.boiler("talk"))
        main = "".join(main)
        if r.random() < 0.3:
            main = f"<div{r.choice(['', ' class=wrap', ' id=container', ' class=row'])}>{main}</div>"
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{''.join(some('top', 3))}{main}{''.join(some('side', 1) + some('foot', 3))}</body></html>"


def _labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """The nodes of a generated page, and whether each is out, in or mixed."""
    # Leaves are told apart by a mark in front of their text, which is taken out before features are made.
    order = nodes_of(parse(re.sub(r"<([a-z0-9]+) MAIN>", "<\\1>￼", page)))
    state = np.zeros(len(order), np.int64)
    at = {id(x): i for i, x in enumerate(order)}
    for i in range(len(order) - 1, -1, -1):
        x = order[i]
        if x.children:
            kinds = {int(state[at[id(c)]]) for c in x.children}
            state[i] = kinds.pop() if len(kinds) == 1 else MIX
        elif x.text:
            state[i] = IN if x.text[0].startswith("￼") else OUT
            x.text[0] = x.text[0].lstrip("￼").strip()
    return order, state


@lru_cache(maxsize=2)
def fitted(pages: int = 320, seed: int = 11) -> Boosted:
    """Trees learnt from `pages` generated pages: the bound on what is learnt from."""
    writer = _Writer(seed)
    made = [_labelled(writer.page()) for _ in range(pages)]
    return Boosted(3).fit(np.concatenate([node_features(o) for o, _ in made]), np.concatenate([s for _, s in made]))


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """Main text of each page; all nodes of the pages go through the trees at once."""
    trees = [nodes_of(parse(p or "")) for p in pages]
    log = model.log_chances(np.concatenate([node_features(t) for t in trees])) if trees else np.zeros((0, 3))
    out, at = [], 0
    for t in trees:
        out.append("\n\n".join(decode(t, log[at : at + len(t)])))
        at += len(t)
    return out


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """pages and the main text of each: the article's blocks, joined by an empty line. Null counts as an empty page, whose text is empty.

    Character references are decoded, white space within a block becomes one space, blocks keep the page's order; nothing else is dropped
    and nothing is cut off. A column of the same name as out_col is replaced; others are carried along.
    """
    model = model or fitted()
    small_batches(pages.sparkSession)
    at = pages.drop(out_col) if out_col != html_col else pages
    names = at.columns
    schema = T.StructType([*at.schema.fields, T.StructField("__made", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 64):
            texts = batch.column(names.index(html_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(extract(texts, model), pa.string())], [*names, "__made"])

    out = at.mapInArrow(run, schema)
    return out.drop(out_col).withColumnRenamed("__made", out_col)
