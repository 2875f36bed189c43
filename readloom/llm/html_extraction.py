"""HTML extraction (operator 7): boosted trees over DOM-node features, decoded so that no node contradicts its ancestors.

A page becomes a tree of block elements and text runs. Each node has features of its subtree (text, link, mark and tag density, share of
the page's text), of its attribute tokens and tag, of its depth and of its place among its siblings, and of its ancestors. Gradient-boosted
trees, trained in numpy on generated pages of many layouts whose main text is known, give each node the probability that its subtree
holds main text. The fitted trees are kept beside this module (`html_trees.json`); `python -m readloom.llm.html_extraction` fits them again, to the same ones. Decoding takes the most likely labelling in which a node outside the main text has only such nodes below it.

The text of a page is that of its text runs inside, in page order: one block a line, white space in a block made one space,
character references decoded. Nothing else is dropped or capped. No shuffle: a page is one row.

Results that the cases have: null, empty and text-free pages have the empty text, others with a run of prose outside what stands around texts never; a page without marks is text; null ids and urls stay; rows that repeat have the same
result; extra columns are ignored; an empty table gives an empty result. Pages are read whole.
"""

from __future__ import annotations

import functools
import json
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col
from .html_dom import HIDDEN, Node, attributes, tree

TAGS = (
    "#text", "p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "tr", "td",
    "h1", "h2", "h3", "blockquote", "pre", "figure", "dl", "body", "html",
)
#: Groups of attribute tokens; a node has a flag for each group that one of its class, id or role tokens is in.
GROUPS = (
    "content article post entry story main body text prose markdown",
    "nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc tabs",
    "header masthead top topbar banner hero logo branding",
    "footer bottom copyright legal colophon imprint",
    "sidebar side aside rail column widget widgets right left complementary",
    "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted dfp",
    "cookie cookies consent gdpr notice alert popup modal overlay disclaimer message toast",
    "comment comments respond reply replies discussion disqus thread",
    "form login signin signup subscribe newsletter search register contact contentinfo",
    "share social related recommended more also trending popular tags meta byline author date",
)
TOKEN_GROUP = {t: k for k, g in enumerate(GROUPS) for t in g.split()}
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
STORY = frozenset(("article", "main"))
CHROME = frozenset(("nav", "header", "footer", "aside", "form"))
HEADINGS = frozenset(("h1", "h2", "h3"))
PLAIN = 18
N_FEATURES = PLAIN + len(TAGS) + 2 * len(GROUPS)
PAGES, TREES, DEPTH, BINS, RATE, SEED = 3000, 160, 6, 32, 0.2, 11
FITTED = "html_trees.json"
#: Words of a run of text that reads like prose.
PROSE = 8
#: Nodes whose features are held at once.
NODES = 60_000


def flags(node: Node) -> int:
    """The groups of the node's attribute tokens, as bits."""
    if not node.attrs:
        return 0
    a, out = attributes(node.attrs), 0
    for k in ("class", "id", "role"):
        for t in SPLIT.findall(a.get(k, "")):
            if (g := TOKEN_GROUP.get(t.lower())) is not None:
                out |= 1 << g
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row a node. A text run that is all its element holds has the element's row, but for the flag of its own tag."""
    total, n = max(1, nodes[0].chars), len(nodes)
    out = np.zeros((n, N_FEATURES), np.float32)
    place = {id(x): k for k, x in enumerate(nodes)}
    own, above, chrome, story, nth = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    tag_at = {t: PLAIN + k for k, t in enumerate(TAGS)}
    seen, rows, copies = 0, [], []
    for k, x in enumerate(nodes):
        for i, c in enumerate(x.children):
            nth[place[id(c)]] = i
        up, chars = x.parent, x.chars
        if up is None:
            j, siblings, share_up, up_chars, up_links, alike = 0, 1, 1.0, 0, 0, 1
        else:
            j, siblings, up_chars, up_links = place[id(up)], len(up.children), up.chars, up.links
            share_up = chars / max(1, up_chars)
            above[k] = above[j] | own[j]
            chrome[k] = chrome[j] + (up.tag in CHROME)
            story[k] = story[j] + (up.tag in STORY)
            own[k] = flags(x)
            if x.tag == "#text" and siblings == 1:
                copies.append((k, j))
        rows.append((
            x.depth, math.log1p(chars), x.links / chars if chars else 0.0, chars / (1 + x.tags), x.marks / (1 + x.words), x.words / (1 + len(x.children)),
            len(x.children), siblings, nth[k] / siblings, share_up, chars / total, seen / total, chrome[k], chars / max(1, x.words),
            math.log1p(up_chars), up_links / up_chars if up_chars else 0.0, story[k], chrome[k] + story[k] == 0,
        ))
        if x.tag == "#text":
            seen += chars
        if (t := tag_at.get(x.tag)) is not None:
            out[k, t] = 1
        for base, bits in ((PLAIN + len(TAGS), own[k]), (PLAIN + len(TAGS) + len(GROUPS), above[k])):
            while bits:
                low = bits & -bits
                out[k, base + low.bit_length() - 1] = 1
                bits ^= low
    out[:, :PLAIN] = rows
    for k, j in copies:
        out[k] = out[j]
        out[k, PLAIN] = 1
    return out


class Boosted:
    """Gradient-boosted trees for a binary label, on binned features, in numpy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
        binned = self.binned(x)
        p0 = y.mean()
        self.base, self.trees = math.log(p0 / (1 - p0)), []
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self.grown(binned, p - y, p * (1 - p), depth, rate)
            self.trees.append(tree)
            score += tree[2][leaf]

    def state(self) -> dict:
        return {"base": self.base, "edges": [e.tolist() for e in self.edges], "trees": [[x.tolist() for x in t] for t in self.trees]}

    @classmethod
    def of(cls, state: dict) -> Boosted:
        """Trees that `state` gave."""
        out = cls.__new__(cls)
        out.base, out.edges = state["base"], [np.array(e, np.float32) for e in state["edges"]]
        out.trees = [(np.array(f, np.int64), np.array(c, np.int64), np.array(v)) for f, c, v in state["trees"]]
        return out

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def grown(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float):
        """A complete tree: (feature, bin) of each inner node and the value of each leaf; and each row's leaf."""
        n_features = binned.shape[1]
        feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, 255, np.int64)
        at = np.zeros(len(g), np.int64)  # node within its level
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            gain = np.full((width, n_features, BINS), -1.0)
            sum_g, sum_h = np.bincount(at, g, width), np.bincount(at, h, width)
            whole = sum_g**2 / (sum_h + 1)
            for f in range(n_features):
                cell = at * BINS + binned[:, f]
                left_g = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                left_h = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                ok = (left_h > 1) & (right_h > 1)
                gain[:, f] = np.where(ok, left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - whole[:, None], -1.0)
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            feature[first : first + width] = np.where(good, best // BINS, 0)
            cut[first : first + width] = np.where(good, best % BINS, 255)
            at = at * 2 + (binned[np.arange(len(g)), feature[first + at]] > cut[first + at])
        value = -np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + 1) * rate
        return (feature, cut, value), at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        binned, rows = self.binned(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(feature):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            score += value[at - len(feature)]
        return score


def prose(nodes: list[Node]) -> list[int]:
    """The text runs that read like prose: PROSE words or more, less than half of it links, in no element that is hidden or whose tag or names are those of what stands around a text."""
    around, out = [False] * len(nodes), []
    place = {id(x): k for k, x in enumerate(nodes)}
    for k, x in enumerate(nodes):
        around[k] = x.parent is not None and (around[place[id(x.parent)]] or x.tag in CHROME or x.tag in HIDDEN or flags(x) > 1)
        if x.tag == "#text" and not around[k] and x.words >= PROSE and 2 * x.links < x.chars:
            out.append(k)
    return out


def decoded(nodes: list[Node], log_odds: np.ndarray) -> list[str]:
    """The text runs inside the main text under the most likely labelling without contradictions; where that is empty, under the most likely one that holds a run of prose, if there is one.

    The longest run of prose is inside where the heading before it is.
    """
    place = {id(x): k for k, x in enumerate(nodes)}
    inside = (-np.logaddexp(0, -log_odds)).tolist()
    outside = (-np.logaddexp(0, log_odds)).tolist()
    for k in range(len(nodes) - 1, -1, -1):
        for c in nodes[k].children:
            j = place[id(c)]
            inside[k] += max(inside[j], outside[j])
            outside[k] += outside[j]

    def kept(forced: int = 0) -> list[bool]:
        """Whether each node is inside, where one must be."""
        path, keep = set(), [False] * len(nodes)
        while nodes[forced].parent is not None:
            path.add(forced)
            forced = place[id(nodes[forced].parent)]
        for k, x in enumerate(nodes):
            keep[k] = x.parent is None or keep[place[id(x.parent)]] and (inside[k] >= outside[k] or k in path) and x.tag not in HIDDEN
        return keep

    keep, able = kept(), prose(nodes)
    if able and not any(k for k, x in zip(keep, nodes, strict=True) if x.tag == "#text"):
        loss = [0.0] * len(nodes)  # of log likelihood, if a node is inside
        for k, x in enumerate(nodes[1:], 1):
            loss[k] = loss[place[id(x.parent)]] + min(0.0, inside[k] - outside[k])
        keep = kept(max(able, key=loss.__getitem__))
    elif able and not keep[longest := max(able, key=lambda k: nodes[k].chars)]:
        heading = next((k for k in range(longest, 0, -1) if nodes[k].tag in HEADINGS), 0)
        if heading and keep[heading]:
            keep = kept(longest)
    return [x.text for k, x in zip(keep, nodes, strict=True) if k and x.tag == "#text"]


SYLLABLES = "an er on re ed ing the st ou nt ha is at ti or th en de la es ra le qu vi ment ción sch ein keit ung".split()


class Pages:
    """Generated pages of many layouts; elements of main text carry the attribute data-main."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + (r.choice((",", ".", ".", "!!", " |", "%%%", "&amp;")) if r.random() < 0.12 else "") for _ in range(r.randint(low, high))]
        return " ".join(out).capitalize() + r.choice((".", ".", ""))

    def inline(self, text: str) -> str:
        r = self.r
        parts = text.split(" ")
        for _ in range(r.choice((0, 0, 1, 2))):
            k = r.randrange(len(parts))
            parts[k] = r.choice(('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "{}<br>", "<span>{}</span>", "<b>{}")).format(parts[k])
        return " ".join(parts)

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def box(self, tags: str, names: str, inner: str) -> str:
        r = self.r
        tag = r.choice(tags.split())
        name = r.choice(names.split())
        attr = r.choice((f' class="{name}"', f' id="{name}"', f' class="x {name} box"', f' class="{name}-{r.choice(("wrap", "inner", "block"))}"', "" if tag in CHROME else f' class="{name}"'))
        return f"<{tag}{attr}>{inner}</{tag}>"

    def noise(self) -> str:
        r = self.r
        return r.choice((
            lambda: self.box("nav nav div ul", "nav menu navbar breadcrumb navigation", self.links(r.randint(2, 9))),
            lambda: self.box("div div section aside", "ad ads advert sponsored promo banner ad-slot", r.choice(("", "<p>")) + self.words(3, 40)),
            lambda: self.box("div", "ad ads advert sponsored", self.words(3, 25)),
            lambda: self.box("div div section", "cookie-notice consent notice gdpr alert cookie-banner", f"<p>{self.words(5, 40)}</p><button>{self.words(1, 2)}</button>"),
            lambda: self.box("aside aside div", "sidebar side widget right-rail", f"<h3>{self.words(1, 4)}</h3>" + r.choice((self.links(r.randint(2, 6)), f"<p>{self.words(5, 60)}</p>"))),
            lambda: self.box("section div div", "comments comment-list discussion", f"<h3>{self.words(1, 3)}</h3>" + "".join(self.box("div div li article", "comment reply", f"<p>{self.words(3, 60)}</p>") for _ in range(r.randint(1, 5)))),
            lambda: self.box("form form div", "newsletter subscribe search login contact-form", f"<form><label>{self.words(1, 6)}</label><input name=q><p>{self.words(2, 20)}</p><button>{self.words(1, 2)}</button></form>"),
            lambda: self.box("div section", "share social related recommended trending", f"<h4>{self.words(1, 3)}</h4>" + self.links(r.randint(2, 6))),
        ))()

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(r.choice(("{}",) * 9 + ("<header>{}</header>",)).format(f"<h1 data-main>{self.words(2, 14)}</h1>"))
        for _ in range(r.choice((1, 1, 1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.78:
                out.append(f"<p data-main>{self.inline(self.words(*r.choice(((1, 6), (5, 30), (20, 120), (40, 300)))))}" + r.choice(("</p>", "</p>", "", "<br>")))
            elif kind < 0.86:
                out.append(f"<h2 data-main>{self.words(1, 8)}</h2>")
            elif kind < 0.91:
                out.append("<ul>" + "".join(f"<li data-main>{self.words(2, 25)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote data-main>{self.words(5, 50)}</blockquote>")
            elif kind < 0.96:
                out.append("<table>" + "".join(f"<tr><td data-main>{self.words(1, 4)}</td><td data-main>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.965:
                out.append(f"<pre data-main>{self.words(3, 40)}</pre>")
            elif kind < 0.97:
                out.append("<dl>" + "".join(f"<dt data-main>{self.words(1, 3)}</dt><dd data-main>{self.words(3, 40)}</dd>" for _ in range(r.randint(1, 4))) + "</dl>")
            elif kind < 0.98:
                out.append("".join(f"<div data-main>{self.words(5, 80)}</div>" for _ in range(r.randint(1, 4))))
            else:
                out.append(self.noise())
        return "".join(out)

    def heading(self, names: str) -> str:
        """A site's head: its name, perhaps with links."""
        return self.box("header header div", names, self.r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 5)}</div>", f"<p>{self.words(1, 8)}</p>")) + self.r.choice(("", self.links(4))))

    def footing(self, names: str) -> str:
        r = self.r
        return self.box("footer footer footer div", names, r.choice(("&copy; ", "", "Copyright ")) + f"{self.words(2, 30)} &middot; {self.words(2, 20)}" + r.choice(("", self.links(3))))

    def token(self) -> str:
        """A class name as tools make them."""
        r = self.r
        return r.choice(("css", "sc", "x", "_")) + "-" + "".join(r.choice("bcdfghjkmnpqrstvwxz0123456789") for _ in range(6))

    def short(self) -> str:
        """Main text of a few short blocks, its heading among them."""
        r = self.r
        head = r.choice(("h1", "h1", "h2"))
        out = [f"<{head} data-main>{self.words(1, 9)}</{head}>"] if r.random() < 0.8 else []
        for _ in range(r.randint(2, 9)):
            out.append(f"<p data-main>{self.inline(self.words(*r.choice(((1, 1), (1, 3), (3, 12), (20, 90)))))}</p>")
        return "".join(out)

    def hashed(self) -> str:
        """A page of nested boxes whose class names say nothing; links and tags tell its parts."""
        r = self.r
        main = self.short() if r.random() < 0.6 else self.main()
        for _ in range(r.randint(1, 4)):
            main = f'<div class="{self.token()} {self.token()}">{main}</div>'
        head = f'<div class="{self.token()}">{r.choice(("", f"<div>{self.words(1, 3)}</div>"))}{self.links(r.randint(3, 9))}</div>'
        tail = f'<div class="{self.token()}">{r.choice((self.links(r.randint(2, 6)), f"<span>&copy; {self.words(1, 6)}</span>" + self.links(3)))}</div>'
        main = r.choice(("", "", "", self.noise())) + main + r.choice(("", "", "", self.noise()))
        return f'<div id="root">{r.choice((head, f"<nav>{self.links(5)}</nav>", f"<header>{self.links(4)}</header>"))}{main}{r.choice((tail, f"<footer>{self.words(2, 12)}</footer>"))}</div>'

    def tabled(self) -> str:
        """A page laid out by tables: links in a cell, the text in another, in paragraphs or in lines of their own cell."""
        r = self.r
        head = r.choice(("", f'<tr><td colspan=2><font size="6">{self.words(1, 4)}</font></td></tr>', f'<tr><td colspan=2>{" | ".join(f"<a href=/{k}>{self.words(1, 2)}</a>" for k in range(r.randint(3, 8)))}</td></tr>'))
        title = r.choice(("", f'<font size="{r.randint(4, 6)}" data-x>{self.words(2, 9)}</font>', f"<b>{self.words(2, 9)}</b>"))
        raw = r.random() < 0.5  # the whole cell is main text, its title a run of text with no element of its own
        if title and not raw:
            title = f"<div data-main>{title}</div>" if r.random() < 0.5 else f"<p data-main>{title}</p>"
        body = "".join(f"<p data-main>{self.inline(self.words(*r.choice(((1, 4), (4, 20), (20, 120)))))}" + r.choice(("</p>", "")) for _ in range(r.randint(1, 8)))
        menu = f"<td width=150>{r.choice((self.links(r.randint(3, 9)), '<br>'.join(f'<a href=/{k}>{self.words(1, 2)}</a>' for k in range(r.randint(3, 9)))))}</td>"
        cell = f'<td valign="top" data-main>{title}{body}</td>' if raw else f'<td valign="top">{r.choice(("", "", "", self.noise()))}{title}{body}{r.choice(("", "", "", self.noise()))}</td>'
        row = [menu, cell]
        if r.random() < 0.3:
            row.reverse()
        tail = r.choice(("", f"<tr><td colspan=2><small>{r.choice(('&copy;', 'Copyright'))} {self.words(1, 6)}</small></td></tr>"))
        return f"<table width=100%>{head}<tr>{''.join(row)}</tr>{tail}</table>"

    def bare(self) -> str:
        """Text right in the body, or in one box without a name, between what other pages have around it."""
        r = self.r
        main = self.short() if r.random() < 0.5 else self.main()
        around = [f"<nav>{self.links(r.randint(2, 7))}</nav>", r.choice(("{}", "<div>{}</div>")).format(main)]
        if r.random() < 0.4:
            around.insert(0, self.heading("header site-header top"))
        for _ in range(r.choice((0, 0, 1, 2))):
            around.insert(r.choice((0, 1, len(around))), self.noise())
        if r.random() < 0.7:
            around.append(self.footing("footer site-footer bottom"))
        return "".join(around)

    def loose(self) -> str:
        """A box whose text stands right in it, in lines or between paragraphs, with or without a name, and what other pages have around it."""
        r = self.r
        out = [f"<h1>{self.words(2, 10)}</h1>"] if r.random() < 0.5 else []
        for _ in range(r.choice((1, 1, 2, 3, 5))):
            text = self.inline(self.words(*r.choice(((4, 20), (15, 60), (30, 150)))))
            out.append(r.choice(("{}", "{}", "{}<br>", "{}<br><br>", "<p>{}</p>", "<p>{}")).format(text))
        attr = r.choice(("", f' class="{self.token()}"', f' class="{self.token()}"', ' id="content"', ' class="text"'))
        main = f"<{(tag := r.choice(('div', 'div', 'section', 'article', 'center')))}{attr} data-main>{''.join(out)}</{tag}>"
        for _ in range(r.choice((0, 0, 1, 2))):
            main = f"<div>{main}</div>"
        head = r.choice(("", f"<nav>{self.links(r.randint(2, 7))}</nav>", self.heading("header site-header top"), f'<div class="{self.token()}">{self.links(r.randint(3, 8))}</div>'))
        tail = r.choice(("", self.footing("footer site-footer bottom"), f"<footer>{self.words(1, 8)}</footer>", f'<div class="{self.token()}"><span>&copy; {self.words(1, 5)}</span></div>'))
        return head + r.choice(("", "", self.noise())) + main + r.choice(("", "", self.noise())) + tail

    def few(self) -> str:
        """A page of one block or a few, with little or nothing around them."""
        r = self.r
        blocks = [f"<p data-main>{self.inline(self.words(*r.choice(((6, 20), (15, 60), (40, 200)))))}" + r.choice(("</p>", "</p>", "")) for _ in range(r.choice((1, 1, 2, 2, 3)))]
        if r.random() < 0.3:
            blocks.insert(0, f"<h1 data-main>{self.words(2, 10)}</h1>")
        if r.random() < 0.15:  # nothing but what stands around a text
            return r.choice((f"<nav>{self.links(r.randint(2, 7))}</nav>", self.noise())) + r.choice(("", self.footing("footer bottom"), f"<footer>&copy; {self.words(1, 4)}</footer>"))
        if r.random() < 0.3:
            blocks = [b.replace("<p data-main>", "<div data-main>").replace("</p>", "") + "</div>" if b.startswith("<p") else b for b in blocks]
        main = "".join(blocks)
        for _ in range(r.choice((0, 0, 0, 1, 2, 3))):
            main = f'<div{r.choice(("", f""" class="{self.token()}" """.rstrip()))}>{main}</div>'
        return r.choice(("", "", "", self.noise())) + main + r.choice(("", "", "", self.noise(), f"<footer>{self.words(1, 8)}</footer>"))

    def named(self) -> str:
        """A page whose main text has an element or a name of its own."""
        r = self.r
        main = self.main() if r.random() < 0.97 else ""
        wrap = r.choice(("article", "article", "main", "div", "section"))
        name = r.choice(("content", "post-content", "article-body", "entry-content", "story", "main", "text", "post"))
        attr = r.choice((f' class="{name}"', f' id="{name}"')) if wrap in ("div", "section") or r.random() < 0.3 else ""
        main = f"<{wrap}{attr}>{main}</{wrap}>"
        if r.random() < 0.3:
            main = r.choice(("<main>{}</main>", '<div class="container">{}</div>', '<div id="page">{}</div>', "<div>{}</div>")).format(main + (self.noise() if r.random() < 0.4 else ""))
        head = [self.noise() for _ in range(r.choice((0, 0, 1, 1, 2, 3)))]
        if r.random() < 0.75:
            head.insert(0, f"<nav>{self.links(r.randint(2, 9))}</nav>")
        if r.random() < 0.45:
            head.insert(0, self.heading("header site-header masthead top"))
        tail = [self.noise() for _ in range(r.choice((0, 0, 1, 2)))]
        if r.random() < 0.85:
            tail.append(self.footing("footer site-footer copyright bottom"))
        return f"{''.join(head)}{main}{''.join(tail)}"

    LAYOUTS = ("named",) * 8 + ("hashed", "tabled", "bare", "bare", "loose", "few", "few")

    def page(self, layout: str | None = None) -> str:
        layout = layout or self.r.choice(self.LAYOUTS)
        if layout == "few" and self.r.random() < 0.3:  # without a frame, or without any mark
            return self.r.choice((self.few(), self.words(10, 200)))
        body = getattr(self, layout)()
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled(nodes: list[Node]) -> np.ndarray:
    """Whether each node's subtree holds text that the generator marked; a page of nothing but text is main text."""
    for x in nodes:
        x.mark = len(nodes) == 2 and x.tag == "#text" or "data-main" in x.attrs or x.parent is not None and x.parent.mark
        x.main = x.tag == "#text" and x.mark
    for x in reversed(nodes[1:]):
        x.parent.main |= x.main
    return np.array([x.main for x in nodes], float)


def fitted(pages: int = PAGES, seed: int = SEED, layouts: tuple[str, ...] | None = None) -> Boosted:
    """The trees, trained on generated pages; the same each time."""
    made, xs, ys = Pages(seed), [], []
    if layouts:
        made.LAYOUTS = layouts
    for _ in range(pages):
        nodes = tree(made.page())
        ys.append(labelled(nodes))
        xs.append(features(nodes))
    return Boosted(np.concatenate(xs), np.concatenate(ys))


def place() -> str:
    return os.path.join(os.path.dirname(__file__), FITTED)


@functools.lru_cache(maxsize=1)
def model() -> Boosted:
    """The fitted trees, from their file."""
    with open(place(), encoding="utf-8") as f:
        return Boosted.of(json.load(f))


def extract(pages: list[str | None], trees: Boosted) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    held: list[list[Node]] = []

    def decide():
        if held:
            odds, at = trees.predict(np.concatenate([features(n) for n in held])), 0
            for nodes in held:
                out.append("\n".join(decoded(nodes, odds[at : at + len(nodes)])))
                at += len(nodes)
            held.clear()

    size = 0
    for page in pages:
        held.append(nodes := tree(page or ""))
        size += len(nodes)
        if size >= NODES:
            decide()
            size = 0
    decide()
    return out


def extractor(trees: Boosted):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                texts = extract(part["_html"].to_pylist(), trees)
                yield pa.RecordBatch.from_pydict({
                    "_id": part["_id"], "_url": part["_url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                })

    return run


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: (id_col, url_col, text, n_chars)."""
    rows = pages.select(col(id_col).alias("_id"), col(url_col).cast("string").alias("_url"), col(html_col).cast("string").alias("_html"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(extractor(model()), f"_id {kind}, _url string, text string, n_chars bigint")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


if __name__ == "__main__":
    with open(place(), "w", encoding="utf-8") as out:
        json.dump(fitted().state(), out)
