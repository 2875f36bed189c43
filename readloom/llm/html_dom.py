"""A lenient HTML tree for extraction: block elements and runs of text, with the figures that node features need."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++|<)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title template noscript iframe object svg canvas audio video select textarea button".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title")}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An opening tag ends an open element of these kinds, up to the element that holds them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "depth", "text", "chars", "links", "words", "marks", "tags", "mark", "main")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.text = ""
        self.chars = self.links = self.words = self.marks = self.tags = 0
        self.mark = self.main = False


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(source)} if source else {}


def tree(source: str) -> list[Node]:
    """All nodes in page order, the document first; text runs are leaves with tag #text."""
    root = Node("#document", "", None)
    nodes, stack = [root], [root]
    where: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
    run: list[str] = []
    linked = hidden = inner = 0  # open links, open hidden elements, linked characters of the run
    anchors: list[str] = []

    def flush():
        nonlocal inner
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                leaf = Node("#text", "", stack[-1])
                leaf.text, leaf.chars, leaf.links = text, len(text), min(inner, len(text))
                leaf.words = text.count(" ") + 1
                leaf.marks = sum(map(text.count, ".,;:!?"))
                stack[-1].children.append(leaf)
                nodes.append(leaf)
            inner = 0

    def close(to: int):
        nonlocal hidden
        flush()
        while len(stack) > to:
            tag = stack.pop().tag
            where[tag].pop()
            hidden -= tag in HIDDEN

    def innermost(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    place, size = 0, len(source)
    while place < size:
        m = TOKEN.match(source, place)
        if m is None:  # nothing matches here: one character of text
            run.append(source[place])
            place += 1
            continue
        place = m.end()
        if (data := m.group(7)) is not None:
            if not hidden:
                run.append(data)
                if linked:
                    inner += len(data)
            continue
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name, ending = name.lower(), bool(m.group(1) or m.group(4))
        if name == "br":
            run.append(" ")
        elif name in INLINE:
            linked = max(0, linked + (-1 if ending else 1)) if name == "a" else linked
            stack[-1].tags += 1
        elif ending:
            if k := innermost((name,)):
                close(k)
            linked = 0
        elif name in VOID:
            if name == "hr":
                flush()
        else:
            attrs = m.group(3) or m.group(6) or ""
            if name in CLOSES_P and stack[-1].tag == "p":
                close(len(stack) - 1)
            ends, holders = ENDS.get(name, ((), ()))
            if (k := innermost(ends)) > innermost(holders):
                close(k)
            flush()
            linked = 0
            node = Node(name, attrs, stack[-1])
            stack[-1].children.append(node)
            nodes.append(node)
            if name in RAW:
                end = RAW[name].search(source, place)
                place = end.end() if end else size
            elif not attrs.rstrip().endswith("/") or name not in ("svg", "iframe"):
                where.setdefault(name, []).append(len(stack))
                stack.append(node)
                hidden += name in HIDDEN
    close(1)
    flush()
    for node in reversed(nodes[1:]):
        up = node.parent
        up.chars += node.chars
        up.links += node.links
        up.words += node.words
        up.marks += node.marks
        up.tags += node.tags + 1
    return nodes
