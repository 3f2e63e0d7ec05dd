"""Main text of pages by wrapper induction over all pages.

All pages of a host are read, and the tree of each is aligned with that of one page of the host (its smallest id) by
simple tree matching: equal elements (tag and class) match, children in order, so that most nodes match; of leaf blocks
those of equal text are preferred.  This is done on whole trees, before anything is known of where the article is.  A
leaf block has the place of the node that it is aligned with; one without a partner has its path from the root.  A text
that at least MOST_FEW articles and a share of CONSTANT of them have at the same place is constant: the host's
template; places whose text varies are slots, and only these can be content.  Constant texts are counted over the whole
host and, by path, over each layout (the containers of a page, with their classes), so a layout that few pages have has
its own template.  A text counts once for each distinct article, so copies under different payloads count once.  Articles
are told apart in two steps: texts that a share of CONSTANT of the pages have at a place are set aside, and an article
is known by its three longest other blocks of LONG words or more, so long footers do not stand for it; a page that has
none (copies of one article may be most pages) is known by its three longest of all, or its longest block if none has
LONG words.  Fewer than MOST_FEW articles are no evidence: nothing is constant there.  Constant blocks are dropped wherever a page of the host has them at
that place.  Where children are so many that the matching's table would pass WIDE cells, its rows are made twice and few are
kept; the matching is the same.

What a page tells of itself is used as well: scripts, styles, forms and the like are no text; menus, headers, footers,
sidebars, notices, adverts and reader comments are known by element or by words in class, id or role.  Where a page has
<article> or <main> with text, the rest of the page is none of it; an article's own header stays if it has a heading.

Text: character references decoded once, white space inside a block (any Unicode white space, line breaks included)
is one space, blocks are trimmed, empty ones dropped, the others joined in page order by a line feed.  Nothing is cut or
capped; end tags may miss and be crossed.  A null html or one without text gives the empty text.  Pages without host
share one wrapper of their own kind.  Repeated rows give equal results; the empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from functools import lru_cache
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, Cuts, lookup_join
from quillspark.llm.url_filter import host

MOST_FEW, CONSTANT, LONG, DEPTH, WIDE = 5, 0.6, 8, 150, 250_000
#: Numbers that a node of many children keeps of what kinds of its children count with each other; others are found again.
KEPT = 4_000_000
#: Wrappers up to which (and up to 16 MB) they are broadcast; beyond, pages are joined with them by shuffle.
BROADCAST_WRAPPERS = 20_000

#: What may stand at a <; text between two of these is found by itself.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NO_TEXT = _RAW | {"head", "form", "button", "select", "option", "svg", "canvas", "object", "math", "audio", "video", "dialog", "datalist", "label", "fieldset"}
_BOILER = {"nav", "footer", "aside", "menu"}
#: Elements that hold blocks: they tell one layout from another.
_BOXES = {"#", "html", "body", "main", "article", "section", "div", "header", "aside", "center"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Words of a class, id or role that name what is not the article.
_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "byline-share", "comment", "comments", "commentlist", "consent", "contentinfo", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "thead"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = {"ul": "li", "ol": "li", "dl": "dt dd", "table": "tr td th thead tbody tfoot p li", "select": "option"}
_P_ENDS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: What the start of an element closes.
_SHUT = {tag: _CLOSES.get(tag, set()) | ({"p"} if tag in _P_ENDS else set()) for tag in {*_CLOSES, *_P_ENDS}}
_RAW_END = {tag: re.compile(rf"</{tag}\s*>|</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW}
#: Elements that a slash at the end of the tag does not close.
_OPEN = {"p", "div", "a", "li", "b", "i", "span"}
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "mark", "kids", "drop")

    def __init__(self, tag: str, mark: str = ""):
        self.tag, self.mark, self.kids, self.drop = tag, mark, [], False

    def text(self) -> str:
        return " ".join(" ".join(self.strings([])).split())

    def strings(self, out: list[str]) -> list[str]:
        for k in self.kids:
            if k.__class__ is Node:
                k.strings(out)
            else:
                out.append(k)
        return out


@lru_cache(4096)
def _name(value: str) -> bool:
    low = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
    return not _WORDS.isdisjoint(_SPLIT.split(low))


def _named(attrs: str) -> tuple[str, bool]:
    """The class of an element, and whether a name says that it is not the article."""
    mark, bad = "", False
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "class":
            mark = value
        bad = bad or (_name if len(value) <= 100 else _name.__wrapped__)(value)
    return mark, bad


def parse(text: str) -> Node:
    """The page's tree: nodes, and strings for text (references decoded)."""
    root = Node("#")
    stack = [root]
    deep: dict[str, int] = {}  # elements below DEPTH stay open as their parent's text; their end tags close nothing
    at, n = 0, len(text)
    while at < n:
        if text[at] != "<":
            end = text.find("<", at)
            words = text[at:end] if end >= 0 else text[at:]
            at += len(words)
            stack[-1].kids.append(html.unescape(words) if "&" in words else words)
            continue
        m = _TOKEN.match(text, at)
        if m is None:  # a < that opens nothing
            stack[-1].kids.append("<")
            at += 1
            continue
        at = m.end()
        end, start, attrs = m.groups()
        if start is not None:
            tag = start.lower()
            if shut := _SHUT.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    t = stack[i].tag
                    if t in shut:
                        del stack[i:]
                        if t not in ("td", "th", "tr", "tbody", "thead"):
                            break
                    elif t not in _INLINE and t != "p" and not (t in ("td", "th", "tr") and tag in ("tr", "td", "th", "tbody", "tfoot")):
                        break
            mark, bad = _named(attrs) if attrs and "=" in attrs else ("", False)
            node = Node(tag, mark)
            node.drop = bad and tag not in ("html", "body", "article", "main")
            stack[-1].kids.append(node)
            if tag in _RAW:
                close = _RAW_END[tag].search(text, at)
                if tag in ("noscript", "template") or close:
                    at = close.end() if close else n
                else:
                    at = n
            elif tag not in _VOID and (tag in _OPEN or not attrs.rstrip().endswith("/")):
                if len(stack) < DEPTH:
                    stack.append(node)
                else:
                    deep[tag] = deep.get(tag, 0) + 1
        elif end is not None:
            tag = end.lower()
            if deep.get(tag):
                deep[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
                if tag not in ("html", "body", "article", "main") and stack[i].tag in ("article", "main", "body", "td", "th") and tag in ("p", "li", "div", "span"):
                    if not any(s.tag == tag for s in stack[1:i]) or tag in ("p", "li"):
                        break
    return root


def _has(node: Node, tags: set[str]) -> bool:
    return any(isinstance(k, Node) and (k.tag in tags or _has(k, tags)) for k in node.kids)


def _links_only(node: Node) -> bool:
    """A list or box of at least three links and no other words: a menu."""
    count = 0
    todo = list(node.kids)
    while todo:
        k = todo.pop()
        if isinstance(k, Node):
            if k.tag == "a":
                count += 1
            else:
                todo += k.kids
        elif k.strip(" \t\r\n|/>·•-–—»›"):
            return False
    return count >= 3


def _prune(node: Node, inside: bool) -> None:
    """Marks what the page itself says is no article."""
    for k in node.kids:
        if isinstance(k, Node):
            if k.tag in _NO_TEXT or k.tag in _BOILER or k.tag == "header" and not (inside and _has(k, {"h1", "h2"})) or k.tag in ("ul", "ol", "div", "section", "table") and _links_only(k):
                k.drop = True
            elif k.tag == "header":
                k.drop = False
            if not k.drop:
                _prune(k, inside or k.tag in ("article", "main"))


def _roots(node: Node, tag: str) -> list[Node]:
    out = []
    for k in node.kids:
        if isinstance(k, Node) and not k.drop:
            out += [k] if k.tag == tag else _roots(k, tag)
    return out


def content(root: Node) -> list[str]:
    """The blocks of the article, or of the page if nothing in it is one."""
    _prune(root, False)
    for tag in ("article", "main"):
        found = blocks(_roots(root, tag))
        if found:
            return found
    return blocks([root])


def blocks(roots: list[Node]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush():
        if line:
            text = " ".join("".join(line).split())
            if text:
                out.append(text)
            line.clear()

    def walk(node: Node):
        for k in node.kids:
            if not isinstance(k, Node):
                line.append(k)
            elif k.drop:
                if k.tag not in _INLINE:
                    flush()
            elif k.tag == "br":
                line.append(" ")
            elif k.tag in _INLINE:
                walk(k)
            else:
                flush()
                walk(k)
                flush()

    for r in roots:
        flush()
        walk(r)
    flush()
    return out


# --- wrappers: keys of constant blocks


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _elements(node: Node, out: list[Node]) -> list[Node]:
    """The elements of a node outside raw text; inline ones are part of their parent's text."""
    for k in node.kids:
        if k.__class__ is Node and not k.drop:
            if k.tag in _INLINE:
                _elements(k, out)
            else:
                out.append(k)
    return out


class Tree:
    """A page's tree for matching: of each node its label, text (leaves) and children, all under one key for equal ones.

    size is what a node adds to a matching with its equal; leaves are number, path, text and node of each leaf with text,
    layout the containers of the page."""

    def __init__(self, root: Node):
        self.nodes: list[tuple[str, str | None, list[int]]] = []
        self.key: list[int] = []
        self.size: list[int] = []
        self.leaves: list[tuple[int, str, str, Node]] = []
        boxes: set[str] = set()
        self.root = self._add(root, "", boxes)
        self.layout = " ".join(sorted(boxes))

    def _add(self, node: Node, path: str, boxes: set[str]) -> int:
        label = f"{node.tag}.{node.mark}"
        path = f"{path}/{label}"
        key, kids, text, size, number = self.key, [], None, 2, len(self.nodes)
        if elements := _elements(node, []):
            if node.tag in _BOXES:
                boxes.add(path)
            kids = [self._add(k, path, boxes) for k in elements]
            number, size = len(self.nodes), 1
            for k in kids:
                size += self.size[k]
        elif text := node.text():
            self.leaves.append((number, path, text, node))
        self.nodes.append((label, text, kids))
        key.append(hash((label, text, tuple([key[k] for k in kids]))))
        self.size.append(size)
        return number


def align(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the nodes of a and the nodes of b that they match, most in all (equal leaves count twice)."""
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    out: dict[int, int] = {}
    todo = [(a.root, b.root)] if _match(a, b, memo, a.root, b.root) else []
    while todo:
        x, y = todo.pop()
        out[x] = y
        if a.key[x] == b.key[y]:
            todo += zip(a.nodes[x][2], b.nodes[y][2], strict=True)
        elif more := memo.get((x, y)):
            todo += more[1]
    return out


def _match(a: Tree, b: Tree, memo: dict, x: int, y: int) -> int:
    """What the best matching of x and y counts; its pairs of children are in the memo, unless both are equal or one is a leaf."""
    if a.key[x] == b.key[y]:  # each node matches its equal
        return a.size[x]
    (label, _, kids), (other, _, kids_) = a.nodes[x], b.nodes[y]
    if label != other:
        return 0
    if not kids or not kids_:  # leaves of equal text are equal
        return 1
    if (x, y) in memo:
        return memo[x, y][0]
    ka, kb = [a.key[k] for k in kids], [b.key[k] for k in kids_]
    n, m, least = len(ka), len(kb), min(len(ka), len(kb))
    first = 0  # equal subtrees at both ends match each other in some best matching
    while first < least and ka[first] == kb[first]:
        first += 1
    tail = 0
    while tail < least - first and ka[-1 - tail] == kb[-1 - tail]:
        tail += 1
    pairs = [*zip(kids[:first], kids_[:first], strict=True), *zip(kids[n - tail :], kids_[m - tail :], strict=True)]
    total = 1
    for k, _ in pairs:
        total += a.size[k]
    u, v, ku, kv = kids[first : n - tail], kids_[first : m - tail], ka[first : n - tail], kb[first : m - tail]
    if u and v:
        score, more = _children(a, b, memo, u, v, ku, kv)
        total += score
    else:
        more = []
    memo[x, y] = total, pairs + more
    return total


def _children(a: Tree, b: Tree, memo: dict, u: list[int], v: list[int], ku: list[int], kv: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """The best matching of children in order: what it counts, its pairs."""
    us, vs = [a.nodes[k] for k in u], [b.nodes[k] for k in v]
    if len({x[0] for x in us + vs}) == 1 and (not any([x[2] for x in us]) or not any([x[2] for x in vs])) and set(ku).isdisjoint(kv):
        pairs = list(zip(u, v))  # noqa: B905  each two count 1: the first of one match those of the other
        return len(pairs), pairs
    if len(u) * len(v) > WIDE:
        return _wide(a, b, memo, u, v)
    size = a.size
    best = [[0] * (len(v) + 1)]
    for k, key, (label, _, kids) in zip(u, ku, us, strict=True):
        up, left, row = best[-1], 0, [0]
        for j, (other, _, kids_) in enumerate(vs):
            if up[j + 1] > left:
                left = up[j + 1]
            if label == other:
                if key == kv[j]:
                    score = up[j] + size[k]
                elif kids and kids_:
                    score = up[j] + _match(a, b, memo, k, v[j])
                else:
                    score = up[j] + 1
                if score > left:
                    left = score
            row.append(left)
        best.append(row)
    i, j, more = len(u), len(v), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            more.append((u[i], v[j]))
    return best[-1][-1], more


def _texts(t: Tree, nodes: list[int]) -> set[str]:
    """The texts of the leaves below."""
    out, todo = set(), list(nodes)
    while todo:
        _, text, kids = t.nodes[todo.pop()]
        if text is not None:
            out.add(text)
        todo += kids
    return out


def _kinds(t: Tree, nodes: list[int], shared: set[str], own: int, known: dict) -> list[int]:
    """Of each node its kind: nodes are of one kind if they differ in texts that the other side has nowhere alone."""

    def kind(x: int) -> int:
        label, text, kids = t.nodes[x]
        return known.setdefault((label, text if text is None or text in shared else own, tuple([kind(k) for k in kids])), len(known))

    return [kind(x) for x in nodes]


def _shapes(t: Tree, nodes: list[int], own: int) -> tuple[Tree, list[int]]:
    """A tree of the nodes' shapes, each once and with no text but `own`, and the shape of each node."""
    out, known = Tree.__new__(Tree), {}
    out.nodes, out.key, out.size = [], [], []

    def shape(x: int) -> int:
        label, text, kids = t.nodes[x]
        k = label, text if text is None else own, tuple([shape(c) for c in kids])
        if k not in known:
            known[k] = len(out.nodes)
            out.nodes.append((label, k[1], list(k[2])))
            out.key.append(hash((label, k[1], tuple([out.key[c] for c in k[2]]))))
            out.size.append(t.size[x])
        return known[k]

    return out, [shape(x) for x in nodes]


def _wide(a: Tree, b: Tree, memo: dict, u: list[int], v: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """_children for many: the table's rows one after another, of which some are kept; from each of these the rows behind it
    are made again, as bits that say where the best comes from.

    What two children count depends on their kinds alone, and without a text in common on their shapes alone."""
    n, m, known = len(u), len(v), {}
    shared = _texts(a, u) & _texts(b, v)
    rows, cols = _kinds(a, u, shared, 1, known), _kinds(b, v, shared, 2, known)
    (ta, ua), (tb, vb) = _shapes(a, u, 1), _shapes(b, v, 2)
    number: dict[int, int] = {}
    kinds: list[tuple[int, int]] = []  # kinds of v: a node of each and its shape
    holds: dict[str, list[int]] = {}
    for k, y, s in zip(cols, v, vb, strict=True):
        if k not in number:
            number[k] = len(kinds)
            for text in _texts(b, [y]) & shared:
                holds.setdefault(text, []).append(len(kinds))
            kinds.append((y, s))
    at, shaped = np.array([number[k] for k in cols]), np.array([s for _, s in kinds])
    have: dict[int, np.ndarray] = {}
    base: dict[int, np.ndarray] = {}
    scratch: dict = {}
    scratch_: dict = {}

    def match(a: Tree, b: Tree, memo: dict, x: int, y: int) -> int:
        if len(memo) > WIDE:
            memo.clear()
        return _match(a, b, memo, x, y)

    def counts(i: int) -> np.ndarray:
        """What child i of u counts with each of v (0 if they do not match)."""
        x, k, s = u[i], rows[i], ua[i]
        if k not in have:
            if s not in base:
                score = np.zeros(len(tb.nodes), np.int32)
                for y in set(vb):
                    score[y] = match(ta, tb, scratch_, s, y)
                if (len(base) + 1) * len(score) > KEPT:
                    base.clear()
                base[s] = score
            score = base[s][shaped]
            for j in {j for text in _texts(a, [x]) & shared for j in holds[text]}:
                score[j] = match(a, b, scratch, x, kinds[j][0])
            if (len(have) + 1) * len(kinds) > KEPT:
                have.clear()
            have[k] = score
        return have[k][at]

    def below(up: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros(m + 1, np.int32)
        np.maximum.accumulate(np.maximum(up[1:], up[:-1] + counts(i)), out=out[1:])
        return out

    apart = max(1, 4 * isqrt(n))
    row, kept = np.zeros(m + 1, np.int32), []
    for i in range(n):
        if i % apart == 0:
            kept.append(row)
        row = below(row, i)
    total, j, more = int(row[-1]), m, []
    for begin in range((n - 1) // apart * apart, -1, -apart):
        row, same = kept.pop(), []
        for i in range(begin, min(begin + apart, n)):
            up, row = row, below(row, i)
            same.append((np.packbits(row[1:] == up[1:]), np.packbits(row[1:] == row[:-1])))
        i = len(same)
        while i and j:
            up, left = same[i - 1]
            byte, bit = (j - 1) >> 3, 128 >> ((j - 1) & 7)
            if up[byte] & bit:
                i -= 1
            elif left[byte] & bit:
                j -= 1
            else:
                i, j = i - 1, j - 1
                more.append((u[begin + i], v[j]))
    for x, y in more:  # their own children's pairs
        _match(a, b, memo, x, y)
    return total, more


def placed(root: Node, model: Tree | None) -> tuple[str, list[tuple[str, str, str, Node]]]:
    """Layout (its hash) of a page, and of each leaf block: place by alignment (else by path), path, text, node."""
    tree = Tree(root)
    layout = f"/{_hash(tree.layout)}"
    if model is None:
        return layout, [(path, path, text, node) for _, path, text, node in tree.leaves]
    to = align(tree, model)
    return layout, [(f"@{to[n]}" if n in to else path, path, text, node) for n, path, text, node in tree.leaves]


def _keys(layout: str, place: str, path: str, text: str) -> tuple[int, int]:
    """Keys of a block for all pages of the host (by alignment) and for those of its layout (by path)."""
    return _hash("", place, text), _hash(layout, path, text)


def counted(text: str, model: Tree | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Long blocks of a page, longest first, as (its two keys, text), and (group, key) of its blocks and, key like
    group, of the page itself."""
    layout, found = placed(parse(text), model)
    longest: dict[str, tuple[int, int]] = {}
    groups = _hash(""), _hash(layout)
    keys = {*zip(groups, groups, strict=True)}
    for place, path, t, _ in found:
        two = _keys(layout, place, path, t)
        longest.setdefault(t, two)
        keys.update(zip(groups, two, strict=True))
    order = sorted(longest, key=lambda t: (-len(t), t))
    long = [t for t in order if t.count(" ") >= LONG - 1] or order[:1]  # blanks are single ones
    return [(*longest[t], _hash(t)) for t in long], list(keys)


def induce(pages: list[str]) -> set[int] | None:
    """The wrapper of pages of one host, the first being the model (None if nothing is constant)."""
    model = Tree(parse(pages[0])) if pages else None
    every = [counted(text, model) for text in pages]
    n = Counter(x for _, keys in every for x in keys)
    often = {k for (g, k), m in n.items() if k != g and m >= MOST_FEW and m >= CONSTANT * n[g, g]}
    have: dict[tuple[int, int], set[tuple[int, ...]]] = {}
    for long, keys in every:
        article = tuple(([t for a, b, t in long if a not in often and b not in often] or [t for *_, t in long])[:3])
        for x in keys:
            have.setdefault(x, set()).add(article)
    return {k for (g, k), a in have.items() if k != g and len(a) >= MOST_FEW and len(a) >= CONSTANT * len(have[g, g])} or None


def extract(text: str, wrapper: set[int] | None, model: Tree | None = None) -> str:
    root = parse(text)
    if wrapper:
        layout, found = placed(root, model)
        for place, path, t, node in found:
            if not wrapper.isdisjoint(_keys(layout, place, path, t)):
                node.drop = True
    return "\n".join(content(root))


class _Known:
    """What a task keeps of the hosts it has seen, at most 300."""

    def __init__(self, make):
        self.make, self.have = make, {}

    def get(self, host_, value):
        if host_ not in self.have:
            if len(self.have) >= 300:
                self.have.clear()
            self.have[host_] = self.make(value)
        return self.have[host_]


def _model(page: str | None) -> Tree | None:
    if not page:
        return None
    tree = Tree(parse(page))
    tree.leaves.clear()  # they hold the page's nodes; pages are aligned with numbers alone
    return tree


def _counted(batches):
    models = _Known(_model)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [counted(page, models.get(host_, model.as_py() if host_ not in models.have else None)) for host_, page, model in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True)]
            long, keys = (_structs([x[i] for x in found], names) for i, names in enumerate((("a", "b", "t"), ("g", "k"))))
            yield pa.record_batch([part.column(0), long, keys], names=["host", "long", "keys"])


def _structs(rows: list[list[tuple[int, ...]]], names: tuple[str, ...]) -> pa.Array:
    at = [0, *accumulate(map(len, rows))]
    flat = [pa.array([x[i] for r in rows for x in r], pa.int64()) for i in range(len(names))]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(flat, names))


def _extract(batches):
    wrappers, models = _Known(lambda x: set(x.as_py())), _Known(lambda x: _model(x.as_py()))
    for batch in batches:
        texts = []
        for page, host_, wrapper, model in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
            texts.append(extract(page or "", wrappers.get(host_, wrapper), models.get(host_, model)) if wrapper.is_valid else extract(page or "", None))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars."""
    cuts = Cuts(pages.sparkSession)
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host(F.col(url_col)).alias("host"))
    full = rows.where(F.length("html") > 0).select("host", "html")
    # the model of each host: its page of smallest id (the largest html of these)
    firsts = cuts.cut(rows.where(F.length("html") > 0).groupBy("host").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("size")))
    near = F.broadcast if firsts.count() <= BROADCAST_WRAPPERS else (lambda x: x)
    models = cuts.cut(rows.where(F.length("html") > 0).join(near(firsts), ["host", "_id"]).groupBy("host").agg(F.max("html").alias("model"), F.max("size").alias("size")))
    sent = models.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("model")), F.lit(0)).alias("b")).first()
    with_model = (lambda df: df.join(F.broadcast(models.drop("size")), "host", "left")) if sent["b"] <= 16 << 20 else (lambda df: lookup_join(df, models, "host", "size"))
    weight = full.groupBy("host").agg(F.count(F.lit(1)).alias("size"))

    def constant(n: DataFrame) -> DataFrame:
        """Sets of keys of each host that enough of n (host, g, k, n) have; cut."""
        n = cuts.cut(n.where(F.col("n") >= MOST_FEW))
        total = n.where("g = k").select("host", "g", F.col("n").alias("total"))
        kept = n.where("g <> k").join(total, ["host", "g"]).where(F.col("n") >= CONSTANT * F.col("total"))
        return cuts.cut(kept.groupBy("host").agg(F.collect_set("k").alias("wrapper")))

    def with_sets(df: DataFrame, sets: DataFrame) -> DataFrame:
        size = sets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("wrapper") * 8 + F.octet_length("host")), F.lit(0)).alias("b")).first()
        if size["n"] <= BROADCAST_WRAPPERS and size["b"] <= 16 << 20:
            return df.join(F.broadcast(sets), "host", "left")
        return lookup_join(df, weight.join(sets, "host"), "host", "size")

    found = with_model(full).select("host", "html", "model").mapInArrow(_counted, "host string, long array<struct<a:long,b:long,t:long>>, keys array<struct<g:long,k:long>>")
    found = cuts.cut(found)  # pages are parsed once: their keys are counted by page, then by article
    n = F.count(F.lit(1)).alias("n")
    often = constant(found.select("host", F.explode("keys").alias("x")).groupBy("host", "x.g", "x.k").agg(n))
    known = with_sets(found, often)
    other = F.filter("long", lambda x: ~F.coalesce(F.array_contains("wrapper", x["a"]) | F.array_contains("wrapper", x["b"]), F.lit(False)))
    article = F.xxhash64(F.transform(F.slice(F.when(F.size(other) > 0, other).otherwise(F.col("long")), 1, 3), lambda x: x["t"]))
    once = known.select("host", article.alias("article"), F.explode("keys").alias("x")).select("host", "x.g", "x.k", "article").distinct()
    wrappers = constant(once.groupBy("host", "g", "k").agg(n))
    cuts.drop(found, often)
    joined = with_sets(rows, wrappers)
    out = with_model(joined.select("_id", "url", "html", "host", "wrapper")).select("_id", "url", "html", "host", "wrapper", "model").mapInArrow(_extract, "_id long, url string, text string, n_chars long")
    return out.select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias(id_col), "url", "text", "n_chars")
