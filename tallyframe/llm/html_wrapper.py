"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page is parsed to a tree of blocks (`parse`). The induction deals with
any page on its own, so a host's pages may lie in any number of tasks and in any order:

1. `trees` and `wrappers`: the shapes of a host's pages are counted, copies of a page once. The most frequent shape is a wrapper, and so is
   each other one that `rare` of the host's pages have, and twice `least` pages; equal counts go by the shape's hash.
2. `evidence`: each page is aligned by simple tree matching to that wrapper of its host that most of its nodes match. Two
   nodes match if their labels are the same, and their children are matched in order so that most nodes match. Runs of list
   items, paragraphs and cells count as one repeated node, whose members give evidence too. What is matched is added
   up by slot, the node of the wrapper: the texts, the words, the words outside links and those inside.
3. `models` and `extract`: a text that is the same in a slot on `share` of a wrapper's pages, and on `least` of them, is
   template. The slots that vary are content; of them, the deepest container that holds MAIN of the varying words outside
   links is the host's article, with a varying main heading that stands before it. Slots whose words are mostly links, and
   pieces of the article that are marked as something else, go.

Marks (tags and class names of menus, notices, adverts, comments and the like) say nothing about an element that holds an
article or most of its page's words. Where a host has fewer than `least` distinct pages, or a page matches no wrapper by half,
they and the marks of articles decide alone.

Defined cases: a null, empty or broken page gives what text can be read from it, the empty string if none. A null url
is a host of its own. Repeated pages get equal results. An empty table gives an empty result. Columns beyond id, url and
html are not read. Elements may be nested to any depth and have any number of children. A task holds a page's tree.
"""

from __future__ import annotations

import html as entities
import json
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import discard_read, lookup, map_arrow, quoted, saved, scratch, table

#: Share of a node's words that its main child must hold, and share of links beyond which a slot is a menu.
MAIN, LINKS = 0.8, 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot option legend".split())
REPEATED = frozenset("p li dt dd tr td th h2 h3 h4 h5 h6 option".split())
#: What a repeated element may hold; one that holds anything else, as the cell of a layout does, stands for itself.
PLAIN = REPEATED | frozenset(("ul", "ol", "dl"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "body": set()}
#: Elements in which an article may be; others are parts of one.
CONTAINERS = frozenset("#document html body div section article main center table tbody tr td form fieldset blockquote dl details".split())

#: Elements without text for readers, and those that by their tag are no article.
SILENT = frozenset("head script style noscript template iframe svg math canvas object audio video button select input textarea label".split())
ASIDE = frozenset("nav aside footer dialog menu".split())
#: Words that as a class, id or role mark what is no article, alone or at the end of a compound; those of OPENING at its start too.
MARKS = frozenset("nav navbar navigation menu sidebar aside footer masthead breadcrumb breadcrumbs ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr alert popup modal newsletter subscribe subscription share sharing social related recommended comment comments commentlist disqus respond reply replies widget toolbar pagination pager login signup search copyright skip contentinfo complementary".split())
OPENING = frozenset("ad ads advert cookie newsletter nav sidebar footer comment comments share social sponsor promo breadcrumb menu".split())
WITHOUT = frozenset("no has with without is not".split())
ARTICLE_WORDS = frozenset("article articlebody post entry story maincontent content main".split())

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_PLAIN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")


def _hash(*parts: int) -> int:
    """A signed 64-bit hash of signed numbers."""
    value = xxhash.xxh3_64_intdigest(struct.pack(f"<{len(parts)}q", *parts))
    return value - (1 << 64) if value >> 63 else value


def text_hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


class Node:
    """An element that holds blocks. items: texts and nodes, in order.

    mark: what its marks say: 0 nothing, 1 no article by its names, 2 no article by its tag, 3 not shown. article: how surely
    they say it's one. sig: a hash of its text, 0 if none. words, links: words of its text, and those of them in links; apart: words outside links in
    parts that are marked. plain: whether it may be a member of a run.
    """

    __slots__ = ("apart", "article", "depth", "inline", "items", "label", "links", "mark", "plain", "shape", "sig", "size", "slot", "tag", "words")

    def __init__(self, tag: str, label: str, depth: int, mark: int = 0, article: int = 0, inline: bool = False):
        self.tag, self.label, self.depth, self.mark, self.article, self.inline = tag, label, depth, mark, article, inline
        self.items: list[str | Node] = []
        self.shape = self.sig = self.words = self.links = self.apart = 0
        self.size, self.slot, self.plain = 1, -1, tag in PLAIN

    @property
    def nodes(self) -> list[Node]:
        return [x for x in self.items if x.__class__ is Node]

    @property
    def run(self) -> bool:
        return self.label.endswith("*")


def _marked(token: str) -> bool:
    """Whether a class, id or role names something that is no article."""
    words = _WORDS.findall(token)
    return bool(words) and (words[-1] in MARKS and words[0] not in WITHOUT or words[0] in OPENING)


@lru_cache(maxsize=4096)
def _described(tag: str, raw: str) -> tuple[str, int, int]:
    """The label of an element, its mark, and how surely its marks say that it's an article."""
    names, words, hidden, article = [], set(), False, {"article": 3, "main": 2}.get(tag, 0)
    for key, value in _ATTRIBUTE.findall(raw) if raw else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            names += value.split()
            words |= set(_WORDS.findall(value))
        elif key == "itemprop" and value == "articlebody":
            article = 3
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    if hidden or tag in SILENT:
        mark = 3
    elif tag in ASIDE:
        mark = 2
    elif tag == "form":
        mark = 1
    else:
        mark = int(tag not in ("html", "body", "main", "article") and any(map(_marked, names)))
    if not article and not mark and tag in BLOCK and tag not in ("html", "body") and words & ARTICLE_WORDS:
        article = 1
    return ".".join([tag, *sorted(set(names))]).replace("*", "+"), mark, article


def parse(page: str | None) -> Node:
    """The tree of a page."""
    page = page or ""
    root = Node("#document", "#document", 0)
    stack, at, pattern = [root], 0, _TAG
    opened, link = Counter(), 0  # open elements by tag; the size of the stack where a link is open

    def text(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            stack[-1].items.append(piece)
            if link:
                stack[-1].links += len(piece.split())

    def close(to: int) -> None:
        nonlocal link
        while len(stack) > to:
            node = stack.pop()
            opened[node.tag] -= 1
            _finish(node)
        if link > len(stack):
            link = 0

    def close_last(tags: set[str], stops: frozenset[str] | set[str] = frozenset()) -> bool:
        """Closes the innermost open element of these tags, unless one of stops is open inside it."""
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    close(i)
                    return True
                if stack[i].tag in stops:
                    break
        return False

    stops_p = frozenset(("td", "th", "div", "article", "section", "body", "li", "blockquote"))
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        found = pattern.match(page, start)
        if not found and pattern is _TAG and _PLAIN.match(page, start):
            pattern = _PLAIN  # a quote that isn't closed: from here on tags end at the next >
            found = pattern.match(page, start)
        if not found:
            if re.match("</?[a-zA-Z]", page[start : start + 3]):
                break  # the page ends inside a tag
            text("<")
            at = start + 1
            continue
        at = found.end()
        end, tag, raw = found.groups()
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if end else len(stack)
            close_last({"a"})
        if end:
            close_last({tag})
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in RAW:
            last = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = last.start() if last else len(page)
            over = page.find(">", stop)
            at = len(page) if over < 0 else over + 1
            continue
        if tag in ENDS_P:
            close_last({"p"}, stops_p)
        if tag in CLOSES:
            while close_last(CLOSES[tag], SCOPES[tag]) and tag == "tr":
                pass
        if tag in VOID:
            if tag == "hr":
                stack[-1].items.append(Node("hr", "hr", len(stack)))
                _finish(stack[-1].items[-1])
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        apart = tag not in BLOCK and tag != "head"
        if apart and tag not in SILENT and not _ATTRIBUTE.search(raw):
            continue
        label, mark, article = _described(tag, raw)
        if tag == "header" and not mark and not any(opened[t] for t in ("article", "main")) and not any(n.article for n in stack):
            mark = 2
        if apart and (not mark or raw.rstrip().endswith("/")):
            continue  # inline elements' text belongs to their block
        node = Node(tag, label, len(stack), mark, article, apart)
        stack[-1].items.append(node)
        stack.append(node)
        opened[tag] += 1
    close(0)
    _unmark(root)
    return root


def _flushed(parts: list[str]) -> str:
    whole = " ".join("".join(parts).split()) if parts else ""
    parts.clear()
    return whole


def _finish(node: Node) -> None:
    """Gathers a node's repeated children, and finds its shape, size, words and signature."""
    parts: list[str] = []
    items: list[str | Node] = []
    shapes, sigs = [_label_hash(node.label)], []
    last: Node | None = None  # the node before, if only blanks stand between

    def ended() -> None:
        if whole := _flushed(parts):
            sigs.append(text_hash(whole))
            node.words += whole.count(" ") + 1

    for x in node.items:
        if x.__class__ is str:
            parts.append(x)
            items.append(x)
            last = last if not x.strip() else None
            continue
        if x.inline or x.mark == 3:
            if not x.inline:
                ended()
                items.append(x)
            continue
        ended()
        if x.sig:
            sigs.append(x.sig)
        node.words, node.links, node.plain = node.words + x.words, node.links + x.links, node.plain and x.plain
        if x.plain and x.tag in REPEATED:
            if last is None or last.label != x.label + "*":
                last = Node(x.tag, x.label + "*", x.depth)
                last.shape = _label_hash(last.label)
                items.append(last)
                node.size += 1
                shapes.append(last.shape)
            last.items.append(x)
            last.words, last.links, last.sig = last.words + x.words, last.links + x.links, _hash(last.sig, x.sig) if last.sig or x.sig else 0
            continue
        items.append(x)
        node.size += x.size
        shapes.append(x.shape)
        last = x
    ended()
    node.links = min(node.links, node.words)
    node.items, node.shape, node.sig = items, _hash(*shapes), _hash(*sigs) if sigs else 0


@lru_cache(maxsize=4096)
def _label_hash(label: str) -> int:
    return text_hash(label)


def _unmark(root: Node) -> None:
    """Takes back marks that can't be, where the page has no article outside what is marked: of what holds an article, or by its names most words of the page."""
    order, free, todo = [], 0, [(root, 0)]
    while todo:
        node, over = todo.pop()
        over = max(over, node.mark)
        order.append(node)
        free = free if over else max(free, node.article)
        todo += [(x, over) for x in node.nodes]
    holds: dict[int, int] = {}
    for node in reversed(order):
        holds[id(node)] = max([node.article, *[holds[id(x)] for x in node.nodes]])
        most = not free and 2 * (node.words - node.links) > root.words - root.links
        if node.mark in (1, 2) and (free < 2 <= holds[id(node)] or node.mark == 1 and most):
            node.mark = 0
        node.apart = sum([x.words - x.links if x.mark in (1, 2) else x.apart for x in node.nodes if x.mark != 3])


def children(node: Node) -> list[Node]:
    """The nodes under a node that an alignment goes on to; the members of a run are not among them."""
    return [] if node.run else [x for x in node.nodes if x.mark != 3]


def _value(a: Node, b: Node, known: dict[tuple[int, int], int]) -> int:
    return 0 if a.label != b.label else a.size if a.shape == b.shape else known[a.shape, b.shape]


def matching(a: Node, b: Node, known: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: the most nodes of a and b that match in order, under matching parents.

    known: found so far, by shapes. What lies deeper is found first, by a list of what to do, as trees may be deep.
    """
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        key = (p.shape, q.shape)
        if p.label == q.label and p.shape != q.shape and key not in known:
            x, y = children(p), children(q)
            first, last = _ends(x, y)
            rows, columns = ({n.shape: n for n in part}.values() for part in (x[first : len(x) - last], y[first : len(y) - last]))
            need = [(u, v) for u in rows for v in columns if u.label == v.label and u.shape != v.shape and (u.shape, v.shape) not in known]
            if need:
                todo += need
                continue
            known[key] = 1 + sum([n for _, _, n in _matched(x, y, known)])
        todo.pop()
    return _value(a, b, known)


def _ends(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """How many nodes at the start and at the end of both lists have equal shapes."""
    first, most = 0, min(len(x), len(y))
    while first < most and x[first].shape == y[first].shape:
        first += 1
    last = 0
    while last < most - first and x[-1 - last].shape == y[-1 - last].shape:
        last += 1
    return first, last


def _matched(x: list[Node], y: list[Node], known: dict[tuple[int, int], int]) -> list[tuple[Node, Node, int]]:
    """The pairs of nodes of two lists that match best in order, with the nodes that match in each; all their matches are known.

    Nodes of equal shape at the ends of both lists are matched at once: no other match holds more. The rest is a table of
    which only steps are kept, in a quarter of a byte a cell, and halved where even that were large.
    """
    first, last = _ends(x, y)
    same = [(p, q, p.size) for p, q in zip(x[:first], y[:first])]
    tail = [(p, q, p.size) for p, q in zip(x[len(x) - last :], y[len(y) - last :])]
    return same + _tabled(x[first : len(x) - last], y[first : len(y) - last], known) + tail


def _gains(x: list[Node], y: list[Node], known: dict[tuple[int, int], int]) -> Iterator[np.ndarray]:
    """For each node of x, the nodes that match between it and each of y; equal shapes are compared once."""
    shapes = {n.shape: n for n in y}
    place = {s: i for i, s in enumerate(shapes)}
    at = np.fromiter((place[n.shape] for n in y), np.int64, len(y))
    rows: dict[int, np.ndarray] = {}
    for p in x:
        if p.shape not in rows:
            rows[p.shape] = np.array([_value(p, q, known) for q in shapes.values()], np.int64)
        yield rows[p.shape][at]


def _totals(x: list[Node], y: list[Node], known: dict[tuple[int, int], int]) -> np.ndarray:
    """The nodes that match between x and each beginning of y."""
    best = np.zeros(len(y) + 1, np.int64)
    for gain in _gains(x, y, known):
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + gain))
    return best


#: Cells of a table of matches whose steps are kept at once.
CELLS = 1 << 27


def _tabled(x: list[Node], y: list[Node], known: dict[tuple[int, int], int]) -> list[tuple[Node, Node, int]]:
    if not x or not y:
        return []
    if len(x) * len(y) > CELLS and len(x) > 1:  # halves of x with the parts of y that suit them, in space for a row
        half = len(x) // 2
        best = _totals(x[:half], y, known) + _totals(x[half:][::-1], y[::-1], known)[::-1]
        cut = int(best.argmax())
        return _tabled(x[:half], y[:cut], known) + _tabled(x[half:], y[cut:], known)
    best, up, left = np.zeros(len(y) + 1, np.int64), [], []
    for gain in _gains(x, y, known):
        above, best = best, np.empty_like(best)
        best[0] = 0
        best[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gain))
        up.append(np.packbits(best == above))
        left.append(np.packbits(best[1:] == best[:-1]))
    out, i, j = [], len(x), len(y)
    while i and j:
        if up[i - 1][j >> 3] >> (7 - (j & 7)) & 1:
            i -= 1
        elif left[i - 1][(j - 1) >> 3] >> (7 - ((j - 1) & 7)) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((x[i], y[j], _value(x[i], y[j], known)))
    return out[::-1]


def aligned(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The pairs of nodes that simple tree matching aligns."""
    if a.label != b.label:
        return []
    known: dict[tuple[int, int], int] = {}
    matching(a, b, known)
    out, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        out.append((p, q))
        x, y = children(p), children(q)
        todo += zip(x, y) if p.shape == q.shape else [(u, v) for u, v, n in _matched(x, y, known) if n]
    return out


def skeleton(root: Node) -> str:
    """A tree's labels in order, each with its depth: what an alignment needs of a wrapper."""
    lines, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        lines.append(f"{depth} {node.label}")
        todo += [(x, depth + 1) for x in reversed(children(node))]
    return "\n".join(lines)


def wrapper_of(text: str) -> Node:
    """The tree of a skeleton; slots are numbers in order."""
    path: list[Node] = []
    for slot, line in enumerate(text.split("\n")):
        depth, label = line.split(" ", 1)
        node = Node(re.split(r"[.*]", label, maxsplit=1)[0], label, int(depth))
        node.slot = slot
        while len(path) > node.depth:
            _shaped(path.pop())
        if path:
            path[-1].items.append(node)
        path.append(node)
    root = path[0]
    while path:
        _shaped(path.pop())
    return root


def _shaped(node: Node) -> None:
    """Shape and size of a wrapper's node, as _finish() gives them to a page's."""
    node.size = 1 + sum([x.size for x in node.items])
    node.shape = _label_hash(node.label) if node.run else _hash(_label_hash(node.label), *[x.shape for x in node.items])


def flat(root: Node) -> list[Node]:
    """The nodes that an alignment sees, in the order of a skeleton."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += reversed(children(node))
    return found


def placed(wrappers: list[Node], root: Node) -> tuple[int, list[int]]:
    """Aligns a page to the wrapper that most of its nodes match, of equal ones the first: its number, and the slots of flat(root), -1 for none.

    The number is -1 if none matches half of the nodes of both.
    """
    best, chosen = 0.0, -1
    for k, w in enumerate(wrappers):
        match = 2 * matching(w, root, {}) / (w.size + root.size)
        if match > best:
            best, chosen = match, k
    if best < 0.5:
        return -1, []
    slots = {id(b): a.slot for a, b in aligned(wrappers[chosen], root)}
    return chosen, [slots.get(id(n), -1) for n in flat(root)]


def members(node: Node) -> list[Node]:
    return node.nodes if node.run else []


def signature(wrapper: int, slot: int, sig: int, member: bool = False) -> int:
    """A hash of a text in a slot, or of a member's in the run there."""
    return _hash(wrapper, slot, sig, member)


class _Kept(dict):
    """The models that a task has met, by their text; it starts afresh beyond `most` characters."""

    def __init__(self, most: int = 1 << 25):
        self.most = self.left = most

    def __missing__(self, text: str | None) -> HostModel:
        if self.left < 0:
            self.clear()
            self.left = self.most
        self.left -= len(text or "") + 100
        self[text] = HostModel(text)
        return self[text]


class HostModel:
    """The wrappers of a host, and of each which slots are the article, which are menus, and which texts are template."""

    def __init__(self, text: str | None):
        self.parts = json.loads(text) if text else []
        self.wrappers = [wrapper_of(p["skeleton"]) for p in self.parts]
        self.main = [frozenset(p.get("main", ())) for p in self.parts]
        self.menus = [frozenset(p.get("menus", ())) for p in self.parts]
        self.template = [frozenset(p.get("template", ())) for p in self.parts]
        self.known: dict[int, tuple[int, list[int]]] = {}

    def place(self, shape: int, tree: Callable[[], Node]) -> tuple[int, list[int]]:
        """placed() for a page of this shape, which is aligned once."""
        if shape not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[shape] = placed(self.wrappers, tree())
        return self.known[shape]


def main_slots(wrapper: Node, slots: dict[int, tuple[int, int, int]], varying: set[int]) -> list[int]:
    """The slots of the article: the deepest container with MAIN of the words of each that it is in, and a varying h1 before it.

    slots: pages, words outside links and words in links by slot, template left out. varying: slots with text that is no template.
    """
    prose = lambda n: slots.get(n.slot, (0, 0, 0))[1]
    node, above = wrapper, []
    if not prose(node):
        return []
    while True:
        inner = [x for x in node.items if x.tag in CONTAINERS and not x.run]
        best = max(inner, key=lambda x: (prose(x), -x.slot), default=None)
        if best is None or node.tag in ("article", "main") or prose(best) < MAIN * prose(node):
            break
        above += [x for x in node.items if x.slot < best.slot]
        node = best
    heads = []
    while above:
        x = above.pop()
        if x.tag == "h1" and x.slot in varying:
            heads.append(x.slot)
        above += [y for y in x.items if x.tag in CONTAINERS or x.tag in ("header", "hgroup")]
    return [*([max(heads)] if heads else []), node.slot]


def blocks(root: Node, model: HostModel | None = None) -> list[str]:
    """The blocks of a page's article."""
    chosen, slots = model.place(root.shape, lambda: root) if model and model.wrappers else (-1, [])
    for node, slot in zip(flat(root) if slots else (), slots):
        node.slot = slot
    places: list[Node] = []
    if chosen >= 0 and model.main[chosen]:
        todo = [root]
        while todo:
            node = todo.pop()
            if node.slot in model.main[chosen]:
                places.append(node)
            else:
                todo += reversed(children(node))
    out: list[str] = []
    if places:
        for place in places:
            _walk(place, out, chosen, model)
        return out
    for place in _by_marks(root):
        _walk(place, out, chosen, model)
    return out


def _by_marks(root: Node) -> list[Node]:
    """The nodes that a page marks as its article, or the whole page."""
    best, places, todo = 0, [], [root]
    while todo:
        node = todo.pop()
        if node.mark or node.inline:
            continue
        if node.article > best:
            best, places = node.article, []
        if node.article == best and best:
            places.append(node)
            if best == 3:
                continue  # articles within an article are part of it
        todo += reversed(node.nodes)
    if best == 1:  # named as an article only: the innermost that holds most of what any of them holds
        most = max(n.words for n in places)
        return [max((n for n in places if 10 * n.words >= 7 * most), key=lambda n: n.depth)]
    return (places[:1] if best == 2 else places) or [root]


def _walk(place: Node, out: list[str], wrapper: int, model: HostModel | None) -> None:
    """Adds the blocks under a node, without template, menus and what is marked as something else."""
    template, menus = (model.template[wrapper], model.menus[wrapper]) if wrapper >= 0 else (frozenset(), frozenset())
    parts: list[str] = []
    todo: list[str | Node | None] = [place]

    def flush() -> None:
        if whole := _flushed(parts):
            out.append(whole)

    while todo:
        x = todo.pop()
        if x.__class__ is str:
            parts.append(x)
            continue
        flush()
        if x is None:
            continue
        if x.mark and x is not place or x.slot >= 0 and (x is not place and x.slot in menus or template and x.sig and signature(wrapper, x.slot, x.sig) in template):
            continue
        inner: list[str | Node | None] = x.items
        if template and x.run and x.slot >= 0:
            inner = [m for m in members(x) if not (m.sig and signature(wrapper, x.slot, m.sig, True) in template)]
        todo.append(None)  # a block ends where its element ends
        todo += reversed(inner)
    flush()


def host_of(url: str | None) -> str:
    """The host of a url in lower case, without user and port."""
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def host_column(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: What pages are in short: a node's text, words outside links and in links by its place, and the texts of the members of runs.
_TREES = "host string, shape long, page long, skeleton string, sigs array<long>, prose array<long>, links array<long>, run array<int>, member array<long>"


def trees(pages: DataFrame) -> DataFrame:
    """_TREES of pages (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _TREES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                root = parse(page.as_py())
                nodes = flat(root)
                inner = [(i, x.sig) for i, n in enumerate(nodes) for x in members(n) if x.sig]
                rows.append((host, root.shape, root.sig, skeleton(root), [n.sig for n in nodes], [n.words - n.links - n.apart for n in nodes], [n.links for n in nodes], [i for i, _ in inner], [x for _, x in inner]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return map_arrow(pages, run, _TREES)


def wrappers(seen: DataFrame, least: int, rare: float) -> DataFrame:
    """(host, model): the skeletons of the wrappers of hosts with `least` distinct pages, as the JSON of a HostModel."""
    counts = seen.select("host", "shape", "page").distinct().groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    shapes = saved(counts, "html-shapes")
    hosts = shapes.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "shape")).alias("first")).filter(F.col("pages") >= least)
    wide = lookup(shapes, saved(hosts, "html-hosts"), ["host"], "inner")
    often = (F.col("n") >= 2 * least) & (F.col("n") >= rare * F.col("pages"))  # 1 / rare of them at most
    kept = wide.filter(often | (F.col("shape") == F.col("first.shape"))).select("host", "shape", "n")
    text = seen.groupBy("host", "shape").agg(F.min("skeleton").alias("skeleton"))  # one of each shape
    ordered = F.sort_array(F.collect_list(F.struct("n", "shape", "skeleton")), asc=False)
    one = F.transform(ordered, lambda x: F.struct(x.skeleton.alias("skeleton")))
    return saved(kept.join(text, ["host", "shape"]).groupBy("host").agg(F.to_json(one).alias("model")), "html-wrappers")


def evidence(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(host, wrapper, slot, sig, n, prose, links): what the slots of wrappers hold, each distinct page counted once; slot -1 stands for the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept()
        for batch in batches:
            hosts, rows = [], []
            for host, shape, page, text, sigs, prose, links, runs, inner, model in zip(*(c.to_pylist() for c in batch.columns)):
                chosen, slots = kept[model].place(shape, lambda text=text: wrapper_of(text))
                if chosen < 0:
                    continue
                found = [(chosen, page, -1, 0, 0, 0)]
                found += [(chosen, page, slot, signature(chosen, slot, sig), p, k) for slot, sig, p, k in zip(slots, sigs, prose, links) if slot >= 0 and sig]
                found += [(chosen, page, slots[i], signature(chosen, slots[i], sig, True), 0, 0) for i, sig in zip(runs, inner) if slots[i] >= 0]
                hosts += [host] * len(found)
                rows += found
            columns = [pa.array(hosts, pa.string()), *[pa.array(c, pa.int64()) for c in (np.array(rows, np.int64).reshape(-1, 6)).T]]
            yield pa.RecordBatch.from_arrays(columns, ["host", "wrapper", "page", "slot", "sig", "prose", "links"])

    rows = lookup(seen, known, ["host"], "inner")
    told = map_arrow(rows, run, "host string, wrapper long, page long, slot long, sig long, prose long, links long")
    once = told.groupBy("host", "wrapper", "page", "slot", "sig").agg(F.max("prose").alias("prose"), F.max("links").alias("links"))
    return once.groupBy("host", "wrapper", "slot", "sig").agg(F.count(F.lit(1)).alias("n"), F.sum("prose").alias("prose"), F.sum("links").alias("links"))


def models(pages: DataFrame, share: float, least: int, rare: float) -> DataFrame:
    """(host, model): a HostModel as JSON, for each host with `least` distinct pages."""
    parsed = saved(trees(pages), "html-trees")
    known = wrappers(parsed, least, rare)
    seen = saved(evidence(parsed, known), "html-evidence")
    discard_read(parsed)
    whole = saved(seen.filter(F.col("slot") == -1).select("host", "wrapper", F.col("n").alias("pages")).filter(F.col("pages") >= least), "html-aligned")
    told = lookup(seen.filter(F.col("slot") >= 0), whole, ["host", "wrapper"], "inner")
    constant = (F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))
    of = lambda c: F.sum(F.when(~constant, F.col(c)).otherwise(F.lit(0)))
    slots = told.groupBy("host", "wrapper", "slot").agg(of("n").alias("n"), of("prose").alias("prose"), of("links").alias("links"), F.collect_list(F.when(constant, F.col("sig"))).alias("template"))
    # a host has as many slots as its wrappers have nodes, and texts that are template on as many as its share allows
    rows = slots.groupBy("host").agg(F.collect_list(F.struct("wrapper", "slot", "n", "prose", "links", "template")).alias("slots"))
    rows = known.join(rows.withColumnRenamed("host", "of"), F.col("host") == F.col("of")).select("host", "model", "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_decided(text, found.as_py()) for text, found in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "model"])

    return saved(map_arrow(rows, run, "host string, model string"), "html-models")


def _decided(text: str, slots: list[dict]) -> str:
    """The JSON of a host's model, from its wrappers and what their slots hold."""
    model = HostModel(text)
    for k, (part, wrapper) in enumerate(zip(model.parts, model.wrappers)):
        mine = {s["slot"]: s for s in slots if s["wrapper"] == k}
        held = {i: (s["n"], s["prose"], s["links"]) for i, s in mine.items()}
        part["main"] = main_slots(wrapper, held, {i for i, s in mine.items() if s["n"]})
        part["menus"] = sorted(i for i, (_, prose, links) in held.items() if links >= LINKS * (prose + links) > 0)
        part["template"] = sorted(t for s in mine.values() for t in s["template"])
    return json.dumps(model.parts)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.5, least: int = 4, rare: float = 0.1) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, blocks joined by an empty line."""
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"), host_column(quoted(url_col)).alias("host"))
    with scratch(pages.sparkSession) as keep:
        joined = keep(lookup(rows, models(rows.select("host", "html"), share, least, rare), ["host"]).select("page_id", "url", "html", "model"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept()
        for batch in batches:
            texts = []
            for page, text in zip(batch.column(2), batch.column(3).to_pylist()):
                texts.append("\n\n".join(blocks(parse(page.as_py()), kept[text])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(joined, run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
