"""Main text of pages by union-free wrapper inference.

A page's tag stream becomes a tree of block elements with text slots; inline markup stays inside a slot. Its own
repetitions are folded first (same-label neighbours, and runs of any period), which gives a skeleton. The
distinct skeletons of a host, few even where a host has a third of all pages, are aligned one after another: a slot
meets a slot, elements of one label are aligned recursively, longest common subsequences match siblings, and what has
no partner becomes optional. The outcome is the host's wrapper, a regular expression of sequences, optional and
repeated groups and slots without unions. Skeletons are merged in a tree of groups of about FAN, so no task gets all
of a host. Every slot of the wrapper carries the figures of all pages that meet there, and they decide first:

* a slot whose text is the same in all of at least ALIKE pages is template, unless the host's pages are copies; one
  that is mostly links is a menu; the others are data;
* the region of the main text is the deepest part of the wrapper that holds MOST of the data characters;
* an article, main or content element is a container if it holds data; its slots are kept, outside of bad elements:
  menus, headers, footers, sidebars, adverts, forms and comments by element, role or whole class name. A class name
  that is doubtful inside an article (search, legal, notice, share, ...) counts only where the figures say template
  or menu;
* in pages without a container the data slots of the region are kept, again outside of bad elements.

Each (host, skeleton) gets its mask of slots; the pages are read again and the mask picks their texts. Masks are
broadcast up to a checked number of bytes and joined by a shuffle beyond. by_evidence tells the pages on which the
figures alone, blind to all names of tags and classes, keep the same slots.

Defined results: null or empty html, or one without main text, gives an empty text; null urls are one host; pages of a
host alone, and ties, need no other pages; repeated rows each get their row; an empty table gives an empty result;
nesting of any depth is kept; bytes that are no UTF-8 are read as U+FFFD; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, joined, table
from .warc import ended

FAN, FEW = 64, 4
#: A text that so many pages or more share at a slot is template; the share of the data that the main region holds.
ALIKE, MOST = 3, (3, 4)
#: Two sibling lists of at most this product of lengths are aligned by a plain table, longer ones in linear space.
TABLE = 4096
OPTIONAL, REPEATED = 1, 2
SLOT, GROUP = "#", "*"

#: Elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr picture q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
INLINE |= set("math semantics maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split())
RAW = set("script style noscript template iframe textarea svg annotation annotation-xml object select title".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements that hold blocks of a text and are no region of their own.
BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table tbody thead tfoot tr td th blockquote pre figure figcaption details summary address".split())
#: Opening one of these ends an open element of the second set, up to an element of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
BAD_TAGS = set("nav footer aside form button menu dialog head fieldset input label legend datalist".split())
BAD_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar rail widget footer foot comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended recommendations pagination pager paging login signin signup register "
    "search copyright legal toolbar skip hidden complementary contentinfo dialog form feedback".split()
)
#: Whole class names and roles that tell even inside an article; other bad words are doubtful there.
SURE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsored promo nav navbar navigation breadcrumb breadcrumbs sidebar footer comment comments reply "
    "replies respond disqus cookie cookies consent gdpr newsletter subscribe pagination pager paging toolbar skip hidden complementary contentinfo".split()
)
#: Ids that tell readers' comments even inside an article, where other ids name its sections.
TALK_WORDS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
WEAK_WORDS = {"header", "head", "masthead", "top"}
GOOD_WORDS = {"article", "articlebody", "content", "entry", "post", "story", "main"}

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    """An element, a slot or a repeated group. texts of a slot: (order, text, characters inside links) in a page, and
    figures in a wrapper: pages, characters, characters inside links, least and greatest text hash."""

    __slots__ = ("label", "flag", "kids", "texts", "shape")

    def __init__(self, label: str, flag: int = 0, kids: list | None = None, texts: list | None = None):
        self.label, self.flag, self.texts = label, flag, texts or []
        self.filled(kids or [])

    def filled(self, kids: list[Node]) -> None:
        """Sets the parts, and with them the shape: equal in this process for trees with equal labels."""
        self.kids, self.shape = kids, hash((self.label, *[k.shape for k in kids]))


def plain(tree: Node, figures: bool = False) -> str:
    """The tree as text, its slots with their figures if asked for."""
    out: list[str] = []
    todo: list[Node | str] = [tree]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        out.append(f"{n.flag}{n.label}" + ("|" + ";".join(str(x) for f in n.texts for x in f) if figures and n.texts else ""))
        if n.kids:
            out.append("{")
            todo.append("}")
            todo += reversed(n.kids)
        else:
            out.append(",")
    return "".join(out)


def tree_of(text: str) -> Node:
    """What plain() gave as a tree."""
    path = [Node("")]
    for m in re.finditer(r"([^{},]+)([{,])|\}", text):
        if m[1] is None:
            done = path.pop()
            done.filled(done.kids)
            continue
        name, _, rest = m[1].partition("|")
        n = Node(name[1:], int(name[0]))
        if rest:
            f = [int(x) for x in rest.split(";")]
            n.texts = [f[i : i + 5] for i in range(0, len(f), 5)]
        path[-1].kids.append(n)
        if m[2] == "{":
            path.append(n)
            room(len(path))
    return path[0].kids[0]


def room(depth: int) -> None:
    """Lets plain Python recursion go down that far."""
    if 6 * depth + 1000 > sys.getrecursionlimit():
        sys.setrecursionlimit(12 * depth + 2000)


def below(tree: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, todo = [], [tree]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += reversed(n.kids)
    return out


def _label(tag: str, attrs: str) -> str:
    """The tag with the words of its class, id and role, numbers left out; = before a bad class name or role that is no
    part of a longer one."""
    words = []
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                words += ["hidden", "=hidden"]
            elif name in ("class", "id", "role", "itemprop"):
                words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
                words += [f"={x}" for x in value.lower().split() if x in (TALK_WORDS if name == "id" else BAD_WORDS)]
    return ".".join([re.sub(r"[^a-z0-9:_-]", "", tag), *sorted(set(words))])


def parse(page: str) -> Node:
    """The page as a folded tree; a slot's texts are (order, text, link characters)."""
    root = Node("root")
    stack: list[tuple[str, Node]] = [("root", root)]
    opened: Counter[str] = Counter()
    run: list[str] = []
    state = {"order": 0, "link": 0, "links": 0}

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                stack[-1][1].kids.append(Node(SLOT, 0, None, [(state["order"], text, state["links"])]))
                state["order"] += 1
            run.clear()
        state["links"] = 0

    def pop() -> None:
        tag, node = stack.pop()
        opened[tag] -= 1
        node.filled(folded(node.kids))

    def close(tags: set[str], until: set[str]) -> None:
        if not any(opened[t] > 0 for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in until:
                return
            if stack[k][0] in tags:
                while len(stack) > k:
                    pop()
                return

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text = html.unescape(page[at : m.start()])
            run.append(text)
            state["links"] += len(text) * (state["link"] > 0)
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                run.append(m[0][9:-3])
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if tag == "a":
                state["link"] = max(0, state["link"] - 1)
            if tag not in INLINE or any(t == tag for t, _ in stack[-3:]):
                flush()
                close({tag}, {"article", "main", "body"} - {tag} if tag == "p" else set())
        elif tag in RAW:
            if tag not in ("script", "style"):
                if not attrs.endswith("/"):
                    at = ended(page, at, tag)
                if tag not in ("svg", "annotation", "annotation-xml"):
                    flush()
                continue
            flush()
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag == "br":
            run.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            if tag == "a":
                state["link"] += 1
            label = _label(tag, attrs)
            if tag in INLINE and not (set(label.split(".")[1:]) & BAD_WORDS):
                continue
            flush()
            if tag in ENDS_P:
                close({"p"}, {"table", "button", "td", "th", "li"} if tag != "p" else {"table", "button", "td", "th"})
            if tag in ENDS:
                close(*ENDS[tag])
            node = Node(label)
            stack[-1][1].kids.append(node)
            stack.append((tag, node))
            opened[tag] += 1
            room(len(stack))
    if at < len(page):
        run.append(html.unescape(page[at:]))
    flush()
    while stack:
        pop()
    return root


@lru_cache(20_000)
def _bare(label: str) -> bool:
    """Whether a label says nothing of what its element is for."""
    return "." not in label and label not in BLOCKS - {"table", "td", "th"} and label not in (SLOT, GROUP)


def folded(kids: list[Node]) -> list[Node]:
    """Siblings with repeated neighbours and repeated runs folded: those of one label, but bare ones only from FEW of one
    shape on, as fewer may each have a part of their own."""
    out: list[Node] = []
    at = 0
    while at < len(kids):
        k, end = kids[at], at + 1
        if not _bare(k.label):
            while end < len(kids) and kids[end].label == k.label:
                end += 1
        else:
            while end < len(kids) and kids[end].shape == k.shape:
                end += 1
            if end - at < FEW:
                end = at + 1
        for other in kids[at + 1 : end]:
            k = met(k, other)
        if end - at > 1:
            k.flag |= REPEATED
        out.append(k)
        at = end
    period = 2
    code = codes(out)
    while 2 * period <= len(out):
        at = repeat(code, period)
        if at is None:
            period += 1
        else:
            out = gathered(out, [k.label for k in out[at : at + period]], at)
            code = codes(out)
    return out


def codes(kids: list[Node]) -> np.ndarray:
    """A number for each label, or shape of a bare one; each group has its own, below 0."""
    if len(kids) < 4:
        return np.zeros(0, np.int64)
    known: dict[str | int, int] = {}
    return np.array([known.setdefault(k.shape if _bare(k.label) else k.label, len(known)) if k.label != GROUP else -1 - i for i, k in enumerate(kids)], np.int64)


def repeat(code: np.ndarray, period: int) -> int | None:
    """Where the first run of `period` codes stands that follows itself at once."""
    same = np.concatenate([[0], np.cumsum(code[:-period] == code[period:])])
    at = np.nonzero(same[period:] - same[:-period] == period)[0]
    return int(at[0]) if len(at) else None


def gathered(kids: list[Node], names: list[str], at: int = 0) -> list[Node]:
    """kids with every run of the labels `names` from `at` on made one repeated group."""
    out, n = kids[:at], len(names)
    while at < len(kids):
        if [k.label for k in kids[at : at + n]] == names:
            if out and out[-1].label == GROUP and [k.label for k in out[-1].kids] == names:
                out[-1].filled(aligned(out[-1].kids, kids[at : at + n]))
            else:
                out.append(Node(GROUP, REPEATED, kids[at : at + n]))
            at += n
        else:
            out.append(kids[at])
            at += 1
    return out


def met(a: Node, b: Node) -> Node:
    """Two nodes of one label as one."""
    return Node(a.label, a.flag | b.flag, aligned(a.kids, b.kids), a.texts + b.texts)


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = _matched(a[head : len(a) - tail], b[head : len(b) - tail])
    return [(i, i) for i in range(head)] + [(head + i, head + j) for i, j in inner] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def partners(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of siblings that are taken as one: a longest common subsequence of shapes, and one of labels between those."""
    out, i, j = [], 0, 0
    for p, q in [*matches([k.shape for k in a], [k.shape for k in b]), (len(a), len(b))]:
        out += [(i + x, j + y) for x, y in matches([k.label for k in a[i:p]], [k.label for k in b[j:q]])]
        if p < len(a):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def _matched(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE and len(a) > 1:
        # The half of a and the cut of b with the most pairs on both sides; each side is matched on its own.
        half, code = len(a) // 2, {x: i for i, x in enumerate(dict.fromkeys(a + b))}
        x, y = (np.array([code[k] for k in part]) for part in (a, b))
        cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _matched(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in _matched(a[half:], b[cut:])]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most pairs of a with each prefix of b."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _grouped_alike(a: list[Node], b: list[Node]) -> tuple[list[Node], list[Node]]:
    """Both lists with the groups of either made in the other as well."""
    for x, first in ((a, True), (b, False)):
        for g in [k for k in x if k.label == GROUP]:
            names = [k.label for k in g.kids]
            if first:
                b = gathered(b, names)
            else:
                a = gathered(a, names)
    return a, b


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Two sibling lists as one: partners met, the rest optional."""
    a, b = _grouped_alike(a, b)
    out, i, j = [], 0, 0
    for p, q in [*partners(a, b), (len(a), len(b))]:
        for k in (*a[i:p], *b[j:q]):
            k.flag |= OPTIONAL
            out.append(k)
        if p < len(a):
            out.append(met(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def slots(tree: Node) -> list[Node]:
    return [n for n in below(tree) if n.label == SLOT]


def _words(label: str) -> set[str]:
    return set(label.split(".")[1:])


def _tag(label: str) -> str:
    return label.partition(".")[0]


@lru_cache(20_000)
def _bad(label: str, inside: bool) -> bool:
    """Whether an element has no main text by its name alone; inside the container only sure names tell."""
    tag, words = _tag(label), _words(label)
    if tag in ("html", "body", "root", "article", "main"):
        return bool(words & {"comment", "comments", "hidden"}) and tag == "article"
    if tag in BAD_TAGS or any(x[1:] in SURE_WORDS for x in words if x[0] == "=") or not inside and words & BAD_WORDS:
        return True
    return not inside and (tag == "header" or bool(words & WEAK_WORDS) and not words & GOOD_WORDS)


@lru_cache(20_000)
def _doubtful(label: str) -> bool:
    """Whether a whole class name or role of the element is a bad word that is not sure."""
    return _tag(label) not in ("html", "body", "root", "article", "main") and any(x[0] == "=" for x in _words(label))


@lru_cache(20_000)
def _holds(kind: int, label: str) -> bool:
    tag = _tag(label)
    return (tag == "article", tag == "main" or "main" in _words(label), tag not in ("html", "body", "root") and bool(_words(label) & GOOD_WORDS))[kind]


class View:
    """A tree with what holds below each of its nodes."""

    def __init__(self, tree: Node):
        self.tree, self.nodes = tree, below(tree)
        self.text: set[int] = set()  # nodes with a slot at or below them
        self.encloses: set[int] = set()  # nodes that hold an article or main container with text, which no sure name rejects
        for n in reversed(self.nodes):
            if n.label == SLOT or any([id(k) in self.text for k in n.kids]):
                self.text.add(id(n))
            for k in n.kids:
                fine = k.label == GROUP or not _bad(k.label, True)
                if fine and ((_holds(0, k.label) or _holds(1, k.label)) and id(k) in self.text or id(k) in self.encloses):
                    self.encloses.add(id(n))

    def out(self, n: Node, inside: bool, loose: bool) -> bool:
        return n.label not in (GROUP, SLOT) and _bad(n.label, inside) and not (loose and not _bad(n.label, True) and id(n) in self.encloses)

    def container(self, loose: bool) -> int | None:
        seen, todo = set(), [self.tree]
        while todo:
            n = todo.pop()
            if not self.out(n, False, loose):
                seen |= {kind for kind in range(3) if n.label not in (GROUP, SLOT) and id(n) in self.text and _holds(kind, n.label)}
                todo += n.kids
        return min(seen, default=None)

    def found(self) -> tuple[int | None, bool]:
        """What marks the main text (0 article, 1 main, 2 a content word, None), and whether it is one that only
        elements with a bad word in a longer name (has-sidebar) enclose."""
        kind = self.container(False)
        if kind in (0, 1):
            return kind, False
        wide = self.container(True)
        return (wide, True) if wide in (0, 1) else (kind, False)

    def data(self, only: set[int] | None = None) -> dict[int, int]:
        """The data characters of every slot (of `only`), by identity: 0 for template and menus."""
        own = [(n, [sum(x) for x in zip(*[f[:3] for f in n.texts], strict=True)], min(f[3] for f in n.texts), max(f[4] for f in n.texts)) for n in self.nodes if n.label == SLOT and n.texts and len(n.texts[0]) == 5]
        # Where no slot differs between pages, they are copies, and sameness tells nothing.
        copies = not any(low != high for _, _, low, high in own)
        out = {id(n): 1 for n in self.nodes if n.label == SLOT and not n.texts}
        out |= {id(n): chars if 2 * link < chars and (low != high or pages < ALIKE or copies) else 0 for n, (pages, chars, link), low, high in own}
        out |= {id(n): sum(len(t) for _, t, _ in n.texts) for n in self.nodes if n.label == SLOT and n.texts and len(n.texts[0]) == 3}
        return {k: v for k, v in out.items() if only is None or k in only}

    def region(self, data: dict[int, int], blind: bool, loose: bool) -> Node:
        """The deepest node of blocks with MOST of the data characters; blind to names, or without bad elements."""
        mass: dict[int, int] = {}
        for n in reversed(self.nodes):
            mass[id(n)] = 0 if not blind and self.out(n, False, loose) else data.get(id(n), 0) + sum([mass[id(k)] for k in n.kids])
        n = self.tree
        while deeper := [k for k in n.kids if k.label != SLOT and _tag(k.label) not in BLOCKS and k.label != GROUP and not k.flag & REPEATED and any([x.label != SLOT for x in k.kids]) and MOST[1] * mass[id(k)] >= MOST[0] * mass[id(n)] > 0]:
            n = deeper[0]
        return n

    def chosen(self, kind: int | None, loose: bool, only: set[int] | None = None) -> set[int]:
        """The identities of the slots that hold main text in pages whose container is `kind` (loose as of found()) and
        whose slots are those of `only`."""
        data, out = self.data(only), set()
        if kind is not None and not self._kept(self.tree, kind, loose, data, out):
            # No container of the kind holds data: what is there is template, and the region of the data decides.
            kind = None
        if kind is None:
            out.clear()
            region = self.region(data, False, loose)
            todo = [(region, self.out(region, False, loose))]
            while todo:
                n, gone = todo.pop()
                if n.label == SLOT and not gone and data.get(id(n)):
                    out.add(id(n))
                todo += [(k, gone or self.out(k, False, loose)) for k in n.kids]
        return out

    def _kept(self, tree: Node, kind: int, loose: bool, data: dict[int, int], out: set[int]) -> bool:
        """Puts the slots in containers of the kind into out; tells whether data is among them."""
        todo = [(tree, False, False)]
        while todo:
            n, inside, doubt = todo.pop()
            if n.label == SLOT:
                if inside and not (doubt and not data.get(id(n))):
                    out.add(id(n))
            elif not self.out(n, inside, loose):
                named = n.label != GROUP
                doubt = doubt or inside and named and _doubtful(n.label)
                inside = inside or named and _holds(kind, n.label)
                todo += [(k, inside, doubt) for k in n.kids]
        return any(data.get(x) for x in out)

    def evident(self, only: set[int]) -> set[int]:
        """The data slots of the region that the figures alone tell."""
        data = self.data(only)
        return {id(n) for n in below(self.region(data, True, False)) if n.label == SLOT and data.get(id(n))}


def container(tree: Node) -> int | None:
    return View(tree).found()[0]


def mask(wrapper: Node, page: Node) -> str:
    """One 0 or 1 for each slot of the page, by the wrapper slot that it is aligned with, under the page's own kind of
    container; a slot that finds no partner is judged by its place in the page. Then + if evident() says the same, or -."""
    host, own = View(wrapper), slots(page)
    kind, loose = View(page).found()
    alone = View(page).chosen(kind, loose)
    # Slots are told apart by their texts, which meeting nodes carry along.
    places = [id(s) in alone for s in own]
    for i, s in enumerate(own):
        s.texts = [[i]]
    at: dict[int, set[int]] = {}

    def walk(a: list[Node], b: list[Node]) -> None:
        a, b = _grouped_alike(a, b)
        for p, q in partners(a, b):
            if b[q].label == SLOT:
                at.setdefault(id(a[p]), set()).update([t[0] for t in b[q].texts])
            walk(a[p].kids, b[q].kids)

    walk(wrapper.kids, page.kids)
    good, evident = host.chosen(kind, loose, set(at)), host.evident(set(at))
    met_slots = {i for x in at.values() for i in x}
    keep = {i for k in good for i in at.get(k, ())} | {i for i, place in enumerate(places) if place and i not in met_slots}
    shown = {i for k in evident for i in at[k]}
    return "".join("1" if i in keep else "0" for i in range(len(own))) + ("+" if keep == shown else "-")


def skeleton(tree: Node) -> str:
    return plain(tree)


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")


_SURVEY = "host string, skeleton string, slots array<struct<pages:long,chars:long,link:long,low:long,high:long>>"


def _read(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def _surveyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, skeleton and the figures of its slots, summed over the pages of a batch."""
    names = ("pages", "chars", "link", "low", "high")
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
    for b in it:
        seen: dict[tuple[str, str], list[list[int]]] = {}
        for url, page in zip(b.column(0).cast(pa.binary()), b.column(1).cast(pa.binary()), strict=True):
            tree = parse(_read(page.as_py()))
            own = [(sum(len(t) for _, t, _ in s.texts), sum(x for _, _, x in s.texts), _hash("\n".join(t for _, t, _ in s.texts))) for s in slots(tree)]
            figures = seen.setdefault((host(_read(url.as_py())), skeleton(tree)), [[0, 0, 0, 2**62, -1] for _ in own])
            for f, (chars, link, h) in zip(figures, own, strict=True):
                f[:] = f[0] + 1, f[1] + chars, f[2] + link, min(f[3], h), max(f[4], h)
        rows = [[dict(zip(names, f, strict=True)) for f in figures] for figures in seen.values()]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([s for _, s in seen], pa.string()), pa.array(rows, kind)], names=["host", "skeleton", "slots"])


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The wrappers of a group as one, in a fixed order."""
    trees = [tree_of(w) for w in sorted(pdf["wrapper"])]
    out = trees[0]
    for t in trees[1:]:
        out = met(out, t)
    for s in slots(out):
        if len(s.texts) > 1:
            s.texts = [[f(x) for f, x in zip((sum, sum, sum, min, max), zip(*s.texts, strict=True), strict=True)]]
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [plain(out, True)]})


def _with_figures(shape: str, figures: list | None) -> str:
    tree = tree_of(shape)
    for s, f in zip(slots(tree), [] if figures is None else figures, strict=False):
        s.texts = [[int(f["pages"]), int(f["chars"]), int(f["link"]), int(f["low"]), int(f["high"])]]
    return plain(tree, True)


def inferred(pages: DataFrame, url: str = "url", page: str = "html") -> tuple[DataFrame, DataFrame]:
    """(host, skeleton) of all distinct skeletons, and (host, wrapper)."""
    seen = checkpointed(_shapes(pages.select(F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))))
    shapes = seen.select("host", "skeleton")
    fig = F.transform("figures", lambda x: F.struct(x["pages"], x["chars"], x["link"], x["low"], x["high"]))

    def start(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({"host": p["host"], "wrapper": [_with_figures(s, f) for s, f in zip(p["skeleton"], p["figures"], strict=True)]})

    now = seen.select("host", "skeleton", fig.alias("figures")).mapInPandas(start, "host string, wrapper string")
    most = seen.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    levels = 0
    while FAN**levels < most:
        levels += 1
    now = now.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(FAN ** max(levels - 1, 0))))
    for level in range(max(levels - 1, 0), -1, -1):
        now = now.withColumn("part", F.expr(f"part % {FAN**level}"))
        now = now.groupBy("host", "part").applyInPandas(lambda key, pdf: _merged(pdf).assign(part=key[1]), "host string, wrapper string, part long")
    return shapes, checkpointed(now.select("host", "wrapper"))


def _shapes(pages: DataFrame) -> DataFrame:
    """Each (host, skeleton) once, with its slots' figures summed over its pages."""
    raw = pages.mapInArrow(_surveyed, _SURVEY)
    rows = raw.select("host", "skeleton", F.posexplode_outer("slots").alias("i", "s"))
    by_slot = rows.groupBy("host", "skeleton", "i").agg(*[F.sum(f"s.{c}").alias(c) for c in ("pages", "chars", "link")], F.min("s.low").alias("low"), F.max("s.high").alias("high"))
    found = F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "pages", "chars", "link", "low", "high"))))
    return by_slot.groupBy("host", "skeleton").agg(found.alias("figures"))


def masks(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, skeleton, mask) of every distinct skeleton."""
    shapes, wrapped = inferred(pages, url, page)
    both = joined(shapes, wrapped.withColumnRenamed("host", "wh"), [("host", "wh")])

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({"host": p["host"], "skeleton": p["skeleton"], "mask": [mask(tree_of(w), tree_of(s)) for s, w in zip(p["skeleton"], p["wrapper"], strict=True)]})

    return checkpointed(both.mapInPandas(batches, "host string, skeleton string, mask string"))


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, by_evidence."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"), F.col(url).cast("string").alias("__u"))
    known = masks(own, "__u")
    # A slot's index in the mask is all that a text needs; hosts and skeletons are met by their hash.
    known = checkpointed(known.select(F.xxhash64("host").alias("kh"), F.xxhash64("skeleton").alias("ks"), F.sha2("skeleton", 256).alias("kd"), "mask"))
    schema = own.select("page_id", "url", F.lit("").alias("host"), F.lit("").alias("skeleton"), F.lit(None).cast("array<struct<i:int,t:string>>").alias("blocks")).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("i", pa.int32()), ("t", pa.string())]))
        for b in it:
            hosts, shapes, blocks = [], [], []
            for u, p in zip(b.column(3).cast(pa.binary()), b.column(2).cast(pa.binary()), strict=True):
                tree = parse(_read(p.as_py()))
                hosts.append(host(_read(u.as_py())))
                shapes.append(skeleton(tree))
                texts = sorted((order, i, t) for i, s in enumerate(slots(tree)) for order, t, _ in s.texts)
                blocks.append([{"i": i, "t": t} for _, i, t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(shapes, pa.string()), pa.array(blocks, kind)], names=["page_id", "url", "host", "skeleton", "blocks"])

    read = own.mapInArrow(batches, schema).withColumns({"__h": F.xxhash64("host"), "__s": F.xxhash64("skeleton"), "__d": F.sha2("skeleton", 256)}).drop("host", "skeleton")
    got = joined(read, known, [("__h", "kh"), ("__s", "ks"), ("__d", "kd")])
    text = F.array_join(F.transform(F.filter("blocks", lambda x: F.substring(F.col("mask"), x["i"] + 1, F.lit(1)) == "1"), lambda x: x["t"]), "\n")
    got = got.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"), F.coalesce(F.endswith("mask", F.lit("+")), F.lit(False)).alias("by_evidence"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_evidence")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
