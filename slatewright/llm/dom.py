"""Trees of web pages for operator 13: a tolerant reader of HTML, simple tree matching, and
templates of a host's pages.

A tree has block elements only; inline markup dissolves in the text around it.  Elements
nested deeper than DEPTH hang from the one at that depth, so that no text is lost and no
walk is deep.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from functools import lru_cache
from html import unescape

DEPTH = 200
#: Cells of a matching of two lists of children; longer ones are matched greedily by label.
CELLS = 40_000

# Names of elements.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes noscript script style template textarea title xmp".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CONTAINERS = set("article body center div html main section table tbody td tr".split())
#: An element ends open ones of these names, up to one of those.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are never an article's text.
NEVER = set("aside button dialog fieldset footer form head label menu nav noscript object option select svg template textarea".split())
#: Words of class, id and role that mark what is not an article's text.
MARKS = set(
    "ad ads adv advert advertisement advertising advertorial alert announcement aside author banner bio breadcrumb breadcrumbs byline comment commentlist comments complementary consent contentinfo cookie cookies copyright disclaimer disqus "
    "footer form gdpr header hidden login masthead menu menubar meta modal nav navbar navigation navigator newsletter notice notification overlay pager pagination popup promo promoted promotion recommended register related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar tooltip topbar tracking widget widgets".split()
)
#: Such words say nothing of these.
WHOLE = {"article", "body", "html", "main"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"<]*"|'[^'<]*'|["'])*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![^\s/=])""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


class Node:
    """A block element: kids are nodes and texts, as (text, characters of it in links)."""

    __slots__ = ("tag", "label", "dropped", "article", "kids", "link", "text", "links", "parent", "runs", "sig", "size", "tid", "holds")

    def __init__(self, tag: str, label: str, dropped: bool, article: bool, link: bool, parent: Node | None):
        self.tag, self.label, self.dropped, self.article, self.link, self.parent = tag, label, dropped, article, link, parent
        self.kids: list = []
        self.text: list[str] = []
        self.links, self.tid, self.holds = 0, None, False

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.kids.append((text, min(self.links, len(text))))
            self.text, self.links = [], 0


def _facts(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Label, whether it is left out, whether it is an article by what it says of itself."""
    dropped, article, first = tag in NEVER, tag in ("article", "main"), ""
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                dropped = True
            elif name in ("class", "id", "role"):
                if name == "class" and value.split():
                    first = _DIGITS.sub("", value.split()[0])
                if name == "role" and value == "main":
                    article = True
                if tag not in ("html", "body", "main") and any(w.lower() in MARKS for w in _WORD.findall(value)):
                    dropped = True
    return f"{tag}.{first}", dropped, article and not dropped


_short = lru_cache(4096)(_facts)


def parse(html: str) -> Node:
    """The tree of a page; whatever the page is, there is one."""
    root = Node("#", "#", False, False, False, None)
    stack, at, n = [root], 0, len(html)

    def words(text: str) -> None:
        top = stack[-1]
        if "&" in text:
            text = unescape(text)
        top.text.append(text)
        if top.link:
            top.links += len(text.strip())

    def pop(to: int) -> None:
        while len(stack) > to:
            stack.pop().flush()

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            words(html[at:])
            break
        if m.start() > at:
            words(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes, top = m[2].lower(), m[3], stack[-1]
        if not m[4]:
            break  # cut inside a tag
        if m[1]:
            if tag == "a":
                top.link = False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop(k)
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "body", "html"):
                    break
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag != "svg":
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                end = html.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else n
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                top.text.append("\n" if tag != "img" else "")
            continue
        label, dropped, article = (_short if len(attributes) < 200 else _facts)(tag, attributes)
        if tag in INLINE and not dropped:
            if tag == "a":
                top.link = True
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop(k)
                    break
                if stack[k].tag in CONTAINERS or stack[k].tag in ("li", "dd", "blockquote", "form"):
                    break
        elif tag in IMPLIED:
            closes, scope = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    pop(k)
                    break
                if stack[k].tag in scope:
                    break
        elif tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        elif tag == "body":
            pop(next((k for k, x in enumerate(stack) if x.tag == "head"), len(stack)))
        top = stack[-1]
        top.flush()
        node = Node(tag, label, dropped, article, top.link, top)
        top.kids.append(node)
        if len(stack) < DEPTH:
            stack.append(node)
        elif attributes.endswith("/"):
            continue
    pop(0)
    return root


def settle(root: Node) -> None:
    """Runs of equal siblings, sizes, signatures; and whether an element holds an article."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if type(k) is Node]
    for node in reversed(order):
        runs: list[list[Node]] = []
        for k in node.kids:
            if type(k) is Node:
                if runs and runs[-1][0].label == k.label:
                    runs[-1].append(k)
                else:
                    runs.append([k])
                node.holds = node.holds or k.holds or k.article
        node.runs = runs
        node.size = 1 + sum(r[0].size for r in runs)
        node.sig = hash((node.label, *[r[0].sig for r in runs]))


class Slot:
    """An element of a template."""

    __slots__ = ("label", "kids", "id", "size", "sig")

    def __init__(self, label: str, kids: list[Slot]):
        self.label, self.kids = label, kids

    def as_list(self) -> list:
        return [self.label, [k.as_list() for k in self.kids]]


def numbered(root: Slot) -> Slot:
    """Ids in page order, sizes and signatures."""
    order, stack = [], [root]
    while stack:
        slot = stack.pop()
        slot.id = len(order)
        order.append(slot)
        stack += reversed(slot.kids)
    for slot in reversed(order):
        slot.size = 1 + sum(k.size for k in slot.kids)
        slot.sig = hash((slot.label, *[k.sig for k in slot.kids]))
    return root


def read_template(text: str) -> Slot:
    make = lambda x: Slot(x[0], [make(k) for k in x[1]])
    return numbered(make(json.loads(text)))


def fresh(node: Node) -> Slot:
    return Slot(node.label, [fresh(r[0]) for r in node.runs])


def score(slot: Slot, node: Node, known: dict) -> int:
    """Simple tree matching: the most elements that two trees share, in order and with the
    elements above them shared too."""
    if slot.label != node.label:
        return 0
    if slot.sig == node.sig:
        return slot.size
    key = (slot.id, id(node))
    if key not in known:
        known[key] = 1 + (_table(slot.kids, node.runs, known)[-1][-1] if slot.kids and node.runs else 0)
    return known[key]


def _table(slots: list[Slot], runs: list[list[Node]], known: dict) -> list[list[int]]:
    if len(slots) * len(runs) > CELLS:
        return [[sum(slots[i].size for i, _ in _greedy(slots, runs))]]
    rows = [[0] * (len(runs) + 1)]
    for s in slots:
        above, row = rows[-1], [0]
        for j, r in enumerate(runs):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            if s.label == r[0].label and (w := above[j] + score(s, r[0], known)) > best:
                best = w
            row.append(best)
        rows.append(row)
    return rows


def _greedy(slots: list[Slot], runs: list[list[Node]]) -> list[tuple[int, int]]:
    places: dict[str, list[int]] = {}
    for i, s in enumerate(slots):
        places.setdefault(s.label, []).append(i)
    out, after = [], 0
    for j, r in enumerate(runs):
        own = places.get(r[0].label, [])
        k = bisect_left(own, after)
        if k < len(own):
            out.append((own[k], j))
            after = own[k] + 1
    return out


def matched(slots: list[Slot], runs: list[list[Node]], known: dict) -> list[tuple[int, int]]:
    """Pairs of a slot and a run in a best matching of two lists of children."""
    if len(slots) == len(runs) and all(s.label == r[0].label for s, r in zip(slots, runs, strict=True)):
        return [(i, i) for i in range(len(slots))]
    if len(slots) * len(runs) > CELLS:
        return _greedy(slots, runs)
    rows, out, i, j = _table(slots, runs, known), [], len(slots), len(runs)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(slot: Slot, node: Node) -> None:
    """Give each element of a page that the template has the id of its slot; elements of a
    run have one slot."""
    known: dict = {}
    stack = [(slot, node)] if slot.label == node.label else []
    while stack:
        s, n = stack.pop()
        n.tid = s.id
        if s.kids and n.runs:
            for i, j in matched(s.kids, n.runs, known):
                stack += [(s.kids[i], member) for member in n.runs[j]]


def merge(slot: Slot, node: Node) -> None:
    """Add to a template what a page has beyond it, where the page has it."""
    known: dict = {}
    stack = [(slot, node)]
    while stack:
        s, n = stack.pop()
        pairs = matched(s.kids, n.runs, known) if s.kids and n.runs else []
        by_run = {j: s.kids[i] for i, j in pairs}
        taken = {j: i for i, j in pairs}
        kids, at = [], 0
        for j, run in enumerate(n.runs):
            if j in by_run:
                kids += s.kids[at : taken[j] + 1]
                at = taken[j] + 1
                stack += [(by_run[j], member) for member in run]
            else:
                kids.append(fresh(run[0]))
        s.kids = kids + s.kids[at:]


def induce(pages: list[str]) -> str:
    """The template of some pages: the first, with what the others have beyond it."""
    template = None
    for html in pages:
        root = parse(html)
        settle(root)
        if template is None:
            template = fresh(root)
        else:
            merge(numbered(template), root)
    return json.dumps(template.as_list(), separators=(",", ":"))


class Text:
    """A text of a page: its key is the slot it stands in, or the path to it from the last
    element that the template has."""

    __slots__ = ("key", "text", "links", "node", "dropped", "article")

    def __init__(self, key: str, text: str, links: int, node: Node, dropped: bool, article: bool):
        self.key, self.text, self.links, self.node, self.dropped, self.article = key, text, links, node, dropped, article


def texts(html: str, template: Slot | None) -> tuple[Node, list[Text]]:
    """The tree of a page and its texts in page order."""
    root = parse(html)
    settle(root)
    if template is not None:
        align(template, root)
    out: list[Text] = []
    stack: list[tuple] = [(root, "", False, False)]
    while stack:
        item, key, dropped, article = stack.pop()
        if type(item) is tuple:
            text, links = item[0]
            out.append(Text(key, text, links, item[1], dropped, article))
            continue
        key = str(item.tid) if item.tid is not None else f"{key}/{item.label}"
        # Whatever holds an article is no part of the page to be left out as a whole.
        dropped = dropped or item.dropped and not item.holds or item.tag == "header" and not article and not item.holds
        article = article or item.article
        stack += [(k, key, dropped, article) if type(k) is Node else ((k, item), key, dropped, article) for k in reversed(item.kids)]
    return root, out
