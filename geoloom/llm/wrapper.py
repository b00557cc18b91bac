"""Main-text extraction by wrapper induction over the pages of each host.

A page becomes a tree of blocks: containers, and runs of leaf blocks of one kind with their texts. The
trees of a host are merged into its wrapper by simple tree matching: children are aligned in order so that
the number of matched nodes is largest, aligned leaves with equal text stay constant (template), others
become slots. The content region is found by going down from the root while one container holds nearly
all the varying text, with the siblings of its mark that are content as well. The way to that region leaves
the induction; where siblings share a mark, each page is aligned with the wrapper by the same matching. Tasks first merge the pages they
read, then partial wrappers of a host are merged one by one in a stream, so a host with a third of all
pages is never gathered. Every page of a host takes part.

From the region all blocks are kept in page order, apart from navigation, headers, footers, sidebars,
notices, adverts, forms, comments and the like, known by element, role, or a class or id that names them as a
whole or by its head noun. Running text and names that only mention such a word are in doubt: they go where
the host's wrapper finds them constant, and on a page without one they stay, apart from notices and headers
outside an article. A form or a named part that holds nearly all text of its page stays. A page without a
region of its host (the only page, or one built differently) falls back on its own: a lone article, or the
same descent over its text.

Defined cases: a null html is an empty page; an unclosed tag at the end is dropped; repeated pages count
as one constant page; a null url has the empty host; other columns pass through untouched.
"""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.names import free_names
from geoloom.llm.urlfilter import host
from geoloom.plans.scratch import materialize

#: share of the varying text that a child must hold for the descent to go on
SHARE = 0.9
#: share of the region's varying text per page from which a sibling of the same mark is content too
TWIN = 0.25
#: child nodes of a wrapper node before further kinds are merged by element name alone
WIDE = 48
#: containers inside each other that the induction tells apart; the parts of deeper ones belong to the last of these, still
#: as blocks of their own, and what is dropped is dropped at any depth
DEPTH = 100
#: hosts a task merges before it hands its wrappers on
HOSTS_HELD = 2000

# fixed values: elements of HTML by their role here
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
DROPPED = set(
    "nav footer aside form script style noscript template iframe svg canvas button select textarea input dialog menu head title "
    "object embed audio video map noembed noframes xmp search datalist".split()
)
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr "
    "notice notices comment comments disqus reply replies respond sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead share sharing social related recommended newsletter subscribe subscription popup modal overlay widget toolbar "
    "pagination pager login signup skip commentlist commentbox discussion".split()
)
#: words that name furniture as a class only; as an id they may be the place of a heading
CLASS_ONLY = {"discussion"}
#: nouns that only say what a named thing is laid out as
LAYOUT = set(
    "area article articles bar block blocks box boxes button buttons container content feed form group icon icons inner item items "
    "left link links list media menu outer panel panels post posts right row section slot stories stuff text this to unit wrap wrapper zone".split()
)
#: words of class names that tell a state of the element rather than what it is
STATES = {"has", "with", "without", "no", "non", "not", "is", "hide", "show", "js"}
#: elements of running text: only the wrapper drops them for their words
WRITING = set("p h1 h2 h3 h4 h5 h6 li dd dt td th tr blockquote pre figure figcaption caption table".split())
#: words of parts that can hold more text than the article and are furniture all the same
NEVER_MAIN = set(
    "ad ads advert adverts advertisement advertising cookie cookies consent gdpr comment comments disqus reply replies respond "
    "newsletter subscribe subscription breadcrumb breadcrumbs share sharing pagination pager commentlist commentbox discussion".split()
)
#: such words that name an advert or reader comments: they drop running text too where they are the whole name
NEVER_TEXT = set("ad ads advert adverts advertisement advertising comment comments disqus reply replies respond commentlist commentbox discussion".split())
ENDS_P = BLOCKS - {"html", "head", "body", "option", "optgroup", "legend", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
# an opened element ends open ones of the same set, up to the nearest of the stops
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
INLINE = {"span", "a", "small", "label", "ins"}
DESCENDS = {"html", "body", "div", "main", "article", "section", "center", "td", "tr", "tbody", "table", "form"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z][^>]*\Z", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_WORDS = re.compile(r"[^a-z]+")


class Node:
    """A container: its element, its mark (element and class words), and its parts in page order.

    ``dropped``: furniture. ``soft``: dropped for words or as a form, and kept if it holds nearly all text of the page.
    ``doubt``: name under which the host's wrapper decides, else ``dropped_alone``.
    """

    __slots__ = ("tag", "mark", "dropped", "soft", "doubt", "dropped_alone", "kids")

    def __init__(self, tag: str, mark: str, dropped: bool):
        self.tag, self.mark, self.dropped, self.soft, self.doubt, self.dropped_alone, self.kids = tag, mark, dropped, False, None, False, []


def furniture(name: str) -> int:
    """How far a class or id names furniture: 3 the whole name, 2 its head noun, 1 some word, 0 none."""
    ws = [w for w in _WORDS.split(name) if len(w) > 1]
    if not DROPPED_WORDS.intersection(ws) or STATES.intersection(ws):
        return 0
    while len(ws) > 1 and ws[-1] in LAYOUT:
        ws.pop()
    if ws[-1] not in DROPPED_WORDS:
        return 1
    return 3 if DROPPED_WORDS.issuperset(ws) else 2


def _never_text(name: str) -> bool:
    """Whether a class names an advert or comments and nothing else."""
    ws = [w for w in _WORDS.split(name) if len(w) > 1]
    return bool(NEVER_TEXT.intersection(ws)) and NEVER_TEXT.union(LAYOUT).issuperset(ws)


def _node(tag: str, attrs: str, inside_article: bool) -> Node:
    dropped = tag in DROPPED or (tag == "header" and not inside_article)
    soft = tag == "form"
    doubt = alone = False
    classes, named = "", []
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name = name.lower()
            if name in ("class", "id"):
                value = html.unescape(value.strip("\"'")).lower()
                if name == "class":
                    classes = " ".join(w for w in _WORDS.split(value) if w)
                for one in value.split():
                    if tag in ("html", "body", "article", "main") or dropped or not (level := furniture(one)):
                        continue
                    if name == "id" and CLASS_ONLY.intersection(_WORDS.split(one)):
                        continue
                    named.append(one)
                    topic = name == "id" and tag == "section" and not NEVER_MAIN.intersection(_WORDS.split(one))
                    if name == "id" and tag in WRITING and tag[0] == "h":
                        named.pop()  # the place a link leads to
                    elif level == 1:
                        doubt = True
                    elif name == "class" and tag in WRITING and tag[0] != "h" and _never_text(one):
                        dropped = True
                    elif tag in WRITING or topic or (level == 2 and {"header", "banner", "notice"}.intersection(_WORDS.split(one))):
                        doubt, alone = True, alone or not inside_article
                    else:
                        dropped, soft = True, not NEVER_MAIN.intersection(_WORDS.split(one))
            elif name == "role" and value.strip("\"'").lower() in DROPPED_ROLES:
                dropped, soft = True, soft and value.strip("\"'").lower() == "form"
    node = Node(tag, f"{tag}.{classes}" if classes else tag, dropped)
    node.soft = soft and dropped
    if doubt and not dropped:
        node.mark = f"{tag}.{classes}?" + " ".join(w for x in named for w in _WORDS.split(x) if w)
        node.doubt, node.dropped_alone = node.mark, alone
    return node


def _release(root: Node) -> None:
    """A soft node outside of which hardly any kept text stands is no furniture."""

    def size(n: Node) -> int:
        return sum(sum(len(x.strip()) for x in k) if isinstance(k, list) else 0 if k.dropped else size(k) for k in n.kids)

    def soft(n: Node) -> Iterator[Node]:
        for kid in n.kids:
            if isinstance(kid, Node):
                if kid.dropped and kid.soft:
                    yield kid
                elif not kid.dropped:
                    yield from soft(kid)

    while True:
        found = max(((size(n), k, n) for k, n in enumerate(soft(root))), default=None)
        if found is None or found[0] == 0 or found[0] < SHARE * (found[0] + size(root)):
            return
        found[2].dropped = False


def settle(node: Node, constant: dict[str, bool]) -> None:
    """Drops the nodes in doubt that the wrapper found constant (or, unknown to it, that go by default)."""
    for kid in node.kids:
        if isinstance(kid, Node) and not kid.dropped:
            if kid.doubt is not None and constant.get(kid.doubt, kid.dropped_alone):
                kid.dropped = True
            else:
                settle(kid, constant)


class _Open:
    """An open element: its name, and the node that takes what stands in it."""

    __slots__ = ("tag", "node")

    def __init__(self, tag: str, node: Node):
        self.tag, self.node = tag, node


def parse(page: str | None) -> Node:
    """Tree of a page: block elements as nodes, everything between them as text (character references decoded)."""
    root = Node("#", "#", False)
    stack = [_Open("#", root)]
    page = page or ""
    at = depth = 0  # depth: nodes on the stack

    def add(piece: str) -> None:
        kids = stack[-1].node.kids
        if kids and isinstance(kids[-1], list):
            kids[-1].append(piece)
        else:
            kids.append([piece])

    def close(k: int) -> None:
        """Ends the open elements from the k-th on."""
        nonlocal depth
        while len(stack) > k:
            gone = stack.pop()
            if gone.node is not stack[-1].node:
                depth -= 1
            elif gone.tag in BLOCKS:
                stack[-1].node.kids.append(Node(gone.tag, gone.tag, False))  # parts the blocks around it

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                add(page[at:])
            break
        if at < m.start():
            add(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCKS or tag in DROPPED or tag in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag or (tag[0] == "h" and tag[1:].isdigit() and stack[k].tag[0] == "h" and stack[k].tag[1:].isdigit()):
                        close(k)
                        break
            elif tag == "br":
                add(" ")
        elif m[2]:
            tag, attrs = m[2].lower(), m[3]
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if tag == "br":
                add(" ")
                continue
            if tag not in BLOCKS and tag not in DROPPED and not _marked(tag, attrs) and not (tag in INLINE and any(n.tag == tag for n in stack)):
                continue
            if tag in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in ("td", "th", "table", "button", "object", "caption"):
                        break
            if tag in ENDS:
                ended, stops = ENDS[tag]
                low = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in stops), 0)
                first = next((k for k in range(low + 1, len(stack)) if stack[k].tag in ended), 0)
                if first:
                    close(first)
            node = _node(tag, attrs, any(n.tag in ("article", "main") for n in stack))
            here = stack[-1].node
            opens = tag not in VOID and not attrs.rstrip().endswith("/")
            if depth < DEPTH or node.dropped or not opens:
                here.kids.append(node)
                if opens:
                    stack.append(_Open(tag, node))
                    depth += 1
            else:
                if tag in BLOCKS:
                    here.kids.append(Node(tag, tag, False))  # parts the blocks around it
                stack.append(_Open(tag, here))
    _release(root)
    return root


def _marked(tag: str, attrs: str) -> bool:
    """Inline elements become nodes only where class words or roles drop them."""
    return tag in INLINE and bool(attrs) and ("class" in attrs or "id" in attrs or "role" in attrs) and _node(tag, attrs, True).dropped


def blocks(node: Node) -> list[str]:
    """Texts of the kept blocks below ``node`` in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if line:
            out.append(line)

    def walk(n: Node) -> None:
        for kid in n.kids:
            if isinstance(kid, list):
                held.extend(kid)
            elif kid.dropped:
                if kid.tag in BLOCKS:
                    flush()
            else:
                flush()
                walk(kid)
                flush()

    walk(node)
    flush()
    return out


class Slot:
    """A node of a page's reduced tree or of a wrapper.

    ``text``: hash of the leaf's texts, None once two pages differ (a slot); ``mass``: characters of its own
    leaves, ``vary``: those found varying; ``kids``: containers and leaf runs in order; ``pages``: pages merged.
    """

    __slots__ = ("mark", "leaf", "text", "mass", "vary", "kids", "pages", "narrow", "nodes")

    def __init__(self, mark: str, leaf: bool, text: int | None, mass: int, kids: list[Slot]):
        self.mark, self.leaf, self.text, self.mass, self.vary, self.kids, self.pages = mark, leaf, text, mass, 0, kids, 1
        self.narrow = False  # kids of one mark were merged
        self.nodes: list[Node] = []  # of the page, not pickled

    def __reduce__(self):
        return _slot, (self.mark, self.leaf, self.text, self.mass, self.vary, self.kids, self.pages, self.narrow)


def _slot(mark, leaf, text, mass, vary, kids, pages, narrow) -> Slot:
    out = Slot(mark, leaf, text, mass, kids)
    out.vary, out.pages, out.narrow = vary, pages, narrow
    return out


def reduced(node: Node) -> Slot:
    """Kept containers of a page, with leaf blocks of one mark in a row as one run."""
    kids: list[Slot] = []
    runs: list[list] = []

    def leaf(mark: str, line: str, kid: Node | None = None) -> None:
        if kids and kids[-1].leaf and kids[-1].mark == mark:
            runs[-1].append(line)
        else:
            kids.append(Slot(mark, True, None, 0, []))
            runs.append([line])
        if kid is not None:
            kids[-1].nodes.append(kid)

    for kid in node.kids:
        if isinstance(kid, list):
            line = " ".join("".join(kid).split())
            if line:
                leaf("#text", line)
        elif not kid.dropped:
            if any(isinstance(x, Node) for x in kid.kids):
                kids.append(reduced(kid))
                runs.append([])
            else:
                line = " ".join("".join(x for part in kid.kids for x in part).split())
                if line:
                    leaf(kid.mark, line, kid)
    for slot, lines in zip(kids, runs):
        if slot.leaf:
            slot.text = xxhash.xxh64_intdigest("\n".join(lines))
            slot.mass = sum(map(len, lines))
    out = Slot(node.mark, False, None, 0, kids)
    out.nodes.append(node)
    return out


def match(a: Slot, b: Slot) -> int:
    """Simple tree matching: nodes in the largest order-preserving match of two trees with equal roots."""
    if a.mark != b.mark or a.leaf != b.leaf:
        return 0
    if a.leaf:
        return 2 if a.text is not None and a.text == b.text else 1
    return 1 + _table(a.kids, b.kids)[-1][-1]


def _table(a: list[Slot], b: list[Slot]) -> list[list[int]]:
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(row[j], rows[-1][j + 1], rows[-1][j] + match(x, y)))
        rows.append(row)
    return rows


def _aligned(a: list[Slot], b: list[Slot]) -> list[tuple[Slot | None, Slot | None]]:
    """Both lists in order: matched pairs, and single nodes with None."""
    table = _table(a, b)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (m := match(a[i - 1], b[j - 1])) and m:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and (not j or table[i][j] == table[i - 1][j]):
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


def _fade(slot: Slot) -> None:
    """Everything below a node that some page lacks varies."""
    if slot.leaf and slot.text is not None:
        slot.text, slot.vary = None, slot.mass
    for kid in slot.kids:
        _fade(kid)


def merge(a: Slot, b: Slot) -> Slot:
    """Wrapper of all pages of two wrappers with equal roots; ``a`` is changed and returned."""
    if a.leaf:
        if a.text is None or b.text is None or a.text != b.text:
            a.vary = (a.mass if a.text is not None else a.vary) + (b.mass if b.text is not None else b.vary)
            a.text = None
        a.mass += b.mass
        a.pages += b.pages
        return a
    a.pages += b.pages
    a.narrow |= b.narrow
    if [k.mark for k in a.kids] == [k.mark for k in b.kids] and [k.leaf for k in a.kids] == [k.leaf for k in b.kids]:
        for x, y in zip(a.kids, b.kids):  # the largest match is the plain one
            merge(x, y)
        return a
    out = []
    for x, y in _aligned(a.kids, b.kids):
        if x is not None and y is not None:
            out.append(merge(x, y))
        else:
            _fade(x or y)
            out.append(x or y)
    a.kids = out
    if len(out) > WIDE:
        a.kids, a.narrow = _narrowed(out), True
    return a


def _narrowed(kids: list[Slot]) -> list[Slot]:
    """Kids of one mark merged, so that a wrapper of very unlike pages stays small; no text is left out of the sums."""
    first: dict[tuple[str, bool], Slot] = {}
    for kid in kids:
        key = (kid.mark, kid.leaf)
        if len(first) >= WIDE and key not in first:
            key = (kid.mark.partition(".")[0], kid.leaf)
            kid.mark = key[0]
        if key in first:
            merge(first[key], kid)
        else:
            first[key] = kid
    return list(first.values())


def _element(mark: str) -> str:
    return mark.partition(".")[0]


def descent(wrapper: Slot, varying: bool = True) -> tuple[list[Slot], list[Slot]] | None:
    """Slots from the root down to the container that holds nearly all varying text (or all text), and the last one
    with its siblings of the same mark that are content too; None without any text."""
    totals: dict[int, int] = {}

    def total(s: Slot) -> int:
        own = (s.vary if s.text is None else 0) if s.leaf and varying else s.mass if s.leaf else 0
        totals[id(s)] = own + sum(map(total, s.kids))
        return totals[id(s)]

    if not total(wrapper):
        return None
    path = [wrapper]
    while True:
        at = path[-1]
        best = max(at.kids, key=lambda k: totals[id(k)], default=None)
        if best is None or totals[id(best)] == 0 or _element(best.mark) not in DESCENDS:
            return path, path[-1:]
        least = TWIN * totals[id(best)] / best.pages
        if totals[id(best)] < SHARE * totals[id(at)]:
            return path, path[-1:]
        twins = [k for k in at.kids if k is best or (k.mark == best.mark and totals[id(k)] and totals[id(k)] >= least * k.pages)]
        path.append(best)
        if len(twins) > 1:
            return path, twins
        if best.leaf or _element(best.mark) in ("article", "main"):
            return path, path[-1:]


def region(wrapper: Slot, varying: bool = True) -> list[str] | None:
    """Marks from the root down to the region."""
    found = descent(wrapper, varying)
    return found and [s.mark for s in found[0]]


def doubts(wrapper: Slot) -> dict[str, bool]:
    """Marks in doubt that several pages have -> whether their text is the same on all of them."""
    out: dict[str, bool] = {}

    def varies(s: Slot) -> bool:
        return s.leaf and s.text is None or any([varies(k) for k in s.kids])

    def walk(s: Slot) -> None:
        if "?" in s.mark and s.pages > 1:
            out[s.mark] = out.get(s.mark, True) and not varies(s)
        for kid in s.kids:
            walk(kid)

    walk(wrapper)
    return out


def plan(wrapper: Slot) -> bytes | None:
    """What a page of the host needs: the wrapper, the place among its siblings of each slot on the way, the last
    slot's twins, and the marks in doubt. Where the mark alone leads on, siblings are left out."""
    found = descent(wrapper)
    if found is None:
        return None
    path, twins = found
    unsure = doubts(wrapper)
    for up, at in zip(path, path[1:]):
        if up.narrow or sum(k.mark == at.mark for k in up.kids) > 1:
            break
        up.kids = [at]
    else:
        if not path[-1].narrow:
            path[-1].kids = []
    way = [next(n for n, k in enumerate(up.kids) if k is at) for up, at in zip(path, path[1:])]
    ends = [n for n, k in enumerate(path[-2].kids) if any(k is t for t in twins)] if len(path) > 1 else []
    return pickle.dumps((wrapper, way, ends, unsure))


def located(wrapper: Slot, way: list[int], ends: list[int], page: Slot) -> list[Node]:
    """Nodes of a page that fall into the region, by aligning its children with the wrapper's on each level."""
    if page.mark != wrapper.mark:
        return []
    found = [page]
    for level, n in enumerate(way):
        chosen = [wrapper.kids[k] for k in (ends if level == len(way) - 1 else [n])]
        mark = chosen[0].mark
        below = []
        for at in found:
            if wrapper.narrow:
                below += [k for k in at.kids if k.mark == mark or ("." not in mark and _element(k.mark) == mark)]
                continue
            same = [k for k in at.kids if k.mark == mark]
            if len(same) > 1 or sum(k.mark == mark for k in wrapper.kids) > 1:
                same = [y for x, y in _aligned(wrapper.kids, at.kids) if y is not None and any(x is c for c in chosen)]
            below += same
        found, wrapper = below, wrapper.kids[n]
    return [node for slot in found for node in slot.nodes]


def at_path(root: Node, path: list[str]) -> Node | None:
    """First node of a page that the marks lead to."""
    if root.mark != path[0]:
        return None
    if len(path) == 1:
        return root
    for kid in root.kids:
        if isinstance(kid, Node) and not kid.dropped and (found := at_path(kid, path[1:])) is not None:
            return found
    return None


def articles(node: Node) -> list[Node]:
    """Topmost kept article elements below ``node``, or else its main elements."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [node]
    while todo:
        n = todo.pop()
        for kid in n.kids:
            if isinstance(kid, Node) and not kid.dropped:
                if kid.tag in found:
                    found[kid.tag].append(kid)
                if kid.tag != "article":
                    todo.append(kid)
    return found["article"] or found["main"]


def main_text(page: str | None, path: list[str] | tuple | None) -> str:
    """Kept blocks of the region at ``path`` (marks, or a plan); a lone article in it narrows it down."""
    root = parse(page)
    nodes: list[Node] = []
    if isinstance(path, tuple):
        nodes = located(*path[:3], reduced(root))
    elif path:
        nodes = [n for n in [at_path(root, path)] if n is not None]
    settle(root, path[3] if isinstance(path, tuple) else {})
    nodes = [n for n in nodes if not n.dropped]
    if not nodes:
        nodes = [root]
        if not articles(root) and (own := descent(reduced(root), varying=False)):
            nodes = [n for slot in own[1] for n in slot.nodes] or nodes
    if len(nodes) == 1 and len(inner := articles(nodes[0])) == 1:
        nodes = inner
    return "\n".join(line for n in nodes for line in blocks(n))


WRAPPER = T.StructType().add("host", T.StringType()).add("wrapper", T.BinaryType())
REGION = T.StructType().add("host", T.StringType()).add("region", T.BinaryType())


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts met by this task; columns host, html."""
    held: dict[str, Slot] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([pickle.dumps(w) for w in held.values()])], names=WRAPPER.names)

    for batch in batches:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree = reduced(parse(page))
            held[name] = merge(held[name], tree) if name in held else tree
        if len(held) > HOSTS_HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of hosts; partial wrappers come sorted by host and are merged one after the other."""
    name, wrapper = None, None
    for batch in batches:
        names, paths = [], []
        for one, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree = pickle.loads(data)
            if one == name:
                wrapper = merge(wrapper, tree)
                continue
            if wrapper is not None:
                names.append(name)
                paths.append(plan(wrapper))
            name, wrapper = one, tree
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(paths, pa.binary())], names=REGION.names)
    if wrapper is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([plan(wrapper)], pa.binary())], names=REGION.names)


@F.pandas_udf(T.StringType())
def _extract(pages: pd.Series, paths: pd.Series) -> pd.Series:
    plans: dict[bytes | None, tuple | None] = {None: None}
    out = []
    for h, p in zip(pages, paths):
        if p not in plans:
            plans[p] = pickle.loads(p)
        out.append(main_text(h, plans[p]))
    return pd.Series(out, dtype=object)


def host_regions(pages: DataFrame) -> DataFrame:
    """(host, region) from pages (host, html); null where the host's pages do not differ."""
    partial = pages.mapInArrow(_induce, WRAPPER)
    ordered = partial.repartition("host").sortWithinPartitions("host", F.xxhash64("wrapper"))
    return materialize(ordered.mapInArrow(_combine, REGION), "regions")


def extract(pages: DataFrame, url: str = "url", into: str = "text") -> DataFrame:
    """``pages`` (with ``html``) and their main text in column ``into``."""
    name, found, out = free_names("host region text", pages)
    hosted = pages.withColumn(name, host(F.col(f"`{url}`")))
    regions = host_regions(hosted.select(F.col(name).alias("host"), "html")).where("region is not null")
    met = hosted.join(regions.select(F.col("host").alias(name), F.col("region").alias(found)), name, "left")
    met = met.withColumn(out, _extract("html", found))
    return met.select(*(F.col(f"`{c}`") for c in pages.columns if c != into), F.col(out).alias(into))


def report(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).drop("html").withColumn("n_chars", F.length("text").cast("long"))


#: for these tables: every page has one article of h1, p, b and br elements and a handful of references
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g'), '</?(p|h1)>', chr(10), 'g'), '<br>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(x, '<[^>]*>', '', 'g') AS x FROM b),
d AS (SELECT page_id, url, replace(replace(replace(replace(regexp_replace(x, '&amp([^;]|$)', '&amp;\1', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', '''') AS x FROM c),
e AS (SELECT page_id, url, list_filter(list_transform(string_split(replace(x, '&amp;', '&'), chr(10)), lambda y: trim(regexp_replace(y, ' +', ' ', 'g'))), lambda y: y <> '') AS x FROM d)
SELECT page_id, url, coalesce(array_to_string(x, chr(10)), '') AS text, CAST(length(coalesce(array_to_string(x, chr(10)), '')) AS BIGINT) AS n_chars FROM e"""
