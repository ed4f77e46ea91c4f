"""A tolerant HTML parser for text extraction, page skeletons, and their alignment
by simple tree matching. Plain functions of one page or of a few skeletons.

A *skeleton* is the tree of block-level elements without text, repeats merged:
siblings of equal structure are one node if at most ``REPEAT`` others stand
between them, and so are childless siblings of one name in a run of childless
siblings. It is written as one line per node in preorder: depth, space, label."""

from __future__ import annotations

import html
import re

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
REPEAT = 4
DEPTH = 200  # deeper elements are skeleton nodes at this depth

# Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements whose content is no text of the page.
SKIPPED = frozenset("script style title textarea noscript template svg math iframe object canvas audio video select datalist xmp noembed noframes".split())
VOID = frozenset("area base br col embed img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag ends an open element of these names, within the container named last.
ENDS = {
    **{h: (HEADINGS, ()) for h in HEADINGS},
    "li": (frozenset(["li"]), ("ul", "ol", "menu", "dir")),
    "dt": (frozenset(["dt", "dd"]), ("dl",)),
    "dd": (frozenset(["dt", "dd"]), ("dl",)),
    "tr": (frozenset(["tr", "td", "th"]), ("table",)),
    "td": (frozenset(["td", "th"]), ("tr", "table")),
    "th": (frozenset(["td", "th"]), ("tr", "table")),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr"]), ("table",)),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr"]), ("table",)),
}
SCOPE = frozenset(["table", "td", "th", "caption"])
# Parts of a page that are not its main text, by element, role, or word of class and id.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notification alert"
    " menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar comment comments reply replies respond disqus"
    " share sharing social newsletter subscribe signup login related popup modal overlay pagination pager toolbar".split()
)
TALK_WORDS = frozenset("comment comments reply replies respond disqus".split())
MAIN = 1  # kinds of a block: inside the main element, its heading, elsewhere
HEADING = 2
ELSEWHERE = 0


class _Node:
    __slots__ = ("tag", "label", "parent", "depth", "kids", "rule", "weak", "main", "holds_main", "talk", "same", "sig", "place")

    def __init__(self, tag: str, label: str, parent: "_Node | None"):
        self.tag, self.label, self.parent = tag, label, parent
        self.depth = parent.depth + 1 if parent else 0
        self.kids: list[_Node] = []
        self.rule = self.weak = self.main = self.holds_main = self.talk = False
        self.same: _Node | None = None


def _label(tag: str, attributes: str) -> tuple[str, set[str], str, bool]:
    """(label, words of class and id, role, hidden): the label has no digits, so
    numbered classes of one kind are equal."""
    words: set[str] = set()
    names, role, hidden = [], "", False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hidden = True
        elif name in ("class", "id"):
            words.update(w.lower() for w in TOKEN.findall(value))
            names.append(re.sub(r"[\d\s]+", " ", value).strip())
        else:
            role = role or value.strip().lower()
    return (f"{tag}.{' '.join(names)}" if names else tag).replace("\n", " "), words, role, hidden


def parse(page: str) -> tuple[str, list[tuple[int, str, int]]]:
    """(skeleton, blocks): blocks in page order as (skeleton node, text, kind). Text
    of menus, headers, footers and the like is left out; character references are
    decoded and white space is one space."""
    root = _Node("body", "body", None)
    nodes, stack = [root], [root]
    blocks: list[tuple[_Node, str]] = []
    parts: list[str] = []
    inline: list[str] = []  # open elements inside an inline element that is left out

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                blocks.append((stack[-1], text))

    def close_to(index: int) -> None:
        del stack[index:]

    def open_(tag: str, attributes: str) -> None:
        label, words, role, hidden = _label(tag, attributes) if attributes.strip(" /\n") else (tag, (), "", False)
        parent = stack[-1]
        node = _Node(tag, label, parent if parent.depth < DEPTH else parent.parent)
        inside = any(n.main for n in stack)
        node.main = (tag in ("article", "main") or role in ("main", "articlebody")) and ASIDE_WORDS.isdisjoint(words)
        node.rule = tag in ASIDE_TAGS or role in ASIDE_ROLES or hidden or (tag == "header" and not inside)
        named = not ASIDE_WORDS.isdisjoint(words)
        node.rule = node.rule or (named and inside)
        node.weak = not node.main and (named or ("header" in words and not inside))
        node.talk = not TALK_WORDS.isdisjoint(words)
        node.parent.kids.append(node)
        nodes.append(node)
        stack.append(node)
        if node.main:
            for n in stack[:-1]:  # a part named by class is the page's frame, if the main element is inside
                n.holds_main = n.holds_main or tag != "article" or not n.talk

    pos, end = 0, len(page)
    while pos < end:
        m = TAG.search(page, pos)
        text = page[pos : m.start() if m else end]
        if text and not inline:
            parts.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        pos, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if inline:  # inside an inline element that is left out
            if tag == inline[0]:
                inline.pop() if m[1] else inline.append(tag)
            if not (tag in BLOCKS and m[1]):
                continue
            inline.clear()
        if m[1]:
            if tag in BLOCKS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag or (tag in HEADINGS and stack[i].tag in HEADINGS):
                        flush()
                        close_to(i)
                        break
                    if stack[i].tag in SCOPE and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
                        break
        elif tag in SKIPPED and not m[3].endswith("/"):
            done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            pos = done.end() if done else end if tag in ("script", "style", "title", "textarea", "xmp") else pos
            parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1):  # a paragraph ends where a block starts
                if stack[i].tag == "p":
                    close_to(i)
                    break
                if stack[i].tag in SCOPE:
                    break
            names, within = ENDS.get(tag, ((), ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    close_to(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif not within or stack[i].tag in within:
                    break
            open_(tag, m[3])
        elif tag == "button" or (m[3] and ("class" in m[3] or "id" in m[3] or "role" in m[3] or "hidden" in m[3])):
            _, words, role, hidden = _label(tag, m[3])
            if tag not in VOID and tag not in ("html", "head", "body") and not m[3].endswith("/") and (tag == "button" or hidden or role in ASIDE_ROLES or not ASIDE_WORDS.isdisjoint(words)):
                inline.append(tag)
    flush()
    return _skeleton(nodes), _kept(blocks)


def _kept(blocks: list[tuple[_Node, str]]) -> list[tuple[int, str, int]]:
    """Blocks outside left-out parts; only those of the main elements, if these
    hold half of that text or more."""
    left_out: dict[int, tuple[bool, bool]] = {}

    def state(node: _Node) -> tuple[bool, bool]:
        """(left out, inside a main element), kept by node."""
        path = []
        while node is not None and id(node) not in left_out:
            path.append(node)
            node = node.parent
        out, main = left_out[id(node)] if node is not None else (False, False)
        for n in reversed(path):
            out = out or n.rule or (n.weak and not n.holds_main)
            main = main or (n.main and not out)
            left_out[id(n)] = out, main
        return out, main

    kept = [(n, t, main) for n, t in blocks for out, main in [state(n)] if not out]
    inside = sum(len(t) for _, t, main in kept if main)
    only_main = 2 * inside >= sum(len(t) for _, t, _ in kept) and inside
    return [
        (_same(n).place, t, (HEADING if n.tag == "h1" else MAIN) if main else ELSEWHERE)
        for n, t, main in kept
        if main or not only_main
    ]


def _same(node: _Node) -> _Node:
    while node.same is not None:
        node = node.same
    return node


def _skeleton(nodes: list[_Node]) -> str:
    """Merge repeats bottom-up and number what is left in preorder."""
    for node in reversed(nodes):  # children come after their parent
        left: list[_Node] = []
        for kid in node.kids:
            twin = None
            if kid.kids:
                twin = next((k for k in reversed(left[-REPEAT:]) if k.kids and k.sig == kid.sig), None)
            else:
                for k in reversed(left):
                    if k.kids:
                        break
                    if k.label == kid.label:
                        twin = k
                        break
            if twin is None:
                left.append(kid)
            else:
                pairs = [(kid, twin)]
                while pairs:
                    a, b = pairs.pop()
                    a.same = b
                    pairs.extend(zip(a.kids, b.kids, strict=False))
        node.kids = left
        node.sig = hash((node.label, tuple(k.sig for k in left)))
    lines = []
    todo = [(nodes[0], 0)]
    while todo:
        node, depth = todo.pop()
        node.place = len(lines)
        lines.append(f"{depth} {node.label}")
        todo.extend((k, depth + 1) for k in reversed(node.kids))
    return "\n".join(lines)


class Tree:
    """A skeleton read back: ``label[i]``, ``kids[i]``, ``parent[i]``."""

    def __init__(self, skeleton: str):
        self.label: list[str] = []
        self.kids: list[list[int]] = []
        self.parent: list[int] = []
        path: list[int] = []
        for i, line in enumerate(skeleton.split("\n")):
            depth, label = line.split(" ", 1)
            del path[int(depth) :]
            self.label.append(label)
            self.kids.append([])
            self.parent.append(path[-1] if path else -1)
            if path:
                self.kids[path[-1]].append(i)
            path.append(i)

    def add(self, label: str, parent: int) -> int:
        self.label.append(label)
        self.kids.append([])
        self.parent.append(parent)
        return len(self.label) - 1

    def write(self) -> str:
        lines, todo = [], [(0, 0)]
        while todo:
            i, depth = todo.pop()
            lines.append(f"{depth} {self.label[i]}")
            todo.extend((k, depth + 1) for k in reversed(self.kids[i]))
        return "\n".join(lines)


def align(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the largest mapping of nodes of ``b`` to nodes of ``a``
    that keeps labels, parents and the order of siblings, as {b node: a node}."""
    size: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def match(x: int, y: int) -> int:
        if (x, y) in size:
            return size[x, y]
        xs, ys = a.kids[x], b.kids[y]
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, p in enumerate(xs):
            row, above = best[i + 1], best[i]
            for j, q in enumerate(ys):
                w = max(above[j + 1], row[j])
                row[j + 1] = max(w, above[j] + match(p, q)) if a.label[p] == b.label[q] else w
        pairs, i, j = [], len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
        chosen[x, y] = pairs
        size[x, y] = 1 + best[len(xs)][len(ys)]
        return size[x, y]

    out: dict[int, int] = {}
    if a.label[0] == b.label[0]:
        match(0, 0)
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[y] = x
            todo.extend(chosen[x, y])
    return out


def merge(skeletons: list[str]) -> str:
    """The wrapper of some skeletons: one by one aligned with what is there, nodes
    without a partner inserted behind their last sibling that has one."""
    wrapper = Tree(skeletons[0])
    for s in skeletons[1:]:
        tree = Tree(s)
        at = align(wrapper, tree)
        for y in range(1, len(tree.label)):  # parents come first
            if y in at:
                continue
            parent = at[tree.parent[y]]
            before = [at[k] for k in tree.kids[tree.parent[y]] if k < y and k in at]
            at[y] = wrapper.add(tree.label[y], parent)
            row = wrapper.kids[parent]
            row.insert(row.index(before[-1]) + 1 if before else 0, at[y])
    return wrapper.write()


def places(wrapper: str, skeleton: str) -> list[int]:
    """For each node of ``skeleton`` its node of ``wrapper``, or -1."""
    at = align(Tree(wrapper), b := Tree(skeleton))
    return [at.get(i, -1) for i in range(len(b.label))]


def paths(skeleton: str) -> list[str]:
    """For each node the labels from the root down."""
    tree, out = Tree(skeleton), []
    for i, label in enumerate(tree.label):
        out.append(f"{out[tree.parent[i]]}/{label}" if i else label)
    return out
