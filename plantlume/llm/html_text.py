"""Visible text of HTML pages, laid out as a reader sees it.

A page is cut into tags and text, a tree is built with the tags that HTML implies, elements that
are not shown are left out, and the rest is laid out: blocks on lines of their own with blank
lines between paragraphs, list items with their markers, table cells in aligned columns. No step
uses recursion, and none searches the open elements for a tag that is not open.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, arrow_map, arrow_type

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
ESCAPED_RAW = {"textarea", "title"}
IN_HEAD = set("base link meta noscript script style template title".split())
NOT_SHOWN = set(
    "head script style template noscript title iframe noembed noframes object audio video canvas datalist area meta link".split()
)
#: not shown inside of svg and math
NOT_DRAWN = set("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
#: HTML that ends an open drawing or formula, unless it stands in one of HOLDS_HTML
BREAKS_OUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strike strong sub sup table tt u ul var".split()
)
HOLDS_HTML = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp".split()
)
SPACED = set("p blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol pre table ul menu dir xmp".split())
CLOSES_P = BLOCKS - {"body", "html", "legend", "option", "optgroup"} | {"xmp"}
LISTS = {"ul", "ol", "menu", "dir"}
#: what a start tag closes, and where looking for it ends
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}),
    "colgroup": ({"caption", "colgroup"}, {"table"}),
}
SECTIONS = {"tbody", "thead", "tfoot"}
TABLE_PARTS = {"caption", "colgroup", "col", "tr", "td", "th"} | SECTIONS
SCOPE = {"table", "td", "th", "caption", "html", "body", "button", "object", "template"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^\"'>]*")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = " \t\n\r\f"
FOLD = re.compile(f"[{SPACE}]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.children, self.parent = tag, attributes, [], parent


def tokens(page: str):
    """("text", s), ("start", tag, attributes, ends in a slash) and ("end", tag) in order; comments and declarations are dropped."""
    at, size, unclosed = 0, len(page), set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield ("text", page[at:])
            return
        if lt > at:
            yield ("text", page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after in "!?" and after:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        closing = after == "/"
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            if closing:  # a bogus comment
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                yield ("text", "<")
                at = lt + 1
            continue
        end = name.end()
        while True:
            end = PLAIN.match(page, end).end()
            if end >= size or page[end] == ">":
                break
            quote = page[end]
            close = -1 if quote in unclosed else page.find(quote, end + 1)
            if close < 0:
                unclosed.add(quote)  # none further on either
                end += 1
            else:
                end = close + 1
        at, tag = min(end + 1, size), name.group().lower()
        if closing:
            yield ("end", tag)
            continue
        inside = page[name.end() : end]
        attributes = {}
        if inside.strip(" /\n\t"):
            for m in ATTRIBUTE.finditer(inside):
                value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
                attributes.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
        yield ("start", tag, attributes, inside.endswith("/"))
        if tag in RAW or tag in ESCAPED_RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = close.start() if close else size
            if end > at:
                yield ("raw" if tag in RAW else "text", page[at:end])
            at = end


def build(page: str) -> tuple[Node, list[tuple[str, str]]]:
    """The tree, with implied tags, and media and text of its style sheets."""
    root = Node("html", {}, None)
    head = None
    body: Node | None = None
    open_ = [root]
    count: Counter[str] = Counter()  # open elements by tag, so that no search begins in vain
    sheets: list[tuple[str, str]] = []

    def cut(i: int) -> None:
        count.subtract(n.tag for n in open_[i:])
        del open_[i:]

    def add(tag: str, attributes: dict[str, str]) -> Node:
        parent, at = spot(tag)
        node = Node(tag, attributes, parent)
        parent.children.insert(at, node) if at is not None else parent.children.append(node)
        open_.append(node)
        count[tag] += 1
        return node

    def spot(tag: str | None) -> tuple[Node, int | None]:
        """Where something goes: what may not stand between rows and cells goes in front of its table."""
        top = open_[-1]
        if top.tag in {"table", "tr"} | SECTIONS and tag not in TABLE_PARTS and tag not in {"script", "style", "template", "form"}:
            k = next(i for i in range(len(open_) - 1, -1, -1) if open_[i].tag == "table" or not i)
            table = open_[k]
            if table.parent is not None:
                siblings = table.parent.children
                at = len(siblings) - 1
                while at >= 0 and siblings[at] is not table:
                    at -= 1
                return table.parent, max(at, 0)
        return top, None

    def close(tags: set[str], stop: set[str]) -> None:
        """Close the innermost open one of ``tags`` within a boundary, with those it stands in directly."""
        if not any(count[t] for t in tags):
            return
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in stop:
                break
            if open_[i].tag in tags:
                while i > 1 and open_[i - 1].tag in tags:
                    i -= 1
                cut(i)
                return

    def enter_body() -> None:
        nonlocal body
        if body is None:
            cut(1)
            body = add("body", {})

    for token in tokens(page):
        kind = token[0]
        if kind == "raw":
            if open_[-1].tag == "style":
                a = open_[-1].attributes
                if a.get("type", "").strip().lower() in ("", "text/css") and not (count["noscript"] or count["template"]):
                    sheets.append((a.get("media", ""), token[1]))
            else:
                open_[-1].children.append(token[1])
            continue
        if kind == "text":
            text = html.unescape(token[1]) if "&" in token[1] else token[1]
            blank = not text.strip(SPACE)
            if open_[-1].tag not in ESCAPED_RAW:
                if blank and (body is None or open_[-1].tag in {"table", "tr"} | SECTIONS):
                    continue
                if body is None and not any(n.tag in NOT_SHOWN - {"head"} for n in open_):
                    enter_body()
            parent, at = (open_[-1], None) if blank or open_[-1].tag in ESCAPED_RAW else spot(None)
            parent.children.insert(at, text) if at is not None else parent.children.append(text)
            continue
        tag = token[1]
        if kind == "start":
            attributes = token[2]
            if tag == "html":
                root.attributes = {**attributes, **root.attributes}
                continue
            if tag == "head":
                if head is None and body is None:
                    head = add("head", attributes)
                continue
            if tag in ("body", "frameset"):
                if body is None:
                    enter_body()
                body.attributes = {**attributes, **body.attributes}
                continue
            if body is None and tag not in IN_HEAD:
                enter_body()
            foreign = count["svg"] or count["math"]
            if foreign and tag in BREAKS_OUT:
                k = next(i for i in range(len(open_) - 1, -1, -1) if open_[i].tag in HOLDS_HTML or open_[i].tag in ("svg", "math"))
                if open_[k].tag not in HOLDS_HTML:
                    cut(k)
                    foreign = False
            if tag in CLOSES_P:
                close({"p"}, SCOPE)
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in TABLE_PARTS and not count["table"]:
                continue  # a part without a table is no element
            if tag in TABLE_PARTS:
                while open_[-1].tag not in {"table", "tr"} | SECTIONS | {"colgroup"}:
                    cut(len(open_) - 1)
                if tag in ("td", "th") and open_[-1].tag != "tr":
                    if open_[-1].tag == "table":
                        add("tbody", {})
                    add("tr", {})
                elif tag == "tr" and open_[-1].tag == "table":
                    add("tbody", {})
            add(tag, attributes)
            if tag in VOID or token[3] and (tag in ("svg", "math") or foreign and not count["foreignobject"]):
                cut(len(open_) - 1)
            continue
        if tag == "br":
            enter_body()
            add("br", {})
            cut(len(open_) - 1)
        elif tag in ("html", "body"):
            continue
        elif tag == "p" and not (count["p"] and _within(open_, "p", SCOPE)):
            enter_body()
            add("p", {})
            cut(len(open_) - 1)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    cut(i)
                    break
                if open_[i].tag in SCOPE:
                    break
        elif count[tag]:
            stop = {"html", "body"} if tag in SCOPE else ({"table", "html", "body"} if tag in TABLE_PARTS else SCOPE)
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    cut(i)
                    break
                if open_[i].tag in stop:
                    break
    return root, sheets


def _within(open_: list[Node], tag: str, stop: set[str]) -> bool:
    for node in reversed(open_):
        if node.tag == tag:
            return True
        if node.tag in stop:
            return False
    return False


#: the screen that media conditions are asked about, in pixels
WIDTH, HEIGHT = 1280, 800
CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|url\([^)"']*\)|\\.|[{};]|[^/"'u\\{};]+|.""", re.S | re.I)
_ID = r"(?:\\[0-9a-fA-F]{1,6}\s?|\\.|[\w-]|[^\x00-\x7f])+"
SIMPLE = re.compile(
    rf"""(?P<nest>&)|(?P<tag>\*|{_ID})|\#(?P<id>{_ID})|\.(?P<class>{_ID})|\[\s*(?P<name>{_ID})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<one>[^"]*)"|'(?P<two>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[is])?\s*)?\]"""
    rf"""|(?P<colons>::?)(?P<pseudo>{_ID})(?:\((?P<inside>(?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\))?""", re.X | re.S)
ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", re.S)
COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
FEATURE = re.compile(r"\(\s*(?:(min|max)-)?(width|height)\s*(?::|(>=|<=|>|<|=))\s*([\d.]+)(px|r?em)\s*\)\Z")
SUPPORTED = re.compile(r"\(\s*display\s*:\s*(?:inline-)?(?:flex|grid|block)\s*\)\Z")
DYNAMIC = set("hover focus active focus-within focus-visible target visited fullscreen modal popover-open".split())
OLD_ELEMENTS = {"before", "after", "first-line", "first-letter"}
#: at-rules whose bodies hold no rules for elements
OTHER_BODIES = set("keyframes font-face page counter-style property font-feature-values font-palette-values view-transition starting-style position-try".split())
#: chains of compounds and of nested rules are settled for the whole page in steps of this length, so that no recursion is deep
STRIDE = 6
#: truths kept for a page before those that can be found again are dropped
KEPT = 2_000_000
SHOWN, GONE = "shown", "none"


def _all(states) -> bool | None:
    """And of truths that may be unknown (None)."""
    out = True
    for state in states:
        if state is False:
            return False
        out = out and state
    return out


def _any(states) -> bool | None:
    out: bool | None = False
    for state in states:
        if state:
            return True
        out = None if state is None else out
    return out


def _split(text: str, at: str = ",") -> list[str]:
    """Parts between separators outside of brackets, quotes and escapes."""
    out, depth, start, quote, k = [], 0, 0, "", 0
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == at and depth <= 0:
            out.append(text[start:k])
            start = k + 1
        k += 1
    return [*out, text[start:]]


def applies(media: str) -> bool | None:
    """If a media list holds on a screen of ``WIDTH`` by ``HEIGHT``; None where that can't be told."""
    return _any(_medium(m) for m in _split(media.lower())) if media.strip() else True


def _medium(query: str) -> bool | None:
    query = query.strip()
    flip = re.match(r"not\b\s*", query)
    states = []
    for part in re.split(r"\s*\band\b\s*", query[flip.end() :] if flip else re.sub(r"^only\b\s*", "", query)):
        part = part.strip()
        m = FEATURE.match(part)
        if re.fullmatch(r"[a-z-]+", part):
            states.append(part in ("all", "screen"))
        elif m:
            side, have = m[1] or m[3] or "=", WIDTH if m[2] == "width" else HEIGHT
            try:
                want = float(m[4]) * (1 if m[5] == "px" else 16)
            except ValueError:
                states.append(None)
                continue
            states.append({"min": have >= want, ">=": have >= want, "max": have <= want, "<=": have <= want, ">": have > want, "<": have < want, "=": have == want}[side])
        elif re.fullmatch(r"\(\s*orientation\s*:\s*(landscape|portrait)\s*\)", part):
            states.append("landscape" in part)
        else:
            states.append(None)
    state = _all(states)
    return (None if state is None else not state) if flip else state


def _declared(text: str) -> tuple[str, str, bool] | None:
    """Property, effect and importance of a declaration that shows or hides."""
    name, _, value = text.partition(":")
    name, value = name.strip().lower(), value.strip().lower()
    if name not in ("display", "visibility") or not value:
        return None
    important = re.search(r"!\s*important\Z", value)
    value = value[: important.start()].strip() if important else value
    if name == "display":
        effect = "back" if value in ("revert", "revert-layer") else GONE if value == "none" else SHOWN
    elif value in ("hidden", "collapse", "visible", "initial"):
        effect = "visible" if value in ("visible", "initial") else "hidden"
    else:
        effect = "back" if value in ("inherit", "unset", "revert", "revert-layer") else "visible"
    return name, effect, bool(important)


def _unescape(name: str) -> str:
    if "\\" not in name:
        return name
    return ESCAPE.sub(lambda m: m[2] if m[1] is None else chr(int(m[1], 16)) if 0 < int(m[1], 16) < 0x110000 else "\ufffd", name)


class Selector:
    """Compounds of a selector from the right, each with the combinator to its right; None-valued where unknown.

    ``nest`` are the selectors of the rule around it: ``&`` stands for any of them, and without one
    the selector is about their descendants.
    """

    def __init__(self, text: str, depth: int = 0, nest: list[Selector] | None = None):
        self.parts: list[tuple[str, list[tuple]]] = []
        self.weight = [0, 0, 0]
        self.nest, self.nested = nest, False
        self.inside: list[Selector] = []  # selectors in brackets, the innermost first
        text, at, joined, simple = text.strip(), 0, "", []
        lead = COMBINATOR.match(text) if nest and not depth else None
        if lead and lead[1]:  # "> p" inside of a rule
            self.parts, joined, at = [("", [self._nest()])], lead[1], lead.end()
        while at < len(text):
            m = SIMPLE.match(text, at)
            if m and m.end() > at:
                simple.append(self._simple(m, depth))
                at = m.end()
                continue
            c = COMBINATOR.match(text, at)
            if not c or not simple:
                raise ValueError(text)
            self.parts.append((joined, simple))
            joined, simple, at = c[1] or " ", [], c.end()
        if not simple:
            raise ValueError(text)
        self.parts.append((joined, simple))
        if nest and not self.nested and not depth:
            self.parts = [("", [self._nest()]), (" ", self.parts[0][1]), *self.parts[1:]]
        # (combinator towards the right neighbour, compound), the subject first
        joins = [j for j, _ in self.parts[1:]]
        self.parts = [(j, p) for j, (_, p) in zip(["", *reversed(joins)], reversed(self.parts))]
        self.key = next((x[:2] for kind in ("id", "class", "tag") for x in self.parts[0][1] if x[0] == kind and x[1] != "*"), ("", ""))

    def _nest(self) -> tuple:
        if not self.nest:
            return "pseudo", "root", ""
        self.nested = True
        self.weight = [a + b for a, b in zip(self.weight, max(s.weight for s in self.nest))]
        return "nest", self.nest

    def _simple(self, m: re.Match, depth: int) -> tuple:
        if m["nest"]:
            return self._nest()
        kind = "pseudo" if m["pseudo"] else "id" if m["id"] else "class" if m["class"] else "name" if m["name"] else "tag"
        if kind == "tag":
            self.weight[2] += m["tag"] != "*"
            return "tag", _unescape(m["tag"]).lower()
        if kind == "pseudo":
            name = m["pseudo"].lower()
            if m["colons"] == "::" or name in OLD_ELEMENTS:
                return "never", name
            if name in ("not", "is", "where", "matches", "any", "-webkit-any", "-moz-any") and m["inside"] is not None and depth < 4:
                inner = [Selector(x, depth + 1, self.nest) for x in _split(m["inside"])]
                self.nested = self.nested or any(i.nested for i in inner)
                self.inside += [x for i in inner for x in (*i.inside, i)]
                if name != "where":
                    self.weight = [a + b for a, b in zip(self.weight, max(i.weight for i in inner))]
                return ("not" if name == "not" else "is"), inner
            self.weight[1] += name != "where"
            return "pseudo", name, (m["inside"] or "").strip().lower()
        self.weight[0 if kind == "id" else 1] += 1
        if kind == "name":
            value = next((_unescape(m[g]) for g in ("one", "two", "bare") if m[g] is not None), "")
            return "name", _unescape(m["name"]).lower(), m["op"], value, m["flag"]
        return kind, _unescape(m[kind])


class Visibility:
    """What is laid out: ``hidden``, and the cascade of ``display`` and ``visibility``.

    Style rules count that hold on a screen of ``WIDTH`` by ``HEIGHT`` pixels, by importance, layer,
    weight and place; inline styles stand above them. Where it can't be told if a rule holds (its
    media condition or a part of its selector), it may show text but hides none.
    """

    def __init__(self, sheets: list[tuple[str, str]]):
        self.rules: dict[tuple[str, str], list[tuple]] = {}
        self.layers: dict[tuple, dict[str, int]] = {}
        self.siblings: dict[int, tuple[Node, dict[int, int], list[Node]]] = {}
        self.count = 0
        # truths by (selector or list of selectors, part) and node; ``ahead`` are settled first, for all nodes
        self.known: dict[tuple[int, int], dict[int, bool | None]] = {}
        self.ahead: list[tuple] = []
        self.depths: dict[int, int] = {}
        self.settled: set[tuple[int, int]] = set()
        self.kept = 0
        for media, sheet in sheets:
            holds = applies(media)
            if holds is not False:
                self._read(sheet, holds)

    # ---- sheets ----

    def _read(self, sheet: str, holds: bool | None) -> None:
        # (selectors or None outside of rules, if the surroundings hold, layer); False: nothing here holds
        stack: list[tuple[list[Selector] | None, bool | None, tuple]] = [(None, holds, ())]
        text: list[str] = []
        for token in CSS.findall(sheet):
            if token.startswith("/*"):
                text.append(" ")
                continue
            if token not in ("{", "}", ";"):
                text.append(token)
                continue
            head, text = "".join(text).strip(), []
            selectors, holds, layer = stack[-1]
            if token == "{":
                stack.append(self._open(head.removeprefix("<!--").strip(), selectors, holds, layer))
                continue
            if head.lower().startswith("@layer") and token == ";":
                for name in _split(head[6:]):
                    self._layer(layer, name)
            elif selectors and holds is not False:
                self._add(head, selectors, holds, layer)
            if token == "}" and len(stack) > 1:
                stack.pop()
        selectors, holds, layer = stack[-1]
        if selectors and holds is not False:
            self._add("".join(text).strip(), selectors, holds, layer)

    def _layer(self, layer: tuple, name: str) -> tuple:
        for part in name.strip().split(".") if name.strip() else [f" {len(self.layers.get(layer, ()))}"]:
            known = self.layers.setdefault(layer, {})
            layer = (*layer, known.setdefault(part.strip(), len(known)))
        return layer

    def _open(self, head: str, selectors: list[Selector] | None, holds: bool | None, layer: tuple) -> tuple:
        if head.startswith("@"):
            name = re.match(r"@([\w-]*)", head)[1].lower()
            rest = head[len(name) + 1 :].strip()
            if name == "layer":
                return selectors, holds, self._layer(layer, rest)
            if re.sub(r"^-[a-z]+-", "", name) in OTHER_BODIES:
                return None, False, layer
            state = applies(rest) if name == "media" else True if name == "supports" and SUPPORTED.match(rest) else None
            return selectors, _all((holds, state)), layer
        if holds is False:
            return [], False, layer
        try:
            own = [Selector(x, nest=selectors or None) for x in _split(head)]
        except ValueError:
            return [], False, layer  # a list with an error in it is no rule, nor is what is nested in it
        for selector in (x for o in own for x in (*o.inside, o)):
            self.ahead += [(selector, k) for k in range(len(selector.parts) - STRIDE, 0, -STRIDE)]
        depth = self.depths[id(own)] = self.depths.get(id(selectors), 0) + 1
        if depth % STRIDE == 0:
            self.ahead.append((own, 0))
        return own, holds, layer

    def _add(self, text: str, selectors: list[Selector], holds: bool | None, layer: tuple) -> None:
        declared = _declared(text)
        if not declared:
            return
        name, effect, important = declared
        rank = (*layer, float("inf"))
        rank = tuple(-x for x in rank) if important else rank
        for selector in selectors:
            self.count += 1
            self.rules.setdefault(selector.key, []).append((selector, holds, name, effect, (important, False, rank, selector.weight, self.count)))

    # ---- selectors ----

    def _place(self, node: Node) -> tuple[int, list[Node]]:
        """Place among the elements of its parent, and those."""
        parent = node.parent
        if parent is None:
            return 0, [node]
        if id(parent) not in self.siblings:
            of = [c for c in parent.children if not isinstance(c, str)]
            self.siblings[id(parent)] = (parent, {id(c): k for k, c in enumerate(of)}, of)
        _, places, of = self.siblings[id(parent)]
        return places[id(node)], of

    def _simple(self, x: tuple, node: Node) -> bool | None:
        kind, a = x[0], node.attributes
        if kind == "tag":
            return x[1] in ("*", node.tag)
        if kind == "class":
            return x[1] in a.get("class", "").split()
        if kind == "id":
            return a.get("id") == x[1]
        if kind == "never":
            return False
        if kind == "nest":
            return self._any_of(x[1], node)
        if kind in ("is", "not"):
            state = _any(self.matches(s, node) for s in x[1])
            return state if kind == "is" or state is None else not state
        if kind == "name":
            _, name, op, want, flag = x
            if name not in a or not op:
                return name in a
            have = a[name]
            if flag == "i" or name in ("type", "lang", "dir", "hidden", "method", "rel", "media"):
                have, want = have.lower(), want.lower()
            if op == "=":
                return have == want
            if op == "~=":
                return want in have.split()
            if op == "|=":
                return have == want or have.startswith(f"{want}-")
            return bool(want) and (have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have)
        name, inside = x[1], x[2]
        if name in DYNAMIC:
            return False
        if name in ("link", "any-link"):
            return node.tag in ("a", "area") and "href" in a
        if name == "root":
            return node.parent is None
        if name == "checked":
            return "checked" in a or "selected" in a
        if name in ("first-child", "last-child", "only-child"):
            k, of = self._place(node)
            return (k == 0 or name == "last-child") and (k == len(of) - 1 or name == "first-child")
        if name == "nth-child":
            m = re.fullmatch(r"(?:([+-]?\d*)n\s*)?(?:([+-]?)\s*(\d+))?", {"odd": "2n+1", "even": "2n"}.get(inside, inside))
            if m and (m[1] is not None or m[3]):
                step = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
                off = self._place(node)[0] + 1 - int(f"{m[2]}{m[3] or 0}")
                return off == 0 if not step else off % step == 0 and off // step >= 0
        return None

    def matches(self, selector: Selector, node: Node) -> bool | None:
        return self._from(selector, 0, node)

    def _from(self, selector: Selector, at: int, node: Node) -> bool | None:
        """If ``node`` fits the compound ``at`` and its surroundings fit those to the left."""
        if at:
            known = self.known.setdefault((id(selector), at), {})
            if id(node) in known:
                return known[id(node)]
        state = _all(self._simple(x, node) for x in selector.parts[at][1])
        if state is not False and at + 1 < len(selector.parts):
            state = _all((state, self._beside(selector, at + 1, node)))
        if at:
            known[id(node)] = state
            self.kept += 1
        return state

    def _beside(self, selector: Selector, at: int, node: Node) -> bool | None:
        """If a node that the combinator of compound ``at`` leads to from ``node`` fits it; each node is asked once."""
        joined = selector.parts[at][0]
        if joined in ">+":
            other = next(self._joined(node, joined), None)
            return False if other is None else self._from(selector, at, other)
        known = self.known.setdefault((id(selector), -at), {})
        path = [node]
        for other in self._joined(node, joined):
            if id(path[-1]) in known:
                break
            path.append(other)
        state = known.setdefault(id(path[-1]), False)  # the last one leads nowhere
        for k in range(len(path) - 2, -1, -1):
            state = known[id(path[k])] = _any((state, self._from(selector, at, path[k + 1])))
        return state

    def _any_of(self, selectors: list[Selector], node: Node) -> bool | None:
        known = self.known.setdefault((id(selectors), 0), {})
        if id(node) not in known:
            known[id(node)] = _any(self.matches(s, node) for s in selectors)
        return known[id(node)]

    def _look_ahead(self, node: Node) -> None:
        """Settle every ``STRIDE``-th step of long chains of compounds and of nested rules, from their outer ends."""
        steps, self.ahead = self.ahead, []
        self.settled = {(id(of), at) for of, at in steps}
        while node.parent is not None:
            node = node.parent
        nodes = [node]
        for of in nodes:
            nodes.extend(c for c in of.children if not isinstance(c, str))
        for of, at in steps:
            for other in nodes:
                if at:
                    self._from(of, at, other)
                else:
                    self._any_of(of, other)

    def _joined(self, node: Node, joined: str):
        if joined in "+~":
            k, of = self._place(node)
            yield from (of[i] for i in range(k - 1, max(k - 2, -1) if joined == "+" else -1, -1))
            return
        parent = node.parent
        while parent is not None:
            yield parent
            parent = None if joined == ">" else parent.parent

    def of(self, node: Node) -> str | None:
        """"none" (not laid out), "hidden" or "visible" (text of the element itself), or None."""
        a, tag = node.attributes, node.tag
        if tag in NOT_SHOWN or tag == "input" and a.get("type", "").lower() == "hidden":
            return GONE
        found: dict[str, list[tuple]] = {}
        if "style" in a:
            for k, text in enumerate(_split("".join(t for t in CSS.findall(a["style"]) if not t.startswith("/*")), ";")):
                declared = _declared(text)
                if declared:
                    found.setdefault(declared[0], []).append(((declared[2], True, (), [], k), declared[1]))
        if self.ahead:
            self._look_ahead(node)
        if self.kept > KEPT:
            self.known, self.kept = {k: v for k, v in self.known.items() if k in self.settled}, 0
        if self.rules:
            keys = [("", ""), ("tag", tag), *(("class", c) for c in dict.fromkeys(a.get("class", "").split())), ("id", a.get("id"))]
            for key in keys:
                for selector, holds, name, effect, rank in self.rules.get(key, ()):
                    state = _all((self.matches(selector, node), holds))
                    if state or state is None and effect in (SHOWN, "visible"):
                        found.setdefault(name, []).append((rank, effect))
        display, visibility = (max(found[n])[1] if n in found else "back" for n in ("display", "visibility"))
        if display == GONE or display == "back" and ("hidden" in a or tag == "dialog" and "open" not in a):
            return GONE
        return None if visibility == "back" else visibility


class Lines:
    """Text flow of a page or a cell: folds white space, breaks lines, indents list items."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0  # line breaks due before the next text
        self.indents: list[list] = []  # [marker still to be written or None, width]

    def write(self, text: str, pre: bool) -> None:
        if pre:
            for k, line in enumerate(text.replace("\r\n", "\n").split("\n")):
                if k:
                    self.newline()
                if line:
                    self._put(line)
            return
        words = FOLD.sub(" ", text)
        if words.startswith(" "):
            self.space = True
            words = words[1:]
        if not words:
            return
        trailing = words.endswith(" ")
        self._put(words[:-1] if trailing else words)
        self.space = trailing

    def _put(self, text: str) -> None:
        if self.gap:
            if self.now:
                self._end()
            if self.done:
                self.done.extend([""] * (self.gap - 1))
            self.gap, self.space = 0, False
        if not self.now:
            self.now.append(self._lead())
            self.space = False
        if self.space:
            self.now.append(" ")
            self.space = False
        self.now.append(text)

    def _lead(self) -> str:
        out = []
        for item in self.indents:
            out.append(item[0].ljust(item[1]) if item[0] else " " * item[1])
            item[0] = None
        return "".join(out)

    def _end(self) -> None:
        self.done.append("".join(self.now).rstrip(" "))
        self.now = []

    def newline(self) -> None:
        """A forced break; with nothing on the line it leaves an empty one."""
        if self.gap or not (self.now or self.done):
            if not (self.now or self.done):
                return
            self.gap = max(self.gap, 1) + (0 if self.now and self.gap < 1 else 1)
        else:
            self.gap = 1
        self.space = False

    def block(self, breaks: int) -> None:
        if self.now or self.done:
            self.gap = max(self.gap, breaks)
        self.space = False

    def lines(self) -> list[str]:
        if self.now:
            self._end()
        return self.done


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


MOST_PADDING = 60


def _span(node: Node, name: str) -> int:
    try:
        return min(max(1, int(node.attributes.get(name, "1"))), 1000)
    except ValueError:
        return 1


def lay_table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, columns, rows spanned) as aligned lines; longer cells than ``MOST_PADDING`` push the rest."""
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column: rows still covered from above
    for row in rows:
        placed, column = [], 0
        busy = {c for c, n in taken.items() if n > 0}
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, wide, tall in row:
            while column in busy:
                column += 1
            placed.append((column, wide, lines))
            if tall > 1:
                taken.update({c: tall - 1 for c in range(column, column + wide)})
            column += wide
        grid.append(placed)
    widths: dict[int, int] = {}
    for placed in grid:
        for column, wide, lines in placed:
            if wide == 1:
                widths[column] = max(widths.get(column, 0), min(MOST_PADDING, max(map(_width, lines), default=0)))
    used = sorted(widths)
    start, at = {}, 0
    for column in range(max((c for p in grid for c, _, _ in p), default=-1) + 1):
        start[column] = at
        if column in widths and widths[column]:
            at += widths[column] + 2
    out = []
    for placed in grid:
        for k in range(max((len(lines) for _, _, lines in placed), default=0)):
            line, filled = [], 0
            for column, _, lines in placed:
                if k < len(lines) and lines[k]:
                    gap = max(start[column] - filled, 2 if filled else 0)
                    line.append(" " * gap + lines[k])
                    filled += gap + _width(lines[k])
            out.append("".join(line).rstrip(" "))
    return out if used or out else []


def render(root: Node, visibility: Visibility) -> str:
    flows, tables, lists = [Lines()], [], []
    # (node or text, True when its children are done, hidden, preformatted, within a drawing or formula)
    stack: list[tuple] = [(root, False, False, False, False)]
    while stack:
        node, leaving, hidden, pre, drawn = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not hidden:
                flow.write(node, pre)
            continue
        tag = node.tag
        if leaving:
            if drawn and tag == "text":
                flow.write(" ", False)
            if tag in ("td", "th", "caption") and tables:
                lines = flows.pop().lines()
                if tag == "caption":
                    tables[-1][0].extend(lines)
                else:
                    if not tables[-1][1]:
                        tables[-1][1].append([])
                    tables[-1][1][-1].append((lines, _span(node, "colspan"), _span(node, "rowspan")))
            elif tag == "table":
                caption, rows = tables.pop()
                flow.block(2)
                for line in caption + lay_table(rows):
                    flow.block(1)
                    if line:
                        flow._put(line)
                    else:
                        flow.newline()
                flow.block(2)
            else:
                if tag in LISTS and lists:
                    lists.pop()
                if tag in ("li", "dd", "blockquote"):
                    item = flow.indents.pop()
                    if item[0] and tag == "li":  # an empty item still shows its marker
                        flow.indents.append(item)
                        flow._put("")
                        flow.indents.pop()
                if tag in BLOCKS:
                    flow.block(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
            continue
        effect = visibility.of(node)
        if effect == "none" or drawn and tag in NOT_DRAWN:
            continue
        drawn = tag in ("svg", "math") or drawn and tag != "foreignobject"
        if drawn and tag == "text":  # placed by itself
            flow.write(" ", False)
        hidden = effect == "hidden" or hidden and effect != "visible"
        if tag == "br":
            flow.newline()
            continue
        if tag == "hr":
            flow.block(2)
            continue
        if tag == "input":
            value = node.attributes.get("value", "")
            if not hidden and value and node.attributes.get("type", "text").lower() not in ("checkbox", "radio", "password", "image", "file", "color", "range"):
                flow.write(f" {value} ", False)
            continue
        pre = pre or tag in ("pre", "textarea", "xmp", "listing", "plaintext")
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
        if tag in ("pre", "textarea") and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        if tag in BLOCKS:
            flow.block(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
        if tag == "table":
            tables.append(([], []))
        elif tag == "tr" and tables:
            tables[-1][1].append([])
        elif tag in ("td", "th", "caption") and tables:
            flows.append(Lines())
        elif tag in LISTS:
            first = node.attributes.get("start", "1")
            lists.append([tag == "ol", int(first) if first.lstrip("-").isdigit() and len(first) < 10 else 1])
        elif tag == "li":
            marker = "- "
            if lists and lists[-1][0]:
                value = node.attributes.get("value", "")
                number = int(value) if value.lstrip("-").isdigit() and len(value) < 10 else lists[-1][1]
                marker, lists[-1][1] = f"{number}. ", number + 1
            flow.indents.append([None if hidden else marker, len(marker)])
        elif tag in ("dd", "blockquote"):
            flow.indents.append([None, 4 if tag == "dd" else 2])
        stack.append((node, True, hidden, pre, drawn))
        stack.extend((c, False, hidden, pre, drawn) for c in reversed(children))
    return "\n".join(flows[0].lines()).strip("\n")


def visible_text(page: str) -> str:
    """Laid-out visible text of one page."""
    root, sheets = build(page)
    return render(root, Visibility(sheets))


def _extract(batches: Batches, schema: pa.Schema) -> Batches:
    for batch in batches:
        texts = [None if h is None else visible_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], schema=schema)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    A null page has null text, an empty one and one that shows nothing the empty text. Repeated
    rows are rendered each; other columns are ignored.
    """
    kinds = [pages.schema[c].dataType for c in ("page_id", "url")]
    kind = T.StructType([T.StructField("page_id", kinds[0]), T.StructField("url", kinds[1]), T.StructField("text", T.StringType())])
    schema = pa.schema([("page_id", arrow_type(kinds[0])), ("url", arrow_type(kinds[1])), ("text", pa.string())])
    return arrow_map(pages.select("page_id", "url", "html"), partial(_extract, schema=schema), kind)


def lines_in(text) -> F.Column:
    return F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0)
