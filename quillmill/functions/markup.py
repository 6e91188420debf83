"""HTML and XML documents: a forgiving tree builder and an XPath evaluator.

Browsers' tag soup has no strict grammar; the builder closes what HTML lets
authors leave open, drops scripts' structure and repairs broken comments and
CDATA. XPath covers the axes and functions that document queries use.
"""

from __future__ import annotations

import html
import re
from html.entities import html5
from html.parser import HTMLParser
from typing import Any

# HTML elements without content, and what closes an open element of the same kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article header footer form pre blockquote nav main hr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
BLOCKS = frozenset("html body div section article table ul ol dl form nav main header footer".split())
HEAD_TAGS = frozenset("title meta link base style script".split())
_REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")
#: Stands for an ampersand that begins no reference until the tree is built; no valid text holds it.
_PLAIN_AND = "\ud800"


class Node:
    """An element, text or comment; the document is an element named ''."""

    __slots__ = ("attrs", "children", "kind", "name", "parent", "text")

    def __init__(self, kind: str, name: str = "", text: str = "", attrs: dict[str, str] | None = None) -> None:
        self.kind, self.name, self.text, self.attrs = kind, name, text, attrs or {}
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def string(self) -> str:
        if self.kind != "element":
            return self.text if self.kind == "text" else ""
        return "".join(c.string() for c in self.children)

    def pieces(self) -> list[str]:
        """Texts of the direct and inner text nodes, trimmed, without empty ones."""
        if self.kind == "text":
            return [t] if (t := self.text.strip()) else []
        return [p for c in self.children for p in c.pieces()]

    def outer(self) -> str:
        if self.kind == "text":
            return html.escape(self.text, quote=False)
        if self.kind == "comment":
            return f"<!--{self.text}-->"
        inner = self.inner()
        if not self.name:
            return inner
        attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.name}{attrs}>{inner}</{self.name}>" if inner else f"<{self.name}{attrs} />"

    def inner(self) -> str:
        return "".join(c.outer() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self, xml: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.xml = xml
        self.root = self.at = Node("element")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool = False) -> None:
        tag, attrs = _with_and(tag), [(_with_and(k), v and _with_and(v)) for k, v in attrs]
        if not self.xml:
            while self.at.name in CLOSED_BY and tag in CLOSED_BY[self.at.name]:
                self.at = self.at.parent
        node = self.at.add(Node("element", tag, attrs={k: v if v is not None else k for k, v in attrs}))
        if not closed and (self.xml or tag not in VOID):
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs, closed=self.xml or tag in VOID)

    def handle_endtag(self, tag: str) -> None:
        tag = _with_and(tag)
        node: Node | None = self.at
        while node is not None and node.name != tag:
            if not self.xml and node.name in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag doesn't close a block
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.add(Node("text", text=_with_and(data)))

    def handle_comment(self, data: str) -> None:
        self.at.add(Node("comment", text=_with_and(data)))

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.at.add(Node("text", text=_with_and(data[6:])))


def _with_and(text: str) -> str:
    return text.replace(_PLAIN_AND, "&")


def _closed_only(m: re.Match[str]) -> str:
    ref = m[1] or ""
    return m[0] if ref.startswith("#") or ref in html5 else _PLAIN_AND + ref


def parse(text: str | None, repair_cdata: bool = True, repair_comments: bool = True, drop_instructions: bool = True, closed_refs: bool = False) -> Node | None:
    """The tree of a document; XML if it says so, else HTML with html, head and body made up.

    In HTML some character references need no semicolon; with ``closed_refs``
    all do, and what lacks it is text.
    """
    if not text or not text.strip():
        return None
    t = text.replace("\0", "")
    xml = t.lstrip().startswith("<?xml")
    if repair_cdata:
        t = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: html.escape(m[1], quote=False), t, flags=re.S)
    if repair_comments:
        t = re.sub(r"<!\[(?:if|endif)[^\]>]*\]-{0,2}>", "", t)
    if drop_instructions:
        t = re.sub(r"<\?.*?\?>", "", t, flags=re.S)
    if closed_refs:
        t = _REFERENCE.sub(_closed_only, t)
    b = _Builder(xml)
    b.feed(t)
    b.close()
    return b.root if xml else _complete(b.root)


def _complete(root: Node) -> Node:
    """Puts loose content where html, head and body belong."""
    top = [c for c in root.children if not (c.kind == "text" and not c.text.strip())]
    page = next((c for c in top if c.name == "html"), None)
    if page is None:
        page = Node("element", "html")
        for c in top:
            page.add(c)
        root.children = []
        root.add(page)
    if not any(c.name in ("body", "frameset") for c in page.children):
        body, own = Node("element", "body"), []
        for c in page.children:
            (own if c.name == "head" else body.children).append(c)
        if not own:
            head = Node("element", "head")
            head.children = [c for c in body.children if c.name in HEAD_TAGS]
            body.children = [c for c in body.children if c.name not in HEAD_TAGS]
            own = [head]
        page.children = []
        for c in [*own, body]:
            page.add(c)
            for x in c.children:
                x.parent = c
    return root


# XPath

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'[^']*'|"[^"]*")|(?P<op>//|::|!=|<=|>=|\.\.|[/@\[\]()|,=<>+*.$-])|(?P<name>[\w][\w.-]*(?::(?!:)[\w*][\w.-]*)?))""")


class XPathError(ValueError):
    pass


class Attr:
    __slots__ = ("name", "owner", "value")

    def __init__(self, owner: Node, name: str, value: str) -> None:
        self.owner, self.name, self.value = owner, name, value


def _lex(path: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(path.rstrip()):
        m = _TOKEN.match(path, at)
        if not m:
            raise XPathError(f"XPath isn't understood at {path[at:]}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


class XPath:
    """A compiled XPath expression."""

    def __init__(self, path: str) -> None:
        self.toks, self.at = _lex(path), 0
        self.tree = self._or()
        if self.at < len(self.toks):
            raise XPathError(f"XPath goes on after its end: {path}")

    def _peek(self, *values: str) -> bool:
        return self.at < len(self.toks) and self.toks[self.at][0] != "str" and self.toks[self.at][1] in values

    def _take(self, *values: str) -> str | None:
        if self._peek(*values):
            self.at += 1
            return self.toks[self.at - 1][1]
        return None

    def _need(self, value: str) -> None:
        if not self._take(value):
            raise XPathError(f"XPath lacks {value}")

    def _chain(self, below, *ops: str):
        left = below()
        while op := self._take(*ops):
            left = ("op", op, left, below())
        return left

    def _or(self):
        return self._chain(self._and, "or")

    def _and(self):
        return self._chain(self._equal, "and")

    def _equal(self):
        return self._chain(self._compare, "=", "!=")

    def _compare(self):
        return self._chain(self._add, "<", ">", "<=", ">=")

    def _add(self):
        return self._chain(self._times, "+", "-")

    def _times(self):
        return self._chain(self._union, "*", "div", "mod")

    def _union(self):
        return self._chain(self._path, "|")

    def _path(self):
        kind, value = self.toks[self.at] if self.at < len(self.toks) else ("end", "")
        follows = self.toks[self.at + 1][1] if self.at + 1 < len(self.toks) else ""
        if kind == "num":
            self.at += 1
            return ("num", float(value))
        if kind == "str":
            self.at += 1
            return ("str", value[1:-1])
        if value == "-":
            self.at += 1
            return ("op", "-", ("num", 0.0), self._path())
        if value == "(":
            self.at += 1
            inner = self._or()
            self._need(")")
            return self._tail(("filter", inner, self._predicates()))
        if kind == "name" and follows == "(" and value not in ("text", "node", "comment"):
            self.at += 2
            args = []
            while not self._take(")"):
                args.append(self._or())
                self._take(",")
            return self._tail(("call", value, args))
        steps = []
        if self._take("//"):
            steps = [("root",), ("step", "descendant-or-self", "node()", []), self._step()]
        elif self._take("/"):
            steps = [("root",)] + ([self._step()] if self._starts() else [])
        else:
            steps = [self._step()]
        return ("path", None, steps + self._steps())

    def _starts(self) -> bool:
        return self.at < len(self.toks) and (self.toks[self.at][0] == "name" or self._peek("@", ".", "..", "*"))

    def _tail(self, source):
        steps = self._steps()
        return ("path", source, steps) if steps else source

    def _steps(self):
        out = []
        while True:
            if self._take("//"):
                out += [("step", "descendant-or-self", "node()", []), self._step()]
            elif self._take("/"):
                out.append(self._step())
            else:
                return out

    def _step(self):
        if self._take("."):
            return ("step", "self", "node()", self._predicates())
        if self._take(".."):
            return ("step", "parent", "node()", self._predicates())
        axis = "child"
        if self._take("@"):
            axis = "attribute"
        elif self.at + 1 < len(self.toks) and self.toks[self.at + 1][1] == "::":
            axis = self.toks[self.at][1]
            self.at += 2
        if not self._starts():
            raise XPathError("XPath lacks a step")
        test = self.toks[self.at][1]
        self.at += 1
        if self._peek("("):
            self.at += 1
            self._need(")")
            test += "()"
        return ("step", axis, test, self._predicates())

    def _predicates(self):
        out = []
        while self._take("["):
            out.append(self._or())
            self._need("]")
        return out

    # evaluation

    def evaluate(self, doc: Node) -> Any:
        """A list of nodes, or a text, number or truth value."""
        return self._eval(self.tree, doc, 1, 1, doc)

    def _eval(self, tree, node, place: int, size: int, root) -> Any:
        kind = tree[0]
        if kind in ("num", "str"):
            return tree[1]
        if kind == "op":
            return self._operate(tree, node, place, size, root)
        if kind == "call":
            return self._call(tree[1], tree[2], node, place, size, root)
        if kind == "filter":
            found = self._eval(tree[1], node, place, size, root)
            for p in tree[2]:
                found = self._keep(found, p, root)
            return found
        source, steps = tree[1], tree[2]
        current = [node] if source is None else self._eval(source, node, place, size, root)
        for step in steps:
            if step[0] == "root":
                current = [root]
                continue
            seen: dict[int, Any] = {}
            out = []
            for n in current:
                found = [x for x in _axis(n, step[1]) if _fits(x, step[2], step[1])]
                for p in step[3]:
                    found = self._keep(found, p, root)
                for x in found:
                    key = id(x) if isinstance(x, Node) else (id(x.owner), x.name)
                    if key not in seen:
                        seen[key] = x
                        out.append(x)
            current = out
        return current

    def _keep(self, found, predicate, root):
        out = []
        for i, x in enumerate(found, 1):
            v = self._eval(predicate, x, i, len(found), root)
            if v == i if isinstance(v, float) else truth(v):
                out.append(x)
        return out

    def _operate(self, tree, node, place, size, root) -> Any:
        _, op, left, right = tree
        a = self._eval(left, node, place, size, root)
        if op in ("or", "and"):
            first = truth(a)
            if first == (op == "or"):
                return first
            return truth(self._eval(right, node, place, size, root))
        b = self._eval(right, node, place, size, root)
        if op == "|":
            return _in_order(root, a + b)
        if op in ("=", "!=", "<", ">", "<=", ">="):
            return _compare(op, a, b)
        x, y = number(a), number(b)
        if op == "+":
            return x + y
        if op == "-":
            return x - y
        if op == "*":
            return x * y
        if not y:
            return float("nan") if op == "mod" or not x else float("inf") * (1 if x > 0 else -1)
        return x / y if op == "div" else x - y * int(x / y)

    def _call(self, name, args, node, place, size, root) -> Any:
        if name == "position":
            return float(place)
        if name == "last":
            return float(size)
        values = [self._eval(a, node, place, size, root) for a in args]
        texts = [string(v) for v in values]
        own = [node] if not values else values[0]
        if name == "count":
            return float(len(values[0]))
        if name in ("string", "normalize-space", "string-length", "number"):
            t = string(own) if not values else texts[0]
            if name == "string":
                return t
            if name == "number":
                return number(t)
            return " ".join(t.split()) if name == "normalize-space" else float(len(t))
        if name in ("name", "local-name"):
            return (own[0].name if own else "").split(":")[-1 if name == "local-name" else 0]
        simple = {
            "not": lambda: not truth(values[0]), "true": lambda: True, "false": lambda: False, "boolean": lambda: truth(values[0]),
            "concat": lambda: "".join(texts), "contains": lambda: texts[1] in texts[0],
            "starts-with": lambda: texts[0].startswith(texts[1]), "ends-with": lambda: texts[0].endswith(texts[1]),
            "substring-before": lambda: texts[0].partition(texts[1])[0] if texts[1] in texts[0] else "",
            "substring-after": lambda: texts[0].partition(texts[1])[2],
            "translate": lambda: texts[0].translate({ord(c): texts[2][i] if i < len(texts[2]) else None for i, c in reversed(list(enumerate(texts[1])))}),
            "sum": lambda: sum(number(string([x])) for x in values[0]), "floor": lambda: float(number(values[0]) // 1),
            "ceiling": lambda: float(-(-number(values[0]) // 1)), "round": lambda: float((number(values[0]) + 0.5) // 1),
        }
        if name == "substring":
            start = round(number(values[1]))
            end = start + round(number(values[2])) if len(values) > 2 else len(texts[0]) + 1
            return texts[0][max(0, start - 1) : max(0, end - 1)]
        if name not in simple:
            raise XPathError(f"XPath function {name} is not supported")
        return simple[name]()


def _in_order(root: Node, nodes: list) -> list:
    order: dict[int, int] = {}

    def walk(n: Node) -> None:
        order[id(n)] = len(order)
        for c in n.children:
            walk(c)

    walk(root)
    key = lambda x: (order.get(id(x), -1), "") if isinstance(x, Node) else (order.get(id(x.owner), -1), x.name)
    seen, out = set(), []
    for x in sorted(nodes, key=key):
        if (k := key(x)) not in seen:
            seen.add(k)
            out.append(x)
    return out


def _axis(n, axis: str) -> list:
    if isinstance(n, Attr):
        return {"self": [n], "parent": [n.owner]}.get(axis, [])
    if axis == "child":
        return n.children
    if axis == "attribute":
        return [Attr(n, k, v) for k, v in n.attrs.items()]
    if axis == "self":
        return [n]
    if axis == "parent":
        return [n.parent] if n.parent else []
    if axis in ("descendant", "descendant-or-self"):
        out, todo = ([n] if axis != "descendant" else []), list(reversed(n.children))
        while todo:
            x = todo.pop()
            out.append(x)
            todo.extend(reversed(x.children))
        return out
    if axis in ("ancestor", "ancestor-or-self"):
        out = [n] if axis != "ancestor" else []
        while n.parent:
            n = n.parent
            out.append(n)
        return out
    if axis in ("following-sibling", "preceding-sibling"):
        if not n.parent:
            return []
        own = n.parent.children
        at = next(i for i, c in enumerate(own) if c is n)
        return own[at + 1 :] if axis == "following-sibling" else own[:at][::-1]
    raise XPathError(f"XPath axis {axis} is not supported")


def _fits(x, test: str, axis: str) -> bool:
    if test == "node()":
        return True
    if isinstance(x, Attr):
        return test in ("*", x.name)
    if test == "text()":
        return x.kind == "text"
    if test == "comment()":
        return x.kind == "comment"
    return x.kind == "element" and x.name != "" and test in ("*", x.name)


def string(v: Any) -> str:
    if isinstance(v, list):
        return string(v[0]) if v else ""
    if isinstance(v, Attr):
        return v.value
    if isinstance(v, Node):
        return v.string()
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v == v and v not in (float("inf"), float("-inf")) and v == int(v) else str(v)
    return v


def number(v: Any) -> float:
    if isinstance(v, bool | float):
        return float(v)
    try:
        return float(string(v).strip())
    except ValueError:
        return float("nan")


def truth(v: Any) -> bool:
    return v != 0 and v == v if isinstance(v, float) else bool(v)


def _compare(op: str, a: Any, b: Any) -> bool:
    lefts = a if isinstance(a, list) else [a]
    rights = b if isinstance(b, list) else [b]
    for x in lefts:
        for y in rights:
            if op in ("=", "!="):
                if isinstance(x, bool) or isinstance(y, bool):
                    same = truth(x if isinstance(x, bool) else a) == truth(y if isinstance(y, bool) else b)
                elif isinstance(x, float) or isinstance(y, float):
                    same = number([x] if not isinstance(x, float | str) else x) == number([y] if not isinstance(y, float | str) else y)
                else:
                    same = string(x) == string(y)
                if same == (op == "="):
                    return True
            else:
                p, q = number([x] if not isinstance(x, float | str) else x), number([y] if not isinstance(y, float | str) else y)
                if {"<": p < q, ">": p > q, "<=": p <= q, ">=": p >= q}[op]:
                    return True
    return False


def node_text(n: Any, text_only: bool) -> str:
    """A node as a query returns it: attribute value, trimmed texts by space, or inner markup."""
    if isinstance(n, Attr):
        return n.value
    if n.kind == "text":
        return n.text.strip() if text_only else n.text
    return " ".join(n.pieces()) if text_only else n.inner()


def xpath_bool(doc: Node | None, path: XPath) -> bool:
    return doc is not None and truth(path.evaluate(doc))


def xpath_first(doc: Node | None, path: XPath, text_only: bool = False) -> str:
    if doc is None:
        return ""
    found = path.evaluate(doc)
    if isinstance(found, list):
        return node_text(found[0], text_only) if found else ""
    return string(found)


def xpath_all(doc: Node | None, path: XPath, text_only: bool = False) -> list[str]:
    if doc is None:
        return []
    found = path.evaluate(doc)
    texts = [node_text(n, text_only) for n in found] if isinstance(found, list) else [string(found)]
    return [t for t in texts if t]


def xpath_subsets(doc: Node | None, path: XPath) -> list[str]:
    """Fragments that a later query takes as its document."""
    if doc is None:
        return []
    found = path.evaluate(doc)
    return [n.value if isinstance(n, Attr) else n.outer() for n in found] if isinstance(found, list) else []
