"""What the parsers share: tokens, nodes, error recovery, and the flat form of a tree.

Parsers work on the source decoded as Latin-1, so every index is a byte offset. They never raise:
what they can't read becomes an ERROR node and parsing goes on at the next statement.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator


class Node:
    """A syntax node: kind, whether it is named, its bytes [start, end), its children, the field it fills."""

    __slots__ = ("end", "field", "kids", "kind", "missing", "named", "start")

    def __init__(self, kind: str, start: int, end: int, kids: list[Node] | None = None, named: bool = True):
        self.kind, self.start, self.end, self.kids, self.named = kind, start, end, kids if kids is not None else [], named
        self.field: str | None = None
        self.missing = False


class Bad(Exception):
    """The input does not go on as the grammar wants."""


#: Kinds of tokens: identifiers and keywords, numbers, strings, operators, line ends, the end.
ID, NUM, STR, OP, LINE, END = "id", "num", "str", "op", "line", "end"


_SAME = {k: k for k in (ID, NUM, STR, OP, LINE, END)}  # kinds are compared by identity


class Token:
    __slots__ = ("end", "fresh", "kind", "part", "start", "text")

    def __init__(self, kind: str, text: str, start: int, end: int, fresh: bool = False):
        self.kind, self.text, self.start, self.end = kind, text, start, end
        self.fresh = fresh  # first of its line
        self.part: object = None


def scan(text: str, pattern: re.Pattern, start: int = 0, stop: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(group name, start, end) of successive tokens; a character that starts none is an operator."""
    stop = len(text) if stop is None else stop
    match = pattern.match
    while start < stop:
        m = match(text, start, stop)
        if m is None or m.end() == start:
            yield OP, start, start + 1
            start += 1
        else:
            yield _SAME.get(m.lastgroup, m.lastgroup) or OP, start, m.end()
            start = m.end()


class Parser:
    """A cursor over tokens, with helpers that build nodes."""

    root = "program"
    keywords: frozenset[str] = frozenset()

    def __init__(self, text: str):
        self.text = text
        self.comments: list[Node] = []
        self.tokens: list[Token] = []
        self.at = 0
        self.lex()
        self.tokens.append(Token(END, "", len(text), len(text), True))
        self.now = self.tokens[0]

    def lex(self) -> None:
        raise NotImplementedError

    # -- the cursor
    def go(self, at: int) -> None:
        self.at, self.now = at, self.tokens[at]

    def step(self) -> Token:
        t = self.now
        if t.kind is not END:
            self.at += 1
            self.now = self.tokens[self.at]
        return t

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def see(self, *texts: str) -> bool:
        return self.now.text in texts and self.now.kind in (OP, ID)

    def word(self) -> bool:
        return self.now.kind is ID and self.now.text not in self.keywords

    # -- nodes
    def leaf(self, kind: str | None = None) -> Node:
        """The current token as a node: named if a kind is given, else a token of its own text."""
        t = self.step()
        if t.kind is END:
            raise Bad
        return Node(kind or t.text, t.start, t.end, None, kind is not None)

    def want(self, text: str) -> Node:
        if not self.see(text):
            raise Bad
        return self.leaf()

    def maybe(self, *texts: str) -> Node | None:
        return self.leaf() if self.see(*texts) else None

    def name(self, kind: str = "identifier") -> Node:
        if not self.word():
            raise Bad
        return self.leaf(kind)

    def make(self, kind: str, *parts: object) -> Node:
        """A node of parts: nodes, lists of them, (field, node), or None."""
        kids: list[Node] = []
        for p in parts:
            if p is None:
                continue
            if isinstance(p, Node):
                kids.append(p)
            elif isinstance(p, tuple):
                node = p[1]
                if node is not None:
                    node.field = p[0]
                    kids.append(node)
            else:
                kids += p
        if kids:
            return Node(kind, kids[0].start, kids[-1].end, kids)
        return Node(kind, self.now.start, self.now.start, kids)

    def listed(self, opening: str, closing: str, item: Callable[[], object], kind: str, separators: tuple[str, ...] = (",",)) -> Node:
        """opening item, item ... closing; what can't be read within is an ERROR."""
        parts: list[Node] = [self.want(opening)]
        while not self.see(closing) and self.now.kind is not END:
            if self.see(*separators):
                parts.append(self.leaf())
                continue
            self.guarded(item, parts, (closing, *separators))
        parts.append(self.closing(closing))
        return self.make(kind, parts)

    def closing(self, text: str) -> Node:
        """The closing token, or a missing one."""
        if self.see(text):
            return self.leaf()
        node = Node(text, self.tokens[self.at - 1].end, self.tokens[self.at - 1].end, None, False)
        node.missing = True
        return node

    def guarded(self, item: Callable[[], object], parts: list[Node], until: tuple[str, ...]) -> None:
        """Append an item; on failure skip to a token of `until` outside brackets, as an ERROR."""
        start = self.at
        try:
            made = item()
            if self.at == start:
                raise Bad
            if isinstance(made, tuple):
                made[1].field = made[0]
                made = made[1]
            if isinstance(made, list):
                parts += made
            elif made is not None:
                parts.append(made)
        except Bad:
            self.go(start)
            parts.append(self.skip(until))

    def skip(self, until: tuple[str, ...]) -> Node:
        """An ERROR node over at least one token, up to one of `until` or the end of its brackets."""
        first, depth = self.now, 0
        kids: list[Node] = []
        while self.now.kind is not END:
            t = self.now
            if kids and depth == 0 and (t.text in until or t.kind is LINE or t.text in ")]}" or t.fresh):
                break
            if t.kind is OP and t.text in "([{" and t.text:
                depth += 1
            elif t.kind is OP and t.text in ")]}" and t.text:
                depth = max(0, depth - 1)
            kids.append(Node("identifier", t.start, t.end) if t.kind is ID and t.text not in self.keywords else Node(t.text or "end", t.start, t.end, None, False))
            self.step()
        return Node("ERROR", first.start, kids[-1].end if kids else first.end, kids)

    # -- whole files
    def file(self) -> Node:
        parts: list[Node] = []
        while self.now.kind is not END:
            start = self.at
            self.guarded(self.statement, parts, (";", "}"))
            if self.at == start:
                self.step()
        return Node(self.root, 0, len(self.text), parts)

    def statement(self) -> object:
        raise NotImplementedError


def place_comments(root: Node, comments: list[Node]) -> None:
    """Put each comment into the innermost node around it."""
    for c in comments:
        node = root
        while True:
            starts = [k.start for k in node.kids]
            i = bisect.bisect_right(starts, c.start) - 1
            if i >= 0 and node.kids[i].kids and node.kids[i].start <= c.start and c.end <= node.kids[i].end:
                node = node.kids[i]
                continue
            node.kids.insert(i + 1, c)
            break


#: Columns of a flat tree, one row a node in preorder.
FIELDS = ("node_id", "parent_id", "subtree_end", "depth", "child_index", "kind", "field", "named", "is_error", "is_missing", "start_byte", "end_byte")


class Tree:
    """A parsed file: nodes in preorder as parallel lists, and row and column of every byte offset."""

    def __init__(self, source: bytes, root: Node):
        self.source = source
        self.nodes = nodes = []
        self.parent = parent = []
        self.depth = depth = []
        self.place = place = []
        self.kids = kids = []
        self.by_kind: dict[str, list[int]] = {}
        self.missing = False
        by_kind = self.by_kind
        stack = [(root, -1, 0, 0)]
        while stack:
            node, up, level, nth = stack.pop()
            me = len(nodes)
            nodes.append(node)
            parent.append(up)
            depth.append(level)
            place.append(nth)
            kids.append([])
            if up >= 0:
                kids[up].append(me)
            if node.kind in by_kind:
                by_kind[node.kind].append(me)
            else:
                by_kind[node.kind] = [me]
            if node.missing:
                self.missing = True
            if node.kids:
                level += 1
                nth = len(node.kids)
                for kid in reversed(node.kids):
                    nth -= 1
                    stack.append((kid, me, level, nth))
        self.end = end = list(range(1, len(nodes) + 1))
        for i in range(len(nodes) - 1, 0, -1):
            if end[i] > end[parent[i]]:
                end[parent[i]] = end[i]
        self.lines = [0] + [m.start() + 1 for m in re.finditer(b"\n", source)]

    def point(self, offset: int) -> tuple[int, int]:
        row = bisect.bisect_right(self.lines, offset) - 1
        return row, offset - self.lines[row]

    def text(self, i: int) -> str:
        n = self.nodes[i]
        return self.source[n.start : n.end].decode("utf-8", "replace")

    @property
    def has_error(self) -> bool:
        return "ERROR" in self.by_kind or self.missing
