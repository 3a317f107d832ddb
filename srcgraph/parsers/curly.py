"""Expressions and blocks of the languages with braces, by operator precedence.

A language says how its operators bind and what its nodes are called; statements and declarations
are its own.
"""

from __future__ import annotations

from .core import END, ID, NUM, OP, STR, Bad, Node, Parser, Token, scan


def levels(*groups: str) -> dict[str, int]:
    """Operators, loosest group first."""
    return {op: i + 1 for i, group in enumerate(groups) for op in group.split()}


class Curly(Parser):
    pattern = None
    binary = levels("||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %")
    assign = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
    prefix = frozenset("! - + ~ ++ --".split())
    number = "number_literal"
    block_kind = "block"
    arguments_kind = "argument_list"

    def lex(self) -> None:
        text, fresh, pairs = self.text, True, []
        for kind, s, e in scan(text, self.pattern):
            if kind == "space":
                continue
            if kind == "newline":
                fresh = True
                continue
            if kind == "comment":
                self.comments.append(Node(self.comment_kind(text[s:e]), s, e))
                fresh = fresh or "\n" in text[s:e]
                continue
            t = Token(kind, text[s:e], s, e, fresh)
            fresh = False
            if kind is OP or kind == OP:
                t.kind = OP
            self.tokens.append(t)
        # the partner of each bracket
        for i, t in enumerate(self.tokens):
            if t.kind == OP and t.text in ("(", "[", "{"):
                pairs.append(i)
            elif t.kind == OP and t.text in (")", "]", "}") and pairs:
                o = pairs.pop()
                self.tokens[o].part = i
                t.part = o

    def comment_kind(self, text: str) -> str:
        return "comment"

    def partner(self, at: int) -> int:
        """The index of the bracket that closes the one at `at`, or of the end."""
        p = self.tokens[at].part
        return p if isinstance(p, int) else len(self.tokens) - 1

    # -- expressions
    def expression(self, least: int = 0) -> Node:
        left = self.unary()
        while True:
            op = self.now
            if op.kind not in (OP, ID):
                return left
            text = op.text
            made = self.special(left, least)
            if made is not None:
                left = made
                continue
            if text in self.assign and least <= 0:
                kind = self.assignment(text)
                o = self.leaf()
                left = self.make(kind, ("left", left), ("operator", o), ("right", self.expression(0)))
                continue
            level = self.binary.get(text)
            if level is None or level <= least or self.blocked(text):
                return left
            o = self.leaf()
            left = self.make("binary_expression", ("left", left), ("operator", o), ("right", self.expression(level)))

    def special(self, left: Node, least: int) -> Node | None:
        """Operators of a language's own after `left`."""
        return None

    def blocked(self, op: str) -> bool:
        """Is the operator none here?"""
        return False

    def assignment(self, op: str) -> str:
        return "assignment_expression"

    def unary(self) -> Node:
        if self.now.kind == OP and self.now.text in self.prefix:
            o = self.leaf()
            kind = "update_expression" if o.kind in ("++", "--") else "unary_expression"
            return self.make(kind, ("operator", o), ("argument" if kind == "update_expression" else "operand", self.unary()))
        return self.postfix(self.primary())

    def primary(self) -> Node:
        raise NotImplementedError

    def postfix(self, left: Node) -> Node:
        raise NotImplementedError

    def parenthesized(self, kind: str = "parenthesized_expression") -> Node:
        return self.make(kind, self.want("("), self.expression(), self.closing(")"))

    def arguments(self) -> Node:
        return self.listed("(", ")", self.argument, self.arguments_kind)

    def argument(self) -> Node:
        return self.expression()

    # -- blocks
    def block(self) -> Node:
        return self.body(self.block_kind, self.statement)

    def body(self, kind: str, item) -> Node:
        parts: list[Node] = [self.want("{")]
        while not self.see("}") and self.now.kind is not END:
            if self.see(";"):
                parts.append(self.leaf())
                continue
            self.guarded(item, parts, (";", "}"))
        parts.append(self.closing("}"))
        return self.make(kind, parts)

    def semicolon(self) -> Node | None:
        return self.maybe(";")

    def generic_end(self, at: int) -> int:
        """The index after the '>' that closes the '<' at `at`, or -1 if these are no type arguments."""
        depth, i = 0, at
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.text == "<":
                depth += 1
            elif t.text in (">", ">>", ">>>") and t.kind == OP:
                depth -= len(t.text)
                if depth <= 0:
                    return i + 1 if depth == 0 else -1
            elif t.text in ("(", "[", "{") and t.kind == OP:
                i = self.partner(i)
            elif not (t.kind == ID or t.kind in (STR, NUM) or t.text in (",", ".", "?", "&", "|", "::", "'", ":", "=", "=>", "extends", "@", "*", "->")):
                return -1
            i += 1
        return -1

    def bare(self, kind: str, stop: int, identifier: str) -> Node:
        """All tokens up to an index as children, names as `identifier` nodes."""
        start = self.now.start
        kids = []
        while self.at < stop and self.now.kind is not END:
            kids.append(self.leaf(identifier) if self.word() else self.leaf())
        if not kids:
            raise Bad
        return Node(kind, start, kids[-1].end, kids)
