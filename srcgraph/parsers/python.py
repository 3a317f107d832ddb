"""Python."""

from __future__ import annotations

import re

from .core import END, ID, LINE, NUM, OP, STR, Bad, Node, Parser, Token
from .curly import levels

_PATTERN = re.compile(
    r"(?P<comment>\#[^\n]*)|(?P<newline>\r?\n)|(?P<space>[ \t\f\r]+|\\\r?\n|\xef\xbb\xbf)"
    r"|(?P<str>(?:[rRbBuUfFtT]{1,2})?(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))"
    r"|(?P<num>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[jJ]?)"
    r"|(?P<id>[A-Za-z_\x80-\xff][\w\x80-\xff]*)"
    r"|(?P<op>\*\*=|//=|<<=|>>=|\.\.\.|->|:=|\*\*|//|==|!=|<=|>=|<>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|<<|>>|.)",
    re.S | re.A,
)
INDENT, DEDENT = "<indent>", "<dedent>"
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_COMPARE = frozenset("< > <= >= == != <> in is not".split())


class Python(Parser):
    root = "module"
    keywords = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
    binary = levels("|", "^", "&", "<< >>", "+ -", "* / // % @")

    def lex(self) -> None:
        text, at, stop = self.text, 0, len(self.text)
        depth, levels_, fresh = 0, [0], True
        match = _PATTERN.match
        out = self.tokens
        while at < stop:
            m = match(text, at)
            kind, e = m.lastgroup, m.end()
            if fresh and not depth:
                # the indentation of a line that holds more than a comment
                if kind == "space" and text[at] != "\\" and text[at] != "\xef":
                    width = len(m[0].expandtabs())
                    n = match(text, e) if e < stop else None
                    if n is None or n.lastgroup in ("newline", "comment"):
                        at = e
                        fresh = False if n is not None and n.lastgroup == "comment" else fresh
                        if n is not None and n.lastgroup == "comment":
                            self.comments.append(Node("comment", e, n.end()))
                            at, fresh = n.end(), True
                        continue
                    at = e
                    m, kind, e = n, n.lastgroup, n.end()
                else:
                    width = 0
                if kind not in ("newline", "comment"):
                    if width > levels_[-1]:
                        levels_.append(width)
                        out.append(Token(INDENT, INDENT, at, at))
                    while width < levels_[-1]:
                        levels_.pop()
                        out.append(Token(DEDENT, DEDENT, out[-1].end, out[-1].end))
                    fresh = False
            if kind == "newline":
                if not depth:
                    if out and out[-1].kind not in (LINE, INDENT, DEDENT):
                        out.append(Token(LINE, "\n", at, at))
                    fresh = True
            elif kind == "comment":
                self.comments.append(Node("comment", at, e))
            elif kind != "space":
                if kind == "op":
                    if m[0] in ("(", "[", "{"):
                        depth += 1
                    elif m[0] in (")", "]", "}"):
                        depth = max(0, depth - 1)
                out.append(Token({"id": ID, "num": NUM, "str": STR}.get(kind, OP), m[0], at, e))
            at = e
        if out and out[-1].kind != LINE:
            out.append(Token(LINE, "\n", stop, stop))
        for _ in levels_[1:]:
            out.append(Token(DEDENT, DEDENT, out[-1].start, out[-1].start))

    def see(self, *texts: str) -> bool:
        return self.now.text in texts and self.now.kind in (OP, ID)

    def line(self) -> bool:
        return self.now.kind in (LINE, DEDENT, END)

    # -- statements
    def file(self) -> Node:
        parts: list[Node] = []
        while self.now.kind is not END:
            if self.now.kind in (LINE, INDENT, DEDENT) or self.see(";"):
                self.step()
                continue
            self.guarded(self.statement, parts, (";",))
        return Node(self.root, 0, len(self.text), parts)

    def end_line(self) -> None:
        if self.now.kind == LINE or self.see(";"):
            self.step()
        elif not self.line():
            raise Bad

    def statement(self) -> object:
        t = self.now.text if self.now.kind == ID else ""
        compound = getattr(self, f"do_{t}", None) if t else None
        if compound is not None:
            made = compound()
            if made is not None:
                return made
        if self.see("@"):
            parts: list = []
            while self.see("@"):
                parts.append(self.make("decorator", self.leaf(), self.named()))
                if self.now.kind == LINE:
                    self.step()
            return self.make("decorated_definition", *parts, ("definition", self.statement()))
        made = self.simple()
        self.end_line()
        return made

    def block(self) -> Node:
        """: then a suite; a function's body begins at its first statement."""
        parts: list[Node] = []
        if self.now.kind != LINE:
            while True:
                self.guarded(self.simple, parts, (";",))
                if self.see(";"):
                    self.step()
                    if self.line():
                        break
                    continue
                break
            if self.now.kind == LINE:
                self.step()
            return self.make("block", parts)
        self.step()
        if self.now.kind != INDENT:
            return self.make("block", parts)
        self.step()
        while self.now.kind not in (DEDENT, END):
            if self.now.kind in (LINE, INDENT) or self.see(";"):
                self.step()
                continue
            self.guarded(self.statement, parts, (";",))
        if self.now.kind == DEDENT:
            self.step()
        return self.make("block", parts)

    def suite(self) -> list:
        return [self.want(":"), ("body", self.block())]

    def simple(self) -> Node:
        t = self.now.text if self.now.kind == ID else ""
        if t in ("pass", "break", "continue"):
            return self.make(f"{t}_statement", self.leaf())
        if t == "return":
            return self.make("return_statement", self.leaf(), None if self.line() or self.see(";") else self.expressions())
        if t == "raise":
            parts: list = [self.leaf()]
            if not self.line() and not self.see(";"):
                parts.append(self.expressions())
                if self.see("from"):
                    parts += [self.leaf(), ("cause", self.expression())]
            return self.make("raise_statement", *parts)
        if t == "import":
            parts = [self.leaf(), ("name", self.imported())]
            while self.see(","):
                parts += [self.leaf(), ("name", self.imported())]
            return self.make("import_statement", *parts)
        if t == "from":
            return self.from_()
        if t in ("global", "nonlocal"):
            parts = [self.leaf(), self.name()]
            while self.see(","):
                parts += [self.leaf(), self.name()]
            return self.make(f"{t}_statement", *parts)
        if t == "del":
            return self.make("delete_statement", self.leaf(), self.expressions())
        if t == "assert":
            parts = [self.leaf(), self.expression()]
            if self.see(","):
                parts += [self.leaf(), self.expression()]
            return self.make("assert_statement", *parts)
        if t == "type" and self.ahead().kind == ID and self.ahead(2).text in ("=", "["):
            parts = [self.leaf(), ("left", self.make("type", self.expression())), self.want("="), ("right", self.make("type", self.expression()))]
            return self.make("type_alias_statement", *parts)
        return self.make("expression_statement", self.assigned())

    def assigned(self) -> Node:
        left = self.expressions()
        if self.see("="):
            if left.kind == "expression_list":
                left.kind = "pattern_list"
            return self.make("assignment", ("left", left), self.leaf(), ("right", self.assigned()))
        if self.see(":"):
            parts: list = [("left", left), self.leaf(), ("type", self.make("type", self.expression()))]
            if self.see("="):
                parts += [self.leaf(), ("right", self.expressions())]
            return self.make("assignment", *parts)
        if self.now.kind == OP and self.now.text in _AUGMENTED:
            return self.make("augmented_assignment", ("left", left), ("operator", self.leaf()), ("right", self.expressions()))
        return left

    def dotted(self) -> Node:
        parts: list = [self.name()]
        while self.see("."):
            parts += [self.leaf(), self.name()]
        return self.make("dotted_name", *parts)

    def imported(self) -> Node:
        name = self.dotted()
        if self.see("as"):
            return self.make("aliased_import", ("name", name), self.leaf(), ("alias", self.name()))
        return name

    def from_(self) -> Node:
        parts: list = [self.leaf()]
        if self.see(".", "..."):
            dots = []
            while self.see(".", "..."):
                dots.append(self.leaf())
            inner: list = [self.make("import_prefix", dots)]
            if not self.see("import"):
                inner.append(self.dotted())
            parts.append(("module_name", self.make("relative_import", *inner)))
        else:
            parts.append(("module_name", self.dotted()))
        parts.append(self.want("import"))
        if self.see("*"):
            return self.make("import_from_statement", *parts, self.make("wildcard_import", self.leaf()))
        opened = self.maybe("(")
        parts.append(opened)
        while self.word():
            parts.append(("name", self.imported()))
            if not self.see(","):
                break
            parts.append(self.leaf())
        if opened is not None:
            parts.append(self.closing(")"))
        kind = "future_import_statement" if any(isinstance(p, tuple) and p[1] is not None and self.text[p[1].start : p[1].end] == "__future__" for p in parts) else "import_from_statement"
        return self.make(kind, *parts)

    def do_if(self) -> Node:
        parts: list = [self.leaf(), ("condition", self.named()), self.want(":"), ("consequence", self.block())]
        while self.see("elif"):
            parts.append(("alternative", self.make("elif_clause", self.leaf(), ("condition", self.named()), self.want(":"), ("consequence", self.block()))))
        return self.make("if_statement", *parts, self.else_())

    def else_(self) -> tuple | None:
        if not self.see("else"):
            return None
        return ("alternative", self.make("else_clause", self.leaf(), *self.suite()))

    def do_while(self) -> Node:
        return self.make("while_statement", self.leaf(), ("condition", self.named()), *self.suite(), self.else_())

    def do_for(self, first: Node | None = None) -> Node:
        word = self.leaf()
        left = self.targets()
        return self.make("for_statement", first, word, ("left", left), self.want("in"), ("right", self.expressions()), *self.suite(), self.else_())

    def targets(self) -> Node:
        """What a for assigns to: no `in` within."""
        first = self.target()
        if not self.see(","):
            return first
        parts = [first]
        while self.see(","):
            parts.append(self.leaf())
            if self.see("in"):
                break
            parts.append(self.target())
        return self.make("pattern_list", parts)

    def target(self) -> Node:
        if self.see("*"):
            return self.make("list_splat_pattern", self.leaf(), self.postfix(self.primary()))
        return self.postfix(self.primary())

    def do_try(self) -> Node:
        parts: list = [self.leaf(), *self.suite()]
        while self.see("except"):
            inner: list = [self.leaf(), self.maybe("*")]
            if not self.see(":"):
                value = self.expressions()
                if self.see("as"):
                    value = self.make("as_pattern", value, self.leaf(), ("alias", self.make("as_pattern_target", self.expression())))
                inner.append(value)
            inner += [self.want(":"), self.block()]
            parts.append(self.make("except_clause" if inner[1] is None else "except_group_clause", *inner))
        parts.append(self.else_())
        if self.see("finally"):
            parts.append(self.make("finally_clause", self.leaf(), self.want(":"), self.block()))
        return self.make("try_statement", *parts)

    def do_with(self, first: Node | None = None) -> Node:
        word = self.leaf()
        opened = None
        if self.see("("):
            # parentheses around the items, or around an expression
            depth, i = 0, self.at
            while True:
                t = self.tokens[i]
                if t.text in ("(", "[", "{") and t.kind == OP:
                    depth += 1
                elif t.text in (")", "]", "}") and t.kind == OP:
                    depth -= 1
                    if depth == 0:
                        break
                elif t.kind is END:
                    break
                i += 1
            if self.tokens[i + 1].text == ":" if i + 1 < len(self.tokens) else False:
                opened = self.leaf()
        parts: list = [opened]
        while True:
            value = self.expression()
            if self.see("as"):
                value = self.make("as_pattern", value, self.leaf(), ("alias", self.make("as_pattern_target", self.target() if not self.see("(") else self.primary())))
            parts.append(self.make("with_item", ("value", value)))
            if not self.see(","):
                break
            parts.append(self.leaf())
            if self.see(")"):
                break
        if opened is not None:
            parts.append(self.closing(")"))
        return self.make("with_statement", first, word, self.make("with_clause", *parts), *self.suite())

    def do_async(self) -> Node | None:
        follows = self.ahead().text
        if follows not in ("def", "for", "with"):
            return None
        first = self.leaf()
        return getattr(self, f"do_{follows}")(first)

    def do_def(self, first: Node | None = None) -> Node:
        parts: list = [first, self.leaf(), ("name", self.name())]
        if self.see("["):
            parts.append(("type_parameters", self.list_of("[", "]", lambda: self.make("type", self.expression()), "type_parameter")))
        parts.append(("parameters", self.list_of("(", ")", self.parameter, "parameters")))
        if self.see("->"):
            parts += [self.leaf(), ("return_type", self.make("type", self.expression()))]
        return self.make("function_definition", *parts, *self.suite())

    def do_class(self) -> Node:
        parts: list = [self.leaf(), ("name", self.name())]
        if self.see("["):
            parts.append(("type_parameters", self.list_of("[", "]", lambda: self.make("type", self.expression()), "type_parameter")))
        if self.see("("):
            parts.append(("superclasses", self.arguments()))
        return self.make("class_definition", *parts, *self.suite())

    def do_match(self) -> Node | None:
        start = self.at
        try:
            word = self.leaf()
            if self.line() or self.see("=", ".", ",", ":", ")", "]") or (self.now.kind == OP and self.now.text not in ("(", "[", "{", "-", "*", "~")):
                raise Bad
            subject = self.expressions()
            colon = self.want(":")
            if self.now.kind != LINE or self.ahead().kind != INDENT or self.ahead(2).text != "case":
                raise Bad
        except Bad:
            self.go(start)
            return None
        self.step()
        self.step()
        parts: list[Node] = []
        while self.now.kind not in (DEDENT, END):
            if self.now.kind == LINE:
                self.step()
                continue
            self.guarded(self.case, parts, (";",))
        if self.now.kind == DEDENT:
            self.step()
        return self.make("match_statement", word, ("subject", subject), colon, ("body", self.make("block", parts)))

    def case(self) -> Node:
        parts: list = [self.want("case")]
        parts.append(self.make("case_pattern", self.pattern_list()))
        if self.see("if"):
            parts.append(("guard", self.make("if_clause", self.leaf(), self.named())))
        return self.make("case_clause", *parts, self.want(":"), ("consequence", self.block()))

    def pattern_list(self) -> Node:
        first = self.pattern_()
        parts = [first]
        while self.see(","):
            parts.append(self.leaf())
            if not self.see("if", ":"):
                parts.append(self.pattern_())
        return self.make("pattern_list", parts) if len(parts) > 1 else first

    def pattern_(self) -> Node:
        if self.see("*", "**"):
            return self.make("splat_pattern", self.leaf(), self.name())
        node = self.either()
        if self.see("as"):
            return self.make("as_pattern", node, self.leaf(), ("alias", self.name()))
        return node

    def parameter(self) -> Node:
        if self.see("/"):
            return self.make("positional_separator", self.leaf())
        if self.see("*") and self.ahead().text in (",", ")"):
            return self.make("keyword_separator", self.leaf())
        if self.see("*", "**"):
            kind = "list_splat_pattern" if self.see("*") else "dictionary_splat_pattern"
            node = self.make(kind, self.leaf(), self.name())
        else:
            node = self.name()
        typed = None
        if self.see(":") and not self.in_lambda:
            typed = [self.leaf(), ("type", self.make("type", self.expression()))]
        if self.see("="):
            kind = "typed_default_parameter" if typed else "default_parameter"
            return self.make(kind, ("name", node), *(typed or []), self.leaf(), ("value", self.expression()))
        return self.make("typed_parameter", node, *typed) if typed else node

    in_lambda = False

    # -- expressions
    def expressions(self) -> Node:
        first = self.starred()
        if not self.see(","):
            return first
        parts = [first]
        while self.see(","):
            parts.append(self.leaf())
            if self.line() or self.see(")", "]", "}", "=", ":", ";"):
                break
            parts.append(self.starred())
        return self.make("expression_list", parts)

    def starred(self) -> Node:
        if self.see("*"):
            return self.make("list_splat", self.leaf(), self.expression())
        return self.named()

    def named(self) -> Node:
        e = self.expression()
        if self.see(":="):
            return self.make("named_expression", ("name", e), self.leaf(), ("value", self.expression()))
        return e

    def expression(self) -> Node:
        if self.see("lambda"):
            word = self.leaf()
            parameters = None
            if not self.see(":"):
                inner: list[Node] = []
                self.in_lambda = True
                while not self.see(":") and not self.line():
                    inner.append(self.leaf() if self.see(",") else self.parameter())
                self.in_lambda = False
                parameters = self.make("lambda_parameters", inner)
            return self.make("lambda", word, ("parameters", parameters), self.want(":"), ("body", self.expression()))
        e = self.either()
        if self.see("if"):
            parts = [e, self.leaf(), self.either(), self.want("else"), self.expression()]
            return self.make("conditional_expression", *parts)
        return e

    def either(self) -> Node:
        left = self.both()
        while self.see("or"):
            left = self.make("boolean_operator", ("left", left), ("operator", self.leaf()), ("right", self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.see("and"):
            left = self.make("boolean_operator", ("left", left), ("operator", self.leaf()), ("right", self.negated()))
        return left

    def negated(self) -> Node:
        if self.see("not"):
            return self.make("not_operator", self.leaf(), ("argument", self.negated()))
        left = self.operators()
        if not (self.see(*_COMPARE) and (not self.see("not") or self.ahead().text == "in")):
            return left
        parts: list = [left]
        while self.see(*_COMPARE) and (not self.see("not") or self.ahead().text == "in"):
            o = self.leaf()
            if o.kind == "not" or (o.kind == "is" and self.see("not")):
                last = self.leaf()
                o = Node(f"{o.kind} {last.kind}", o.start, last.end, None, False)
            parts += [("operators", o), self.operators()]
        return self.make("comparison_operator", *parts)

    def operators(self, least: int = 0) -> Node:
        left = self.unary()
        while self.now.kind == OP:
            level = self.binary.get(self.now.text)
            if level is None or level <= least:
                break
            left = self.make("binary_operator", ("left", left), ("operator", self.leaf()), ("right", self.operators(level)))
        return left

    def unary(self) -> Node:
        if self.see("-", "+", "~"):
            return self.make("unary_operator", ("operator", self.leaf()), ("argument", self.unary()))
        if self.see("await"):
            return self.make("await", self.leaf(), self.unary())
        left = self.postfix(self.primary())
        if self.see("**"):
            return self.make("binary_operator", ("left", left), ("operator", self.leaf()), ("right", self.unary()))
        return left

    def postfix(self, left: Node) -> Node:
        while True:
            if self.see("."):
                left = self.make("attribute", ("object", left), self.leaf(), ("attribute", self.leaf("identifier") if self.now.kind == ID else self.name()))
            elif self.see("("):
                left = self.make("call", ("function", left), ("arguments", self.arguments()))
            elif self.see("["):
                parts: list = [self.leaf()]
                while not self.see("]") and self.now.kind not in (END, LINE):
                    parts.append(self.leaf() if self.see(",") else ("subscript", self.slice()))
                left = self.make("subscript", ("value", left), *parts, self.closing("]"))
            else:
                return left

    def slice(self) -> Node:
        first = None if self.see(":") else self.starred()
        if not self.see(":"):
            return first
        parts: list = [first]
        while self.see(":"):
            parts.append(self.leaf())
            if not self.see(":", "]", ","):
                parts.append(self.expression())
        return self.make("slice", *parts)

    def list_of(self, opening: str, closing: str, item, kind: str) -> Node:
        return self.listed(opening, closing, item, kind)

    def arguments(self) -> Node:
        start = self.at
        opening = self.want("(")
        if not self.see(")", "*", "**"):
            try:
                first = self.named()
                if self.see("for", "async"):
                    return self.make("generator_expression", opening, ("body", first), *self.clauses(), self.closing(")"))
            except Bad:
                pass
        self.go(start)
        return self.listed("(", ")", self.argument, "argument_list")

    def argument(self) -> Node:
        if self.see("*"):
            return self.make("list_splat", self.leaf(), self.expression())
        if self.see("**"):
            return self.make("dictionary_splat", self.leaf(), self.expression())
        if self.word() and self.ahead().text == "=":
            return self.make("keyword_argument", ("name", self.name()), self.leaf(), ("value", self.expression()))
        e = self.named()
        if self.see("for", "async"):
            return self.make("generator_expression", ("body", e), *self.clauses())
        return e

    def clauses(self) -> list[Node]:
        parts: list[Node] = []
        while self.see("for", "async", "if"):
            if self.see("if"):
                parts.append(self.make("if_clause", self.leaf(), self.either() if not self.see("lambda") else self.expression()))
                continue
            first = self.maybe("async")
            word = self.want("for")
            left = self.targets()
            parts.append(self.make("for_in_clause", first, word, ("left", left), self.want("in"), ("right", self.either())))
        return parts

    def primary(self) -> Node:
        t = self.now
        if t.kind == NUM:
            return self.leaf("float" if re.search(r"[.jJ]|[0-9][eE]", t.text) and not t.text[:2] in ("0x", "0X") else "integer")
        if t.kind == STR:
            first = self.string()
            if self.now.kind != STR:
                return first
            parts = [first]
            while self.now.kind == STR:
                parts.append(self.string())
            return self.make("concatenated_string", parts)
        if self.see("("):
            return self.parenthesis()
        if self.see("["):
            return self.bracket()
        if self.see("{"):
            return self.brace()
        if self.see("..."):
            return self.leaf("ellipsis")
        if t.kind == ID:
            if t.text in ("True", "False", "None"):
                return self.leaf(t.text.lower())
            if t.text == "yield":
                parts = [self.leaf(), self.maybe("from")]
                if not self.line() and not self.see(")", "]", "}", ";", "="):
                    parts.append(self.expressions())
                return self.make("yield", *parts)
            if self.word():
                return self.name()
        raise Bad

    def parenthesis(self) -> Node:
        opening = self.leaf()
        if self.see(")"):
            return self.make("tuple", opening, self.leaf())
        first = self.starred()
        if self.see("as"):  # within a case's pattern
            first = self.make("as_pattern", first, self.leaf(), ("alias", self.name()))
        if self.see("for", "async"):
            return self.make("generator_expression", opening, ("body", first), *self.clauses(), self.closing(")"))
        if not self.see(","):
            return self.make("parenthesized_expression", opening, first, self.closing(")"))
        parts: list[Node] = [opening, first]
        while not self.see(")") and self.now.kind not in (END, LINE):
            parts.append(self.leaf() if self.see(",") else self.starred())
        return self.make("tuple", parts, self.closing(")"))

    def bracket(self) -> Node:
        opening = self.leaf()
        parts: list = [opening]
        if not self.see("]"):
            first = self.starred()
            if self.see("for", "async"):
                return self.make("list_comprehension", opening, ("body", first), *self.clauses(), self.closing("]"))
            parts.append(first)
        while not self.see("]") and self.now.kind not in (END, LINE):
            parts.append(self.leaf() if self.see(",") else self.starred())
        return self.make("list", *parts, self.closing("]"))

    def brace(self) -> Node:
        opening = self.leaf()
        parts: list = [opening]
        kind = "dictionary"
        while not self.see("}") and self.now.kind not in (END, LINE):
            if self.see(","):
                parts.append(self.leaf())
                continue
            if self.see("**"):
                parts.append(self.make("dictionary_splat", self.leaf(), self.operators()))
                continue
            first = self.starred()
            if self.see(":"):
                first = self.make("pair", ("key", first), self.leaf(), ("value", self.expression()))
            else:
                kind = "set"
            if self.see("for", "async"):
                return self.make("dictionary_comprehension" if kind == "dictionary" else "set_comprehension", opening, ("body", first), *self.clauses(), self.closing("}"))
            parts.append(first)
        return self.make(kind, *parts, self.closing("}"))

    def string(self) -> Node:
        """Its start, content, the holes of a format string, its end."""
        t = self.step()
        text = t.text
        m = re.match(r"[A-Za-z]*(?:\"\"\"|'''|\"|')", text)
        quote = m[0].lstrip("rRbBuUfFtT")
        last = len(text) - len(quote) if len(text) >= m.end() + len(quote) and text.endswith(quote) else len(text)
        node = Node("string", t.start, t.end, [Node("string_start", t.start, t.start + m.end())])
        head = m[0].lower()
        start = i = m.end()
        if "f" in head[: -len(quote)]:
            while i < last:
                two = text[i : i + 2]
                if two in ("{{", "}}"):
                    i += 2
                elif text[i] == "{":
                    if i > start:
                        node.kids.append(Node("string_content", t.start + start, t.start + i))
                    end = self.hole_end(text, i, last)
                    node.kids.append(self.hole(t.start + i, t.start + end))
                    i = start = end
                else:
                    i += 1
        if last > start:
            node.kids.append(Node("string_content", t.start + start, t.start + last))
        if last < len(text):
            node.kids.append(Node("string_end", t.start + last, t.end))
        return node

    @staticmethod
    def hole_end(text: str, i: int, last: int) -> int:
        depth, quote = 0, ""
        while i < last:
            c = text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "{[(":
                depth += 1
            elif c in "}])":
                depth -= 1
                if depth == 0:
                    return i + 1
            i += 1
        return last

    def hole(self, start: int, end: int) -> Node:
        node = Node("interpolation", start, end)
        code = self.text[start + 1 : end - 1].lstrip()
        inner, shift = Python(code), end - 1 - len(code)
        try:
            found = inner.expressions()
        except Bad:
            return node
        stack = [found]
        while stack:
            n = stack.pop()
            n.start += shift
            n.end += shift
            stack += n.kids
        found.field = "expression"
        node.kids = [Node("{", start, start + 1, None, False), found, Node("}", end - 1, end, None, False)]
        return node
