"""Bash."""

from __future__ import annotations

import re

from .core import END, Bad, Node, Parser, Token

_WORD = re.compile(r"(?:\\.|[^\s\"'`$|&;()<>\\])+", re.S)
_ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=", re.A)
_SPECIAL = re.compile(r"\$(?:[A-Za-z_]\w*|[0-9@*#?$!_-])", re.A)
_OPERATOR = re.compile(r"&&|\|\||\|&|;;&|;;|;&|<<<|<<-|<<|>>|&>>|&>|>&|<&|<>|>\||[|&;()<>{}\n!]")
#: Words that open or close a compound command, fixed values.
_RESERVED = frozenset("if then elif else fi for while until do done case esac in function select time { } ! [[ ]]".split())


class Bash(Parser):
    """Reads characters, not tokens: what a character means depends on where it stands."""

    def __init__(self, text: str):
        self.text, self.at, self.comments = text, 0, []
        self.pending: list[tuple[str, bool, bool, Node]] = []
        self.quoted = 0  # backquotes around

    # -- characters
    def blank(self, lines: bool = False) -> None:
        text = self.text
        while self.at < len(text):
            c = text[self.at]
            if c in " \t\r" or (lines and c == "\n"):
                self.at += 1
                if c == "\n":
                    self.heredocs()
            elif text.startswith("\\\n", self.at):
                self.at += 2
            elif c == "#" and (self.at == 0 or text[self.at - 1] in " \t\n;|&()`"):
                end = text.find("\n", self.at)
                end = len(text) if end < 0 else end
                self.comments.append(Node("comment", self.at, end))
                self.at = end
            else:
                return

    def peek(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def reserved(self, *words: str) -> bool:
        self.blank()
        for w in words:
            if self.peek(w):
                after = self.text[self.at + len(w) : self.at + len(w) + 1]
                if not after or after in " \t\n;&|()<>\r" or (w in ("{", "}", "!") and after in " \t\n;"):
                    return True
        return False

    def token(self, n: int) -> Node:
        node = Node(self.text[self.at : self.at + n], self.at, self.at + n, None, False)
        self.at += n
        return node

    def make(self, kind: str, *parts: object) -> Node:
        self.now = Token(END, "", self.at, self.at)
        return super().make(kind, *parts)

    def keyword(self, *words: str) -> Node:
        self.blank(True)
        for w in words:
            if self.reserved(w):
                return self.token(len(w))
        raise Bad

    def heredocs(self) -> None:
        """After a line's end: the documents announced on it."""
        announced, self.pending = self.pending, []
        for word, strip, quoted, node in announced:
            start = self.at
            while self.at < len(self.text):
                end = self.text.find("\n", self.at)
                end = len(self.text) if end < 0 else end
                line = self.text[self.at : end]
                self.at = min(end + 1, len(self.text))
                if (line.lstrip("\t") if strip else line).rstrip("\r") == word:
                    node.kids.append(self.heredoc_body(start, end - len(line), quoted))
                    node.kids.append(Node("heredoc_end", end - len(line), end))
                    break
            else:
                node.kids.append(self.heredoc_body(start, self.at, quoted))

    def heredoc_body(self, start: int, end: int, quoted: bool) -> Node:
        """A document's text; unless its word is quoted, the expansions in it are its children."""
        node = Node("heredoc_body", start, end)
        if quoted or not re.compile(r"[$`]").search(self.text, start, end):
            return node
        held, self.at = (self.text, self.at, self.pending), start
        self.text, self.pending = self.text[:end], []  # nothing in it goes on beyond its end
        while self.at < end:
            c, at = self.text[self.at], self.at
            try:
                if c == "$" and (_SPECIAL.match(self.text, at) or self.text[at + 1 : at + 2] in ("(", "{")):
                    node.kids.append(self.expansion())
                elif c == "`":
                    node.kids.append(self.backquote())
                else:
                    self.at += 2 if c == "\\" else 1
            except (Bad, IndexError):
                self.at = at + 1
        self.text, self.at, self.pending = held
        return node

    # -- lists of commands
    def file(self) -> Node:
        parts: list[Node] = []
        while True:
            self.blank(True)
            if self.at >= len(self.text):
                break
            self.one(parts, ())
        return Node("program", 0, len(self.text), parts)

    def one(self, parts: list[Node], stops: tuple[str, ...]) -> None:
        """A statement and what separates it from the next; on failure an ERROR to the end of the line."""
        start = self.at
        try:
            parts.append(self.list())
            self.blank()
            if self.peek(";;"):
                return
            if self.at < len(self.text) and self.text[self.at] in ";&":
                parts.append(self.token(1))
            elif self.peek("\n"):
                self.at += 1
                self.heredocs()
        except (Bad, IndexError):
            self.at = start
            end = self.text.find("\n", start + 1)
            end = len(self.text) if end < 0 else end
            parts.append(Node("ERROR", start, end))
            self.at = end

    def statements(self, *stops: str) -> list[Node]:
        parts: list[Node] = []
        while True:
            self.blank(True)
            if self.at >= len(self.text) or any(self.peek(s) if s in (")", ";;", "`") else self.reserved(s) for s in stops):
                return parts
            self.one(parts, stops)

    def list(self) -> Node:
        left = self.pipeline()
        while True:
            self.blank()
            if not (self.peek("&&") or self.peek("||")):
                return left
            o = self.token(2)
            self.blank(True)
            left = self.make("list", left, o, self.pipeline())

    def pipeline(self) -> Node:
        self.blank()
        if self.reserved("!"):
            return self.make("negated_command", self.token(1), self.pipeline())
        first = self.redirected(self.command())
        self.blank()
        if not self.peek("|") or self.peek("||"):
            return first
        parts = [first]
        while True:
            self.blank()
            if not self.peek("|") or self.peek("||"):
                return self.make("pipeline", parts)
            parts.append(self.token(2 if self.peek("|&") else 1))
            self.blank(True)
            parts.append(self.redirected(self.command()))

    def redirected(self, node: Node) -> Node:
        parts: list[Node] = []
        while True:
            self.blank()
            r = self.redirect()
            if r is None:
                break
            parts.append(r)
        if not parts:
            return node
        return self.make("redirected_statement", ("body", node), *[("redirect", p) for p in parts])

    def redirect(self) -> Node | None:
        m = re.compile(r"(\d*)(<<<|<<-|<<|>>|&>>|&>|>&|<&|<>|>\||>|<)(?!\()").match(self.text, self.at)
        if not m:
            return None
        parts: list = []
        if m[1]:
            parts.append(("descriptor", Node("file_descriptor", m.start(1), m.end(1))))
        parts.append(Node(m[2], m.start(2), m.end(2), None, False))
        self.at = m.end()
        self.blank()
        if m[2] in ("<<", "<<-"):
            w = re.compile(r"(['\"]?)([^\s'\"|&;()<>]+)\1|\\(\S+)").match(self.text, self.at)
            if not w:
                raise Bad
            self.at = w.end()
            node = self.make("heredoc_redirect", *parts, Node("heredoc_start", w.start(), w.end()))
            self.pending.append((w[2] or w[3], m[2] == "<<-", bool(w[1] or w[3]), node))
            return node
        kind = "herestring_redirect" if m[2] == "<<<" else "file_redirect"
        return self.make(kind, *parts, ("destination", self.word_()))

    # -- commands
    def command(self) -> Node:
        self.blank()
        text = self.text
        if self.at >= len(text):
            raise Bad
        for word, method in (("if", self.if_), ("for", self.for_), ("select", self.for_), ("while", self.while_), ("until", self.while_), ("case", self.case), ("function", self.function), ("{", self.group), ("[[", self.test)):
            if self.reserved(word):
                return method()
        if self.peek("(("):
            return self.arithmetic("compound_statement")
        if self.peek("("):
            opening = self.token(1)
            inner = self.statements(")")
            return self.make("subshell", opening, inner, self.closing_(")"))
        if self.peek("[ "):
            return self.bracket()
        m = re.compile(r"([^\s\"'`$|&;()<>=\\]+)[ \t]*\([ \t]*\)").match(text, self.at)
        if m:
            name = Node("word", m.start(1), m.end(1))
            self.at = m.end()
            opening = [Node("(", m.end() - 2, m.end() - 1, None, False), Node(")", m.end() - 1, m.end(), None, False)]
            self.blank(True)
            return self.make("function_definition", ("name", name), *opening, ("body", self.command()))
        if self.reserved("declare", "local", "export", "readonly", "typeset"):
            return self.declaration()
        return self.simple()

    def closing_(self, text: str) -> Node:
        self.blank(True)
        if self.peek(text):
            return self.token(len(text))
        node = Node(text, self.at, self.at, None, False)
        node.missing = True
        return node

    def function(self) -> Node:
        word = self.token(8)
        self.blank()
        m = re.compile(r"[^\s\"'`$|&;()<>\\{]+").match(self.text, self.at)
        if not m:
            raise Bad
        name = Node("word", m.start(), m.end())
        self.at = m.end()
        self.blank()
        parts: list = []
        if self.peek("("):
            parts.append(self.token(1))
            self.blank()
            parts.append(self.closing_(")"))
        self.blank(True)
        return self.make("function_definition", word, ("name", name), *parts, ("body", self.command()))

    def group(self) -> Node:
        opening = self.token(1)
        inner = self.statements("}")
        return self.make("compound_statement", opening, inner, self.closing_("}"))

    def if_(self) -> Node:
        parts: list = [self.token(2), *[("condition", s) if s.named else s for s in self.statements("then")], self.keyword("then"), self.statements("elif", "else", "fi")]
        while self.reserved("elif"):
            parts.append(self.make("elif_clause", self.token(4), self.statements("then"), self.keyword("then"), self.statements("elif", "else", "fi")))
            self.blank(True)
        if self.reserved("else"):
            parts.append(self.make("else_clause", self.token(4), self.statements("fi")))
        return self.make("if_statement", *parts, self.keyword("fi"))

    def do(self) -> Node:
        return self.make("do_group", self.keyword("do"), self.statements("done"), self.keyword("done"))

    def while_(self) -> Node:
        word = self.token(5)
        return self.make("while_statement", word, *[("condition", s) if s.named else s for s in self.statements("do")], ("body", self.do()))

    def for_(self) -> Node:
        word = self.token(3 if self.peek("for") else 6)
        self.blank()
        if self.peek("(("):
            head = self.arithmetic("parenthesized")
            self.blank()
            parts: list = [word, head.kids]
            if self.peek(";"):
                parts.append(self.token(1))
            self.blank(True)
            body = self.do() if self.reserved("do") else self.group()
            return self.make("c_style_for_statement", *parts, ("body", body))
        m = re.compile(r"[A-Za-z_]\w*", re.A).match(self.text, self.at)
        if not m:
            raise Bad
        parts = [word, ("variable", Node("variable_name", m.start(), m.end()))]
        self.at = m.end()
        self.blank(True)
        if self.reserved("in"):
            parts.append(self.token(2))
            self.blank()
            while self.at < len(self.text) and self.text[self.at] not in ";\n":
                parts.append(("value", self.word_()))
                self.blank()
        if self.peek(";"):
            parts.append(self.token(1))
        return self.make("for_statement", *parts, ("body", self.do()))

    def case(self) -> Node:
        word = self.token(4)
        self.blank()
        parts: list = [word, ("value", self.word_()), self.keyword("in")]
        while True:
            self.blank(True)
            if self.at >= len(self.text) or self.reserved("esac"):
                break
            inner: list = []
            if self.peek("("):
                inner.append(self.token(1))
            while True:
                self.blank(True)
                m = re.compile(r"(?:\\.|\"[^\"]*\"|'[^']*'|[^\s|()\"'\\])+").match(self.text, self.at)
                if not m:
                    raise Bad
                inner.append(("value", Node("word" if not re.search(r"[*?\[]", m[0]) else "extglob_pattern", m.start(), m.end())))
                self.at = m.end()
                self.blank()
                if not self.peek("|"):
                    break
                inner.append(self.token(1))
            if not self.peek(")"):
                raise Bad
            inner.append(self.token(1))
            inner.append(self.statements(";;", ";&", "esac"))
            self.blank(True)
            for end in (";;&", ";;", ";&"):
                if self.peek(end):
                    inner.append(("termination", self.token(len(end))))
                    break
            parts.append(self.make("case_item", *inner))
        return self.make("case_statement", *parts, self.keyword("esac"))

    def declaration(self) -> Node:
        m = re.compile(r"[a-z]+").match(self.text, self.at)
        parts: list = [self.token(m.end() - m.start())]
        while True:
            self.blank()
            if self.at >= len(self.text) or self.text[self.at] in ";&|\n)#" or self.peek(">") or self.peek("<"):
                break
            if _ASSIGN.match(self.text, self.at):
                parts.append(self.assignment())
                continue
            m = re.compile(r"[A-Za-z_]\w*(?=[\s;&|)]|$)", re.A).match(self.text, self.at)
            if m:
                parts.append(Node("variable_name", m.start(), m.end()))
                self.at = m.end()
            else:
                parts.append(self.word_())
        return self.make("declaration_command", *parts)

    def assignment(self) -> Node:
        m = _ASSIGN.match(self.text, self.at)
        plus = 2 if m[0].endswith("+=") else 1
        name_end = m.end() - plus
        bracket = m[0].find("[")
        if bracket >= 0:
            name: Node = Node("subscript", m.start(), name_end, [Node("variable_name", m.start(), m.start() + bracket), Node("word", m.start() + bracket + 1, name_end - 1)])
            name.kids[0].field, name.kids[1].field = "name", "index"
        else:
            name = Node("variable_name", m.start(), name_end)
        o = Node("+=" if plus == 2 else "=", name_end, m.end(), None, False)
        self.at = m.end()
        value: Node | None = None
        if self.peek("("):
            parts: list[Node] = [self.token(1)]
            while True:
                self.blank(True)
                if self.at >= len(self.text) or self.peek(")"):
                    break
                if self.peek("["):
                    end = self.text.find("]=", self.at)
                    self.at = end + 2 if end > 0 else self.at + 1
                parts.append(self.word_())
            value = self.make("array", parts, self.closing_(")"))
        elif self.at < len(self.text) and self.text[self.at] not in " \t\n;&|)`":
            value = self.word_()
        # the name fills the field that the catalogue's pattern asks for
        return self.make("variable_assignment", ("variable", name), o, value and ("value", value))

    def simple(self) -> Node:
        parts: list = []
        while _ASSIGN.match(self.text, self.at):
            parts.append(self.assignment())
            self.blank()
        if self.at >= len(self.text) or self.text[self.at] in self.ends():
            if not parts:
                raise Bad
            return parts[0] if len(parts) == 1 else self.make("variable_assignments", *parts)
        before: list[Node] = []
        r = self.redirect()
        while r is not None:
            before.append(r)
            self.blank()
            r = self.redirect()
        name = self.word_()
        parts += before
        parts.append(("name", self.make("command_name", name)))
        while True:
            self.blank()
            if self.at >= len(self.text) or self.text[self.at] in self.ends():
                if not self.peek("&>"):
                    break
            m = re.compile(r"\d*[<>]|&>").match(self.text, self.at)
            if m and not re.compile(r"[<>]\(").match(self.text, self.at):
                break
            parts.append(("argument", self.word_()))
        return self.make("command", *parts)

    # -- tests and arithmetic
    def test(self) -> Node:
        opening = self.token(2)
        inner = self.conditions("]]")
        return self.make("test_command", opening, inner, self.closing_("]]"))

    def bracket(self) -> Node:
        opening = self.token(1)
        inner = self.conditions("]")
        node = self.make("test_command", opening, inner, self.closing_("]"))
        return node

    def conditions(self, end: str, least: int = 0) -> Node | None:
        self.blank(True)
        if self.reserved(end) or self.peek(end):
            return None
        left = self.condition(end)
        while True:
            self.blank(True)
            if self.peek("||") and least < 1:
                left = self.make("binary_expression", ("left", left), ("operator", self.token(2)), ("right", self.conditions(end, 1)))
            elif self.peek("&&") and least < 2:
                left = self.make("binary_expression", ("left", left), ("operator", self.token(2)), ("right", self.conditions(end, 2)))
            else:
                return left

    def condition(self, end: str) -> Node:
        self.blank(True)
        if self.peek("! "):
            return self.make("unary_expression", ("operator", self.token(1)), self.condition(end))
        if self.peek("("):
            opening = self.token(1)
            inner = self.conditions(")")
            return self.make("parenthesized_expression", opening, inner, self.closing_(")"))
        m = re.compile(r"-[a-zA-Z](?=\s)").match(self.text, self.at)
        if m:
            o = Node("test_operator", m.start(), m.end())
            self.at = m.end()
            self.blank()
            return self.make("unary_expression", ("operator", o), self.word_())
        left = self.word_()
        self.blank(True)
        m = re.compile(r"=~|==|!=|=|<|>|-(?:eq|ne|lt|le|gt|ge|nt|ot|ef)(?=\s)").match(self.text, self.at)
        if not m:
            return left
        o = Node(m[0] if not m[0].startswith("-") else "test_operator", m.start(), m.end(), None, m[0].startswith("-"))
        self.at = m.end()
        self.blank(True)
        if m[0] == "=~":
            r = re.compile(r"(?:\\.|\[[^\]]*\]|\"[^\"]*\"|\([^)\n]*\)|[^\s\\\"])+").match(self.text, self.at)
            if not r:
                raise Bad
            right: Node = Node("regex", r.start(), r.end())
            self.at = r.end()
        else:
            right = self.word_()
        return self.make("binary_expression", ("left", left), ("operator", o), ("right", right))

    def arithmetic(self, kind: str) -> Node:
        """(( ... )): names and operators, && and || as binary expressions."""
        start = self.at
        depth, i = 0, self.at
        while i < len(self.text):
            c = self.text[i]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    break
            i += 1
        end = min(i + 1, len(self.text))
        kids = [Node("((", start, start + 2, None, False), *self.operands(start + 2, max(start + 2, end - 2)), Node("))", end - 2, end, None, False)]
        self.at = end
        return Node(kind, start, end, kids)

    def operands(self, start: int, end: int) -> list[Node]:
        for o in ("||", "&&"):
            at = self.text.find(o, start, end)
            if at >= 0:
                left, right = self.operands(start, at), self.operands(at + 2, end)
                op = Node(o, at, at + 2, None, False)
                op.field = "operator"
                return [Node("binary_expression", start, end, [*left, op, *right])]
        return [Node("variable_name" if not m[0][0].isdigit() else "number", m.start(), m.end()) for m in re.compile(r"[A-Za-z_]\w*|\d+", re.A).finditer(self.text, start, end)]

    # -- words
    def word_(self) -> Node:
        """A word: one part as it is, or a concatenation."""
        parts: list[Node] = []
        text = self.text
        start = self.at
        while self.at < len(text):
            c = text[self.at]
            if c == '"':
                parts.append(self.string())
            elif c == "'":
                end = text.find("'", self.at + 1)
                end = len(text) if end < 0 else end + 1
                parts.append(Node("raw_string", self.at, end))
                self.at = end
            elif text.startswith("$'", self.at):
                m = re.compile(r"\$'(?:\\.|[^'\\])*'?", re.S).match(text, self.at)
                parts.append(Node("ansi_c_string", self.at, m.end()))
                self.at = m.end()
            elif c == "$":
                parts.append(self.expansion())
            elif c == "`":
                if self.quoted:
                    break
                parts.append(self.backquote())
            elif c in "<>" and text[self.at + 1 : self.at + 2] == "(":
                opening = self.token(2)
                inner = self.statements(")")
                parts.append(self.make("process_substitution", opening, inner, self.closing_(")")))
            else:
                m = _WORD.match(text, self.at)
                if not m:
                    break
                parts.append(Node("number" if m[0].isdigit() else "word", m.start(), m.end()))
                self.at = m.end()
        if not parts:
            raise Bad
        return parts[0] if len(parts) == 1 else Node("concatenation", start, self.at, parts)

    def string(self) -> Node:
        node = Node("string", self.at, self.at + 1, [Node('"', self.at, self.at + 1, None, False)])
        self.at += 1
        start = self.at
        text = self.text

        def content() -> None:
            if self.at > start:
                node.kids.append(Node("string_content", start, self.at))

        while self.at < len(text) and text[self.at] != '"':
            c = text[self.at]
            if c == "\\":
                self.at += 2
            elif c == "$" and (_SPECIAL.match(text, self.at) or text[self.at + 1 : self.at + 2] in ("(", "{")):
                content()
                node.kids.append(self.expansion())
                start = self.at
            elif c == "`":
                content()
                node.kids.append(self.backquote())
                start = self.at
            else:
                self.at += 1
        self.at = min(self.at, len(text))
        content()
        if self.at < len(text):
            node.kids.append(Node('"', self.at, self.at + 1, None, False))
            self.at += 1
        node.end = self.at
        return node

    def expansion(self) -> Node:
        text = self.text
        if self.peek("$(("):
            dollar = self.at
            self.at += 1
            node = self.arithmetic("arithmetic_expansion")
            node.start = dollar
            return node
        if self.peek("$("):
            opening = self.token(2)
            inner = self.statements(")")
            return self.make("command_substitution", opening, inner, self.closing_(")"))
        if self.peek("${"):
            start, depth = self.at, 0
            node = Node("expansion", start, start)
            self.at += 2
            m = re.compile(r"[!#]?([A-Za-z_]\w*|[0-9@*#?$!-])", re.A).match(text, self.at)
            if m:
                node.kids.append(Node("variable_name" if m[1][0].isalpha() or m[1][0] == "_" else "special_variable_name", m.start(1), m.end(1)))
                self.at = m.end()
            while self.at < len(text):
                c = text[self.at]
                if c == "}" and depth == 0:
                    self.at += 1
                    break
                if c == "\\":
                    self.at += 2
                elif c == "$" and text[self.at + 1 : self.at + 2] in ("(", "{"):
                    node.kids.append(self.expansion())
                elif c == "$" and _SPECIAL.match(text, self.at):
                    node.kids.append(self.expansion())
                elif c == "`":
                    node.kids.append(self.backquote())
                else:
                    depth += (c == "{") - (c == "}")
                    self.at += 1
            node.end = self.at
            return node
        m = _SPECIAL.match(text, self.at)
        if not m:
            node = Node("word", self.at, self.at + 1)
            self.at += 1
            return node
        self.at = m.end()
        kind = "variable_name" if m[0][1].isalpha() or (m[0][1] == "_" and len(m[0]) > 1) else "special_variable_name"
        return Node("simple_expansion", m.start(), m.end(), [Node("$", m.start(), m.start() + 1, None, False), Node(kind, m.start() + 1, m.end())])

    def ends(self) -> str:
        """Characters that end a simple command."""
        return ";&|\n)`" if self.quoted else ";&|\n)"

    def backquote(self) -> Node:
        opening = self.token(1)
        self.quoted += 1
        inner = self.statements("`")
        self.quoted -= 1
        return self.make("command_substitution", opening, inner, self.closing_("`"))
