"""Go."""

from __future__ import annotations

import re

from .core import END, ID, NUM, OP, STR, Bad, Node, Token
from .curly import Curly, levels

_PATTERN = re.compile(
    r"(?P<newline>\n)|(?P<space>[ \t\r]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<str>`[^`]*`?|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<num>0[xX][0-9a-fA-F_.pP+-]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?i?)"
    r"|(?P<id>[A-Za-z_\x80-\xff][\w\x80-\xff]*)"
    r"|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|.)",
    re.S | re.A,
)
_STOPS = frozenset(("return", "break", "continue", "fallthrough", ")", "]", "}", "++", "--"))


class Go(Curly):
    root = "source_file"
    pattern = _PATTERN
    keywords = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
    binary = levels("||", "&&", "== != < <= > >=", "+ - | ^", "* / % << >> & &^")
    assign = frozenset()
    prefix = frozenset("+ - ! ^ * & <-".split())

    def lex(self) -> None:
        super().lex()
        # a line that ends with an operand or a closing token ends a statement
        out: list[Token] = []
        for t in self.tokens:
            if t.fresh and out and (out[-1].kind in (NUM, STR) or (out[-1].kind == ID and out[-1].text not in self.keywords) or out[-1].text in _STOPS):
                out.append(Token(OP, "\n", out[-1].end, out[-1].end))
            out.append(t)
        self.tokens = out
        pairs = []
        for i, t in enumerate(out):
            if t.kind == OP and t.text in ("(", "[", "{"):
                pairs.append(i)
            elif t.kind == OP and t.text in (")", "]", "}") and pairs:
                out[pairs.pop()].part = i
        self.plain = False  # in the head of a statement, where a brace opens its block

    def lines(self) -> None:
        while self.see("\n", ";"):
            self.step()

    def semicolon(self) -> Node | None:
        if self.see("\n"):
            self.step()
            return None
        return self.maybe(";")

    def body(self, kind: str, item) -> Node:
        parts: list[Node] = [self.want("{")]
        held, self.plain = self.plain, False
        self.lines()
        while not self.see("}") and self.now.kind is not END:
            self.guarded(item, parts, (";", "\n", "}"))
            self.lines()
        self.plain = held
        parts.append(self.closing("}"))
        return self.make(kind, parts)

    def listed(self, opening: str, closing: str, item, kind: str, separators: tuple[str, ...] = (",", "\n", ";")) -> Node:
        parts: list[Node] = [self.want(opening)]
        held, self.plain = self.plain, False
        while not self.see(closing) and self.now.kind is not END:
            if self.see("\n"):
                self.step()
            elif self.see(*separators):
                parts.append(self.leaf())
            else:
                self.guarded(item, parts, (closing, *separators))
        self.plain = held
        parts.append(self.closing(closing))
        return self.make(kind, parts)

    # -- declarations
    def statement(self) -> object:
        self.lines()
        t = self.now.text if self.now.kind == ID else ""
        if t == "package":
            return self.make("package_clause", self.leaf(), self.name("package_identifier"))
        if t == "import":
            return self.make("import_declaration", self.leaf(), self.listed("(", ")", self.import_spec, "import_spec_list") if self.see("(") else self.import_spec())
        if t == "func" and (self.ahead().kind == ID or self.method_ahead()):
            return self.function()
        if t == "type":
            return self.make("type_declaration", self.leaf(), self.grouped(self.type_spec))
        if t == "var":
            return self.make("var_declaration", self.leaf(), self.grouped(self.var_spec))
        if t == "const":
            return self.make("const_declaration", self.leaf(), self.grouped(lambda: self.var_spec("const_spec")))
        if t == "if":
            return self.if_()
        if t == "for":
            return self.for_()
        if t == "switch":
            return self.switch()
        if t == "select":
            return self.select()
        if t in ("return",):
            return self.make("return_statement", self.leaf(), None if self.see("\n", ";", "}") else self.expressions())
        if t in ("break", "continue", "goto"):
            return self.make(f"{t}_statement", self.leaf(), self.name("label_name") if self.word() else None)
        if t == "fallthrough":
            return self.make("fallthrough_statement", self.leaf())
        if t in ("go", "defer"):
            return self.make(f"{t}_statement", self.leaf(), self.expression())
        if self.see("{"):
            return self.block()
        if self.word() and self.ahead().text == ":" and self.ahead().kind == OP:
            return self.make("labeled_statement", ("label", self.name("label_name")), self.leaf(), None if self.see("}") else self.statement())
        return self.simple()

    def method_ahead(self) -> bool:
        """func (receiver) name ( ..."""
        if self.ahead().text != "(":
            return False
        i = self.partner(self.at + 1) + 1
        return i + 1 < len(self.tokens) and self.tokens[i].kind == ID and self.tokens[i + 1].text in ("(", "[")

    def grouped(self, spec) -> list[Node]:
        if not self.see("("):
            return [spec()]
        whole = self.listed("(", ")", spec, "list")
        return whole.kids

    def import_spec(self) -> Node:
        name = None
        if self.see("."):
            name = self.leaf("dot")
        elif self.word():
            name = self.leaf("blank_identifier" if self.now.text == "_" else "package_identifier")
        return self.make("import_spec", ("name", name), ("path", self.string()))

    def string(self) -> Node:
        if self.now.kind != STR:
            raise Bad
        kind = {"`": "raw_string_literal", '"': "interpreted_string_literal", "'": "rune_literal"}[self.now.text[0]]
        return self.leaf(kind)

    def function(self) -> Node:
        parts: list = [self.leaf()]
        kind = "function_declaration"
        if self.see("("):
            kind = "method_declaration"
            parts.append(("receiver", self.parameters()))
        parts.append(("name", self.name("field_identifier" if kind == "method_declaration" else "identifier")))
        if self.see("["):
            parts.append(("type_parameters", self.type_parameters()))
        parts += self.signature()
        if self.see("{"):
            parts.append(("body", self.block()))
        return self.make(kind, *parts)

    def type_parameters(self) -> Node:
        return self.bare("type_parameter_list", self.partner(self.at) + 1, "type_identifier")

    def signature(self) -> list:
        parts: list = [("parameters", self.parameters())]
        if self.see("("):
            parts.append(("result", self.parameters()))
        elif not self.see("{", "\n", ";", ",", ")", "]", "}", "=", ":=", ":") and self.now.kind is not END and self.now.kind != STR:
            parts.append(("result", self.type()))
        return parts

    def parameters(self) -> Node:
        return self.listed("(", ")", self.parameter, "parameter_list")

    def parameter(self) -> Node:
        parts: list = []
        # names are followed by a type unless the list is of types only
        i, names = self.at, 0
        while self.tokens[i].kind == ID and self.tokens[i + 1].text == ",":
            names, i = names + 1, i + 2
        t, u = self.tokens[i], self.tokens[i + 1]
        typed = t.kind == ID and t.text not in self.keywords and u.text not in (",", ")", ".", "\n")
        if typed:
            for _ in range(names):
                parts += [("name", self.name()), self.leaf()]
            parts.append(("name", self.name()))
        if self.see("..."):
            parts.append(self.leaf())
            return self.make("variadic_parameter_declaration", *parts, ("type", self.type()))
        return self.make("parameter_declaration", *parts, ("type", self.type()))

    def type_spec(self) -> Node:
        parts: list = [("name", self.name("type_identifier"))]
        if self.see("[") and self.ahead().kind == ID and self.ahead(2).text not in ("]",):
            parts.append(("type_parameters", self.type_parameters()))
        if self.see("="):
            parts.append(self.leaf())
            return self.make("type_alias", *parts, ("type", self.type()))
        return self.make("type_spec", *parts, ("type", self.type()))

    def var_spec(self, kind: str = "var_spec") -> Node:
        parts: list = [("name", self.name())]
        while self.see(","):
            parts += [self.leaf(), ("name", self.name())]
        if not self.see("=", "\n", ";", ")") and self.now.kind is not END:
            parts.append(("type", self.type()))
        if self.see("="):
            parts += [self.leaf(), ("value", self.expressions())]
        return self.make(kind, *parts)

    # -- types
    def type(self) -> Node:
        t = self.now.text
        if self.see("*"):
            return self.make("pointer_type", self.leaf(), self.type())
        if self.see("("):
            return self.make("parenthesized_type", self.leaf(), self.type(), self.closing(")"))
        if self.see("["):
            if self.ahead().text == "]":
                return self.make("slice_type", self.leaf(), self.leaf(), ("element", self.type()))
            parts = [self.leaf(), ("length", self.leaf() if self.see("...") else self.expression()), self.closing("]")]
            return self.make("array_type", *parts, ("element", self.type()))
        if self.see("<-") or t == "chan":
            parts = [self.maybe("<-"), self.want("chan"), self.maybe("<-")]
            return self.make("channel_type", *parts, ("value", self.type()))
        if t == "map":
            return self.make("map_type", self.leaf(), self.want("["), ("key", self.type()), self.closing("]"), ("value", self.type()))
        if t == "func":
            return self.make("function_type", self.leaf(), *self.signature())
        if t == "struct":
            return self.make("struct_type", self.leaf(), self.body("field_declaration_list", self.field))
        if t == "interface":
            return self.make("interface_type", self.leaf(), self.body("field_declaration_list", self.method_spec).kids)
        if not self.word():
            raise Bad
        if self.ahead().text == ".":
            node = self.make("qualified_type", ("package", self.leaf("package_identifier")), self.leaf(), ("name", self.name("type_identifier")))
        else:
            node = self.leaf("type_identifier")
        if self.see("[") and self.ahead().text != "]" and not self.plain:
            node = self.make("generic_type", ("type", node), ("type_arguments", self.listed("[", "]", self.type, "type_arguments")))
        return node

    def field(self) -> Node:
        parts: list = []
        if self.see("*") or (self.word() and (self.ahead().text in ("\n", "}", ".", ";") or self.ahead().kind == STR)):
            parts = [self.maybe("*"), ("type", self.type())]
        else:
            parts = [("name", self.name("field_identifier"))]
            while self.see(","):
                parts += [self.leaf(), ("name", self.name("field_identifier"))]
            parts.append(("type", self.type()))
        if self.now.kind == STR:
            parts.append(("tag", self.string()))
        return self.make("field_declaration", *parts)

    def method_spec(self) -> Node:
        if self.word() and self.ahead().text == "(":
            return self.make("method_elem", ("name", self.name("field_identifier")), *self.signature())
        parts: list = [self.maybe("~"), self.type()]
        while self.see("|"):
            parts += [self.leaf(), self.maybe("~"), self.type()]
        return self.make("type_elem", *parts)

    # -- statements
    def expressions(self) -> Node:
        parts = [self.expression()]
        while self.see(","):
            parts += [self.leaf(), self.expression()]
        return self.make("expression_list", parts)

    def simple(self) -> Node:
        left = self.expressions()
        if self.see(":="):
            return self.make("short_var_declaration", ("left", left), self.leaf(), ("right", self.range() if self.see("range") else self.expressions()))
        if self.now.kind == OP and (self.now.text == "=" or (self.now.text.endswith("=") and self.now.text not in ("==", "!=", "<=", ">=", ":="))):
            return self.make("assignment_statement", ("left", left), ("operator", self.leaf()), ("right", self.expressions()))
        only = left.kids[0]
        only.field = None
        if self.see("++", "--"):
            kind = "inc_statement" if self.now.text == "++" else "dec_statement"
            return self.make(kind, only, self.leaf())
        if self.see("<-"):
            return self.make("send_statement", ("channel", only), self.leaf(), ("value", self.expression()))
        if len(left.kids) > 1:
            raise Bad
        return self.make("expression_statement", only)

    def range(self) -> Node:
        return self.make("range", self.leaf(), self.expression())

    def header(self, work):
        held, self.plain = self.plain, True
        try:
            return work()
        finally:
            self.plain = held

    def if_(self) -> Node:
        parts: list = [self.leaf()]

        def head() -> None:
            first = self.simple()
            if self.see(";", "\n"):
                parts.append(("initializer", first))
                s = self.semicolon()
                if s:
                    parts.append(s)
                first = self.simple()
            parts.append(("condition", first.kids[0] if first.kind == "expression_statement" else first))

        self.header(head)
        parts.append(("consequence", self.block()))
        if self.see("else"):
            parts += [self.leaf(), ("alternative", self.if_() if self.see("if") else self.block())]
        return self.make("if_statement", *parts)

    def for_(self) -> Node:
        parts: list = [self.leaf()]

        def head() -> None:
            if self.see("{"):
                return
            if self.see("range"):
                parts.append(self.make("range_clause", self.leaf(), ("right", self.expression())))
                return
            first = None if self.see(";") else self.left_of_range()
            if first is not None and first.kind == "range_clause":
                parts.append(first)
                return
            if self.see(";"):
                clause: list = [("initializer", first), self.leaf()]
                if not self.see(";"):
                    clause.append(("condition", self.expression()))
                if self.see(";"):
                    clause.append(self.leaf())
                if not self.see("{"):
                    clause.append(("update", self.simple()))
                parts.append(self.make("for_clause", *clause))
            elif first is not None:
                parts.append(first.kids[0] if first.kind == "expression_statement" else first)

        self.header(head)
        return self.make("for_statement", *parts, ("body", self.block()))

    def left_of_range(self) -> Node:
        start = self.at
        left = self.expressions()
        if self.see(":=", "=") and self.ahead().text == "range":
            return self.make("range_clause", ("left", left), self.leaf(), self.leaf(), ("right", self.expression()))
        self.go(start)
        return self.simple()

    def switch(self) -> Node:
        parts: list = [self.leaf()]
        kind = "expression_switch_statement"

        def head() -> None:
            nonlocal kind
            while not self.see("{") and self.now.kind is not END:
                s = None if self.see(";", "\n") else self.simple()
                if self.see(";", "\n"):
                    parts.append(("initializer", s))
                    self.semicolon()
                    continue
                if s is None:
                    raise Bad
                inner = s.kids[-1] if s.kids else s
                guard = inner.kids[0] if inner.kind == "expression_list" and inner.kids else inner
                if guard.kind == "type_assertion_expression" and any(k.kind == "type" for k in guard.kids):
                    kind = "type_switch_statement"
                    if s.kind == "short_var_declaration":
                        parts.append(("alias", s.kids[0]))
                        parts.append(s.kids[1])
                    parts.append(("value", guard.kids[0]))
                    parts.extend(guard.kids[1:])
                else:
                    parts.append(("value", s.kids[0] if s.kind == "expression_statement" else s))

        self.header(head)
        case = "type_case" if kind == "type_switch_statement" else "expression_case"
        body = self.body("block", lambda: self.case(case))
        return self.make(kind, *parts, body.kids)

    def case(self, kind: str) -> Node:
        if self.see("default"):
            return self.make("default_case", self.leaf(), self.want(":"), *self.inside())
        parts: list = [self.want("case")]
        if kind == "type_case":
            parts.append(("type", self.type()))
            while self.see(","):
                parts += [self.leaf(), ("type", self.type())]
        elif kind == "communication_case":
            parts.append(("communication", self.simple()))
        else:
            parts.append(("value", self.expressions()))
        return self.make(kind, *parts, self.want(":"), *self.inside())

    def inside(self) -> list[Node]:
        parts: list[Node] = []
        self.lines()
        while not self.see("case", "default", "}") and self.now.kind is not END:
            self.guarded(self.statement, parts, (";", "\n", "}"))
            self.lines()
        return parts

    def select(self) -> Node:
        return self.make("select_statement", self.leaf(), self.body("block", lambda: self.case("communication_case")).kids)

    # -- expressions
    def primary(self) -> Node:
        t = self.now
        if t.kind == NUM:
            text = t.text
            return self.leaf("imaginary_literal" if text.endswith("i") and not text.startswith("0x") else "float_literal" if re.search(r"[.eE]", text) and not text.startswith(("0x", "0X")) else "int_literal")
        if t.kind == STR:
            return self.string()
        if self.see("("):
            held, self.plain = self.plain, False
            self_ = self.make("parenthesized_expression", self.leaf(), self.expression(), self.closing(")"))
            self.plain = held
            return self_
        if t.text == "func":
            start = self.at
            parts = [self.leaf(), *self.signature()]
            if self.see("{"):
                return self.make("func_literal", *parts, ("body", self.block()))
            self.go(start)
            return self.type()
        if self.see("[") or t.text in ("map", "struct", "chan", "interface"):
            kind = self.type()
            return self.composite(kind) if self.see("{") else kind
        if self.word():
            kind = {"nil": "nil", "true": "true", "false": "false", "iota": "iota"}.get(t.text, "identifier")
            return self.leaf(kind)
        raise Bad

    def composite(self, kind: Node) -> Node:
        if kind.kind == "identifier":
            kind.kind = "type_identifier"
        elif kind.kind == "selector_expression":
            kind.kind = "qualified_type"
            for k, field, name in zip([k for k in kind.kids if k.named], ("package", "name"), ("package_identifier", "type_identifier"), strict=False):
                k.field, k.kind = field, name
        return self.make("composite_literal", ("type", kind), ("body", self.literal_value()))

    def literal_value(self) -> Node:
        return self.listed("{", "}", self.element, "literal_value")

    def element(self) -> Node:
        first = self.make("literal_element", self.literal_value() if self.see("{") else self.expression())
        if self.see(":"):
            return self.make("keyed_element", first, self.leaf(), self.make("literal_element", self.literal_value() if self.see("{") else self.expression()))
        return first

    def postfix(self, left: Node) -> Node:
        while True:
            if self.see("."):
                dot = self.leaf()
                if self.see("("):
                    opening = self.leaf()
                    inner = self.leaf() if self.see("type") else self.type()
                    left = self.make("type_assertion_expression", ("operand", left), dot, opening, inner if inner.kind == "type" else ("type", inner), self.closing(")"))
                else:
                    left = self.make("selector_expression", ("operand", left), dot, ("field", self.name("field_identifier")))
            elif self.see("("):
                left = self.make("call_expression", ("function", left), ("arguments", self.listed("(", ")", self.call_argument, "argument_list")))
            elif self.see("["):
                left = self.index(left)
            elif self.see("{") and not self.plain and left.kind in ("identifier", "selector_expression", "generic_type"):
                left = self.composite(left)
            else:
                return left

    def call_argument(self) -> Node:
        e = self.expression()
        if self.see("..."):
            return self.make("variadic_argument", e, self.leaf())
        return e

    def index(self, left: Node) -> Node:
        held, self.plain = self.plain, False
        parts: list = [self.leaf()]
        kind = "index_expression"
        while not self.see("]") and self.now.kind is not END:
            if self.see(":"):
                kind = "slice_expression"
                parts.append(self.leaf())
            elif self.see(",", "\n"):
                parts.append(self.leaf()) if self.see(",") else self.step()
            else:
                parts.append(("index" if kind == "index_expression" else "end", self.expression()))
        self.plain = held
        return self.make(kind, ("operand", left), *parts, self.closing("]"))

    def unary(self) -> Node:
        if self.now.kind == OP and self.now.text in self.prefix:
            return self.make("unary_expression", ("operator", self.leaf()), ("operand", self.unary()))
        return self.postfix(self.primary())
