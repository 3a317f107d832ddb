"""JavaScript and TypeScript."""

from __future__ import annotations

import re

from .core import END, ID, NUM, OP, STR, Bad, Node, Token
from .curly import Curly, levels

_PATTERN = re.compile(
    r"(?P<newline>\n)|(?P<space>[ \t\r\f\v]+|\xc2\xa0|\xef\xbb\xbf)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|\#![^\n]*)"
    r"|(?P<str>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?)"
    r"|(?P<id>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)"
    r"|(?P<op>>>>=|\*\*=|<<=|>>=|\.\.\.|\?\?=|&&=|\|\|=|===|!==|=>|\?\?|\?\.(?![0-9])|\*\*|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|.)",
    re.S | re.A,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: Words after which a slash starts a regular expression, fixed values.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else instanceof yield await default".split())
_PREDEFINED = frozenset("string number boolean any void unknown never object symbol bigint undefined null".split())


class JavaScript(Curly):
    pattern = _PATTERN
    typed = False
    keywords = frozenset("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
    binary = levels("?? ||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**")
    assign = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= ??= &&= ||=".split())
    block_kind = "statement_block"
    arguments_kind = "arguments"
    class_name = "identifier"
    field_kind = "field_definition"

    def lex(self) -> None:
        self.no_in = False
        self.read(0, len(self.text), "")
        pairs = []
        for i, t in enumerate(self.tokens):
            if t.kind == OP and t.text in ("(", "[", "{", "${"):
                pairs.append(i)
            elif t.kind == OP and t.text in (")", "]", "}") and pairs:
                self.tokens[pairs.pop()].part = i

    def read(self, at: int, stop: int, until: str) -> int:
        """Tokens from `at` on; in a template's hole, up to the brace that closes it."""
        text, fresh, depth = self.text, True, 0
        match = self.pattern.match
        while at < stop:
            c = text[at]
            if c == "`":
                at = self.template(at, stop)
                fresh = False
                continue
            if c == "/" and text[at : at + 2] not in ("//", "/*") and text[at - 1 : at] != "<" and self.regex_here():
                m = _REGEX.match(text, at)
                if m:
                    self.tokens.append(Token("regex", m[0], at, m.end(), fresh))
                    at, fresh = m.end(), False
                    continue
            m = match(text, at)
            kind, e = m.lastgroup, m.end()
            if kind == "newline":
                fresh = True
            elif kind == "comment":
                self.comments.append(Node("comment" if not m[0].startswith("#!") else "hash_bang_line", at, e))
                fresh = fresh or "\n" in m[0]
            elif kind != "space":
                if until and kind == "op":
                    if c == "{":
                        depth += 1
                    elif c == "}":
                        if depth == 0:
                            return at
                        depth -= 1
                t = Token({"id": ID, "num": NUM, "str": STR}.get(kind, OP), m[0], at, e, fresh)
                self.tokens.append(t)
                fresh = False
            at = e
        return at

    def regex_here(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == ID:
            return t.text in _BEFORE_REGEX
        return t.kind == OP and t.text not in (")", "]", "}", "++", "--") and t.text != "`"

    def template(self, at: int, stop: int) -> int:
        self.tokens.append(Token(OP, "`", at, at + 1))
        i = start = at + 1
        while i < stop and self.text[i] != "`":
            if self.text[i] == "\\":
                i += 2
            elif self.text[i : i + 2] == "${":
                if i > start:
                    self.tokens.append(Token("fragment", self.text[start:i], start, i))
                self.tokens.append(Token(OP, "${", i, i + 2))
                i = self.read(i + 2, stop, "}")
                if i < stop:
                    self.tokens.append(Token(OP, "}", i, i + 1))
                i += 1
                start = i
            else:
                i += 1
        if i > start:
            self.tokens.append(Token("fragment", self.text[start : min(i, stop)], start, min(i, stop)))
        if i < stop:
            self.tokens.append(Token(OP, "`", i, i + 1))
        return i + 1

    def semicolon(self) -> Node | None:
        if self.see(";"):
            return self.leaf()
        if self.see("}") or self.now.fresh or self.now.kind is END:
            return None
        raise Bad

    # -- statements
    def statement(self) -> object:
        t = self.now.text if self.now.kind == ID else ""
        if self.see("{"):
            return self.block()
        if self.see(";"):
            return self.make("empty_statement", self.leaf())
        method = getattr(self, f"do_{t}", None) if t else None
        if method and self.ahead().text not in ("=", ".", ":") and not (self.ahead().text == "(" and t in ("import", "class", "type", "interface", "enum", "async", "let")):
            made = method()
            if made is not None:
                return made
        if self.see("@"):
            return self.decorated()
        if self.word() and self.ahead().text == ":" and self.ahead().kind == OP:
            return self.make("labeled_statement", ("label", self.name("statement_identifier")), self.leaf(), ("body", self.statement()))
        return self.make("expression_statement", self.comma(), self.semicolon())

    def decorated(self) -> Node:
        parts = []
        while self.see("@"):
            parts.append(self.make("decorator", self.leaf(), self.postfix(self.primary())))
        node = self.statement()
        node.kids[:0] = parts
        node.start = parts[0].start
        return node

    def comma(self) -> Node:
        first = self.expression()
        if not self.see(","):
            return first
        parts = [first]
        while self.see(","):
            parts += [self.leaf(), self.expression()]
        return self.make("sequence_expression", parts)

    def string(self) -> Node:
        t = self.now
        if t.kind != STR:
            raise Bad
        self.step()
        node = Node("string", t.start, t.end)
        if t.end - t.start > 2:
            node.kids.append(Node("string_fragment", t.start + 1, t.end - 1))
        return node

    def do_import(self) -> Node | None:
        if self.ahead().text == ".":
            return None
        parts: list = [self.leaf()]
        if self.see("type") and self.ahead().text != "from" and self.ahead().text != ",":
            parts.append(self.leaf())
        if self.now.kind != STR:
            clause: list = []
            while not self.see("from") and self.now.kind is not END:
                if self.see(","):
                    clause.append(self.leaf())
                elif self.see("{"):
                    clause.append(self.listed("{", "}", lambda: self.specifier("import_specifier"), "named_imports"))
                elif self.see("*"):
                    clause.append(self.make("namespace_import", self.leaf(), self.want("as"), self.name()))
                elif self.typed and self.word() and self.ahead().text == "=":
                    inner = [self.name(), self.leaf(), self.expression()]
                    return self.make("import_alias", *parts, inner, self.semicolon())
                else:
                    clause.append(self.name())
            parts += [self.make("import_clause", clause), self.leaf()]
        parts.append(("source", self.string()))
        if self.see("with", "assert") and self.ahead().text == "{":
            parts += [self.leaf(), self.object()]
        return self.make("import_statement", *parts, self.semicolon())

    def specifier(self, kind: str) -> Node:
        parts: list = []
        if self.see("type") and self.ahead().kind == ID and self.ahead().text != "as":
            parts.append(self.leaf())
        parts.append(("name", self.string() if self.now.kind == STR else self.leaf("identifier")))
        if self.see("as"):
            parts += [self.leaf(), ("alias", self.leaf("identifier"))]
        return self.make(kind, *parts)

    def do_export(self) -> Node:
        parts: list = [self.leaf()]
        if self.see("type") and self.ahead().text == "{":
            parts.append(self.leaf())
        if self.see("default"):
            parts.append(self.leaf())
            if self.see("function", "class", "async", "abstract", "interface") or self.see("@"):
                start = self.at
                try:
                    made = self.statement()
                except Bad:
                    self.go(start)
                    made = ("value", self.expression())
                    return self.make("export_statement", *parts, made, self.semicolon())
                return self.make("export_statement", *parts, ("declaration", made))
            return self.make("export_statement", *parts, ("value", self.expression()), self.semicolon())
        if self.see("*"):
            star = self.leaf()
            parts.append(self.make("namespace_export", star, self.leaf(), self.leaf("identifier")) if self.see("as") else star)
            return self.make("export_statement", *parts, self.want("from"), ("source", self.string()), self.semicolon())
        if self.see("{"):
            parts.append(self.listed("{", "}", lambda: self.specifier("export_specifier"), "export_clause"))
            if self.see("from"):
                parts += [self.leaf(), ("source", self.string())]
            return self.make("export_statement", *parts, self.semicolon())
        if self.see("="):
            return self.make("export_statement", *parts, self.leaf(), self.expression(), self.semicolon())
        return self.make("export_statement", *parts, ("declaration", self.statement()))

    def do_async(self) -> Node | None:
        if self.ahead().text != "function" or self.ahead().fresh:
            return None
        return self.do_function(self.leaf())

    def do_function(self, first: Node | None = None) -> Node:
        parts: list = [first, self.leaf()]
        star = self.maybe("*")
        parts += [star, ("name", self.name())]
        parts += self.signature()
        if self.typed and not self.see("{"):
            return self.make("function_signature", *parts, self.semicolon())
        return self.make("generator_function_declaration" if star else "function_declaration", *parts, ("body", self.block()))

    def signature(self) -> list:
        parts: list = []
        if self.typed and self.see("<"):
            parts.append(("type_parameters", self.type_parameters()))
        parts.append(("parameters", self.listed("(", ")", self.parameter, "formal_parameters")))
        if self.typed and self.see(":"):
            parts.append(("return_type", self.annotation()))
        return parts

    def parameter(self) -> Node:
        if self.see("..."):
            return self.make("rest_pattern", self.leaf(), self.pattern_())
        left = self.pattern_()
        if self.see("="):
            return self.make("assignment_pattern", ("left", left), self.leaf(), ("right", self.expression()))
        return left

    def pattern_(self) -> Node:
        if self.see("{"):
            return self.listed("{", "}", self.property_pattern, "object_pattern")
        if self.see("["):
            return self.listed("[", "]", self.element_pattern, "array_pattern")
        if self.see("this"):
            return self.leaf("this")
        return self.name()

    def element_pattern(self) -> Node:
        return self.parameter_like()

    def parameter_like(self) -> Node:
        if self.see("..."):
            return self.make("rest_pattern", self.leaf(), self.pattern_())
        left = self.pattern_()
        if self.see("="):
            return self.make("assignment_pattern", ("left", left), self.leaf(), ("right", self.expression()))
        return left

    def property_pattern(self) -> Node:
        if self.see("..."):
            return self.make("rest_pattern", self.leaf(), self.pattern_())
        if self.ahead().text == ":" or self.see("["):
            return self.make("pair_pattern", ("key", self.key()), self.want(":"), ("value", self.parameter_like()))
        name = self.leaf("shorthand_property_identifier_pattern")
        if self.see("="):
            return self.make("object_assignment_pattern", ("left", name), self.leaf(), ("right", self.expression()))
        return name

    def do_class(self) -> Node:
        return self.class_("class_declaration", None)

    def class_(self, kind: str, first: Node | None) -> Node:
        parts: list = [first, self.leaf()]
        if self.word() and self.now.text not in ("implements",):
            parts.append(("name", self.name(self.class_name)))
        elif kind != "class":
            raise Bad
        if self.typed and self.see("<"):
            parts.append(("type_parameters", self.type_parameters()))
        heritage: list = []
        if self.see("extends"):
            word = self.leaf()
            base = self.postfix(self.primary())
            if self.typed:
                inner: list = [word, ("value", base)]
                if self.see("<"):
                    inner.append(("type_arguments", self.type_arguments()))
                heritage.append(self.make("extends_clause", *inner))
            else:
                heritage += [word, base]
        if self.typed and self.see("implements"):
            inner = [self.leaf(), self.type()]
            while self.see(","):
                inner += [self.leaf(), self.type()]
            heritage.append(self.make("implements_clause", *inner))
        if heritage:
            parts.append(self.make("class_heritage", *heritage))
        parts.append(("body", self.body("class_body", self.member)))
        return self.make(kind, *parts)

    def key(self) -> Node:
        t = self.now
        if t.kind == STR:
            return self.string()
        if t.kind == NUM:
            return self.leaf("number")
        if self.see("["):
            return self.make("computed_property_name", self.leaf(), self.expression(), self.closing("]"))
        if self.see("#"):
            start = self.step().start
            name = self.leaf("private_property_identifier")
            name.start = start
            return name
        if t.kind == ID:
            return self.leaf("property_identifier")
        raise Bad

    def modifiers(self) -> list[Node]:
        parts: list[Node] = []
        words = ("static", "async", "get", "set") + (("public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor") if self.typed else ())
        while True:
            if self.see("@"):
                parts.append(self.make("decorator", self.leaf(), self.postfix(self.primary())))
            elif self.see(*words) and self.ahead().text not in ("(", "=", ";", "}", ":", "?", "!", "<", ",") and not (self.ahead().fresh and self.now.text in ("get", "set", "static")):
                t = self.now.text
                parts.append(self.make("accessibility_modifier", self.leaf()) if t in ("public", "private", "protected") else self.make("override_modifier", self.leaf()) if t == "override" else self.leaf())
            elif self.see("*"):
                parts.append(self.leaf())
            else:
                return parts

    def member(self) -> Node:
        if self.see("static") and self.ahead().text == "{":
            return self.make("class_static_block", self.leaf(), ("body", self.block()))
        parts: list = self.modifiers()
        if self.typed and self.see("[") and self.ahead().kind == ID and self.ahead(2).text == ":":
            return self.make("index_signature", *parts, self.leaf(), ("name", self.name()), self.annotation(), self.closing("]"), self.annotation() if self.see(":") else None, self.semicolon())
        parts.append(("name", self.key()))
        if self.typed:
            parts.append(self.maybe("?", "!"))
        if self.see("(") or (self.typed and self.see("<")):
            parts += self.signature()
            if self.see("{"):
                return self.make("method_definition", *parts, ("body", self.block()))
            return self.make("method_signature" if not any(k.kind == "abstract" for k in parts if isinstance(k, Node)) else "abstract_method_signature", *parts, self.semicolon())
        if self.field_kind == "field_definition":
            name = parts[-1]
            parts[-1] = ("property", name[1])
        if self.typed and self.see(":"):
            parts.append(("type", self.annotation()))
        if self.see("="):
            parts += [self.leaf(), ("value", self.expression())]
        node = self.make(self.field_kind, *parts)
        self.semicolon()
        return node

    def variables(self, kind: str) -> Node:
        parts: list = [("kind", self.leaf()), self.declarator()]
        while self.see(","):
            parts += [self.leaf(), self.declarator()]
        return self.make(kind, *parts)

    def declarator(self) -> Node:
        parts: list = [("name", self.pattern_())]
        if self.typed:
            parts.append(self.maybe("!"))
            if self.see(":"):
                parts.append(("type", self.annotation()))
        if self.see("="):
            parts += [self.leaf(), ("value", self.expression())]
        return self.make("variable_declarator", *parts)

    def declared(self, kind: str) -> Node:
        node = self.variables(kind)
        end = self.semicolon()
        if end is not None:
            node.kids.append(end)
            node.end = end.end
        return node

    def do_const(self) -> Node:
        if self.typed and self.ahead().text == "enum":
            return self.do_enum(self.leaf())
        return self.declared("lexical_declaration")

    def do_let(self) -> Node | None:
        return self.declared("lexical_declaration") if self.ahead().kind == ID or self.ahead().text in ("{", "[") else None

    def do_var(self) -> Node:
        return self.declared("variable_declaration")

    def condition(self) -> Node:
        return self.make("parenthesized_expression", self.want("("), self.comma(), self.closing(")"))

    def do_if(self) -> Node:
        parts: list = [self.leaf(), ("condition", self.condition()), ("consequence", self.statement())]
        if self.see("else"):
            parts.append(("alternative", self.make("else_clause", self.leaf(), self.statement())))
        return self.make("if_statement", *parts)

    def do_while(self) -> Node:
        return self.make("while_statement", self.leaf(), ("condition", self.condition()), ("body", self.statement()))

    def do_do(self) -> Node:
        return self.make("do_statement", self.leaf(), ("body", self.statement()), self.want("while"), ("condition", self.condition()), self.maybe(";"))

    def do_for(self) -> Node:
        parts: list = [self.leaf()]
        if self.see("await"):
            parts.append(self.leaf())
        parts.append(self.want("("))
        start = self.at
        try:
            inner: list = []
            if self.see("var", "let", "const"):
                inner += [("kind", self.leaf()), ("left", self.pattern_())]
            else:
                inner.append(("left", self.postfix(self.primary())))
            if not self.see("of", "in"):
                raise Bad
            inner += [("operator", self.leaf()), ("right", self.comma()), self.closing(")")]
            return self.make("for_in_statement", *parts, *inner, ("body", self.statement()))
        except Bad:
            self.go(start)
        self.no_in = True
        if self.see(";"):
            parts.append(("initializer", self.make("empty_statement", self.leaf())))
        elif self.see("var", "let", "const"):
            node = self.variables("variable_declaration" if self.see("var") else "lexical_declaration")
            node.kids.append(self.closing(";"))
            parts.append(("initializer", node))
        else:
            parts.append(("initializer", self.make("expression_statement", self.comma(), self.closing(";"))))
        self.no_in = False
        parts.append(("condition", self.make("empty_statement", self.leaf()) if self.see(";") else self.make("expression_statement", self.comma(), self.closing(";"))))
        if not self.see(")"):
            parts.append(("increment", self.comma()))
        return self.make("for_statement", *parts, self.closing(")"), ("body", self.statement()))

    def blocked(self, op: str) -> bool:
        return op == "in" and self.no_in

    def do_switch(self) -> Node:
        return self.make("switch_statement", self.leaf(), ("value", self.condition()), ("body", self.body("switch_body", self.case)))

    def case(self) -> Node:
        if self.see("default"):
            parts: list = [self.leaf(), self.want(":")]
            kind = "switch_default"
        else:
            parts = [self.want("case"), ("value", self.comma()), self.want(":")]
            kind = "switch_case"
        inside: list[Node] = []
        while not self.see("case", "default", "}") and self.now.kind is not END:
            self.guarded(self.statement, inside, (";", "}"))
        return self.make(kind, *parts, inside)

    def do_try(self) -> Node:
        parts: list = [self.leaf(), ("body", self.block())]
        if self.see("catch"):
            inner: list = [self.leaf()]
            if self.see("("):
                inner += [self.leaf(), ("parameter", self.pattern_())]
                if self.typed and self.see(":"):
                    inner.append(("type", self.annotation()))
                inner.append(self.closing(")"))
            parts.append(("handler", self.make("catch_clause", *inner, ("body", self.block()))))
        if self.see("finally"):
            parts.append(("finalizer", self.make("finally_clause", self.leaf(), ("body", self.block()))))
        return self.make("try_statement", *parts)

    def ended(self, kind: str) -> Node:
        parts: list = [self.leaf()]
        if not (self.see(";", "}") or self.now.fresh or self.now.kind is END):
            parts.append(self.comma() if kind not in ("break_statement", "continue_statement") else ("label", self.name("statement_identifier")))
        return self.make(kind, *parts, self.semicolon())

    def do_return(self) -> Node:
        return self.ended("return_statement")

    def do_throw(self) -> Node:
        return self.ended("throw_statement")

    def do_break(self) -> Node:
        return self.ended("break_statement")

    def do_continue(self) -> Node:
        return self.ended("continue_statement")

    def do_debugger(self) -> Node:
        return self.ended("debugger_statement")

    # -- expressions
    def assignment(self, op: str) -> str:
        return "assignment_expression" if op == "=" else "augmented_assignment_expression"

    def special(self, left: Node, least: int) -> Node | None:
        t = self.now.text
        if t in ("++", "--") and not self.now.fresh:
            return self.make("update_expression", ("argument", left), ("operator", self.leaf()))
        if t == "?" and least <= 0:
            return self.make("ternary_expression", ("condition", left), self.leaf(), ("consequence", self.expression()), self.want(":"), ("alternative", self.expression()))
        if t == ">" and self.ahead().text in (">", ">=") and self.now.end == self.ahead().start and least < self.binary[">>"]:
            first = self.step()
            o = Node(">>", first.start, self.now.end, None, False)
            last = self.step()
            if last.text == ">" and self.see(">") and self.now.start == last.end:
                self.step()
                o.kind, o.end = ">>>", o.end + 1
            return self.make("binary_expression", ("left", left), ("operator", o), ("right", self.expression(self.binary[">>"])))
        return None

    def unary(self) -> Node:
        t = self.now
        if t.kind == ID and t.text in ("typeof", "void", "delete"):
            return self.make("unary_expression", ("operator", self.leaf()), ("argument", self.unary()))
        if t.text == "await" and t.kind == ID and (self.ahead().kind in (ID, STR) or self.ahead().text in ("(", "[", "{", "`")) and not self.ahead().fresh:
            return self.make("await_expression", self.leaf(), self.unary())
        if t.text == "yield" and t.kind == ID and not (self.ahead().text in ("=", ".", ",")):
            parts: list = [self.leaf(), self.maybe("*")]
            if not (self.see(")", "]", "}", ",", ";", ":") or self.now.fresh or self.now.kind is END):
                parts.append(self.expression())
            return self.make("yield_expression", *parts)
        if t.kind == OP and t.text in self.prefix:
            o = self.leaf()
            return self.make("update_expression" if o.kind in ("++", "--") else "unary_expression", ("operator", o), ("argument", self.unary()))
        return self.postfix(self.primary())

    def arrow_ahead(self) -> bool:
        i = self.at
        if self.tokens[i].text == "async" and self.tokens[i + 1].kind == ID and not self.tokens[i + 1].fresh or (self.tokens[i].text == "async" and self.tokens[i + 1].text in ("(", "<")):
            i += 1
        t = self.tokens[i]
        if t.kind == ID and t.text not in self.keywords:
            return self.tokens[i + 1].text == "=>"
        if self.typed and t.text == "<":
            i = self.generic_end(i)
            if i < 0:
                return False
            t = self.tokens[i]
        if t.text != "(" or t.kind != OP:
            return False
        i = min(self.partner(i) + 1, len(self.tokens) - 1)
        if self.tokens[i].text == "=>":
            return True
        if not self.typed or self.tokens[i].text != ":":
            return False
        i += 1
        for _ in range(60):  # a return type, then the arrow
            if i >= len(self.tokens) - 1 or self.tokens[i].text in (";", ",", ")", "]", "}", "=", "?", ":"):
                return False
            if self.tokens[i].text == "=>":
                return True
            i = self.partner(i) + 1 if self.tokens[i].text in ("(", "[", "{") and self.tokens[i].kind == OP else i + 1
        return False

    def arrow(self) -> Node:
        parts: list = []
        if self.see("async") and self.ahead().text != "=>":
            parts.append(self.leaf())
        if self.word():
            parts.append(("parameter", self.name()))
        else:
            parts += self.signature()
        parts.append(self.want("=>"))
        held, self.no_in = self.no_in, False
        parts.append(("body", self.block() if self.see("{") else self.expression()))
        self.no_in = held
        return self.make("arrow_function", *parts)

    def primary(self) -> Node:
        t = self.now
        if (t.kind == ID or t.text in ("(", "<")) and self.arrow_ahead():
            return self.arrow()
        if t.kind == NUM:
            return self.leaf("number")
        if t.kind == STR:
            return self.string()
        if t.kind == "regex":
            self.step()
            end = self.text.rindex("/", t.start, t.end)
            kids = [Node("/", t.start, t.start + 1, None, False), Node("regex_pattern", t.start + 1, end), Node("/", end, end + 1, None, False)]
            if end + 1 < t.end:
                kids.append(Node("regex_flags", end + 1, t.end))
            return Node("regex", t.start, t.end, kids)
        if self.see("`"):
            return self.template_string()
        if self.see("("):
            held, self.no_in = self.no_in, False
            node = self.make("parenthesized_expression", self.leaf(), self.comma(), self.closing(")"))
            self.no_in = held
            return node
        if self.see("["):
            return self.listed("[", "]", self.spread, "array")
        if self.see("{"):
            return self.object()
        if self.see("<") and self.ahead().kind == ID and not self.typed or (self.see("<") and self.ahead().text == ">"):
            return self.jsx()
        if t.kind == ID:
            w = t.text
            if w in ("this", "super", "null", "true", "false", "undefined"):
                return self.leaf(w)
            if w == "async" and self.ahead().text == "function":
                first = self.leaf()
                return self.function_expression(first)
            if w == "function":
                return self.function_expression(None)
            if w == "class":
                return self.class_("class", None)
            if w == "new":
                if self.ahead().text == ".":
                    return self.make("meta_property", self.leaf(), self.leaf(), self.leaf())
                parts: list = [self.leaf(), ("constructor", self.callee())]
                if self.typed and self.see("<"):
                    parts.append(("type_arguments", self.type_arguments()))
                if self.see("("):
                    parts.append(("arguments", self.arguments()))
                return self.make("new_expression", *parts)
            if w == "import":
                if self.ahead().text == ".":
                    return self.make("meta_property", self.leaf(), self.leaf(), self.leaf())
                return self.leaf("import")
            if self.word():
                return self.name()
        if self.see("#"):
            return self.key()
        raise Bad

    def callee(self) -> Node:
        node = self.primary()
        while self.see(".", "["):
            if self.see("."):
                node = self.make("member_expression", ("object", node), self.leaf(), ("property", self.key()))
            else:
                node = self.make("subscript_expression", ("object", node), self.leaf(), ("index", self.comma()), self.closing("]"))
        return node

    def function_expression(self, first: Node | None) -> Node:
        parts: list = [first, self.leaf()]
        star = self.maybe("*")
        parts.append(star)
        if self.word():
            parts.append(("name", self.name()))
        return self.make("generator_function" if star else "function_expression", *parts, *self.signature(), ("body", self.block()))

    def template_string(self) -> Node:
        parts: list[Node] = [self.leaf()]
        while not self.see("`") and self.now.kind is not END:
            if self.now.kind == "fragment":
                parts.append(self.leaf("string_fragment"))
            elif self.see("${"):
                parts.append(self.make("template_substitution", self.leaf(), self.comma(), self.closing("}")))
            else:
                raise Bad
        return self.make("template_string", parts, self.closing("`"))

    def spread(self) -> Node:
        if self.see("..."):
            return self.make("spread_element", self.leaf(), self.expression())
        return self.expression()

    argument = spread

    def object(self) -> Node:
        return self.listed("{", "}", self.property, "object")

    def property(self) -> Node:
        if self.see("..."):
            return self.make("spread_element", self.leaf(), self.expression())
        if self.now.kind == ID and self.ahead().text in (",", "}"):
            return self.leaf("shorthand_property_identifier")
        if self.word() and self.ahead().text == "=":
            return self.make("object_assignment_pattern", ("left", self.leaf("shorthand_property_identifier_pattern")), self.leaf(), ("right", self.expression()))
        parts: list = self.modifiers()
        name = self.key()
        if self.see("(") or (self.typed and self.see("<")):
            return self.make("method_definition", *parts, ("name", name), *self.signature(), ("body", self.block()))
        return self.make("pair", *parts, ("key", name), self.want(":"), ("value", self.expression()))

    def jsx(self) -> Node:
        """An element of embedded markup: its tags are matched, the expressions in braces are its children."""
        start, depth = self.now.start, 0
        parts: list[Node] = []
        i = self.at
        while i < len(self.tokens) - 1:
            t = self.tokens[i]
            if t.text == "{" and t.kind is OP:
                self.go(i)
                parts.append(self.jsx_expression())
                i = self.at
                continue
            if t.text == "<" and self.tokens[i + 1].text == "/":
                depth -= 1
            elif t.text == "<" and (self.tokens[i + 1].kind == ID or self.tokens[i + 1].text == ">"):
                depth += 1
            elif t.text == "/" and self.tokens[i + 1].text == ">" and self.tokens[i - 1].text != "<":
                depth -= 1
            if t.text == ">" and depth <= 0 and (self.tokens[i - 1].text != "="):
                self.go(i + 1)
                return Node("jsx_element", start, t.end, parts)
            i += 1
        raise Bad

    def jsx_expression(self) -> Node:
        """An expression in braces, or none; what can't be read is an ERROR to the closing brace."""
        at, held = self.at, self.no_in
        self.no_in = False
        try:
            return self.make("jsx_expression", self.leaf(), None if self.see("}") else self.spread() if self.see("...") else self.comma(), self.want("}"))
        except Bad:
            self.go(at)
            depth = 0
            while self.now.kind is not END:
                depth += self.see("{", "${") - self.see("}")
                t = self.step()
                if not depth:
                    return Node("ERROR", self.tokens[at].start, t.end)
            raise
        finally:
            self.no_in = held

    def postfix(self, left: Node) -> Node:
        while True:
            if self.see(".", "?."):
                chain = self.leaf()
                if chain.kind == "?.":
                    chain = Node("optional_chain", chain.start, chain.end, [chain])
                    if self.see("("):
                        left = self.make("call_expression", ("function", left), ("optional_chain", chain), ("arguments", self.arguments()))
                        continue
                    if self.see("["):
                        left = self.make("subscript_expression", ("object", left), ("optional_chain", chain), self.leaf(), ("index", self.comma()), self.closing("]"))
                        continue
                    left = self.make("member_expression", ("object", left), ("optional_chain", chain), ("property", self.key()))
                else:
                    left = self.make("member_expression", ("object", left), chain, ("property", self.key()))
            elif self.see("("):
                left = self.make("call_expression", ("function", left), ("arguments", self.arguments()))
            elif self.see("["):
                held, self.no_in = self.no_in, False
                left = self.make("subscript_expression", ("object", left), self.leaf(), ("index", self.comma()), self.closing("]"))
                self.no_in = held
            elif self.see("`") and not self.now.fresh:
                left = self.make("call_expression", ("function", left), ("arguments", self.template_string()))
            elif self.typed and self.see("!") and not self.now.fresh and self.ahead().text != "=":
                left = self.make("non_null_expression", left, self.leaf())
            elif self.typed and self.see("<") and self.call_types():
                kinds = self.type_arguments()
                left = self.make("call_expression", ("function", left), ("type_arguments", kinds), ("arguments", self.arguments()))
            else:
                return left

    def call_types(self) -> bool:
        end = self.generic_end(self.at)
        return end > 0 and self.tokens[end].text == "(" and self.tokens[end].kind == OP


class TypeScript(JavaScript):
    typed = True
    class_name = "type_identifier"
    field_kind = "public_field_definition"

    # -- types
    def annotation(self) -> Node:
        return self.make("type_annotation", self.want(":"), self.type())

    def type_parameters(self) -> Node:
        return self.listed("<", ">", self.type_parameter, "type_parameters")

    def type_parameter(self) -> Node:
        parts: list = [self.maybe("const", "in", "out"), ("name", self.name("type_identifier"))]
        if self.see("extends"):
            parts.append(("constraint", self.make("constraint", self.leaf(), self.type())))
        if self.see("="):
            parts.append(("value", self.make("default_type", self.leaf(), self.type())))
        return self.make("type_parameter", *parts)

    def type_arguments(self) -> Node:
        parts: list[Node] = [self.want("<")]
        while not self.see(">") and self.now.kind is not END:
            parts.append(self.leaf() if self.see(",") else self.type())
        parts.append(self.closing(">"))
        return self.make("type_arguments", parts)

    def type(self) -> Node:
        if self.see("asserts") and self.ahead().kind == ID:
            return self.make("asserts", self.leaf(), self.type())
        if self.now.kind == ID and self.ahead().text == "is" and not self.ahead().fresh:
            return self.make("type_predicate", ("name", self.leaf("identifier")), self.leaf(), ("type", self.type()))
        node = self.union()
        if self.see("extends") and not self.now.fresh:
            return self.make("conditional_type", ("left", node), self.leaf(), ("right", self.union()), self.want("?"), ("consequence", self.type()), self.want(":"), ("alternative", self.type()))
        return node

    def union(self) -> Node:
        first = self.maybe("|", "&")
        node = self.one_type()
        while self.see("|", "&"):
            kind = "union_type" if self.see("|") else "intersection_type"
            node = self.make(kind, first, node, self.leaf(), self.one_type())
            first = None
        return node

    def one_type(self) -> Node:
        t = self.now
        if self.see("(", "<") and self.function_type_ahead():
            return self.make("function_type", self.type_parameters() if self.see("<") else None, ("parameters", self.listed("(", ")", self.parameter, "formal_parameters")), self.want("=>"), ("return_type", self.type()))
        if self.see("new", "abstract"):
            parts: list = [self.maybe("abstract"), self.want("new"), self.type_parameters() if self.see("<") else None]
            return self.make("constructor_type", *parts, self.listed("(", ")", self.parameter, "formal_parameters"), self.want("=>"), self.type())
        if self.see("("):
            node = self.make("parenthesized_type", self.leaf(), self.type(), self.closing(")"))
        elif self.see("{"):
            node = self.object_type("object_type")
        elif self.see("["):
            node = self.listed("[", "]", self.tuple_part, "tuple_type")
        elif t.kind in (STR, NUM) or self.see("true", "false", "null", "undefined", "-"):
            if self.see("-"):
                self.step()
                if self.now.kind is not NUM:
                    raise Bad
            node = self.make("literal_type", self.string() if self.now.kind == STR else self.leaf("number" if self.now.kind == NUM else self.now.text))
        elif self.see("`"):
            node = self.make("template_literal_type", self.template_string())
        elif self.see("keyof", "unique") and self.ahead().text not in ("=", ",", ")", ";", ">"):
            return self.make("index_type_query", self.leaf(), self.one_type())
        elif self.see("readonly") and self.ahead().text not in ("=", ",", ")", ";", ">"):
            return self.make("readonly_type", self.leaf(), self.one_type())
        elif self.see("infer"):
            return self.make("infer_type", self.leaf(), self.name("type_identifier"))
        elif self.see("typeof"):
            node = self.make("type_query", self.leaf(), self.callee() if not self.see("import") else self.expression(20))
        elif self.see("this"):
            node = self.leaf("this_type")
        elif t.kind == ID and t.text in _PREDEFINED:
            node = self.leaf("predefined_type")
        elif t.kind == ID:
            node = self.leaf("type_identifier")
            while self.see("."):
                node.kind = "identifier" if node.kind == "type_identifier" else "nested_identifier"
                node = self.make("nested_type_identifier", ("module", node), self.leaf(), ("name", self.leaf("type_identifier")))
            if self.see("<") and not self.now.fresh:
                node = self.make("generic_type", ("name", node), ("type_arguments", self.type_arguments()))
        else:
            raise Bad
        while self.see("[") and not self.now.fresh:
            if self.ahead().text == "]":
                node = self.make("array_type", node, self.leaf(), self.leaf())
            else:
                node = self.make("lookup_type", node, self.leaf(), self.type(), self.closing("]"))
        return node

    def function_type_ahead(self) -> bool:
        i = self.at
        if self.tokens[i].text == "<":
            i = self.generic_end(i)
            if i < 0 or self.tokens[i].text != "(":
                return False
        return self.tokens[min(self.partner(i) + 1, len(self.tokens) - 1)].text == "=>"

    def tuple_part(self) -> Node:
        if self.see("..."):
            return self.make("rest_type", self.leaf(), self.tuple_part())
        if self.word() and self.ahead().text in (":", "?") and self.ahead(2).text != ",":
            return self.make("required_parameter", ("pattern", self.name()), self.maybe("?"), ("type", self.annotation()))
        node = self.type()
        return self.make("optional_type", node, self.leaf()) if self.see("?") else node

    def object_type(self, kind: str) -> Node:
        parts: list[Node] = [self.want("{")]
        while not self.see("}") and self.now.kind is not END:
            if self.see(",", ";"):
                parts.append(self.leaf())
                continue
            self.guarded(self.type_member, parts, (",", ";", "}"))
        parts.append(self.closing("}"))
        return self.make(kind, parts)

    def type_member(self) -> Node:
        if self.see("(", "<"):
            return self.make("call_signature", *self.signature())
        if self.see("new") and self.ahead().text == "(":
            return self.make("construct_signature", self.leaf(), *self.signature())
        parts: list = []
        while self.see("readonly", "get", "set", "+", "-") and self.ahead().text not in (":", "?", "(", ";", ",", "}"):
            parts.append(self.leaf())
        if self.see("[") and self.ahead().kind == ID and self.ahead(2).text in (":", "in"):
            opening = self.leaf()
            if self.ahead().text == "in":
                inner = self.make("mapped_type_clause", ("name", self.name("type_identifier")), self.leaf(), ("type", self.type()), *([self.leaf(), self.type()] if self.see("as") else []))
                parts += [opening, inner, self.closing("]")]
            else:
                parts += [opening, ("name", self.name()), self.annotation(), self.closing("]")]
            while self.see("?", "+", "-"):
                parts.append(self.leaf())
            return self.make("index_signature", *parts, ("type", self.annotation()) if self.see(":") else None)
        parts += [("name", self.key()), self.maybe("?")]
        if self.see("(", "<"):
            return self.make("method_signature", *parts, *self.signature())
        return self.make("property_signature", *parts, ("type", self.annotation()) if self.see(":") else None)

    def parameter(self) -> Node:
        parts: list = self.modifiers()
        if self.see("..."):
            parts.append(("pattern", self.make("rest_pattern", self.leaf(), self.pattern_())))
        else:
            parts.append(("pattern", self.pattern_()))
        kind = "required_parameter"
        if self.see("?"):
            kind = "optional_parameter"
            parts.append(self.leaf())
        if self.see(":"):
            parts.append(("type", self.annotation()))
        if self.see("="):
            parts += [self.leaf(), ("value", self.expression())]
        return self.make(kind, *parts)

    # -- declarations
    def do_interface(self) -> Node | None:
        if self.ahead().kind != ID:
            return None
        parts: list = [self.leaf(), ("name", self.name("type_identifier"))]
        if self.see("<"):
            parts.append(("type_parameters", self.type_parameters()))
        if self.see("extends"):
            inner: list = [self.leaf(), ("type", self.type())]
            while self.see(","):
                inner += [self.leaf(), ("type", self.type())]
            parts.append(self.make("extends_type_clause", *inner))
        return self.make("interface_declaration", *parts, ("body", self.object_type("interface_body")))

    def do_type(self) -> Node | None:
        if self.ahead().kind != ID or self.ahead().fresh:
            return None
        parts: list = [self.leaf(), ("name", self.name("type_identifier"))]
        if self.see("<"):
            parts.append(("type_parameters", self.type_parameters()))
        return self.make("type_alias_declaration", *parts, self.want("="), ("value", self.type()), self.semicolon())

    def do_enum(self, first: Node | None = None) -> Node:
        return self.make("enum_declaration", first, self.leaf(), ("name", self.name()), ("body", self.listed("{", "}", self.enum_member, "enum_body")))

    def enum_member(self) -> Node:
        name = self.key()
        if self.see("="):
            return self.make("enum_assignment", ("name", name), self.leaf(), ("value", self.expression()))
        return name

    def do_abstract(self) -> Node | None:
        return self.class_("abstract_class_declaration", self.leaf()) if self.ahead().text == "class" else None

    def do_declare(self) -> Node | None:
        if self.ahead().kind != ID or self.ahead().fresh:
            return None
        return self.make("ambient_declaration", self.leaf(), self.block() if self.see("global") and self.step() else self.statement())

    def do_namespace(self) -> Node | None:
        if self.ahead().kind not in (ID, STR) or self.ahead().fresh:
            return None
        head = [self.leaf(), ("name", self.string() if self.now.kind == STR else self.callee())]
        return self.make("internal_module" if head[0].kind == "namespace" else "module", *head, ("body", self.block()) if self.see("{") else self.semicolon())

    do_module = do_namespace

    def special(self, left: Node, least: int) -> Node | None:
        if self.see("as", "satisfies") and not self.now.fresh and least < self.binary["<"]:
            kind = "as_expression" if self.see("as") else "satisfies_expression"
            return self.make(kind, left, self.leaf(), self.leaf("const") if self.see("const") else self.type())
        return super().special(left, least)

    def unary(self) -> Node:
        if self.see("<") and not self.arrow_ahead():
            return self.make("type_assertion", self.type_arguments(), self.unary())
        return super().unary()
