"""C#."""

from __future__ import annotations

import re

from .core import END, ID, NUM, STR, Bad, Node
from .curly import Curly, levels

_PATTERN = re.compile(
    r"(?P<newline>\n)|(?P<space>[ \t\r\f]+|\xef\xbb\xbf)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<hash>\#[^\n]*)"
    r"|(?P<str>\$*\"\"\".*?(?:\"\"\"|\Z)|(?:\$@|@\$|@)\"(?:\"\"|[^\"])*\"?|\$?\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<num>0[xX][0-9a-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:[0-9][0-9_]*(?:\.[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[fFdDmMuUlL]*)"
    r"|(?P<id>@?[A-Za-z_\x80-\xff][\w\x80-\xff]*)"
    r"|(?P<op><<=|>>=|\?\?=|=>|\?\?|\?\.|\.\.|->|::|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|.)",
    re.S | re.A,
)
_MODIFIERS = frozenset("public protected private internal static readonly const abstract virtual override sealed extern async partial unsafe volatile new ref file required".split())
_PREDEFINED = frozenset("bool byte sbyte short ushort int uint long ulong float double decimal char string object void nint nuint dynamic".split())
_TYPES = {"class": "class_declaration", "interface": "interface_declaration", "struct": "struct_declaration", "enum": "enum_declaration", "record": "record_declaration"}


class CSharp(Curly):
    root = "compilation_unit"
    pattern = _PATTERN
    keywords = frozenset("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split())
    binary = levels("??", "||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >>", "+ -", "* / %", "..")
    assign = frozenset("= += -= *= /= %= &= |= ^= <<= >>= ??=".split())
    prefix = frozenset("! - + ~ ++ -- & * ^ ..".split())

    def lex(self) -> None:
        super().lex()
        self.tokens = [t for t in self.tokens if t.kind != "hash"]
        pairs = []
        for i, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in ("(", "[", "{"):
                pairs.append(i)
            elif t.kind == "op" and t.text in (")", "]", "}") and pairs:
                self.tokens[pairs.pop()].part = i

    # -- declarations
    def statement(self) -> object:
        t = self.now.text
        if t == "{":
            return self.block()
        if t == ";":
            return self.make("empty_statement", self.leaf())
        if t == "using" and self.ahead().text != "(" and not self.using_declares():
            parts: list = [self.leaf(), self.maybe("static")]
            if self.word() and self.ahead().text == "=":
                parts += [("name", self.name()), self.leaf()]
            return self.make("using_directive", *parts, self.type_or_name(), self.closing(";"))
        if t == "global" and self.ahead().text == "using":
            first = self.leaf()
            node = self.statement()
            return self.make("using_directive", first, node.kids)
        if t == "namespace":
            head = [self.leaf(), ("name", self.qualified())]
            if self.see(";"):
                return self.make("file_scoped_namespace_declaration", *head, self.leaf())
            return self.make("namespace_declaration", *head, ("body", self.body("declaration_list", self.statement)))
        method = getattr(self, f"do_{t}", None) if self.now.kind == ID else None
        if method and not (t in ("yield", "using", "fixed", "lock") and self.ahead().text in ("=", ".")):
            return method()
        if self.word() and self.ahead().text == ":" and self.ahead(2).text != ":":
            return self.make("labeled_statement", self.name(), self.leaf(), self.statement())
        start = self.at
        try:
            declared = self.declaration(local=True)
        except Bad:
            declared = None
        if declared is not None:
            return declared
        self.go(start)
        return self.make("expression_statement", self.expression(), self.closing(";"))

    def using_declares(self) -> bool:
        """using var x = ..., using Type x = ..."""
        i = self.at + 1
        return self.tokens[i].kind == ID and self.tokens[i + 1].kind == ID and self.tokens[i].text != "static"

    def qualified(self) -> Node:
        node = self.name()
        while self.see(".", "::") and self.ahead().kind == ID:
            node = self.make("qualified_name", ("qualifier", node), self.leaf(), ("name", self.name()))
        return node

    def type_or_name(self) -> Node:
        return self.type()

    def modifiers(self) -> list[Node]:
        parts: list[Node] = []
        while True:
            if self.see("[") and self.tokens[min(self.partner(self.at) + 1, len(self.tokens) - 1)].text not in (";", ".", ")"):
                parts.append(self.listed("[", "]", self.attribute, "attribute_list"))
            elif self.now.kind == ID and self.now.text in _MODIFIERS and not (self.now.text in ("partial", "async", "file", "required") and self.ahead().kind != ID):
                parts.append(self.make("modifier", self.leaf()))
            else:
                return parts

    def attribute(self) -> Node:
        if self.word() and self.ahead().text == ":":
            return self.make("attribute_target_specifier", self.name(), self.leaf())
        parts: list = [("name", self.qualified())]
        if self.see("("):
            parts.append(self.listed("(", ")", self.argument, "attribute_argument_list"))
        return self.make("attribute", *parts)

    def declaration(self, local: bool, owner: str = "") -> Node | None:
        modifiers = self.modifiers()
        t = self.now.text
        if t in _TYPES and self.ahead().kind == ID:
            return self.type_declaration(modifiers, t)
        if t == "delegate" and not (local and self.ahead().text in ("{", "(")):
            parts = [*modifiers, self.leaf(), ("type", self.type()), ("name", self.name())]
            if self.see("<"):
                parts.append(("type_parameters", self.type_parameters()))
            return self.make("delegate_declaration", *parts, ("parameters", self.parameters()), *self.constraints(), self.closing(";"))
        if t == "event":
            word = self.leaf()
            kind = self.type()
            if self.ahead().text == "{":
                return self.make("event_declaration", *modifiers, word, ("type", kind), ("name", self.name()), ("accessors", self.body("accessor_list", self.accessor)))
            return self.make("event_field_declaration", *modifiers, word, self.variables(kind), self.closing(";"))
        if t == "~" and not local:
            return self.make("destructor_declaration", *modifiers, self.leaf(), ("name", self.name()), ("parameters", self.parameters()), *self.method_body())
        if not local and self.word() and self.ahead().text == "(":
            parts = [*modifiers, ("name", self.name()), ("parameters", self.parameters())]
            if self.see(":"):
                parts.append(self.make("constructor_initializer", self.leaf(), self.leaf(), self.arguments()))
            return self.make("constructor_declaration", *parts, *self.method_body())
        if t in ("implicit", "explicit") and not local:
            parts = [*modifiers, self.leaf(), self.leaf(), ("type", self.type()), ("parameters", self.parameters())]
            return self.make("conversion_operator_declaration", *parts, *self.method_body())
        kind = self.type()
        if self.see("operator") and not local:
            parts = [*modifiers, ("type", kind), self.leaf(), self.leaf()]
            while not self.see("("):
                parts.append(self.leaf())
            return self.make("operator_declaration", *parts, ("parameters", self.parameters()), *self.method_body())
        if self.see("this") and not local:
            parts = [*modifiers, ("type", kind), self.leaf(), ("parameters", self.listed("[", "]", self.parameter, "bracketed_parameter_list"))]
            return self.make("indexer_declaration", *parts, *self.property_body())
        if not self.word():
            raise Bad
        after = self.ahead()
        if not local and after.text == "." and not modifiers:  # an explicit interface's member
            while self.ahead().text in (".", "<"):
                self.step() if self.ahead().text == "." else self.go(self.generic_end(self.at + 1) - 1)
                self.step()
            after = self.ahead()
        if after.text == "(" or (after.text == "<" and self.generic_end(self.at + 1) > 0 and self.tokens[self.generic_end(self.at + 1)].text == "("):
            name = self.name()
            generics = self.type_parameters() if self.see("<") else None
            if local:
                close = self.tokens[min(self.partner(self.at) + 1, len(self.tokens) - 1)]
                if close.text not in ("{", "=>", "where"):
                    raise Bad
            parts = [*modifiers, ("type" if local else "returns", kind), ("name", name), generics and ("type_parameters", generics), ("parameters", self.parameters()), *self.constraints()]
            return self.make("local_function_statement" if local else "method_declaration", *parts, *self.method_body())
        if not local and after.text in ("{", "=>"):
            return self.make("property_declaration", *modifiers, ("type", kind), ("name", self.name()), *self.property_body())
        if after.text not in (";", "=", ",", "["):
            raise Bad
        variables = self.variables(kind)
        if not self.see(";"):
            raise Bad
        return self.make("local_declaration_statement" if local else "field_declaration", *modifiers, variables, self.leaf())

    def variables(self, kind: Node) -> Node:
        parts: list = [("type", kind), self.declarator()]
        while self.see(","):
            parts += [self.leaf(), self.declarator()]
        return self.make("variable_declaration", *parts)

    def declarator(self) -> Node:
        parts: list = [("name", self.name())]
        if self.see("["):
            parts.append(self.listed("[", "]", self.argument, "bracketed_argument_list"))
        if self.see("="):
            parts += [self.leaf(), self.initial()]
        return self.make("variable_declarator", *parts)

    def initial(self) -> Node:
        return self.listed("{", "}", self.initial, "initializer_expression") if self.see("{") else self.expression()

    def type_declaration(self, modifiers: list[Node], word: str) -> Node:
        parts: list = [*modifiers, self.leaf()]
        if word == "record" and self.see("class", "struct"):
            parts.append(self.leaf())
        parts.append(("name", self.name()))
        if self.see("<"):
            parts.append(("type_parameters", self.type_parameters()))
        if self.see("("):
            parts.append(self.parameters())
        if self.see(":"):
            inner: list = [self.leaf(), self.type()]
            if self.see("("):
                inner.append(self.arguments())
            while self.see(","):
                inner += [self.leaf(), self.type()]
            parts.append(self.make("base_list", *inner))
        parts += self.constraints()
        if self.see(";"):
            return self.make(_TYPES[word], *parts, self.leaf())
        if word == "enum":
            parts.append(("body", self.listed("{", "}", self.enum_member, "enum_member_declaration_list")))
        else:
            parts.append(("body", self.body("declaration_list", lambda: self.declaration(local=False))))
        return self.make(_TYPES[word], *parts, self.maybe(";"))

    def enum_member(self) -> Node:
        parts: list = [*self.modifiers(), ("name", self.name())]
        if self.see("="):
            parts += [self.leaf(), ("value", self.expression())]
        return self.make("enum_member_declaration", *parts)

    def constraints(self) -> list[Node]:
        out = []
        while self.see("where"):
            parts: list = [self.leaf(), self.name(), self.want(":")]
            while not self.see("{", "where", ";", "=>") and self.now.kind is not END:
                parts.append(self.leaf() if self.see(",", "(", ")", "new", "class", "struct", "?") else self.type())
            out.append(self.make("type_parameter_constraints_clause", *parts))
        return out

    def method_body(self) -> list:
        if self.see("{"):
            return [("body", self.block())]
        if self.see("=>"):
            return [("body", self.make("arrow_expression_clause", self.leaf(), self.expression())), self.closing(";")]
        return [self.closing(";")]

    def property_body(self) -> list:
        if self.see("=>"):
            return self.method_body()
        parts: list = [("accessors", self.body("accessor_list", self.accessor))]
        if self.see("="):
            parts += [self.leaf(), ("value", self.initial()), self.closing(";")]
        return parts

    def accessor(self) -> Node:
        return self.make("accessor_declaration", *self.modifiers(), ("name", self.leaf()), *self.method_body())

    def parameters(self) -> Node:
        return self.listed("(", ")", self.parameter, "parameter_list")

    def parameter(self) -> Node:
        parts: list = self.modifiers()
        while self.see("params", "out", "in", "this", "ref", "scoped"):
            parts.append(self.make("modifier", self.leaf()))
        parts += [("type", self.type()), ("name", self.name())]
        if self.see("="):
            parts += [self.leaf(), self.expression()]
        return self.make("parameter", *parts)

    # -- types
    def type_parameters(self) -> Node:
        end = self.generic_end(self.at)
        if end < 0:
            raise Bad
        return self.bare("type_parameter_list", end, "identifier")

    def type(self) -> Node:
        if self.see("("):
            node = self.listed("(", ")", self.tuple_part, "tuple_type")
        elif self.now.kind == ID and self.now.text in _PREDEFINED:
            node = self.leaf("predefined_type")
        elif self.see("ref"):
            return self.make("ref_type", self.leaf(), ("type", self.type()))
        elif self.see("var") and self.ahead().kind == ID:
            node = self.leaf("implicit_type")
        else:
            node = self.name()
            while True:
                if self.see("<"):
                    end = self.generic_end(self.at)
                    if end < 0:
                        break
                    node = self.make("generic_name", node, self.type_arguments(end))
                elif self.see(".", "::") and self.ahead().kind == ID and self.ahead().text not in self.keywords:
                    node = self.make("qualified_name", ("qualifier", node), self.leaf(), ("name", self.name()))
                else:
                    break
        while True:
            if self.see("?") and self.ahead().text not in ("(",) and (self.ahead().kind == ID or self.ahead().text in (")", ">", ",", "[", "]", "{", ";")) and not self.ternary_ahead():
                node = self.make("nullable_type", ("type", node), self.leaf())
            elif self.see("[") and all(t.text == "," for t in self.tokens[self.at + 1 : self.partner(self.at)]):
                node = self.make("array_type", ("type", node), ("rank", self.make("array_rank_specifier", self.leaf(), [self.leaf() for _ in range(self.partner(self.at - 1) - self.at)], self.closing("]"))))
            elif self.see("*"):
                node = self.make("pointer_type", ("type", node), self.leaf())
            else:
                return node

    def ternary_ahead(self) -> bool:
        """Is the ? here that of a conditional: a ':' follows before the statement ends?"""
        if self.ahead().kind == ID and self.ahead(2).text in ("=", ";", ",", ")", "{", "=>", "("):
            return False
        i = self.at + 1
        while i < len(self.tokens) and self.tokens[i].text not in (";", "{", "}", ")", ",", "=", ">"):
            if self.tokens[i].text == ":":
                return True
            i = self.partner(i) + 1 if self.tokens[i].text in ("(", "[") else i + 1
        return False

    def tuple_part(self) -> Node:
        return self.make("tuple_element", ("type", self.type()), ("name", self.name()) if self.word() else None)

    def type_arguments(self, end: int) -> Node:
        parts: list[Node] = [self.leaf()]
        while self.at < end - 1 and not self.see(">"):
            parts.append(self.leaf() if self.see(",") else self.type())
        if self.see(">"):
            parts.append(self.leaf())
        return self.make("type_argument_list", parts)

    # -- statements
    def condition(self) -> list:
        return [self.want("("), ("condition", self.expression()), self.closing(")")]

    def do_if(self) -> Node:
        parts: list = [self.leaf(), *self.condition(), ("consequence", self.statement())]
        if self.see("else"):
            parts += [self.leaf(), ("alternative", self.statement())]
        return self.make("if_statement", *parts)

    def do_while(self) -> Node:
        return self.make("while_statement", self.leaf(), *self.condition(), ("body", self.statement()))

    def do_do(self) -> Node:
        return self.make("do_statement", self.leaf(), ("body", self.statement()), self.want("while"), *self.condition(), self.closing(";"))

    def do_for(self) -> Node:
        parts: list = [self.leaf(), self.want("(")]
        if not self.see(";"):
            start = self.at
            try:
                kind = self.type()
                if not self.word():
                    raise Bad
                parts.append(("initializer", self.variables(kind)))
            except Bad:
                self.go(start)
                while not self.see(";") and self.now.kind is not END:
                    parts.append(self.leaf() if self.see(",") else ("initializer", self.expression()))
        parts.append(self.closing(";"))
        if not self.see(";"):
            parts.append(("condition", self.expression()))
        parts.append(self.closing(";"))
        while not self.see(")") and self.now.kind is not END:
            parts.append(self.leaf() if self.see(",") else ("update", self.expression()))
        return self.make("for_statement", *parts, self.closing(")"), ("body", self.statement()))

    def do_foreach(self) -> Node:
        parts: list = [self.leaf(), self.want("(")]
        if self.see("var") and self.ahead().text == "(":
            parts.append(("left", self.make("declaration_expression", self.leaf(), self.listed("(", ")", self.name, "parenthesized_variable_designation"))))
        else:
            parts += [("type", self.type()), ("left", self.name())]
        return self.make("foreach_statement", *parts, self.want("in"), ("right", self.expression()), self.closing(")"), ("body", self.statement()))

    def do_await(self) -> Node:
        if self.ahead().text == "foreach":
            first = self.leaf()
            return self.make("foreach_statement", first, self.do_foreach().kids)
        if self.ahead().text == "using":
            self.step()
            return self.statement()
        return self.make("expression_statement", self.expression(), self.closing(";"))

    def do_switch(self) -> Node:
        return self.make("switch_statement", self.leaf(), self.want("("), ("value", self.expression()), self.closing(")"), ("body", self.body("switch_body", self.section)))

    def section(self) -> Node:
        parts: list[Node] = []
        while self.see("case", "default"):
            if self.see("default"):
                parts += [self.leaf(), self.want(":")]
                continue
            parts += [self.leaf(), self.make("constant_pattern", self.pattern_())]
            if self.see("when"):
                parts.append(self.make("when_clause", self.leaf(), self.expression()))
            parts.append(self.want(":"))
        if not parts:
            raise Bad
        while not self.see("case", "default", "}") and self.now.kind is not END:
            self.guarded(self.statement, parts, (";", "}"))
        return self.make("switch_section", parts)

    arrows = True  # off in a pattern, where an arrow ends it

    def pattern_(self) -> Node:
        self.arrows = False
        try:
            return self.one_pattern()
        finally:
            self.arrows = True

    def one_pattern(self) -> Node:
        start = self.at
        try:
            kind = self.type()
            if self.word() and not self.see("when", "and", "or"):
                return self.make("declaration_pattern", ("type", kind), ("name", self.name()))
        except Bad:
            pass
        self.go(start)
        if self.see("{"):
            return self.skip((":", "=>", ";")) and self.make("recursive_pattern")
        if self.see("<", ">", "<=", ">="):
            return self.make("relational_pattern", self.leaf(), self.expression(self.binary["<"]))
        if self.see("not"):
            return self.make("negated_pattern", self.leaf(), self.pattern_())
        return self.expression()

    def do_try(self) -> Node:
        parts: list = [self.leaf(), ("body", self.block())]
        while self.see("catch"):
            inner: list = [self.leaf()]
            if self.see("("):
                inner.append(self.make("catch_declaration", self.leaf(), ("type", self.type()), ("name", self.name()) if self.word() else None, self.closing(")")))
            if self.see("when"):
                inner.append(self.make("catch_filter_clause", self.leaf(), self.want("("), self.expression(), self.closing(")")))
            parts.append(self.make("catch_clause", *inner, ("body", self.block())))
        if self.see("finally"):
            parts.append(self.make("finally_clause", self.leaf(), self.block()))
        return self.make("try_statement", *parts)

    def do_using(self) -> Node:
        parts: list = [self.leaf()]
        if not self.see("("):
            return self.make("local_declaration_statement", *parts, self.variables(self.type()), self.closing(";"))
        parts.append(self.leaf())
        start = self.at
        try:
            kind = self.type()
            if not self.word():
                raise Bad
            parts.append(self.variables(kind))
        except Bad:
            self.go(start)
            parts.append(self.expression())
        return self.make("using_statement", *parts, self.closing(")"), ("body", self.statement()))

    def do_lock(self) -> Node:
        return self.make("lock_statement", self.leaf(), self.want("("), self.expression(), self.closing(")"), self.statement())

    def do_return(self) -> Node:
        return self.make("return_statement", self.leaf(), None if self.see(";") else self.expression(), self.closing(";"))

    def do_yield(self) -> Node:
        return self.make("yield_statement", self.leaf(), self.leaf(), None if self.see(";") else self.expression(), self.closing(";"))

    def do_throw(self) -> Node:
        return self.make("throw_statement", self.leaf(), None if self.see(";") else self.expression(), self.closing(";"))

    def do_break(self) -> Node:
        return self.make("break_statement", self.leaf(), self.closing(";"))

    def do_continue(self) -> Node:
        return self.make("continue_statement", self.leaf(), self.closing(";"))

    def do_goto(self) -> Node:
        return self.make("goto_statement", self.leaf(), self.maybe("case", "default"), None if self.see(";") else self.expression(), self.closing(";"))

    # -- expressions
    def special(self, left: Node, least: int) -> Node | None:
        t = self.now.text
        if t == "?" and least <= 0:
            return self.make("conditional_expression", ("condition", left), self.leaf(), ("consequence", self.expression()), self.want(":"), ("alternative", self.expression()))
        if t == "is" and least < self.binary["<"]:
            parts: list = [("expression", left), self.leaf(), ("pattern", self.pattern_())]
            while self.see("and", "or"):
                parts += [self.leaf(), self.pattern_()]
            return self.make("is_pattern_expression", *parts)
        if t == "as" and least < self.binary["<"]:
            return self.make("as_expression", ("left", left), ("operator", self.leaf()), ("right", self.type()))
        if t == "switch" and self.ahead().text == "{":
            return self.make("switch_expression", left, self.leaf(), self.listed("{", "}", self.arm, "switch_expression_body"))
        if t == "with" and self.ahead().text == "{":
            return self.make("with_expression", left, self.leaf(), self.listed("{", "}", self.expression, "with_body"))
        if t == ">" and self.now.end == self.ahead().start and self.ahead().text == ">" and least < self.binary[">>"]:
            o = Node(">>", self.now.start, self.ahead().end, None, False)
            self.step()
            self.step()
            return self.make("binary_expression", ("left", left), ("operator", o), ("right", self.expression(self.binary[">>"])))
        return None

    def arm(self) -> Node:
        parts: list = [self.pattern_()]
        while self.see("and", "or"):
            parts += [self.leaf(), self.pattern_()]
        if self.see("when"):
            parts.append(self.make("when_clause", self.leaf(), self.expression()))
        return self.make("switch_expression_arm", *parts, self.want("=>"), self.expression())

    def argument(self) -> Node:
        parts: list = []
        if self.word() and self.ahead().text == ":" and self.ahead(2).text != ":":
            parts += [("name", self.name()), self.leaf()]
        if self.see("ref", "out", "in"):
            parts.append(self.leaf())
            if self.now.kind == ID and self.ahead().kind == ID:
                return self.make("argument", *parts, self.make("declaration_expression", ("type", self.type()), ("name", self.name())))
        return self.make("argument", *parts, self.expression())

    def lambda_ahead(self) -> bool:
        if not self.arrows:
            return False
        i = self.at + (1 if self.see("async", "static") else 0)
        t = self.tokens[i]
        if t.kind == ID and t.text not in self.keywords and self.tokens[i + 1].text == "=>":
            return True
        return t.text == "(" and self.tokens[min(self.partner(i) + 1, len(self.tokens) - 1)].text == "=>"

    def unary(self) -> Node:
        if self.see("await") and (self.ahead().kind == ID or self.ahead().text == "("):
            return self.make("await_expression", self.leaf(), self.unary())
        if self.see("throw"):
            return self.make("throw_expression", self.leaf(), self.expression())
        if self.see("(") and self.cast_ahead():
            return self.make("cast_expression", self.leaf(), ("type", self.type()), self.closing(")"), ("value", self.unary()))
        if self.now.kind == "op" and self.now.text in self.prefix:
            return self.make("prefix_unary_expression", self.leaf(), self.unary())
        return self.postfix(self.primary())

    def cast_ahead(self) -> bool:
        i, close = self.at + 1, self.partner(self.at)
        if self.tokens[i].kind != ID or self.lambda_ahead():
            return False
        after = self.tokens[min(close + 1, len(self.tokens) - 1)]
        if self.tokens[i].text in _PREDEFINED:
            return all(t.text in ("[", "]", "?", "*") for t in self.tokens[i + 1 : close])
        if not all(t.kind == ID or t.text in (".", "<", ">", ",", "[", "]", "?") for t in self.tokens[i:close]):
            return False
        return (after.kind == ID and after.text not in ("is", "as", "switch", "with", "and", "or", "in", "when")) or after.kind in (NUM, STR) or after.text in ("(", "!", "~")

    def primary(self) -> Node:
        t = self.now
        if self.lambda_ahead():
            parts: list = [self.maybe("async", "static")]
            if self.word():
                parts.append(("parameters", self.make("implicit_parameter", self.name())))
            else:
                parts.append(("parameters", self.listed("(", ")", self.lambda_parameter, "parameter_list")))
            return self.make("lambda_expression", *parts, self.want("=>"), ("body", self.block() if self.see("{") else self.expression()))
        if t.kind == NUM:
            return self.leaf("real_literal" if re.search(r"[.fFdDmM]|[eE][+-]?[0-9]", t.text) and not t.text.lower().startswith("0x") else "integer_literal")
        if t.kind == STR:
            if t.text.startswith("'"):
                return self.leaf("character_literal")
            if t.text.startswith(("$", "@$")):
                return self.interpolated()
            return self.leaf("verbatim_string_literal" if t.text.startswith("@") else "raw_string_literal" if t.text.startswith('"""') else "string_literal")
        if self.see("("):
            inner = self.listed("(", ")", self.argument, "tuple_expression")
            if sum(k.kind == "argument" for k in inner.kids) == 1:
                only = next(k for k in inner.kids if k.kind == "argument")
                inner.kind = "parenthesized_expression"
                i = inner.kids.index(only)
                inner.kids[i : i + 1] = only.kids
            return inner
        if self.see("["):
            return self.listed("[", "]", self.expression, "collection_expression")
        if t.text == "new":
            return self.creation()
        if t.text in ("this", "base"):
            return self.leaf(t.text)
        if t.text in ("true", "false"):
            return self.leaf("boolean_literal")
        if t.text == "null":
            return self.leaf("null_literal")
        if t.text in ("typeof", "sizeof", "default") and self.ahead().text == "(":
            return self.make(f"{t.text}_expression", self.leaf(), self.leaf(), ("type", self.type()), self.closing(")"))
        if t.text == "default":
            return self.leaf("default_expression")
        if t.text in ("checked", "unchecked"):
            return self.make("checked_expression", self.leaf(), self.parenthesized())
        if t.text == "delegate":
            parts = [self.leaf()]
            if self.see("("):
                parts.append(self.parameters())
            return self.make("anonymous_method_expression", *parts, self.block())
        if t.kind == ID and t.text in _PREDEFINED:
            return self.leaf("predefined_type")
        if self.word():
            if self.ahead().text == "<":
                end = self.generic_end(self.at + 1)
                if end > 0 and self.tokens[end].text in ("(", ".", ")", ",", ";", "{", "]"):
                    return self.make("generic_name", self.name(), self.type_arguments(end))
            if self.see("var") and self.ahead().kind == ID:
                return self.make("declaration_expression", ("type", self.type()), ("name", self.name()))
            return self.name()
        raise Bad

    def lambda_parameter(self) -> Node:
        if self.word() and self.ahead().text in (",", ")"):
            return self.make("parameter", ("name", self.name()))
        return self.parameter()

    def interpolated(self) -> Node:
        """A string with holes: each hole's expression is parsed on its own."""
        t = self.step()
        node = Node("interpolated_string_expression", t.start, t.end)
        i, depth = t.text.index('"') + 1, 0
        start = i
        while i < len(t.text):
            c = t.text[i]
            if c == "{" and t.text[i : i + 2] == "{{" and depth == 0:
                i += 1
            elif c == "{":
                depth += 1
                start = i if depth == 1 else start
            elif c == "}" and depth:
                depth -= 1
                if depth == 0:
                    node.kids.append(self.hole(t.start + start, t.start + i + 1))
            i += 1
        return node

    def hole(self, start: int, end: int) -> Node:
        inner = type(self)(" " * (start + 1) + self.text[start + 1 : end - 1])
        node = Node("interpolation", start, end)
        try:
            node.kids.append(inner.expression())
        except Bad:
            pass
        return node

    def creation(self) -> Node:
        new = self.leaf()
        if self.see("("):
            parts: list = [new, ("arguments", self.arguments())]
            if self.see("{"):
                parts.append(("initializer", self.initial()))
            return self.make("implicit_object_creation_expression", *parts)
        if self.see("["):
            return self.make("implicit_array_creation_expression", new, self.leaf(), [self.leaf() for _ in range(self.partner(self.at - 1) - self.at)], self.closing("]"), self.initial())
        if self.see("{"):
            return self.make("anonymous_object_creation_expression", new, self.initial().kids)
        start = self.at
        kind = self.type()
        if self.see("["):
            self.go(start)
            kind = self.creation_type()
            sizes = self.listed("[", "]", self.argument, "array_rank_specifier")
            while self.see("["):
                sizes = self.make("array_rank_specifier", sizes.kids, self.leaf(), self.closing("]"))
            return self.make("array_creation_expression", new, ("type", self.make("array_type", ("type", kind), ("rank", sizes))), self.initial() if self.see("{") else None)
        if kind.kind == "array_type":
            return self.make("array_creation_expression", new, ("type", kind), self.initial() if self.see("{") else None)
        parts = [new, ("type", kind)]
        if self.see("("):
            parts.append(("arguments", self.arguments()))
        if self.see("{"):
            parts.append(("initializer", self.initial()))
        return self.make("object_creation_expression", *parts)

    def creation_type(self) -> Node:
        if self.now.text in _PREDEFINED:
            return self.leaf("predefined_type")
        node = self.name()
        while self.see(".") or (self.see("<") and self.generic_end(self.at) > 0):
            node = self.make("qualified_name", node, self.leaf(), self.name()) if self.see(".") else self.make("generic_name", node, self.type_arguments(self.generic_end(self.at)))
        return node

    def member_name(self) -> Node:
        name = self.name()
        if self.see("<"):
            end = self.generic_end(self.at)
            if end > 0 and self.tokens[end].text in ("(", ".", ")", ",", ";", "]", "}"):
                return self.make("generic_name", name, self.type_arguments(end))
        return name

    def postfix(self, left: Node) -> Node:
        while True:
            if self.see(".", "->") and self.ahead().kind == ID:
                left = self.make("member_access_expression", ("expression", left), self.leaf(), ("name", self.member_name()))
            elif self.see("?.") or (self.see("?") and self.ahead().text == "[" and self.now.end == self.ahead().start):
                first = self.leaf()
                if first.kind == "?.":
                    inner: Node = self.make("member_binding_expression", ("name", self.member_name()))
                else:
                    inner = self.make("element_binding_expression", self.listed("[", "]", self.argument, "bracketed_argument_list"))
                left = self.make("conditional_access_expression", ("condition", left), first, self.postfix(inner))
            elif self.see("("):
                left = self.make("invocation_expression", ("function", left), ("arguments", self.arguments()))
            elif self.see("["):
                left = self.make("element_access_expression", ("expression", left), ("subscript", self.listed("[", "]", self.argument, "bracketed_argument_list")))
            elif self.see("++", "--"):
                left = self.make("postfix_unary_expression", left, self.leaf())
            elif self.see("!") and self.ahead().text in (".", ";", ")", ",", "[", "?."):
                left = self.make("postfix_unary_expression", left, self.leaf())
            else:
                return left
