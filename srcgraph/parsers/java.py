"""Java."""

from __future__ import annotations

import re

from .core import END, ID, NUM, STR, Bad, Node
from .curly import Curly, levels

_PATTERN = re.compile(
    r"(?P<newline>\n)|(?P<space>[ \t\r\f]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<str>\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<num>0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[fFdDlL]?)"
    r"|(?P<id>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)"
    r"|(?P<op><<=|\.\.\.|->|::|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|.)",
    re.S | re.A,
)
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_PRIMITIVES = {"byte": "integral_type", "short": "integral_type", "int": "integral_type", "long": "integral_type", "char": "integral_type", "float": "floating_point_type", "double": "floating_point_type", "boolean": "boolean_type", "void": "void_type"}
_TYPES = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}


class Java(Curly):
    pattern = _PATTERN
    keywords = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
    binary = levels("||", "&&", "|", "^", "&", "== !=", "< > <= >=", "<< >> >>>", "+ -", "* / %")

    def comment_kind(self, text: str) -> str:
        return "block_comment" if text.startswith("/*") else "line_comment"

    # -- declarations
    def statement(self) -> object:
        t = self.now.text if self.now.kind == ID else self.now.text
        if t == "package":
            return self.make("package_declaration", self.leaf(), self.qualified(), self.closing(";"))
        if t == "import":
            parts = [self.leaf(), self.maybe("static"), self.qualified()]
            if self.see("."):
                parts += [self.leaf(), self.make("asterisk", self.want("*"))]
            return self.make("import_declaration", *parts, self.closing(";"))
        if t == "{":
            return self.block()
        if t == ";":
            return self.leaf()
        method = getattr(self, f"do_{t}", None) if self.now.kind == ID else None
        if method and not (t == "yield" and self.ahead().text in ("=", ".", "(")):
            return method()
        if self.word() and self.ahead().text == ":" and t not in ("default",):
            return self.make("labeled_statement", self.name(), self.leaf(), self.statement())
        start = self.at
        modifiers = self.modifiers()
        declared = self.declaration(modifiers, local=True)
        if declared is not None:
            return declared
        if modifiers is not None:
            if self.see("{"):
                return self.make("static_initializer", modifiers.kids, self.block())
            self.go(start)
        if t == "synchronized":
            return self.make("synchronized_statement", self.leaf(), self.parenthesized(), ("body", self.block()))
        return self.make("expression_statement", self.expression(), self.closing(";"))

    def modifiers(self) -> Node | None:
        parts: list[Node] = []
        while True:
            if self.see("@") and self.ahead().text != "interface":
                parts.append(self.annotation())
            elif self.now.kind == ID and (self.now.text in _MODIFIERS) and not (self.now.text == "default" and self.ahead().text in (":", "->")) and not (self.now.text == "synchronized" and self.ahead().text == "("):
                parts.append(self.leaf())
            elif self.see("non") and self.ahead().text == "-":
                parts += [self.leaf(), self.leaf(), self.leaf()]
            else:
                return self.make("modifiers", parts) if parts else None

    def annotation(self) -> Node:
        parts: list = [self.leaf(), ("name", self.qualified())]
        if self.see("("):
            return self.make("annotation", *parts, ("arguments", self.listed("(", ")", self.annotation_value, "annotation_argument_list")))
        return self.make("marker_annotation", *parts)

    def annotation_value(self) -> Node:
        if self.word() and self.ahead().text == "=":
            return self.make("element_value_pair", ("key", self.name()), self.leaf(), ("value", self.element_value()))
        return self.element_value()

    def element_value(self) -> Node:
        if self.see("{"):
            return self.listed("{", "}", self.element_value, "element_value_array_initializer")
        return self.annotation() if self.see("@") else self.expression()

    def qualified(self) -> Node:
        node = self.name()
        while self.see(".") and self.ahead().kind == ID:
            node = self.make("scoped_identifier", ("scope", node), self.leaf(), ("name", self.name()))
        return node

    def declaration(self, modifiers: Node | None, local: bool) -> Node | None:
        """A type, method, constructor, field or local variable, or None if this is something else."""
        t = self.now.text
        if t in _TYPES and self.ahead().kind == ID and (t != "record" or self.ahead(2).text in ("(", "<")):
            return self.type_declaration(t, modifiers)
        if t == "@" and self.ahead().text == "interface":
            return self.make("annotation_type_declaration", modifiers, self.leaf(), self.leaf(), ("name", self.name()), ("body", self.body("annotation_type_body", self.member)))
        start = self.at
        try:
            generics = self.type_parameters() if self.see("<") else None
            if self.word() and self.ahead().text == "(" and not local:
                return self.make("constructor_declaration", modifiers, generics and ("type_parameters", generics), ("name", self.name()), ("parameters", self.parameters()), self.throws(), ("body", self.make_constructor_body()))
            if self.word() and self.ahead().text == "{" and not local:
                return self.make("compact_constructor_declaration", modifiers, ("name", self.name()), ("body", self.block()))
            kind = self.type()
            if not self.word():
                raise Bad
            if self.ahead().text == "(" and not local:
                head = [modifiers, generics and ("type_parameters", generics), ("type", kind), ("name", self.name()), ("parameters", self.parameters()), self.dimensions(), self.throws()]
                if self.see("default"):
                    head += [self.leaf(), self.element_value()]
                return self.make("method_declaration", *head, ("body", self.block()) if self.see("{") else self.closing(";"))
            if self.ahead().text not in (";", "=", ",", "[", ":", ")"):
                raise Bad
            parts: list = [modifiers, ("type", kind), ("declarator", self.declarator())]
            while self.see(","):
                parts += [self.leaf(), ("declarator", self.declarator())]
            if not self.see(";"):
                raise Bad
            return self.make("local_variable_declaration" if local else "field_declaration", *parts, self.leaf())
        except Bad:
            self.go(start)
            return None

    def make_constructor_body(self) -> Node:
        body = self.block()
        body.kind = "constructor_body"
        return body

    def type_declaration(self, word: str, modifiers: Node | None) -> Node:
        parts: list = [modifiers, self.leaf(), ("name", self.name())]
        if self.see("<"):
            parts.append(("type_parameters", self.type_parameters()))
        if word == "record":
            parts.append(("parameters", self.parameters()))
        while self.see("extends", "implements", "permits"):
            w = self.now.text
            kind = {"extends": "superclass" if word == "class" else "extends_interfaces", "implements": "super_interfaces", "permits": "permits"}[w]
            inner: list = [self.leaf(), self.type()]
            while self.see(","):
                inner += [self.leaf(), self.type()]
            parts.append(self.make(kind, *inner))
        item = self.enum_member if word == "enum" else self.member
        parts.append(("body", self.body(f"{word if word != 'record' else 'class'}_body", item)))
        return self.make(f"{word}_declaration", *parts)

    def enum_member(self) -> object:
        if self.see(","):
            return self.leaf()
        annotated = self.modifiers()
        if self.word() and self.ahead().text in (",", ";", "}", "(", "{") and annotated is None:
            parts: list = [("name", self.name())]
            if self.see("("):
                parts.append(("arguments", self.arguments()))
            if self.see("{"):
                parts.append(("body", self.body("class_body", self.member)))
            return self.make("enum_constant", *parts)
        return self.member(annotated)

    def member(self, modifiers: Node | None = None) -> object:
        modifiers = modifiers or self.modifiers()
        if self.see("{"):
            block = self.block()
            return self.make("static_initializer", modifiers.kids, block) if modifiers else block
        declared = self.declaration(modifiers, local=False)
        if declared is None:
            raise Bad
        return declared

    def declarator(self) -> Node:
        parts: list = [("name", self.name()), self.dimensions()]
        if self.see("="):
            parts += [self.leaf(), ("value", self.initializer())]
        return self.make("variable_declarator", *parts)

    def initializer(self) -> Node:
        return self.listed("{", "}", self.initializer, "array_initializer") if self.see("{") else self.expression()

    def dimensions(self) -> Node | None:
        parts: list[Node] = []
        while self.see("[") and self.ahead().text == "]":
            parts += [self.leaf(), self.leaf()]
        return self.make("dimensions", parts) if parts else None

    def throws(self) -> Node | None:
        if not self.see("throws"):
            return None
        parts = [self.leaf(), self.type()]
        while self.see(","):
            parts += [self.leaf(), self.type()]
        return self.make("throws", parts)

    def parameters(self) -> Node:
        return self.listed("(", ")", self.parameter, "formal_parameters")

    def parameter(self) -> Node:
        modifiers = self.modifiers()
        kind = self.type()
        if self.see("..."):
            return self.make("spread_parameter", modifiers, kind, self.leaf(), self.make("variable_declarator", ("name", self.name())))
        if self.see("this"):
            return self.make("receiver_parameter", modifiers, kind, self.leaf("this"))
        return self.make("formal_parameter", modifiers, ("type", kind), ("name", self.name()), self.dimensions())

    # -- types
    def type_parameters(self) -> Node:
        end = self.generic_end(self.at)
        if end < 0:
            raise Bad
        return self.bare("type_parameters", end, "type_identifier")

    def type(self) -> Node:
        while self.see("@"):
            self.annotation()
        if self.now.kind == ID and self.now.text in _PRIMITIVES:
            node = self.leaf(_PRIMITIVES[self.now.text])
        elif self.see("?"):
            parts: list = [self.leaf()]
            if self.see("extends", "super"):
                parts += [self.leaf(), self.type()]
            return self.make("wildcard", *parts)
        else:
            node = self.name("type_identifier")
            while True:
                if self.see("<"):
                    end = self.generic_end(self.at)
                    if end < 0:
                        raise Bad
                    node = self.make("generic_type", node, self.type_arguments(end))
                elif self.see(".") and self.ahead().kind == ID and self.ahead().text not in self.keywords:
                    node = self.make("scoped_type_identifier", node, self.leaf(), self.name("type_identifier"))
                else:
                    break
        dims = self.dimensions()
        return self.make("array_type", ("element", node), ("dimensions", dims)) if dims else node

    def type_arguments(self, end: int) -> Node:
        """The arguments up to `end`, where a closing >> may be two brackets."""
        parts: list[Node] = [self.leaf()]
        while self.at < end - 1 and not self.see(">"):
            parts.append(self.leaf() if self.see(",", "&") else self.type())
        if self.see(">"):
            parts.append(self.leaf())
        return self.make("type_arguments", parts)

    # -- statements
    def do_if(self) -> Node:
        parts: list = [self.leaf(), ("condition", self.parenthesized()), ("consequence", self.statement())]
        if self.see("else"):
            parts += [self.leaf(), ("alternative", self.statement())]
        return self.make("if_statement", *parts)

    def do_while(self) -> Node:
        return self.make("while_statement", self.leaf(), ("condition", self.parenthesized()), ("body", self.statement()))

    def do_do(self) -> Node:
        return self.make("do_statement", self.leaf(), ("body", self.statement()), self.want("while"), ("condition", self.parenthesized()), self.closing(";"))

    def do_for(self) -> Node:
        head = self.leaf()
        opening = self.want("(")
        start = self.at
        try:
            modifiers = self.modifiers()
            kind, name = self.type(), self.name()
            if not self.see(":"):
                raise Bad
            return self.make("enhanced_for_statement", head, opening, modifiers, ("type", kind), ("name", name), self.leaf(), ("value", self.expression()), self.closing(")"), ("body", self.statement()))
        except Bad:
            self.go(start)
        parts: list = [head, opening]
        if self.see(";"):
            parts.append(self.leaf())
        else:
            declared = self.declaration(self.modifiers(), local=True)
            if declared is not None:
                parts.append(("init", declared))
            else:
                while not self.see(";") and self.now.kind is not END:
                    parts.append(self.leaf() if self.see(",") else ("init", self.expression()))
                parts.append(self.closing(";"))
        if not self.see(";"):
            parts.append(("condition", self.expression()))
        parts.append(self.closing(";"))
        while not self.see(")") and self.now.kind is not END:
            parts.append(self.leaf() if self.see(",") else ("update", self.expression()))
        return self.make("for_statement", *parts, self.closing(")"), ("body", self.statement()))

    def do_switch(self) -> Node:
        return self.make("switch_expression", self.leaf(), ("condition", self.parenthesized()), ("body", self.body("switch_block", self.switch_part)))

    def switch_part(self) -> Node:
        labels = [self.label()]
        if self.see("->"):
            arrow = self.leaf()
            if self.see("{"):
                body = self.block()
            elif self.see("throw"):
                body = self.do_throw()
            else:
                body = self.make("expression_statement", self.expression(), self.closing(";"))
            return self.make("switch_rule", labels, arrow, body)
        parts: list[Node] = [labels[0], self.want(":")]
        while self.see("case", "default"):
            parts += [self.label(), self.want(":")]
        while not self.see("case", "default", "}") and self.now.kind is not END:
            self.guarded(self.statement, parts, (";", "}"))
        return self.make("switch_block_statement_group", parts)

    def label(self) -> Node:
        if self.see("default"):
            return self.make("switch_label", self.leaf())
        parts: list = [self.want("case")]
        while not self.see(":", "->") and self.now.kind is not END:
            if self.see(","):
                parts.append(self.leaf())
                continue
            start = self.at
            try:
                kind = self.type()
                name = self.name()
                parts.append(self.make("type_pattern", kind, name))
                continue
            except Bad:
                self.go(start)
            self.arrows = False
            try:
                parts.append(self.leaf() if self.see("default") else self.expression())
            finally:
                self.arrows = True
        return self.make("switch_label", *parts)

    def do_try(self) -> Node:
        parts: list = [self.leaf()]
        kind = "try_statement"
        if self.see("("):
            kind = "try_with_resources_statement"
            parts.append(("resources", self.listed("(", ")", self.resource, "resource_specification", (";",))))
        parts.append(("body", self.block()))
        while self.see("catch"):
            inner = [self.leaf(), self.want("("), self.catch_parameter(), self.closing(")"), ("body", self.block())]
            parts.append(self.make("catch_clause", *inner))
        if self.see("finally"):
            parts.append(self.make("finally_clause", self.leaf(), self.block()))
        return self.make(kind, *parts)

    def resource(self) -> Node:
        if self.word() and self.ahead().text in (")", ";", "."):
            return self.make("resource", self.expression())
        modifiers = self.modifiers()
        return self.make("resource", modifiers, ("type", self.type()), ("name", self.name()), self.want("="), ("value", self.expression()))

    def catch_parameter(self) -> Node:
        modifiers = self.modifiers()
        kinds = [self.type()]
        while self.see("|"):
            kinds += [self.leaf(), self.type()]
        return self.make("catch_formal_parameter", modifiers, self.make("catch_type", kinds), ("name", self.name()))

    def do_return(self) -> Node:
        return self.make("return_statement", self.leaf(), None if self.see(";") else self.expression(), self.closing(";"))

    def do_yield(self) -> Node:
        return self.make("yield_statement", self.leaf(), self.expression(), self.closing(";"))

    def do_throw(self) -> Node:
        return self.make("throw_statement", self.leaf(), self.expression(), self.closing(";"))

    def do_break(self) -> Node:
        return self.make("break_statement", self.leaf(), self.name() if self.word() else None, self.closing(";"))

    def do_continue(self) -> Node:
        return self.make("continue_statement", self.leaf(), self.name() if self.word() else None, self.closing(";"))

    def do_assert(self) -> Node:
        parts: list = [self.leaf(), self.expression()]
        if self.see(":"):
            parts += [self.leaf(), self.expression()]
        return self.make("assert_statement", *parts, self.closing(";"))

    # -- expressions
    def special(self, left: Node, least: int) -> Node | None:
        t = self.now.text
        if t == "?" and least <= 0:
            return self.make("ternary_expression", ("condition", left), self.leaf(), ("consequence", self.expression()), self.want(":"), ("alternative", self.expression()))
        if t == "instanceof" and least < self.binary["<"]:
            parts = [("left", left), self.leaf(), self.maybe("final"), ("right", self.type())]
            if self.word():
                parts.append(("name", self.name()))
            return self.make("instanceof_expression", *parts)
        if t == ">" and self.now.end == self.ahead().start and self.ahead().text == ">" and least < self.binary[">>"]:
            self.leaf()
            o = Node(">>", self.now.start - 1, self.now.end, None, False)
            self.leaf()
            if self.see(">") and self.now.start == o.end:
                self.leaf()
                o.kind, o.end = ">>>", o.end + 1
            return self.make("binary_expression", ("left", left), ("operator", o), ("right", self.expression(self.binary[">>"])))
        return None

    def unary(self) -> Node:
        if self.see("(") and self.cast_ahead():
            return self.make("cast_expression", self.leaf(), ("type", self.type()), self.closing(")"), ("value", self.unary()))
        return super().unary()

    def cast_ahead(self) -> bool:
        i = self.at + 1
        if self.tokens[i].kind != ID:
            return False
        close = self.partner(self.at)
        after = self.tokens[min(close + 1, len(self.tokens) - 1)]
        if self.tokens[i].text in _PRIMITIVES:
            return all(t.text in ("[", "]") for t in self.tokens[i + 1 : close])
        if not all(t.kind == ID or t.text in (".", "<", ">", ",", "[", "]", "?", "&") for t in self.tokens[i:close]):
            return False
        return (after.kind == ID and after.text not in ("instanceof",)) or after.kind in (NUM, STR) or after.text in ("(", "!", "~")

    arrows = True  # off in a case label, where an arrow ends it

    def lambda_ahead(self) -> bool:
        if not self.arrows:
            return False
        if self.word() and self.ahead().text == "->":
            return True
        return self.see("(") and self.tokens[min(self.partner(self.at) + 1, len(self.tokens) - 1)].text == "->"

    def primary(self) -> Node:
        t = self.now
        if self.lambda_ahead():
            if self.word():
                parameters = self.name()
            elif all(x.kind == ID or x.text == "," for x in self.tokens[self.at + 1 : self.partner(self.at)]) and self.ahead(2).kind != ID:
                parameters = self.listed("(", ")", self.name, "inferred_parameters")
            else:
                parameters = self.parameters()
            return self.make("lambda_expression", ("parameters", parameters), self.leaf(), ("body", self.block() if self.see("{") else self.expression()))
        if t.kind == NUM:
            text = t.text.lower()
            if text.startswith("0x"):
                return self.leaf("hex_integer_literal")
            if text.startswith("0b"):
                return self.leaf("binary_integer_literal")
            return self.leaf("decimal_floating_point_literal" if re.search(r"[.efd]", text) else "decimal_integer_literal")
        if t.kind == STR:
            return self.leaf("character_literal" if t.text[0] == "'" else "string_literal")
        if self.see("("):
            return self.parenthesized()
        if t.text == "new":
            return self.creation()
        if t.text == "switch":
            return self.do_switch()
        if t.text in ("this", "super"):
            node = self.leaf(t.text)
            if self.see("("):
                return self.make("explicit_constructor_invocation", ("constructor", node), ("arguments", self.arguments()))
            return node
        if t.text in ("true", "false"):
            return self.leaf(t.text)
        if t.text == "null":
            return self.leaf("null_literal")
        if t.text in _PRIMITIVES:
            kind = self.type()
            if self.see("."):
                return self.make("class_literal", kind, self.leaf(), self.want("class"))
            return kind
        if self.word():
            if self.ahead().text == "(":
                return self.make("method_invocation", ("name", self.name()), ("arguments", self.arguments()))
            if self.ahead().text == "<":
                end = self.generic_end(self.at + 1)
                if end > 0 and self.tokens[end].text == "::":
                    return self.type()
            if self.ahead().text == "[" and self.ahead(2).text == "]":
                return self.type()
            return self.name()
        raise Bad

    def creation(self) -> Node:
        new = self.leaf()
        kind = self.creation_type()
        if self.see("["):
            parts: list = []
            while self.see("["):
                if self.ahead().text == "]":
                    parts.append(("dimensions", self.dimensions()))
                else:
                    parts.append(("dimensions", self.make("dimensions_expr", self.leaf(), self.expression(), self.closing("]"))))
            if self.see("{"):
                parts.append(("value", self.initializer()))
            return self.make("array_creation_expression", new, ("type", kind), *parts)
        parts = [new, ("type", kind), ("arguments", self.arguments())]
        if self.see("{"):
            parts.append(self.body("class_body", self.member))
        return self.make("object_creation_expression", *parts)

    def creation_type(self) -> Node:
        if self.now.text in _PRIMITIVES:
            return self.leaf(_PRIMITIVES[self.now.text])
        node = self.name("type_identifier")
        while self.see("<", "."):
            if self.see("<"):
                end = self.generic_end(self.at)
                if end < 0:
                    raise Bad
                node = self.make("generic_type", node, self.type_arguments(end))
            else:
                node = self.make("scoped_type_identifier", node, self.leaf(), self.name("type_identifier"))
        return node

    def postfix(self, left: Node) -> Node:
        while True:
            if self.see("."):
                dot = self.leaf()
                generics = None
                if self.see("<"):
                    generics = self.type_arguments(self.generic_end(self.at))
                if self.see("new"):
                    inner = self.creation()
                    left = self.make("object_creation_expression", left, dot, inner.kids)
                elif self.see("class"):
                    left = self.make("class_literal", left, dot, self.leaf())
                elif self.see("this", "super"):
                    left = self.make("field_access", ("object", left), dot, ("field", self.leaf(self.now.text)))
                elif self.ahead().text == "(":
                    left = self.make("method_invocation", ("object", left), dot, generics and ("type_arguments", generics), ("name", self.name()), ("arguments", self.arguments()))
                else:
                    left = self.make("field_access", ("object", left), dot, ("field", self.name()))
            elif self.see("["):
                left = self.make("array_access", ("array", left), self.leaf(), ("index", self.expression()), self.closing("]"))
            elif self.see("++", "--"):
                left = self.make("update_expression", left, self.leaf())
            elif self.see("::"):
                left = self.make("method_reference", left, self.leaf(), self.leaf() if self.see("new") else self.name())
            else:
                return left
