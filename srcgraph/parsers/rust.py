"""Rust."""

from __future__ import annotations

import re

from .core import END, ID, NUM, OP, STR, Bad, Node, Token
from .curly import Curly, levels

_PATTERN = re.compile(
    r"(?P<newline>\n)|(?P<space>[ \t\r]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<str>b?c?r(?P<fence>\#*)\".*?\"(?P=fence)|[bc]?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n\x80-\xff]|[\xc0-\xff][\x80-\xbf]+)')"
    r"|(?P<life>'[A-Za-z_]\w*)"
    r"|(?P<num>0[xX][0-9a-fA-F_]+\w*|0[bB][01_]+\w*|0[oO][0-7_]+\w*|[0-9][0-9_]*(?:\.[0-9][0-9_]*|\.(?![.A-Za-z_]))?(?:[eE][+-]?[0-9_]+)?(?:[iuf](?:8|16|32|64|128|size))?)"
    r"|(?P<id>(?:r\#)?[A-Za-z_\x80-\xff][\w\x80-\xff]*)"
    r"|(?P<op><<=|>>=|\.\.=|\.\.\.|\.\.|->|=>|::|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|.)",
    re.S | re.A,
)
_PRIMITIVES = frozenset("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())


class Rust(Curly):
    root = "source_file"
    pattern = _PATTERN
    keywords = frozenset("as async await break const continue dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return static struct trait true type unsafe use where while".split())
    binary = levels(".. ..=", "||", "&&", "== != < > <= >=", "|", "^", "&", "<< >>", "+ -", "* / %")
    assign = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
    arguments_kind = "arguments"
    plain = False  # in the head of a statement, where a brace opens its block

    def lex(self) -> None:
        super().lex()
        for t in self.tokens:
            if t.kind in ("fence",):
                t.kind = STR

    def comment_kind(self, text: str) -> str:
        return "block_comment" if text.startswith("/*") else "line_comment"

    # -- items
    def statement(self) -> object:
        if self.see(";"):
            return self.make("empty_statement", self.leaf())
        if self.see("#"):
            parts: list = [self.leaf()]
            inner = self.maybe("!")
            body = self.tree("[", "]")
            return self.make("inner_attribute_item" if inner else "attribute_item", *parts, inner, body)
        start = self.at
        visibility = self.visibility()
        item = self.item(visibility)
        if item is not None:
            return item
        self.go(start)
        if self.see("let"):
            return self.let()
        e = self.labelled() if self.now.kind == "life" else self.expression()
        if self.see(";"):
            return self.make("expression_statement", e, self.leaf())
        if e.kind in ("if_expression", "match_expression", "while_expression", "loop_expression", "for_expression", "block", "unsafe_block", "async_block") and not self.see("}"):
            return self.make("expression_statement", e)
        if e.kind == "macro_invocation" and not self.see("}"):
            return self.make("expression_statement", e)
        if not self.see("}") and self.now.kind is not END:
            raise Bad
        return e

    def expression(self, least: int = 0) -> Node:
        # a block-like expression that starts a statement ends there
        return super().expression(least)

    def visibility(self) -> Node | None:
        if not self.see("pub"):
            return None
        return self.make("visibility_modifier", self.leaf(), self.tree("(", ")").kids if self.see("(") and self.ahead().text in ("crate", "super", "self", "in") else None)

    def tree(self, opening: str, closing: str) -> Node:
        """Tokens in brackets, names as identifiers."""
        close = self.partner(self.at)
        parts: list[Node] = [self.want(opening)]
        while self.at < close and self.now.kind is not END:
            t = self.now
            if t.kind == OP and t.text in ("(", "[", "{"):
                parts.append(self.tree(t.text, {"(": ")", "[": "]", "{": "}"}[t.text]))
            else:
                parts.append(self.literal() if t.kind in (NUM, STR) else self.leaf("identifier") if t.kind == ID and t.text not in self.keywords else self.leaf())
        parts.append(self.closing(closing))
        return self.make("token_tree", parts)

    def item(self, visibility: Node | None) -> Node | None:
        t = self.now.text if self.now.kind == ID else ""
        i = self.at
        while self.tokens[i].text in ("const", "async", "unsafe", "extern", "default") and self.tokens[i + 1].kind in (ID, STR) and self.tokens[i + 1].text in ("fn", "async", "unsafe", "extern", "const", "trait", "impl") or (self.tokens[i].text == "extern" and self.tokens[i + 1].kind == STR and self.tokens[i + 2].text == "fn"):
            i += 1 + (self.tokens[i + 1].kind == STR)
        word = self.tokens[i].text
        before: list[Node] = [self.literal() if self.now.kind == STR else self.leaf() for _ in range(i - self.at)] if word in ("fn", "trait", "impl") else []
        modifiers = self.make("function_modifiers", before) if before and word == "fn" else before
        if word == "fn" and self.tokens[i + 1].kind == ID:
            parts: list = [visibility, modifiers or None, self.leaf(), ("name", self.name())]
            if self.see("<"):
                parts.append(("type_parameters", self.type_parameters()))
            parts.append(("parameters", self.listed("(", ")", self.parameter, "parameters")))
            if self.see("->"):
                parts += [self.leaf(), ("return_type", self.type())]
            parts.append(self.where())
            if self.see(";"):
                return self.make("function_signature_item", *parts, self.leaf())
            return self.make("function_item", *parts, ("body", self.block()))
        if word in ("struct", "union") and self.ahead().kind == ID and self.ahead().text not in self.keywords:
            parts = [visibility, self.leaf(), ("name", self.name("type_identifier"))]
            if self.see("<"):
                parts.append(("type_parameters", self.type_parameters()))
            parts.append(self.where())
            if self.see("("):
                parts += [("body", self.listed("(", ")", self.ordered_field, "ordered_field_declaration_list")), self.where(), self.closing(";")]
            elif self.see("{"):
                parts.append(("body", self.listed("{", "}", self.field, "field_declaration_list")))
            else:
                parts.append(self.closing(";"))
            return self.make(f"{word}_item", *parts)
        if word == "enum":
            parts = [visibility, self.leaf(), ("name", self.name("type_identifier"))]
            if self.see("<"):
                parts.append(("type_parameters", self.type_parameters()))
            return self.make("enum_item", *parts, self.where(), ("body", self.listed("{", "}", self.variant, "enum_variant_list")))
        if word == "trait":
            parts = [visibility, *before, self.leaf(), ("name", self.name("type_identifier"))]
            if self.see("<"):
                parts.append(("type_parameters", self.type_parameters()))
            if self.see(":"):
                parts.append(("bounds", self.bounds()))
            return self.make("trait_item", *parts, self.where(), ("body", self.body("declaration_list", self.statement)))
        if word == "impl" and (not before or before[-1].kind == "unsafe"):
            parts = [visibility, *before, self.leaf()]
            if self.see("<"):
                parts.append(("type_parameters", self.type_parameters()))
            parts.append(self.maybe("!"))
            first = self.type()
            if self.see("for"):
                parts += [("trait", first), self.leaf(), ("type", self.type())]
            else:
                parts.append(("type", first))
            return self.make("impl_item", *parts, self.where(), ("body", self.body("declaration_list", self.statement)))
        if t == "mod":
            return self.make("mod_item", visibility, self.leaf(), ("name", self.name()), ("body", self.body("declaration_list", self.statement)) if self.see("{") else self.closing(";"))
        if t == "type":
            parts = [visibility, self.leaf(), ("name", self.name("type_identifier"))]
            if self.see("<"):
                parts.append(("type_parameters", self.type_parameters()))
            if self.see(":"):
                parts.append(("bounds", self.bounds()))
            if self.see("="):
                parts += [self.leaf(), ("type", self.type())]
                return self.make("type_item", *parts, self.where(), self.closing(";"))
            return self.make("associated_type", *parts, self.where(), self.closing(";"))
        if t == "use":
            return self.make("use_declaration", visibility, self.leaf(), ("argument", self.use_tree()), self.closing(";"))
        if t in ("const", "static") and (self.ahead().kind == ID) and self.ahead().text not in ("move", "async") and self.ahead().text != "{":
            parts = [visibility, self.leaf(), self.make("mutable_specifier", self.leaf()) if self.see("mut") else None, ("name", self.leaf("identifier"))]
            if self.see(":"):
                parts += [self.leaf(), ("type", self.type())]
            if self.see("="):
                parts += [self.leaf(), ("value", self.expression())]
            return self.make(f"{t}_item", *parts, self.closing(";"))
        if t == "extern" and self.ahead().text == "crate":
            return self.make("extern_crate_declaration", visibility, self.leaf(), self.leaf(), ("name", self.leaf("identifier")), *([self.leaf(), self.leaf("identifier")] if self.see("as") else []), self.closing(";"))
        if t == "extern" and self.ahead().kind == STR and self.ahead(2).text == "{":
            return self.make("foreign_mod_item", self.leaf(), self.literal(), ("body", self.body("declaration_list", self.statement)))
        if t == "macro_rules" and self.ahead().text == "!":
            parts = [self.leaf(), self.leaf(), ("name", self.name())]
            return self.make("macro_definition", *parts, self.tree(self.now.text, {"(": ")", "[": "]", "{": "}"}.get(self.now.text, "}")), self.maybe(";"))
        return None

    def use_tree(self) -> Node:
        if self.see("{"):
            return self.listed("{", "}", self.use_tree, "use_list")
        if self.see("*"):
            return self.make("use_wildcard", self.leaf())
        node: Node | None = None
        if self.see("::"):
            node = None
        else:
            node = self.leaf({"self": "self", "crate": "crate", "super": "super"}.get(self.now.text, "identifier"))
        while self.see("::"):
            colons = self.leaf()
            if self.see("{"):
                return self.make("scoped_use_list", ("path", node), colons, ("list", self.use_tree()))
            if self.see("*"):
                return self.make("use_wildcard", node, colons, self.leaf())
            node = self.make("scoped_identifier", ("path", node), colons, ("name", self.leaf("identifier")))
        if self.see("as"):
            return self.make("use_as_clause", ("path", node), self.leaf(), ("alias", self.leaf("identifier")))
        if node is None:
            raise Bad
        return node

    def where(self) -> Node | None:
        if not self.see("where"):
            return None
        parts: list = [self.leaf()]
        while not self.see("{", ";") and self.now.kind is not END:
            if self.see(","):
                parts.append(self.leaf())
                continue
            parts.append(self.make("where_predicate", self.leaf("lifetime") if self.now.kind == "life" else ("left", self.type()), ("bounds", self.bounds())))
        return self.make("where_clause", *parts)

    def bounds(self) -> Node:
        parts: list = [self.want(":")]
        while True:
            if self.now.kind == "life":
                parts.append(self.leaf("lifetime"))
            elif self.see("?"):
                parts.append(self.make("removed_trait_bound", self.leaf(), self.type()))
            elif not self.see(",", "{", "=", ">", ";"):
                parts.append(self.type())
            if not self.see("+"):
                return self.make("trait_bounds", *parts)
            parts.append(self.leaf())

    def type_parameters(self) -> Node:
        end = self.generic_end(self.at)
        if end < 0:
            raise Bad
        return self.bare("type_parameters", end, "type_identifier")

    def generic_end(self, at: int) -> int:
        depth, i = 0, at
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.text == "<" and t.kind == OP:
                depth += 1
            elif t.text == ">" and t.kind == OP:
                depth -= 1
                if depth == 0:
                    return i + 1
            elif t.kind == OP and t.text in ("(", "[", "{"):
                i = self.partner(i)
            elif t.text in (";", "}", ")", "&&", "||", "==", "!=") and t.kind == OP:
                return -1
            i += 1
        return -1

    def field(self) -> Node:
        while self.see("#"):
            self.leaf()
            self.tree("[", "]")
        return self.make("field_declaration", self.visibility(), ("name", self.name("field_identifier")), self.want(":"), ("type", self.type()))

    def ordered_field(self) -> object:
        while self.see("#"):
            self.leaf()
            self.tree("[", "]")
        self.visibility()
        return ("type", self.type())

    def variant(self) -> Node:
        while self.see("#"):
            self.leaf()
            self.tree("[", "]")
        parts: list = [self.visibility(), ("name", self.name())]
        if self.see("("):
            parts.append(("body", self.listed("(", ")", self.ordered_field, "ordered_field_declaration_list")))
        elif self.see("{"):
            parts.append(("body", self.listed("{", "}", self.field, "field_declaration_list")))
        if self.see("="):
            parts += [self.leaf(), ("value", self.expression())]
        return self.make("enum_variant", *parts)

    def parameter(self) -> Node:
        while self.see("#"):
            self.leaf()
            self.tree("[", "]")
        i = self.at
        while self.tokens[i].text in ("&", "mut") or self.tokens[i].kind == "life":
            i += 1
        if self.tokens[i].text == "self" and self.tokens[i + 1].text != ":":
            parts: list = []
            while self.at < i:
                parts.append(self.leaf("lifetime") if self.now.kind == "life" else self.make("mutable_specifier", self.leaf()) if self.see("mut") else self.leaf())
            return self.make("self_parameter", *parts, self.leaf("self"))
        parts = [self.make("mutable_specifier", self.leaf()) if self.see("mut") else None]
        return self.make("parameter", *parts, ("pattern", self.pattern_()), self.want(":"), ("type", self.type()))

    # -- types
    def type(self) -> Node:
        if self.see("&", "&&"):
            if self.see("&&"):
                t = self.now
                self.step()
                return self.make("reference_type", Node("&", t.start, t.start + 1, None, False), self.reference(Node("&", t.start + 1, t.end, None, False)))
            return self.reference(self.leaf())
        if self.see("*"):
            return self.make("pointer_type", self.leaf(), self.make("mutable_specifier", self.leaf()) if self.see("mut") else self.want("const"), ("type", self.type()))
        if self.see("("):
            node = self.listed("(", ")", self.type, "tuple_type")
            if len(node.kids) == 2:
                node.kind = "unit_type"
            return node
        if self.see("["):
            parts: list = [self.leaf(), ("element", self.type())]
            if self.see(";"):
                parts += [self.leaf(), ("length", self.expression())]
            return self.make("array_type", *parts, self.closing("]"))
        if self.see("!"):
            return self.make("never_type", self.leaf())
        if self.see("_"):
            return self.leaf("_")
        if self.see("dyn", "impl"):
            kind = "dynamic_type" if self.see("dyn") else "abstract_type"
            word = self.leaf()
            return self.make(kind, word, ("trait", self.with_bounds(self.leaf("lifetime") if self.now.kind == "life" else self.type())))
        if self.see("for"):
            return self.make("higher_ranked_trait_bound", self.leaf(), self.type_parameters(), self.type())
        if self.see("fn", "unsafe", "extern"):
            parts = []
            while not self.see("fn"):
                parts.append(self.literal() if self.now.kind == STR else self.leaf())
            parts += [self.leaf(), ("parameters", self.listed("(", ")", self.fn_type_part, "parameters"))]
            if self.see("->"):
                parts += [self.leaf(), ("return_type", self.type())]
            return self.make("function_type", *parts)
        if self.see("<"):
            return self.bare("qualified_type_path", self.qualified_end(), "type_identifier")
        if self.now.kind != ID or self.now.text in self.keywords:
            raise Bad
        if self.now.text in _PRIMITIVES:
            return self.leaf("primitive_type")
        node = self.leaf({"self": "self", "crate": "crate", "super": "super"}.get(self.now.text, "type_identifier"))
        if self.see("!"):
            return self.make("macro_invocation", ("macro", node), self.leaf(), self.tree(self.now.text, {"(": ")", "[": "]", "{": "}"}.get(self.now.text, ")")))
        while True:
            if self.see("::") and self.ahead().kind == ID:
                if node.kind == "type_identifier":
                    node.kind = "identifier"
                elif node.kind == "scoped_type_identifier":
                    node.kind = "scoped_identifier"
                    node.kids[-1].kind = "identifier"
                node = self.make("scoped_type_identifier", ("path", node), self.leaf(), ("name", self.leaf("type_identifier")))
            elif self.see("<") or (self.see("::") and self.ahead().text == "<"):
                if self.see("::"):
                    self.leaf()
                node = self.make("generic_type", ("type", node), ("type_arguments", self.type_arguments()))
            elif self.see("(") and node.kind == "type_identifier" and self.text[node.start : node.end] in ("Fn", "FnMut", "FnOnce"):
                parts = [("trait", node), ("parameters", self.listed("(", ")", self.type, "parameters"))]
                if self.see("->"):
                    parts += [self.leaf(), ("return_type", self.type())]
                node = self.make("function_type", *parts)
            else:
                return node

    def with_bounds(self, first: Node) -> Node:
        if not self.see("+"):
            return first
        parts = [first]
        while self.see("+"):
            parts += [self.leaf(), self.leaf("lifetime") if self.now.kind == "life" else self.type()]
        return self.make("bounded_type", parts)

    def fn_type_part(self) -> Node:
        if self.now.kind == ID and self.ahead().text == ":" and self.ahead(2).text != ":":
            return self.make("parameter", ("pattern", self.leaf("identifier")), self.leaf(), ("type", self.type()))
        return self.type()

    def reference(self, first: Node) -> Node:
        parts: list = [first]
        if self.now.kind == "life":
            parts.append(self.leaf("lifetime"))
        if self.see("mut"):
            parts.append(self.make("mutable_specifier", self.leaf()))
        return self.make("reference_type", *parts, ("type", self.type()))

    def qualified_end(self) -> int:
        end = self.generic_end(self.at)
        if end < 0:
            raise Bad
        while self.tokens[end].text == "::" and self.tokens[end + 1].kind == ID:
            end += 2
        return end

    def type_arguments(self) -> Node:
        parts: list[Node] = [self.want("<")]
        while not self.see(">") and self.now.kind is not END:
            if self.see(","):
                parts.append(self.leaf())
            elif self.now.kind == "life":
                parts.append(self.leaf("lifetime"))
            elif self.now.kind in (NUM, STR):
                parts.append(self.literal())
            elif self.see("{"):
                parts.append(self.block())
            elif self.now.kind == ID and self.ahead().text == "=":
                parts.append(self.make("type_binding", ("name", self.leaf("type_identifier")), self.leaf(), ("type", self.type())))
            else:
                parts.append(self.type())
        parts.append(self.closing(">"))
        return self.make("type_arguments", parts)

    # -- patterns
    def pattern_(self) -> Node:
        first = self.maybe("|")
        node = self.one_pattern()
        while self.see("|"):
            node = self.make("or_pattern", first, node, self.leaf(), self.one_pattern())
            first = None
        return node

    def one_pattern(self) -> Node:
        t = self.now
        if self.see("&", "&&"):
            return self.make("reference_pattern", self.leaf(), self.make("mutable_specifier", self.leaf()) if self.see("mut") else None, self.one_pattern())
        if self.see("ref"):
            return self.make("ref_pattern", self.leaf(), self.one_pattern())
        if self.see("mut"):
            return self.make("mut_pattern", self.make("mutable_specifier", self.leaf()), self.one_pattern())
        if self.see("_"):
            return self.leaf("_")
        if self.see("(", "["):
            kind = "tuple_pattern" if self.see("(") else "slice_pattern"
            return self.listed(self.now.text, ")" if self.see("(") else "]", self.pattern_, kind)
        if self.see("..", "..="):
            return self.make("remaining_field_pattern", self.leaf(), None if self.see(",", ")", "]", "}") else self.one_pattern())
        if self.see("-") or t.kind in (NUM, STR) or self.see("true", "false"):
            node = self.make("negative_literal", self.leaf(), self.literal()) if self.see("-") else self.literal()
            return self.range_pattern(node)
        if t.kind != ID or t.text in self.keywords:
            raise Bad
        node = self.path()
        if self.see("!"):
            return self.macro(node)
        if self.see("("):
            inner = self.listed("(", ")", self.pattern_, "tuple_struct_pattern")
            return self.make("tuple_struct_pattern", ("type", node), inner.kids)
        if self.see("{"):
            inner = self.listed("{", "}", self.field_pattern, "struct_pattern")
            if node.kind == "identifier":
                node.kind = "type_identifier"
            return self.make("struct_pattern", ("type", node), inner.kids)
        if self.see("@"):
            return self.make("captured_pattern", node, self.leaf(), self.one_pattern())
        return self.range_pattern(node)

    def range_pattern(self, node: Node) -> Node:
        if self.see("..=", "..", "..."):
            return self.make("range_pattern", node, self.leaf(), None if self.see(",", ")", "]", "=>", "if", "|") else self.one_pattern())
        return node

    def field_pattern(self) -> Node:
        if self.see(".."):
            return self.make("remaining_field_pattern", self.leaf())
        if self.now.kind in (ID, NUM) and self.ahead().text == ":":
            return self.make("field_pattern", ("name", self.leaf("field_identifier")), self.leaf(), ("pattern", self.pattern_()))
        parts: list = [self.maybe("ref"), self.make("mutable_specifier", self.leaf()) if self.see("mut") else None]
        return self.make("field_pattern", *parts, ("name", self.leaf("shorthand_field_identifier")))

    # -- statements
    def let(self) -> Node:
        parts: list = [self.leaf()]
        if self.see("mut"):
            parts.append(self.make("mutable_specifier", self.leaf()))
        parts.append(("pattern", self.pattern_()))
        if self.see(":"):
            parts += [self.leaf(), ("type", self.type())]
        if self.see("="):
            parts += [self.leaf(), ("value", self.expression())]
            if self.see("else"):
                parts += [self.leaf(), ("alternative", self.block())]
        return self.make("let_declaration", *parts, self.closing(";"))

    def head(self) -> Node:
        held, self.plain = self.plain, True
        try:
            return self.chain()
        finally:
            self.plain = held

    def chain(self) -> Node:
        """A condition: expressions and let patterns joined by &&."""
        first = self.let_condition() if self.see("let") else self.expression()
        if not self.see("&&"):
            return first
        parts = [first]
        while self.see("&&"):
            parts += [self.leaf(), self.let_condition() if self.see("let") else self.expression(self.binary["&&"])]
        return self.make("let_chain", parts)

    def let_condition(self) -> Node:
        return self.make("let_condition", self.leaf(), ("pattern", self.pattern_()), self.want("="), ("value", self.expression(self.binary["&&"])))

    def block(self) -> Node:
        held, self.plain = self.plain, False
        try:
            return super().block()
        finally:
            self.plain = held

    def listed(self, opening: str, closing: str, item, kind: str, separators: tuple[str, ...] = (",",)) -> Node:
        held, self.plain = self.plain, False
        try:
            return super().listed(opening, closing, item, kind, separators)
        finally:
            self.plain = held

    def if_(self) -> Node:
        parts: list = [self.leaf(), ("condition", self.head()), ("consequence", self.block())]
        if self.see("else"):
            parts.append(("alternative", self.make("else_clause", self.leaf(), self.if_() if self.see("if") else self.block())))
        return self.make("if_expression", *parts)

    def match_(self) -> Node:
        word, value = self.leaf(), self.head()
        return self.make("match_expression", word, ("value", value), ("body", self.body("match_block", self.arm)))

    def arm(self) -> object:
        if self.see(","):
            return self.leaf()
        while self.see("#"):
            self.leaf()
            self.tree("[", "]")
        held, self.plain = self.plain, False
        inner: list = [self.pattern_()]
        if self.see("if"):
            inner += [self.leaf(), ("condition", self.chain())]
        parts: list = [("pattern", self.make("match_pattern", *inner)), self.want("=>"), ("value", self.expression())]
        self.plain = held
        return self.make("match_arm", *parts, self.maybe(","))

    def labelled(self) -> Node:
        label = self.make("label", self.leaf())
        colon = self.want(":")
        node = self.primary()
        node.kids[:0] = [label, colon]
        node.start = label.start
        return node

    # -- expressions
    def special(self, left: Node, least: int) -> Node | None:
        t = self.now.text
        if t == "as":
            return self.make("type_cast_expression", ("value", left), self.leaf(), ("type", self.type()))
        if t in ("..", "..=") and least < 1:
            parts: list = [left, self.leaf()]
            if not self.see(")", "]", "}", ",", ";", "=>") and not (self.see("{") and self.plain) and self.now.kind is not END:
                parts.append(self.expression(1))
            return self.make("range_expression", *parts)
        if t == ">" and self.ahead().text in (">", ">=") and self.now.end == self.ahead().start:
            if self.ahead().text == ">=":
                o = Node(">>=", self.now.start, self.ahead().end, None, False)
                self.step()
                self.step()
                return self.make("compound_assignment_expr", ("left", left), ("operator", o), ("right", self.expression()))
            if least < self.binary[">>"]:
                o = Node(">>", self.now.start, self.ahead().end, None, False)
                self.step()
                self.step()
                return self.make("binary_expression", ("left", left), ("operator", o), ("right", self.expression(self.binary[">>"])))
        return None

    def blocked(self, op: str) -> bool:
        return op in ("..", "..=")

    def assignment(self, op: str) -> str:
        return "assignment_expression" if op == "=" else "compound_assignment_expr"

    def unary(self) -> Node:
        if self.see("&", "&&"):
            o = self.leaf()
            parts: list = [o]
            if self.see("raw") and self.ahead().text in ("mut", "const"):
                parts += [self.leaf(), self.leaf()]
            elif self.see("mut"):
                parts.append(self.make("mutable_specifier", self.leaf()))
            return self.make("reference_expression", *parts, ("value", self.unary()))
        if self.see("-", "!", "*"):
            return self.make("unary_expression", self.leaf(), self.unary())
        if self.see("..", "..="):
            parts = [self.leaf()]
            if not self.see(")", "]", "}", ",", ";"):
                parts.append(self.expression(1))
            return self.make("range_expression", *parts)
        return self.postfix(self.primary())

    def literal(self) -> Node:
        t = self.now
        if t.kind == NUM:
            return self.leaf("float_literal" if re.search(r"\.|f32|f64|[0-9]e", t.text) and not t.text.startswith("0x") else "integer_literal")
        if t.kind == STR:
            return self.leaf("char_literal" if t.text.lstrip("b").startswith("'") else "raw_string_literal" if re.match(r"b?c?r", t.text) else "string_literal")
        if self.see("true", "false"):
            return self.leaf("boolean_literal")
        raise Bad

    def path(self) -> Node:
        if self.see("<"):
            return self.bare("scoped_identifier", self.qualified_end(), "identifier")
        if self.see("::"):
            node: Node | None = None
        else:
            node = self.leaf({"self": "self", "crate": "crate", "super": "super"}.get(self.now.text, "identifier"))
        while self.see("::"):
            colons = self.leaf()
            if self.see("<"):
                node = self.make("generic_function", ("function", node), colons, ("type_arguments", self.type_arguments()))
            else:
                node = self.make("scoped_identifier", ("path", node), colons, ("name", self.leaf("identifier")))
        if node is None:
            raise Bad
        return node

    def macro(self, name: Node) -> Node:
        bang = self.leaf()
        if not self.see("(", "[", "{"):
            raise Bad
        return self.make("macro_invocation", ("macro", name), bang, self.tree(self.now.text, {"(": ")", "[": "]", "{": "}"}[self.now.text]))

    def closure(self) -> Node:
        parts: list = []
        while self.see("static", "async", "move"):
            parts.append(self.leaf())
        if self.see("||"):
            parts.append(("parameters", self.make("closure_parameters", self.leaf())))
        else:
            inner: list[Node] = [self.want("|")]
            while not self.see("|") and self.now.kind is not END:
                if self.see(","):
                    inner.append(self.leaf())
                    continue
                p = self.one_pattern()
                inner.append(self.make("parameter", ("pattern", p), self.leaf(), ("type", self.type())) if self.see(":") else p)
            inner.append(self.closing("|"))
            parts.append(("parameters", self.make("closure_parameters", inner)))
        if self.see("->"):
            parts += [self.leaf(), ("return_type", self.type())]
        return self.make("closure_expression", *parts, ("body", self.expression()))

    def primary(self) -> Node:
        t = self.now
        if t.kind in (NUM, STR) or self.see("true", "false"):
            return self.literal()
        if self.see("("):
            node = self.listed("(", ")", self.expression, "tuple_expression")
            named = [k for k in node.kids if k.named]
            if not named:
                node.kind = "unit_expression"
            elif len(named) == 1 and not any(k.kind == "," for k in node.kids):
                node.kind = "parenthesized_expression"
            return node
        if self.see("["):
            return self.listed("[", "]", self.expression, "array_expression", (",", ";"))
        if self.see("{"):
            return self.block()
        if self.see("|", "||") or (self.see("move", "static") and self.ahead().text in ("|", "||")) or (self.see("async") and self.ahead().text in ("|", "move") and self.ahead(2).text != "{"):
            return self.closure()
        if self.see("<", "::"):
            return self.path()
        if t.kind == "life":
            return self.labelled()
        if t.kind != ID:
            raise Bad
        w = t.text
        if w == "if":
            return self.if_()
        if w == "match":
            return self.match_()
        if w == "while":
            return self.make("while_expression", self.leaf(), ("condition", self.head()), ("body", self.block()))
        if w == "loop":
            return self.make("loop_expression", self.leaf(), ("body", self.block()))
        if w == "for":
            parts: list = [self.leaf(), ("pattern", self.pattern_()), self.want("in"), ("value", self.head())]
            return self.make("for_expression", *parts, ("body", self.block()))
        if w in ("unsafe", "async", "const") and (self.ahead().text == "{" or self.ahead(2).text == "{"):
            parts = [self.leaf(), self.maybe("move")]
            return self.make(f"{w}_block", *parts, self.block())
        if w in ("return", "break", "continue"):
            parts = [self.leaf()]
            if self.now.kind == "life":
                parts.append(self.make("label", self.leaf()))
            if w != "continue" and not self.see(";", "}", ")", "]", ",", "=>") and not (self.see("{") and self.plain) and self.now.kind is not END:
                parts.append(self.expression())
            return self.make(f"{w}_expression", *parts)
        if w == "let":
            return self.let_condition()
        if w in self.keywords:
            raise Bad
        node = self.path()
        if self.see("!") and self.ahead().text in ("(", "[", "{"):
            return self.macro(node)
        if self.see("{") and not self.plain and node.kind in ("identifier", "scoped_identifier", "generic_function") and self.struct_ahead(node):
            if node.kind == "identifier":
                node.kind = "type_identifier"
            return self.make("struct_expression", ("name", node), ("body", self.listed("{", "}", self.field_value, "field_initializer_list")))
        return node

    def struct_ahead(self, node: Node) -> bool:
        a, b = self.ahead(), self.ahead(2)
        return a.text in ("}", "..") or (a.kind in (ID, NUM) and b.text in (":", ",", "}")) or a.text == "#"

    def field_value(self) -> Node:
        if self.see(".."):
            return self.make("base_field_initializer", self.leaf(), None if self.see("}") else self.expression())
        if self.ahead().text == ":":
            return self.make("field_initializer", ("field", self.leaf("field_identifier")), self.leaf(), ("value", self.expression()))
        return self.make("shorthand_field_initializer", self.leaf("identifier"))

    def postfix(self, left: Node) -> Node:
        while True:
            if self.see("."):
                dot = self.leaf()
                if self.see("await"):
                    left = self.make("await_expression", left, dot, self.leaf())
                    continue
                if self.now.kind not in (ID, NUM):
                    raise Bad
                field = self.leaf("field_identifier" if self.now.kind == ID else "integer_literal")
                left = self.make("field_expression", ("value", left), dot, ("field", field))
                if self.see("::"):
                    left = self.make("generic_function", ("function", left), self.leaf(), ("type_arguments", self.type_arguments()))
            elif self.see("("):
                left = self.make("call_expression", ("function", left), ("arguments", self.listed("(", ")", self.expression, "arguments")))
            elif self.see("["):
                held, self.plain = self.plain, False
                left = self.make("index_expression", left, self.leaf(), self.expression(), self.closing("]"))
                self.plain = held
            elif self.see("?"):
                left = self.make("try_expression", left, self.leaf())
            else:
                return left
