"""YAML, by indentation."""

from __future__ import annotations

import re

from .core import Bad, Node, Parser

_SCALARS = (
    (re.compile(r"(?:~|null|Null|NULL)\Z"), "null_scalar"),
    (re.compile(r"(?:true|True|TRUE|false|False|FALSE)\Z"), "boolean_scalar"),
    (re.compile(r"(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)\Z"), "integer_scalar"),
    (re.compile(r"(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))\Z"), "float_scalar"),
)
_KEY = re.compile(r"(?:\"(?:\\.|[^\"\\\n])*\"|'(?:''|[^'\n])*'|[^\s#&*!|>%@`\"'{}\[\],?:-][^\n]*?|[-?:][^\s][^\n]*?)(?=[ \t]*:(?:[ \t\r\n]|\Z))")
_PROPERTY = re.compile(r"([&!][^\s,\[\]{}]*)[ \t]*")


class Yaml(Parser):
    def __init__(self, text: str):
        self.text, self.comments, self.at = text, [], 0

    # -- places
    def column(self, at: int) -> int:
        return at - (self.text.rfind("\n", 0, at) + 1)

    def skip_blank(self) -> None:
        """To the next character that is neither space nor comment."""
        text = self.text
        while self.at < len(text):
            c = text[self.at]
            if c in " \t\r\n":
                self.at += 1
            elif c == "#" and (self.at == 0 or text[self.at - 1] in " \t\n"):
                end = text.find("\n", self.at)
                end = len(text) if end < 0 else end
                if not self.comments or self.comments[-1].start < self.at:
                    self.comments.append(Node("comment", self.at, end))
                self.at = end
            else:
                return

    def spaces(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t\r":
            self.at += 1

    def mark(self) -> str:
        """--- or ... at the start of a line, else nothing."""
        three = self.text[self.at : self.at + 3]
        if three in ("---", "...") and self.column(self.at) == 0 and self.text[self.at + 3 : self.at + 4] in ("", " ", "\n", "\r", "\t"):
            return three
        return ""

    # -- documents
    def file(self) -> Node:
        documents: list[Node] = []
        while True:
            self.skip_blank()
            if self.at >= len(self.text):
                break
            start, parts = self.at, []
            while self.text[self.at : self.at + 1] == "%":
                end = self.text.find("\n", self.at)
                end = len(self.text) if end < 0 else end
                parts.append(Node("reserved_directive", self.at, end))
                self.at = end
                self.skip_blank()
            if self.mark() == "---":
                parts.append(Node("---", self.at, self.at + 3, None, False))
                self.at += 3
                self.skip_blank()
            while self.at < len(self.text) and not self.mark():
                before = self.at
                try:
                    node = self.node(-1)
                    if node is not None:
                        parts.append(node)
                except (Bad, RecursionError):
                    self.at = before
                if self.at == before:
                    end = self.text.find("\n", before)
                    end = len(self.text) if end < 0 else end
                    parts.append(Node("ERROR", before, max(end, before + 1)))
                    self.at = max(end, before + 1)
                self.skip_blank()
            if self.at < len(self.text) and self.mark() == "...":
                parts.append(Node("...", self.at, self.at + 3, None, False))
                self.at += 3
            end = parts[-1].end if parts else self.at
            documents.append(Node("document", start, end, parts))
            if self.at == start:
                self.at += 1
        return Node("stream", 0, len(self.text), documents)

    def node(self, parent: int) -> Node | None:
        """A block node deeper than `parent`, or None."""
        self.skip_blank()
        if self.at >= len(self.text) or self.mark() or self.column(self.at) <= parent:
            return None
        start, properties = self.at, []
        while (m := _PROPERTY.match(self.text, self.at)) and not _KEY.match(self.text, self.at):
            properties.append(Node("anchor" if m[1][0] == "&" else "tag", m.start(1), m.end(1)))
            self.at = m.end()
            line = self.text.find("\n", start)
            self.skip_blank() if line >= 0 and self.text[self.at : self.at + 1] in ("\n", "\r", "") else None
            if self.at >= len(self.text) or self.column(self.at) <= parent:
                return Node("flow_node", start, properties[-1].end, properties)
        c = self.text[self.at]
        if c == "-" and self.text[self.at + 1 : self.at + 2] in ("", " ", "\n", "\t", "\r"):
            inner = self.sequence()
        elif c in "|>":
            inner = self.scalar_block(parent)
        elif self.key_ahead():
            inner = self.mapping()
        else:
            flow = self.flow(parent)
            if properties:
                flow.kids[:0] = properties
                flow.start = start
            return flow
        return Node("block_node", start, inner.end, [*properties, inner])

    def key_ahead(self) -> bool:
        if self.text[self.at] == "?" and self.text[self.at + 1 : self.at + 2] in (" ", "\n", ""):
            return True
        if self.text[self.at] in "{[":
            return False
        m = re.compile(r"[&*!][^\s]+[ \t]*").match(self.text, self.at)
        return bool(_KEY.match(self.text, m.end() if m and self.text[self.at] != "*" else self.at)) or bool(re.compile(r"\*\S+[ \t]*:(?:\s|\Z)").match(self.text, self.at))

    def mapping(self) -> Node:
        column, pairs = self.column(self.at), []
        while self.at < len(self.text) and self.column(self.at) == column and not self.mark() and self.key_ahead():
            pairs.append(self.pair(column))
            self.skip_blank()
        if not pairs:
            raise Bad
        return Node("block_mapping", pairs[0].start, pairs[-1].end, pairs)

    def pair(self, column: int) -> Node:
        start, parts = self.at, []
        if self.text[self.at] == "?" and self.text[self.at + 1 : self.at + 2] in (" ", "\n", ""):
            parts.append(Node("?", self.at, self.at + 1, None, False))
            self.at += 1
            key = self.node(column)
            self.skip_blank()
        else:
            properties = []
            while (m := _PROPERTY.match(self.text, self.at)) and self.text[self.at] in "&!":
                properties.append(Node("anchor" if m[1][0] == "&" else "tag", m.start(1), m.end(1)))
                self.at = m.end()
            m = re.compile(r"\*[^\s:]+").match(self.text, self.at) if self.text[self.at] == "*" else _KEY.match(self.text, self.at)
            if not m:
                raise Bad
            key = Node("flow_node", m.start(), m.end(), [*properties, self.scalar(m.start(), m.end())])
            self.at = m.end()
            self.spaces()
        if key is not None:
            key.field = "key"
            parts.append(key)
        if self.text[self.at : self.at + 1] == ":":
            parts.append(Node(":", self.at, self.at + 1, None, False))
            self.at += 1
            self.skip_blank()
            value = None
            if self.at < len(self.text) and not self.mark():
                here = self.column(self.at)
                same_line = "\n" not in self.text[parts[-1].end : self.at]
                # a sequence may stand at its key's own column
                if here == column and not same_line and self.text[self.at] == "-" and self.text[self.at + 1 : self.at + 2] in (" ", "\n", "\r", ""):
                    inner = self.sequence()
                    value = Node("block_node", inner.start, inner.end, [inner])
                else:
                    value = self.node(column)
            if value is not None:
                value.field = "value"
                parts.append(value)
        end = parts[-1].end if parts else self.at
        return Node("block_mapping_pair", start, end, parts)

    def sequence(self) -> Node:
        column, items = self.column(self.at), []
        while self.at < len(self.text) and self.column(self.at) == column and self.text[self.at] == "-" and self.text[self.at + 1 : self.at + 2] in ("", " ", "\n", "\t", "\r") and not self.mark():
            dash = Node("-", self.at, self.at + 1, None, False)
            self.at += 1
            value = self.node(column)
            items.append(Node("block_sequence_entry", dash.start, value.end if value else dash.end, [dash, value] if value else [dash]))
            self.skip_blank()
        return Node("block_sequence", items[0].start, items[-1].end, items)

    def scalar_block(self, parent: int) -> Node:
        start = self.at
        end = self.text.find("\n", self.at)
        if end < 0:
            self.at = len(self.text)
            return Node("block_scalar", start, self.at)
        self.at = end + 1
        last = end
        while self.at < len(self.text):
            stop = self.text.find("\n", self.at)
            stop = len(self.text) if stop < 0 else stop
            line = self.text[self.at : stop]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= max(parent, -1) or (line.strip() and parent < 0 and not line.startswith(" ")):
                break
            if line.strip():
                last = stop
            self.at = stop + 1
        self.at = min(self.at, len(self.text))
        return Node("block_scalar", start, last)

    # -- flow style
    def flow(self, parent: int) -> Node:
        c = self.text[self.at]
        if c in "{[":
            inner = self.collection()
            return Node("flow_node", inner.start, inner.end, [inner])
        start = self.at
        if c in "\"'":
            m = re.compile(r"\"(?:\\.|[^\"\\])*\"?|'(?:''|[^'])*'?", re.S).match(self.text, self.at)
            self.at = m.end()
            return Node("flow_node", start, self.at, [self.scalar(start, self.at)])
        if c == "*":
            m = re.compile(r"\*[^\s,\[\]{}]+").match(self.text, self.at)
            self.at = m.end() if m else self.at + 1
            return Node("flow_node", start, self.at, [Node("alias", start, self.at)])
        # a plain scalar may go on over deeper lines
        end = start
        while True:
            stop = self.text.find("\n", self.at)
            stop = len(self.text) if stop < 0 else stop
            line = self.text[self.at : stop]
            cut = re.search(r"[ \t]#", line)
            piece = line[: cut.start()] if cut else line
            end = self.at + len(piece.rstrip())
            self.at = self.at + len(piece)
            if cut or stop >= len(self.text):
                break
            held = self.at
            self.at = stop
            self.skip_blank()
            if self.at >= len(self.text) or self.column(self.at) <= parent or self.mark() or self.key_ahead() or self.text[self.at] == "#" or (self.text[self.at] == "-" and self.text[self.at + 1 : self.at + 2] in (" ", "\n")):
                self.at = held
                break
        if end <= start:
            raise Bad
        return Node("flow_node", start, end, [self.scalar(start, end)])

    def scalar(self, start: int, end: int) -> Node:
        text = self.text[start:end]
        if text[:1] == '"':
            return Node("double_quote_scalar", start, end)
        if text[:1] == "'":
            return Node("single_quote_scalar", start, end)
        if text[:1] == "*":
            return Node("alias", start, end)
        kind = next((k for p, k in _SCALARS if p.match(text)), "string_scalar")
        return Node("plain_scalar", start, end, [Node(kind, start, end)])

    def collection(self) -> Node:
        opening = self.text[self.at]
        closing = {"{": "}", "[": "]"}[opening]
        start = self.at
        kids = [Node(opening, start, start + 1, None, False)]
        self.at += 1
        while True:
            self.skip_blank()
            if self.at >= len(self.text):
                break
            c = self.text[self.at]
            if c == closing:
                kids.append(Node(c, self.at, self.at + 1, None, False))
                self.at += 1
                break
            if c == ",":
                kids.append(Node(c, self.at, self.at + 1, None, False))
                self.at += 1
                continue
            before = self.at
            kids.append(self.flow_item(opening == "{"))
            if self.at == before:
                raise Bad
        return Node("flow_mapping" if opening == "{" else "flow_sequence", start, self.at, kids)

    def flow_item(self, pairs: bool) -> Node:
        start = self.at
        key = self.flow_value()
        self.skip_blank()
        if self.text[self.at : self.at + 1] == ":":
            colon = Node(":", self.at, self.at + 1, None, False)
            self.at += 1
            self.skip_blank()
            key.field = "key"
            kids = [key, colon]
            if self.text[self.at : self.at + 1] not in (",", "}", "]", ""):
                value = self.flow_value()
                value.field = "value"
                kids.append(value)
            return Node("flow_pair", start, kids[-1].end, kids)
        if pairs:
            key.field = "key"
            return Node("flow_pair", start, key.end, [key])
        return key

    def flow_value(self) -> Node:
        c = self.text[self.at]
        start = self.at
        if c in "{[":
            inner = self.collection()
            return Node("flow_node", start, inner.end, [inner])
        if c in "\"'":
            m = re.compile(r"\"(?:\\.|[^\"\\])*\"?|'(?:''|[^'])*'?", re.S).match(self.text, self.at)
        else:
            m = re.compile(r"(?:[^,\[\]{}:\n#]|:(?![\s,\[\]{}])|(?<!\s)#)+").match(self.text, self.at)
        if not m:
            raise Bad
        end = start + len(m[0].rstrip())
        self.at = m.end()
        return Node("flow_node", start, end, [self.scalar(start, end)])
