"""Tree patterns in S-expression syntax: parsing, checking and matching.

Supported: named nodes `(kind ...)`, wildcards `_` and `(_)`, tokens `"text"`, fields `name: ...`,
negated fields `!name`, alternatives `[...]`, groups `(...)`, captures `@name`, quantifiers ? * +,
anchors `.`, and the predicates #eq? #not-eq? #match? #not-match? #any-of? #not-any-of?. Anything
else is an invalid query.

A node gives one match for each way to bind its captured parts; parts without captures only
constrain. Captures come in source order, outer nodes first.
"""

from __future__ import annotations

import ast
import functools
import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..parsers.core import Tree
from ..parsers.kinds import FIELDS, NODES

_TOKEN = re.compile(r"\s+|;[^\n]*|(?P<str>\"(?:\\.|[^\"\\])*\")|(?P<cap>@[\w.-]+)|(?P<pred>#[\w-]+[?!])|(?P<field>[\w-]+\s*:)|(?P<not>![\w-]+)|(?P<name>[\w-]+)|(?P<op>[()\[\]?*+.])", re.A)

Binding = tuple[tuple[str, int], ...]


class InvalidQuery(ValueError):
    def __init__(self, message: str):
        super().__init__(f"invalid query: {message}")


@dataclass
class Pattern:
    """One pattern; kind None stands for any node, alternatives for a choice, group for a run of siblings."""

    kind: str | None = None
    named: bool = True
    alternatives: list[Pattern] = field(default_factory=list)
    group: list[Pattern] = field(default_factory=list)
    children: list[Pattern] = field(default_factory=list)
    absent: list[str] = field(default_factory=list)
    captures: list[str] = field(default_factory=list)
    role: str | None = None  # the field it must fill
    many: str = ""
    anchored: bool = False  # no named sibling between it and what stands before
    last: bool = False  # among children: nothing named may follow the last of them
    only: frozenset[str] | None = None  # the kinds that its node can have; None: any

    def captures_any(self) -> bool:
        return bool(self.captures) or any(p.captures_any() for p in (*self.alternatives, *self.group, *self.children))


@dataclass
class Query:
    patterns: list[Pattern]
    predicates: list[list[tuple[str, list[str]]]]  # of each pattern

    def captured(self) -> bool:
        return any(p.captures_any() for p in self.patterns)


def parse_query(text: str, kinds=None) -> Query:
    """The query of a text; kinds(name, "node" or "field") tells whether a language has it."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidQuery(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    place = 0

    def peek() -> tuple[str, str]:
        return tokens[place] if place < len(tokens) else ("end", "")

    def step() -> tuple[str, str]:
        nonlocal place
        t = peek()
        place += 1
        return t

    def suffix(p: Pattern) -> Pattern:
        while True:
            kind, value = peek()
            if kind == "op" and value in "?*+" and not p.many:
                p.many = step()[1]
            elif kind == "cap":
                p.captures.append(step()[1][1:])
            else:
                return p

    def known(name: str, what: str) -> str:
        if kinds is not None and name not in ("ERROR", "MISSING") and not kinds(name, what):
            raise InvalidQuery(f"impossible {what} {name!r}")
        return name

    def one() -> Pattern:
        kind, value = step()
        if kind == "field":
            p = one()
            p.role = known(value[:-1].strip(), "field")
            return p
        if kind == "str":
            return suffix(Pattern(kind=ast.literal_eval(value), named=False))
        if kind == "name" and value == "_":
            return suffix(Pattern(kind=None, named=False))
        if (kind, value) == ("op", "["):
            p = Pattern()
            while peek() != ("op", "]"):
                if peek()[0] == "end":
                    raise InvalidQuery("unclosed [")
                p.alternatives.append(one())
            step()
            if not p.alternatives:
                raise InvalidQuery("empty [")
            return suffix(p)
        if (kind, value) != ("op", "("):
            raise InvalidQuery(f"unexpected {value or 'end'!r}")
        if peek()[0] == "name":
            name = step()[1]
            p = Pattern(kind=None if name == "_" else known(name, "node"))
            if name == "MISSING" and peek()[0] in ("name", "str"):
                step()
            members(p.children, p)
        elif peek() in (("op", "("), ("op", "[")) or peek()[0] in ("str", "field"):
            p = Pattern()
            members(p.group, p)
        else:
            raise InvalidQuery(f"unexpected {peek()[1] or 'end'!r}")
        return suffix(p)

    predicates: list[tuple[str, list[str]]] = []

    def members(into: list[Pattern], owner: Pattern) -> None:
        anchored = False
        while True:
            kind, value = peek()
            if kind == "end":
                raise InvalidQuery("unclosed (")
            if (kind, value) == ("op", ")"):
                step()
                owner.last = anchored
                return
            if (kind, value) == ("op", "."):
                step()
                anchored = True
            elif kind == "not":
                owner.absent.append(known(step()[1][1:], "field"))
            elif (kind, value) == ("op", "(") and place + 1 < len(tokens) and tokens[place + 1][0] == "pred":
                predicate()
            else:
                p = one()
                p.anchored, anchored = anchored, False
                into.append(p)

    def predicate() -> None:
        step()
        name, arguments = step()[1], []
        if name not in ("#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?", "#not-any-of?"):
            raise InvalidQuery(f"unknown predicate {name}")
        while peek() != ("op", ")"):
            kind, value = step()
            if kind not in ("cap", "str", "name"):
                raise InvalidQuery(f"bad argument of {name}")
            arguments.append(value if kind == "cap" else "=" + (ast.literal_eval(value) if kind == "str" else value))
        step()
        if len(arguments) < 2 or not arguments[0].startswith("@"):
            raise InvalidQuery(f"bad arguments of {name}")
        if "match" in name:
            try:
                re.compile(arguments[1][1:])
            except re.error as e:
                raise InvalidQuery(str(e)) from None
        predicates.append((name, arguments))

    out = Query([], [])
    while peek()[0] != "end":
        if peek() == ("op", "(") and place + 1 < len(tokens) and tokens[place + 1][0] == "pred":
            if not out.patterns:
                raise InvalidQuery("a predicate without a pattern")
            predicate()
            out.predicates[-1] += predicates
            predicates = []
            continue
        out.patterns.append(one())
        out.predicates.append(predicates)
        predicates = []
    if not out.patterns:
        raise InvalidQuery("empty")
    return out


@functools.lru_cache(maxsize=None)
def vocabulary(parser: str) -> dict[str, frozenset[str]] | None:
    """The kinds of named nodes and the fields that a parser makes: its own `nodes` and `fields`, or those declared for its language.

    A parser that declares neither takes any name: None.
    """
    module, _, name = parser.partition(":")
    for cls in getattr(importlib.import_module(module), name).__mro__:
        if "nodes" in vars(cls):
            return {"node": frozenset(cls.nodes), "field": frozenset(getattr(cls, "fields", ()))}
        if cls.__module__.startswith("srcgraph.parsers.") and cls.__name__.lower() in NODES:
            return {"node": NODES[cls.__name__.lower()], "field": FIELDS[cls.__name__.lower()]}
    return None


def has_name(parser: str) -> Callable[[str, str], bool]:
    """(name, "node" or "field") -> does the parser make it?"""
    known = vocabulary(parser)
    return lambda name, what: known is None or name in known[what]


class Matcher:
    """Runs a query over trees."""

    def __init__(self, query: Query):
        self.query = query
        for p in query.patterns:
            self.narrow(p)
        # which pattern can begin at a kind of node; None: at any
        self.starts: dict[str | None, list[int]] = {}
        for n, p in enumerate(query.patterns):
            for kind in self.roots(p):
                self.starts.setdefault(kind, []).append(n)

    def narrow(self, p: Pattern) -> None:
        kinds = self.roots(p)
        p.only = None if None in kinds else frozenset(kinds)
        for q in (*p.alternatives, *p.group, *p.children):
            self.narrow(q)

    def roots(self, p: Pattern) -> set[str | None]:
        if p.alternatives:
            return set().union(*(self.roots(a) for a in p.alternatives))
        if p.group:
            return {None}
        return {None if p.kind == "MISSING" else p.kind}

    def matches(self, tree: Tree) -> list[Binding]:
        """All matches in the order of their first node."""
        out: list[Binding] = []
        if None in self.starts:
            anywhere = self.starts[None]
            todo = [(i, n) for i, node in enumerate(tree.nodes) for n in (*self.starts.get(node.kind, ()), *anywhere)]
        elif len(self.starts) == 1:  # one kind: its nodes are in order already
            ((kind, ns),) = self.starts.items()
            todo = [(i, n) for i in tree.by_kind.get(kind, ()) for n in ns]
        else:
            todo = sorted((i, n) for kind, ns in self.starts.items() for i in tree.by_kind.get(kind, ()) for n in ns)
        for i, n in todo:
            p = self.query.patterns[n]
            found = self.run_of(p, tree, i) if p.group else self.at(p, tree, i)
            for b in dict.fromkeys(found):
                if self.holds(self.query.predicates[n], tree, b):
                    out.append(b)
        return out

    def run_of(self, p: Pattern, tree: Tree, i: int) -> list[Binding]:
        """A top-level group: its first member at node i, the others among the later siblings."""
        parent = tree.parent[i]
        if parent < 0:
            return []
        kids = tree.kids[parent]
        return self.among(p.group, 0, tree, kids, kids.index(i), exact=True)

    def at(self, p: Pattern, tree: Tree, i: int) -> list[Binding]:
        own = tuple((c, i) for c in p.captures)
        if p.alternatives:
            return [own + b for a in p.alternatives for b in (self.at(a, tree, i) if not a.role or tree.nodes[i].field == a.role else [])]
        node = tree.nodes[i]
        if p.kind is None:
            if p.named and not node.named:
                return []
        elif p.kind == "MISSING":
            if not node.missing:
                return []
        elif node.kind != p.kind or node.named != p.named:
            return []
        kids = tree.kids[i]
        if p.absent and any(tree.nodes[k].field in p.absent for k in kids):
            return []
        if not p.children:
            return [own]
        if len(p.children) == 1 and not (p.last or p.children[0].many or p.children[0].group or p.children[0].anchored):
            return self.with_child(own, p.children[0], tree, kids)
        return [own + b for b in self.among(p.children, 0, tree, kids, 0, last=p.last)]

    def with_child(self, own: Binding, p: Pattern, tree: Tree, kids: list[int]) -> list[Binding]:
        """What among() gives for one plain child."""
        out: list[Binding] = []
        nodes, role, only = tree.nodes, p.role, p.only
        for k in kids:
            node = nodes[k]
            if (role is None or node.field == role) and (only is None or node.kind in only):
                found = self.at(p, tree, k)
                if found and not p.captures_any():
                    return [own]
                out += [own + b for b in found]
        return out if len(out) < 2 else list(dict.fromkeys(out))

    def among(self, ps: list[Pattern], n: int, tree: Tree, kids: list[int], start: int, exact: bool = False, last: bool = False) -> list[Binding]:
        """Matches of ps[n:] with siblings kids[start:], in order."""
        if n == len(ps):
            return [()] if not last or not any(tree.nodes[k].named for k in kids[start:]) else []
        p = ps[n]
        bare = not p.captures_any()
        out: list[Binding] = []
        if p.many in ("*", "+"):
            for j in range(start, len(kids)):
                run: Binding = ()
                e, anything = j, False
                while e < len(kids):
                    found = self.single(p, tree, kids[e])
                    if not found:
                        if tree.nodes[kids[e]].named or not anything:
                            break
                        e += 1
                        continue
                    run, anything, e = run + found[0], True, e + 1
                if anything:
                    return [run + b for b in self.among(ps, n + 1, tree, kids, e, last=last)]
                if exact or (p.anchored and tree.nodes[kids[j]].named):
                    break
            return self.among(ps, n + 1, tree, kids, start, last=last) if p.many == "*" else []
        for j in range(start, len(kids)):
            if p.group:
                found = self.among(p.group, 0, tree, kids, j, exact=True)
                width = len(p.group)
            else:
                found, width = self.single(p, tree, kids[j]), 1
            if found:
                rest = self.among(ps, n + 1, tree, kids, j + width, last=last)
                out += [b + r for b in (found[:1] if bare else found) for r in rest]
                if bare and out and not any(q.captures_any() for q in ps[n + 1 :]):
                    break
            if exact or (p.anchored and tree.nodes[kids[j]].named):
                break
        if not out and p.many == "?":
            return self.among(ps, n + 1, tree, kids, start, last=last)
        return list(dict.fromkeys(out))

    def single(self, p: Pattern, tree: Tree, i: int) -> list[Binding]:
        node = tree.nodes[i]
        if p.role and node.field != p.role or p.only is not None and node.kind not in p.only:
            return []
        return self.at(p, tree, i)

    def holds(self, predicates: list[tuple[str, list[str]]], tree: Tree, b: Binding) -> bool:
        for name, arguments in predicates:
            texts = [tree.text(i) for c, i in b if c == arguments[0][1:]]
            if arguments[1].startswith("@"):
                values = [tree.text(i) for c, i in b if c == arguments[1][1:]]
            else:
                values = [a[1:] for a in arguments[1:]]
            for t in texts:
                hit = bool(re.search(values[0], t)) if "match" in name and values else t in values[: None if "any" in name else 1]
                if hit == name.startswith("#not-"):
                    return False
        return True


@functools.lru_cache(maxsize=256)
def compiled(text: str, parser: str | None = None) -> Matcher:
    """A matcher, made once a worker; with a parser, names are checked against its vocabulary."""
    return Matcher(parse_query(text, has_name(parser) if parser else None))
